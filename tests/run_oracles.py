"""Run registered queries against their SQL: python tests/run_oracles.py [sf dir] [name prefix ...]."""

import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
from tests.oracle import compare, connect  # noqa: E402

from ontoweave.catalog import ORACLES, QUERIES  # noqa: E402
from ontoweave.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark, con, bad = local_session(8), connect(sf), 0
for name, fn in QUERIES.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    try:
        df = fn(spark, sf)
        ok, note = compare(df, con, ORACLES[name]) if name in ORACLES else (True, f"{len(df.collect())} rows (no sql)")
        types = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
        if name in ORACLES:
            res = con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
            note += " | " + ",".join(f"{n}:{t}" for n, t in types if n and t) if not ok else ""
            duck = {r[0]: r[1] for r in res}
            pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            wrong = [(n, t, duck.get(n)) for n, t in types if pairs.get(t, duck.get(n)) != duck.get(n)]
            if wrong:
                note += f" TYPES {wrong}"
    except Exception as e:  # noqa: BLE001
        ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
    bad += not ok
    print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s {note}", flush=True)
print("failures:", bad)
