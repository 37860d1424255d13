"""Conversation repair, spelling variants and WARC bundles against plain versions."""

import hashlib
import io
import itertools
import random
import re
import zlib
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from ontoweave.llm import spelling, turn_repair, warc

CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, cost int, rows string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_repair(rows):
    """The same report by a forward table over turns, with the damage applied row by row."""
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        if damage:
            convs[conv] += [(turn, "user" if damage == 4 else role, text)] * (1 + (damage == 3))
    return {conv: plain_report(turns) for conv, turns in convs.items()}


def plain_report(turns):
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))

    def put(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best.items()):
                put(best, NEXT[state], (cost + 2, edits + "I", (lines, f"{NAMES[NEXT[state]]}:")))
        return best

    best = inserted({0: (0, "", None)})
    for (_, role, text), fault in zip(turns, faults):
        ahead = {}
        for state, (cost, edits, lines) in best.items():
            put(ahead, state, (cost + 3, edits + "D", lines))
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                if (state, role[:1]) in FITS:
                    put(ahead, FITS[state, role[:1]], (cost + more, edits + "K", (lines, f"{role}:{text}")))
                put(ahead, NEXT[state], (cost + 2 + more, edits + "R", (lines, f"{NAMES[NEXT[state]]}:{text}")))
        best = inserted(ahead)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])
    repaired = []
    while lines:
        lines, line = lines
        repaired.append(line)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired[::-1]).encode()).hexdigest())


def reports(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in frame.collect()}


def random_turns(rnd, conv, n):
    texts = ["Yes.", "No", " ", "", "So it is!", "why?", "x.\n"]
    return [(conv, rnd.choice([t, t, None, t // 2]), rnd.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]), rnd.choice(texts + [f"t{t}.", f"u{t}", None])) for t in range(n)]


def test_search_equals_every_edit_sequence():
    rnd = random.Random(5)
    for _ in range(300):
        turns = [(t, rnd.choice("suat"), rnd.choice(["a.", "b", "c.", ""])) for t in range(rnd.randint(0, 7))]
        items, seen = [], set()
        for _, role, text in turns:
            gone = not text or (role, text) in seen
            items.append((role, 0 if gone else int(text[-1] != "."), int(gone)))
            seen.add((role, text))
        cost, audit = turn_repair.repair(items)
        assert (cost, audit) == plain_report(turns)[5:7]


def test_repair_of_odd_rows(spark):
    rnd = random.Random(1)
    rows = [r for conv in [*range(60), None] for r in random_turns(rnd, conv, rnd.randint(1, 12))]
    rows += rows[:40] + [(900, 0, "user", "word " * 200_000), (901, None, None, None), (902, -(1 << 62), "user", "a."), (902, 1 << 62, "assistant", "b.")]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS)
    report, turns = turn_repair.repair_conversations(frame)
    assert reports(report) == plain_repair(rows)
    assert turns.columns == ["conv_id", "turn", "role", "digest", "before", "kept", "after"]
    assert turn_repair.repair_conversations(frame.limit(0))[0].count() == 0
    named = frame.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).filter("conv_id is not null")
    assert turn_repair.repair_conversations(named)[0].count() == len({r[0] for r in rows if r[0] is not None})


def test_repair_of_a_conversation_of_many_pieces(spark):
    """One conversation holds most rows: its pieces lie in several tasks and are joined in two rounds."""
    rnd = random.Random(2)
    rows = [(7, t, rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ["user", "assistant"][t % 2], rnd.choice(["Yes.", f"{t}.", f"{t}", f"{t}!"])) for t in range(2500)]
    rows += [r for conv in range(20, 40) for r in random_turns(rnd, conv, 9)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(5)
    report, _ = turn_repair.repair_conversations(frame, piece=32)
    assert reports(report) == plain_repair(rows)


def variants(words):
    """(form, root, n, n_near, form_n) of each word, by comparing all pairs."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    forms, out = {}, {}
    for w, n in words.items():
        found = sorted((-words[v], v) for v in words if near(w, v))
        forms[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
        out[w] = (n, len(found), words.get(forms[w]))
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w])
    return out


def test_near_words_equal_all_pairs(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abñ") for _ in range(rnd.randint(5, 8))): rnd.choice([3, 4, 8, 20, 20, 41]) for _ in range(700)}
    words |= {"a" * n: 3 * n for n in (5, 6, 7, 9, 3000, 3001)} | {"tree" + c + "house": 5 for c in "abcdef"} | {"treehouse": 10, "treehous": 5, "treehousé": 5}
    frame = spark.createDataFrame([*words.items()], "word string, n long")
    want = variants(words)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(frame).collect()} == want
    split = spelling.near_words(frame, largest=8)  # nearly every state is halved down to single letters
    assert {r["word"]: r["n_near"] for r in split.collect()} == {w: v[3] for w, v in want.items() if v[3]}
    assert spelling.group_variants(frame.limit(0)).count() == 0


def test_acceptor_is_minimal_and_counts_its_strings():
    words = sorted("".join(w) for n in (2, 3) for w in itertools.product("ab", repeat=n))
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) == 4  # states differ by what may follow alone
    for k, word in enumerate(words):
        state = rank = 0
        for letter in word:
            state, before = acceptor.arcs[state][letter]
            rank += before
        assert acceptor.final[state] and rank == k


def test_vocabulary_of_odd_texts(spark):
    texts = {0: None, 1: "", 2: "Tree trees " * 50, 3: "×÷ À la carte Ärger ärger" * 9, 4: "x" * 70_001 + " " + "x" * 70_001, 5: "ÉcoleÉcole école's 123 naïve_naïve", None: "Nullid nullid nullid Nullid", 6: "x" * 70_001}
    rows = [(i, t) for i, t in texts.items()] + [(2, texts[2])] + [(100 + k, f"house{chr(97 + k % 26)} common word") for k in range(400)]
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()} == want
    assert spelling.vocabulary(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, digest string, first int, n string"


def test_bundles_of_odd_pages(spark):
    long = "<p>" + "é" * 400_000
    rows = [
        (5, "http://a/\r\nX: 1", "b" * 100), (3, None, "b" * 100), (9, "http://c", "b" * 100), (None, "http://n", "b" * 100), (1, "http://d", "c" * 99), (2, "http://d", "c" * 99),
        (4, "http://e", None), (6, "http://e", ""), (7, "http://l", long), (8, "http://l", long), (8, "http://l", long), (-3, "http://m", "é" * 50), (None, "u", "WARC/1.1\r\n\r\n" * 20), (7, "http://l", long),
    ]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)
    bundles = warc.write_bundles(frame)
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    want = Counter()
    for i, data in payloads:
        ids = [j for j, d in payloads if d == data and j is not None]
        first = min(ids, default=None)
        again = len(data) >= 100 and i != first
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(tuple(r) for r in warc.read_bundles(bundles).collect()) == want
    assert warc.read_bundles(warc.write_bundles(frame.limit(0))).count() == 0

    index = warc.record_index(bundles)
    assert index.count() == len(rows)
    digest = hashlib.sha256(long.encode()).hexdigest()
    asked = spark.createDataFrame([(warc.record_id(7, digest),), (warc.record_id(8, digest),), ("<urn:uuid:none>",)], "record_id string")
    got = {r["record_id"]: r for r in warc.fetch_records(bundles, asked).collect()}
    assert bytes(got[warc.record_id(7, digest)]["payload"]).decode() == long and got[warc.record_id(8, digest)]["record_type"] == "revisit" and len(got) == 2


def test_a_bundle_is_a_zstandard_file_with_frames_of_its_own(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>page {k} " + "text " * 3000) for k in range(60)]
    bundles = warc.write_bundles(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES).coalesce(1))
    warc.export_bundles(bundles, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").iterdir()
    content = file.read_bytes()
    frames = warc.frames_of(content)
    assert len(frames) > 2 and all(warc.read_frame(content, f).startswith(b"WARC/1.1\r\n") for f in frames)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert whole == b"".join(warc.read_frame(content, f) for f in frames)
    at, n = 0, 0
    while at < len(whole):
        head, _, body, at = warc.read_record(whole, at)
        assert body.decode() == rows[warc.page_of(head["warc-record-id"])][2]
        n += 1
    assert n == 60
    assert [warc.page_of(warc.record_id(i, "ab" * 32)) for i in (0, 1, -1, None, (1 << 63) - 1, -(1 << 63))] == [0, 1, -1, None, (1 << 63) - 1, -(1 << 63)]
