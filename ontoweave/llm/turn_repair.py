"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

Turns of a conversation are cut into pieces that no executor has to hold together: rows are
dealt by ranges of (conversation, turn) and packed as they stream past. A search runs depth
first through the edits in ASCII order under a bound on the cost that grows until a path
accepts; a transposition table keeps, for each (row, role state), the cost under which it is
known to fail, over all bounds and starts. A conversation within one piece is searched as a
whole. For the few that reach over several, each piece is searched from every role state to
every other, and the tables of neighbouring pieces are joined in groups until one is left.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoweave.llm.base import query, sql_crc32, stored, table

# Fixed values of the repair: edits and their costs, role states and what each accepts.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED = 1  # an undeleted truncated row
BLANKS = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # the next user or assistant turn
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
FITS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ENDS = (START, AFTER_A)
STATE_OF = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
PAIR = min(COSTS[DELETE] - TRUNCATED, COSTS[INSERT], COSTS[REROLE])  # what neighbours that do not fit cost beyond their truncation
LEGAL = {"su", "ua", "au"}

PIECE = 256  # groups of equal rows in a piece
JOINED = 16  # pieces joined at once
SHORT = 16  # items up to which a worker remembers repairs

Item = tuple[str, int, int]  # (role's initial, 1 if truncated, rows that must go: a run of them is one item)


def items_of(initial: str, kind: str, rows: int, repeats: int) -> list[Item]:
    """The search's view of ``rows`` equal rows of which the last ``repeats`` are duplicates."""
    if kind == "blank":
        return [(initial, 0, rows)]
    first = [(initial, int(kind == "truncated"), 0)] if rows > repeats else []
    return [*first, *([(initial, 0, repeats)] if repeats else [])]


class Search:
    """Cheapest edits of one list of items to one set of end states."""

    def __init__(self, items: list[Item], ends: tuple[int, ...]):
        self.items, self.ends = items, ends
        self.least = [0] * (len(items) + 1)  # what the rest costs at least, whatever its roles
        self.place = [0] * (len(items) + 1)  # how many rows before may stay
        for k, (_, _, gone) in enumerate(items):
            self.place[k + 1] = self.place[k] + (not gone)
        for k in range(len(items) - 1, -1, -1):
            _, truncated, gone = items[k]
            self.least[k] = self.least[k + 1] + (COSTS[DELETE] * gone or truncated)
        # Neighbours whose roles do not fit need an edit of 2 or more between them or on one of them, so as many such
        # pairs as have no row in common count in full; the end is the last row's neighbour.
        self.staying = [initial for initial, _, gone in items if not gone]
        m = len(self.staying)
        self.pairs = [0] * (m + 2)
        for j in range(m - 1, -1, -1):
            if j == m - 1:
                fits = STATE_OF.get(self.staying[j]) in ends
            else:
                fits = self.staying[j] + self.staying[j + 1] in LEGAL
            self.pairs[j] = self.pairs[j + 1] if fits else max(self.pairs[j + 1], 1 + self.pairs[j + 2])
        self.fails: dict[tuple[int, int], int] = {}  # cost under which no path from here accepts

    def moves(self, k: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edits, cost, next item, next state) in ASCII order of the edits."""
        out = []
        turn = TURN[state]
        if k == len(self.items):
            return [(INSERT, COSTS[INSERT], k, turn)]
        initial, truncated, gone = self.items[k]
        out.append((DELETE * (gone or 1), COSTS[DELETE] * (gone or 1), k + 1, state))
        out.append((INSERT, COSTS[INSERT], k, turn))
        if not gone:
            if (state, initial) in FITS:
                out.append((KEEP, COSTS[KEEP] + truncated, k + 1, FITS[state, initial]))
            out.append((REROLE, COSTS[REROLE] + truncated, k + 1, turn))
        return out

    def bound(self, k: int, state: int) -> int:
        j = self.place[k]
        fits = (state, self.staying[j]) in FITS if j < len(self.staying) else state in self.ends
        pairs = self.pairs[j] if fits else max(self.pairs[j], 1 + self.pairs[j + 1])
        return max(self.least[k] + PAIR * pairs, self.fails.get((k, state), 0))

    def from_state(self, start: int) -> tuple[int, str]:
        """(cost, edits) from the first item; the bound grows by what the last depth found it lacks."""
        bound = self.bound(0, start)
        while (edits := self._within(bound, start)) is None:
            bound = self.bound(0, start)
        return bound, edits

    def _within(self, bound: int, start: int) -> str | None:
        """The first accepting path of at most ``bound``, depth first; else what each state visited lacks is noted."""
        n = len(self.items)
        if n == 0 and start in self.ends:
            return ""
        # a frame: (item, state, cost so far, moves left, least cost found from here, edits that led here)
        frames = [[0, start, 0, iter(self.moves(0, start)), None, ""]]
        while frames:
            top = frames[-1]
            k, state, cost = top[:3]
            move = next(top[3], None)
            if move is None:
                frames.pop()
                self.fails[k, state] = max(self.fails.get((k, state), 0), top[4])
                if frames:
                    above = frames[-1]
                    lack = top[2] - above[2] + self.fails[k, state]
                    above[4] = lack if above[4] is None else min(above[4], lack)
                continue
            edits, price, k, state = move
            cost += price
            if k == n and state in self.ends and cost <= bound:
                return "".join([*(f[5] for f in frames), edits])
            lack = price + self.bound(k, state)
            if cost - price + lack > bound:
                top[4] = lack if top[4] is None else min(top[4], lack)
                continue
            frames.append([k, state, cost, iter(self.moves(k, state)), None, edits])
        return None


def repair(items: list[Item]) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return _short_repair(tuple(items)) if len(items) <= SHORT else Search(items, ENDS).from_state(START)


@lru_cache(maxsize=1 << 15)
def _short_repair(items: tuple[Item, ...]) -> tuple[int, str]:
    return Search(list(items), ENDS).from_state(START)


def _deleted(items: list[Item]) -> tuple[int, str]:
    edits = "".join(DELETE * (gone or 1) for _, _, gone in items)
    return COSTS[DELETE] * len(edits), edits


def edit_table(items: list[Item]) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, edits) between all role states that the piece can lead from and to.

    Only deleted rows lead from the start or from a system turn to itself, and one system turn that stays from one to the other.
    """
    out = [(state, state, *_deleted(items)) for state in (START, AFTER_S)]
    system = [(truncated, -k) for k, (initial, truncated, gone) in enumerate(items) if initial == "s" and not gone]
    if system:
        truncated, k = min(system)
        before, after = _deleted(items[:-k]), _deleted(items[1 - k :])
        out.append((START, AFTER_S, before[0] + COSTS[KEEP] + truncated + after[0], before[1] + KEEP + after[1]))
    for end in (AFTER_U, AFTER_A):
        search = Search(items, (end,))
        out += [(start, end, *search.from_state(start)) for start in range(4)]
    return out


def damaged_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage that the checksum of conversation and turn selects."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    damage = F.crc32(key) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter(damage != 0).select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(damage == 3, 2).otherwise(1).alias("copies")
    )


def _digest():
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def equal_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, rows, repeats, kind): equal rows of a turn as one, with how many of them repeat an earlier row."""
    bare = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(bare == "", "blank").when(~F.substr(bare, F.char_length(bare), F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("whole")
    slim = rows.select("conv_id", "turn", "role", _digest().alias("digest"), kind.alias("kind"), "copies")
    groups = slim.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("rows"), F.first("kind").alias("kind"))
    groups = stored(groups, "equal_rows")
    # the first turn of each role and text: one row a text, so a text that fills a conversation is folded before it moves
    first = groups.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.has_turn").alias("h"), F.col("first.turn").alias("t"))
    match = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    is_first = F.col("h").isNull() | ((F.col("h") == F.col("turn").isNotNull()) & F.col("turn").eqNullSafe(F.col("t")))
    repeats = F.when(F.col("kind") == "blank", F.lit(0)).otherwise(F.col("rows") - F.when(is_first, 1).otherwise(0))
    return groups.join(first, match, "left").select("conv_id", "turn", "role", "digest", "rows", repeats.cast("long").alias("repeats"), "kind")


PACKED = (
    "conv_id {0}, whole boolean, seq long, turns array<bigint>, roles array<string>, digests array<binary>, rows array<bigint>, repeats array<bigint>,"
    " kinds array<string>, state string, table string"
)


def _summary(group: list[tuple]) -> dict:
    """Counts of a piece, and what its neighbours need to count across their border."""
    turns = [g[0] for g in group if g[0] is not None]
    initials = [g[1][:1] for g in group]
    same = sum(g[3] - 1 for g in group if g[1][:1] * 2 not in LEGAL)
    return {
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        "blank": sum(g[3] for g in group if g[5] == "blank"), "duplicate": sum(g[4] for g in group),
        "truncated": sum(g[5] == "truncated" and g[3] > g[4] for g in group),
        "illegal": same + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
    }


def join_summaries(a: dict, b: dict) -> dict:
    turns = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    return {
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"], "turns": turns,
        **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")},
        "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL), "first": a["first"], "last": b["last"],
    }


def join_tables(a: list, b: list) -> list:
    """Edits through both pieces: per start and end the cheapest, of equal cost the first in ASCII order.

    Edits of a piece are a list, one entry for each piece joined: (role state it starts in, edits).
    """
    best: dict[tuple[int, int], tuple[int, str, list]] = {}
    for start, mid, cost, edits in a:
        for mid2, end, cost2, edits2 in b:
            if mid == mid2 and ((start, end) not in best or cost + cost2 <= best[start, end][0]):
                parts = edits + edits2
                new = (cost + cost2, "".join(e for _, e in parts), parts)
                if (start, end) not in best or new[:2] < best[start, end][:2]:
                    best[start, end] = new
    return [[start, end, cost, parts] for (start, end), (cost, _, parts) in sorted(best.items())]


def _pack(kind: pa.DataType, size: int):
    """Pieces of a task's sorted rows; only a conversation that touches a border of the task, or is long, is not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(conv, group, whole, seq):
            items = [i for g in group for i in items_of(g[1][:1], g[5], g[3], g[4])]
            if whole:
                cost, edits = repair(items)
                found = [[START, AFTER_A, cost, [[START, edits]]]]
            else:
                found = [[s, e, c, [[s, edits]]] for s, e, c, edits in edit_table(items)]
            return conv, whole, seq, *map(list, zip(*group)), json.dumps(_summary(group)), json.dumps(found)

        def emit(rows):
            columns = list(zip(*rows))
            numbers, words = pa.list_(pa.int64()), pa.list_(pa.string())
            kinds = [kind, pa.bool_(), pa.int64(), numbers, words, pa.list_(pa.binary()), numbers, numbers, words, pa.string(), pa.string()]
            names = ["conv_id", "whole", "seq", "turns", "roles", "digests", "rows", "repeats", "kinds", "state", "table"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        out, group, conv, seq, first = [], [], None, 0, True
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and own != conv:
                    out.append(piece(conv, group, not first and seq == 0, seq))
                    group, seq, first = [], 0, False
                elif len(group) == size:
                    out.append(piece(conv, group, False, seq))
                    group, seq = [], seq + 1
                conv = own
                group.append(row)
                if len(out) >= 256:
                    yield emit(out)
                    out = []
        if group:  # the next task may hold more of it
            out.append(piece(conv, group, False, seq))
        if out:
            yield emit(out)

    return run


def _join(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, numbers, groups = (c.to_pylist() for c in batch.columns)
            rows = []
            for conv, number, group in zip(convs, numbers, groups):
                group = sorted(group, key=lambda g: g["number"])
                state, found = json.loads(group[0]["state"]), json.loads(group[0]["table"])
                if number == 0:
                    found = [f for f in found if f[0] == START]
                for g in group[1:]:
                    state, found = join_summaries(state, json.loads(g["state"])), join_tables(found, json.loads(g["table"]))
                rows.append((conv, number, json.dumps(state), json.dumps(found)))
            columns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.string()))], ["conv_id", "number", "state", "table"]
            )

    return run


def _choose(kind: pa.DataType):
    """The cheapest edits of each conversation, of equal cost the first in ASCII order, and its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, state, found in zip(*(c.to_pylist() for c in batch.columns)):
                state = json.loads(state)
                cost, audit, path = min(
                    (cost, "".join(e for _, e in path), path) for start, end, cost, path in json.loads(found) if start == START and end in ENDS
                )
                gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
                cells = [{"start": start, "edits": edits} for start, edits in path]
                out.append((conv, min(gaps, (1 << 63) - 1), *(state[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit, cells))
            long = pa.int64()
            cells = pa.list_(pa.struct([("start", pa.int32()), ("edits", pa.string())]))
            columns = zip(*out) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *[long] * 6, pa.string(), cells])], [*REPORT[:-1], "path"])

    return run


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _edits(kind: pa.DataType):
    """A row for each group of equal rows: turns inserted before it, the role it is kept with (null: deleted), turns inserted after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns, roles, digests, counts, repeats, kinds, state, edits in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0

                def inserted():
                    nonlocal at, state
                    found = []
                    while at < len(edits) and edits[at] == INSERT:
                        state, at = TURN[state], at + 1
                        found.append(ROLE[state])
                    return found

                for k, (turn, role, digest) in enumerate(zip(turns, roles, digests)):
                    before, kept, after = inserted(), None, []
                    for initial, _, gone in items_of(role[:1], kinds[k], counts[k], repeats[k]):
                        (before if kept is None else after).extend(inserted())
                        if edits[at] == KEEP:
                            kept, state = role, FITS[state, initial]
                        elif edits[at] == REROLE:
                            state = TURN[state]
                            kept = ROLE[state]
                        at += gone or 1
                    if k == len(turns) - 1:
                        after += inserted()
                    out.append((conv, turn, role, digest, before, kept, after))
            kinds_ = [kind, pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*out)) if out else [[]] * 7
            names = ["conv_id", "turn", "role", "digest", "before", "kept", "after"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_)], names)

    return run


def _hash(kind: pa.DataType):
    """(c, repaired_sha256): texts stream past in order, each after the row of its edits; only the running digest is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, lines, waiting = None, None, 0, None
        convs, sums = [], []

        def line(text: str) -> None:
            nonlocal lines
            sha.update(("\n" if lines else "").encode() + text.encode())
            lines += 1

        for batch in batches:
            small = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (own, before, kept, after, is_text), text in zip(small, batch.column(5)):
                if sha is None or own != conv:
                    if sha is not None:
                        convs.append(conv)
                        sums.append(sha.hexdigest())
                    conv, sha, lines, waiting = own, hashlib.sha256(), 0, None
                if is_text:
                    if waiting is not None:  # of equal texts the first is kept
                        line(f"{waiting[0]}:{text.as_py()}")
                        for role in waiting[1]:
                            line(f"{role}:")
                        waiting = None
                    continue
                for role in before:
                    line(f"{role}:")
                waiting = None if kept is None else (kept, after)
                if kept is None:
                    for role in after:
                        line(f"{role}:")
        if sha is not None:
            convs.append(conv)
            sums.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(sums, pa.string())], ["c", "repaired_sha256"])

    return run


def _joined_pieces(pieces: DataFrame, kind: pa.DataType, conv: str) -> DataFrame:
    """(conv_id, state, table) of the conversations that are not whole: neighbouring pieces joined, ``JOINED`` at a time."""
    shape = f"conv_id {conv}, number long, state string, table string"
    left = pieces.select("conv_id", "number", "state", "table")
    most = left.agg(F.max("number")).first()[0]
    while True:
        groups = left.withColumn("group", F.floor(F.col("number") / JOINED)).groupBy("conv_id", "group").agg(
            F.collect_list(F.struct("number", "state", "table")).alias("pieces")
        )
        left = stored(groups.mapInArrow(_join(kind), shape), "joined_pieces")
        most = (most or 0) // JOINED
        if most == 0:
            return left.select("conv_id", "state", "table")


def repair_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True, piece: int = PIECE
) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of every conversation.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. turns: conv_id,
    turn, role, digest, before, kept, after - what each group of equal rows becomes; inserted turns have no text.

    A null role or text is one space, so a null text is blank; a null turn comes first and counts for no gap; null
    ids are one conversation. Rows of one turn are ordered by role, then by the SHA-256 of their text. Equal rows are
    one group with a count. A conversation without rows after the damage reports zeros and the digest of nothing; an
    empty table gives no rows, columns beyond the four are not read. The digest of a conversation reads its texts in order, in bounded memory.
    """
    whole = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    if dict(whole.dtypes)["conv_id"] != "string":
        whole = whole.withColumn("conv_id", F.col("conv_id").cast("long"))
    ids = whole.select("conv_id").distinct()
    rows = damaged_rows(whole) if damage else whole.withColumn("copies", F.lit(1))
    conv = dict(rows.dtypes)["conv_id"]
    kind = pa.string() if conv == "string" else pa.int64()
    order = [F.col(c) for c in ("conv_id", "turn", "role", "digest")]  # nulls come first
    groups = stored(equal_rows(rows), "turn_groups")
    dealt = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = dealt.select(*order, "rows", "repeats", "kind").mapInArrow(_pack(kind, piece), PACKED.format(conv))
    packed = stored(packed.select(F.spark_partition_id().alias("part"), "*"), "packed_turns")
    parts = packed.filter(~F.col("whole"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) - 1  # over one row for PIECE groups
    pieces = stored(packed.filter("whole").withColumn("number", F.lit(0)).unionByName(parts.withColumn("number", number)), "pieces")

    tables = pieces.filter("whole").select("conv_id", "state", "table").unionByName(_joined_pieces(pieces.filter(~F.col("whole")), kind, conv))
    counts = ", ".join(f"{c} long" for c in REPORT[1:7])
    chosen = tables.mapInArrow(_choose(kind), f"conv_id {conv}, {counts}, audit string, path array<struct<start:int,edits:string>>")
    chosen = stored(chosen, "chosen_edits")
    cells = chosen.select(F.col("conv_id").alias("c"), F.posexplode("path").alias("k", "cell"))
    own = pieces.join(cells, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("number") == F.col("k")))
    own = own.select("conv_id", "turns", "roles", "digests", "rows", "repeats", "kinds", "cell.start", "cell.edits")
    edits = own.mapInArrow(
        _edits(kind), f"conv_id {conv}, turn long, role string, digest binary, before array<string>, kept string, after array<string>"
    )
    edits = stored(edits, "turn_edits")

    texts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "text", F.lit(True).alias("is_text"))
    stream = edits.withColumn("is_text", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(*order, "is_text").select("conv_id", "before", "kept", "after", "is_text", "text")
    sums = stream.mapInArrow(_hash(kind), f"c {conv}, repaired_sha256 string")
    report = ids.join(chosen.withColumnRenamed("conv_id", "d").drop("path"), F.col("conv_id").eqNullSafe(F.col("d")), "left").join(
        sums, F.col("conv_id").eqNullSafe(F.col("c")), "left"
    )
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return report.select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in REPORT[1:]]), edits


def _sql_step(source: str, price: str, edit: str, line: str = "''") -> str:
    """A role state's best (cost, edits, repaired lines) with one more edit."""
    return f"CASE WHEN {source} IS NOT NULL THEN {{'c': {source}.c + {price}, 'a': {source}.a || '{edit}', 'l': {source}.l || {line}}} END"


def _sql_least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_USER, _ASSISTANT, _OWN = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || r.role || ':' || r.text"
_GONE = "r.fault IN ('blank', 'duplicate')"
_PRICE = "CAST(r.fault = 'truncated' AS BIGINT)"


def _sql_kept(source: str, initial: str) -> str:
    return f"CASE WHEN NOT {_GONE} AND r.initial = '{initial}' THEN {_sql_step(source, _PRICE, 'K', _OWN)} END"


def _sql_reroled(source: str, role: str) -> str:
    return f"CASE WHEN NOT {_GONE} THEN {_sql_step(source, f'2 + {_PRICE}', 'R', role + ' || r.text')} END"


# The same repair as a fold over turns that keeps the best edits of each role state: s0 start, s1, s2, s3 after s, u, a.
OP11_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), dealt AS (SELECT conv_id, turn, role, text, {sql_crc32("key")} % 20 AS damage FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE damage <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place
  FROM damaged
), rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'whole' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS earlier
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM rows GROUP BY conv_id
), folded AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, l VARCHAR) AS s1,
    {_sql_step("{'c': 0::BIGINT, 'a': '', 'l': ''}", "2", "I", _USER)} AS s2, {_sql_step("{'c': 2::BIGINT, 'a': 'I', 'l': " + _USER + "}", "2", "I", _ASSISTANT)} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, place, n0, n1, i2, {_sql_least("n3", _sql_step("i2", "2", "I", _ASSISTANT))}
  FROM (SELECT *, {_sql_least("n2", *(_sql_step(s, "2", "I", _USER) for s in ("n0", "n1", "n3")))} AS i2 FROM (
    SELECT f.conv_id, r.place, {_sql_step("s0", "3", "D")} AS n0, {_sql_least(_sql_step("s1", "3", "D"), _sql_kept("s0", "s"))} AS n1,
      {_sql_least(_sql_step("s2", "3", "D"), *(_sql_kept(s, "u") for s in ("s0", "s1", "s3")), *(_sql_reroled(s, _USER) for s in ("s0", "s1", "s3")))} AS n2,
      {_sql_least(_sql_step("s3", "3", "D"), _sql_kept("s2", "a"), _sql_reroled("s2", _ASSISTANT))} AS n3
    FROM folded f JOIN rows r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.place = f.place + 1))
), best AS (
  SELECT c.*, {_sql_least("s0", "s3")} AS b FROM counts c JOIN folded f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.place = c.n
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))[0]
