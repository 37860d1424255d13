"""Relations between documents and the graph they form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoweave.functions import text as tx
from ontoweave.functions.numeric import with_rounded
from ontoweave.operators.graph import connected_components
from ontoweave.operators.grouping import strongest
from ontoweave.operators.ordering import top_per_group
from ontoweave.session import cut_lineage, stored, tasks_for

# --- fixed values of the domain ---------------------------------------------------------
ROLE_PATTERNS = [
    ("feedback", "反馈意见|反馈.*意见|回复|回函|答复"),
    ("approval", "批复|批办单|批办|批示|审批"),
    ("request", "请示|申请"),
    ("attachment", "附件|附表|附录"),
]
ROLE_TYPES = {"feedback": "feedback_to", "approval": "approval_for", "request": "request_for", "attachment": "attachment_of"}
ROLE_CONFIDENCE = {"feedback": 0.88, "approval": 0.86, "request": 0.82, "attachment": 0.78}
TYPE_PATTERNS = [
    ("abolishes", "废止|停止执行|宣布失效|予以废止|不再执行"),
    ("revises", "修订|修改|修正|调整|补充|更新"),
    ("replaces", "替代|取代|代替|替换|原.*同时废止"),
    ("solicits_opinion_on", "征求意见|征询意见|征求.*建议|公开征求"),
    ("based_on", "依据|根据|按照|遵照|依照"),
    ("implements", "贯彻|落实|实施|执行"),
]
TYPE_CONFIDENCE = {
    "based_on": 0.86, "abolishes": 0.88, "revises": 0.84, "replaces": 0.86, "solicits_opinion_on": 0.82,
    "cites_by_doc_no": 0.82, "implements": 0.84,
}
DEFAULT_CONFIDENCE = 0.74
TYPE_WEIGHTS = {
    "approval_for": 1.45, "request_for": 1.35, "feedback_to": 1.3, "attachment_of": 1.25, "abolishes": 1.25,
    "replaces": 1.22, "revises": 1.18, "based_on": 1.16, "implements": 1.14, "solicits_opinion_on": 1.12,
    "cites_by_doc_no": 1.1, "cites": 0.95, "same_series": 0.82, "shared_reference": 0.68, "same_matter": 0.55,
    "topically_related": 0.35, "semantically_related": 0.3,
}
DEFAULT_WEIGHT = 0.7
SOFT_TYPES = ["same_matter", "shared_reference", "topically_related", "semantically_related"]
QUOTE_GROUP, SERIES_GROUP, NUMBER_GROUP = (2, 10), (2, 8), (1, 5)
TITLE_TARGETS = 12
GRAM = 8
PIECES = [1, 2, 3, 4, 6, GRAM]
SOFT_THRESHOLD, SOFT_TARGETS, SOFT_TERMS = 0.22, 4, 24
PAIRS_A_TASK = 100_000_000
PROFILE_THRESHOLD, PROFILE_TARGETS, TITLE_BONUS = 0.18, 4, 0.2
RELATION = ["source_document_id", "target_document_id", "relation_type", "confidence", "method"]


def _lookup(col: Column, table: dict[str, object], default: object) -> Column:
    chain = None
    for key, value in table.items():
        chain = (F.when if chain is None else chain.when)(col == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def _ladder(text: Column, patterns: list[tuple[str, str]], default: Column) -> Column:
    chain = None
    for name, pattern in patterns:
        chain = (F.when if chain is None else chain.when)(text.rlike(pattern), F.lit(name))
    return chain.otherwise(default)


def relation_role(title: Column) -> Column:
    return _ladder(F.coalesce(title, F.lit("")), ROLE_PATTERNS, F.lit(""))


def relation_type(role: Column, text: Column, default: str = "cites") -> Column:
    """Type by the role of the citing document, else by the wording around the citation."""
    return F.when(role != "", _lookup(role, ROLE_TYPES, default)).otherwise(_ladder(text, TYPE_PATTERNS, F.lit(default)))


def relation_confidence(role: Column, kind: Column) -> Column:
    return F.when(role != "", _lookup(role, ROLE_CONFIDENCE, DEFAULT_CONFIDENCE)).otherwise(
        _lookup(kind, TYPE_CONFIDENCE, DEFAULT_CONFIDENCE)
    )


def edge_weight(kind: Column) -> Column:
    return _lookup(kind, TYPE_WEIGHTS, DEFAULT_WEIGHT)


def edge_score() -> Column:
    return F.coalesce("confidence", F.lit(0.0)) * edge_weight(F.col("relation_type"))


def context_around(text: Column, needle: Column, window: int = 180) -> Column:
    """Text around the first occurrence of the needle, else the start of the text."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.position(needle, text)
    start = F.greatest(at - 1 - window, F.lit(0))
    return F.when(at > 0, F.substring(text, start + 1, at - 1 - start + F.length(needle) + window)).otherwise(
        F.substring(text, F.lit(1), F.lit(window))
    )


# Brackets of a document number that count as the same one.
OPENING, CLOSING = "〔\\[［(（", "〕\\]］)）"
BLANKS = "[\\s\u00a0\u3000]*"


def number_pattern(number: Column) -> Column:
    """Pattern of a number in any brackets and with blanks anywhere inside."""
    spelled = F.regexp_replace(F.regexp_replace(number, f"[\\s\u00a0\u3000]+", ""), r"([\s\S])", r"\\Q$1\\E" + BLANKS.replace("\\", "\\\\"))
    spelled = F.regexp_replace(spelled, rf"\\Q[{OPENING}]\\E", f"[{OPENING}]".replace("\\", "\\\\"))
    spelled = F.regexp_replace(spelled, rf"\\Q[{CLOSING}]\\E", f"[{CLOSING}]".replace("\\", "\\\\"))
    return F.substring(spelled, F.lit(1), F.length(spelled) - len(BLANKS))


def number_context(text: Column, number: Column, window: int = 180) -> Column:
    """Struct (position, found, context) of a number's first place in the original text, however it is spelled there.

    The number as given is looked for first, then in other brackets or with blanks. ``position`` counts from 1 and
    is 0 where the number is nowhere, or is null or blank; the context is then the start of the text.
    The text itself is never rewritten, so positions and words are the original's.
    """
    pattern = number_pattern(number)
    literal = F.position(number, text)
    named = F.coalesce(F.trim(number), F.lit("")) != ""
    place = F.when(~named, 0).when(literal > 0, literal).otherwise(F.regexp_instr(text, pattern))
    found = F.when(literal > 0, number).otherwise(F.coalesce(F.regexp_substr(text, pattern), F.lit("")))
    place, found = F.coalesce(place, F.lit(0)), F.when(named, found).otherwise("")
    start = F.greatest(place - 1 - window, F.lit(0))
    around = F.substring(text, start + 1, place - 1 - start + F.length(found) + window)
    return F.struct(
        place.alias("position"), found.alias("found"),
        F.coalesce(F.when(place > 0, around).otherwise(F.substring(text, 1, window)), F.lit("")).alias("context"),
    )


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """One relation per (source, target, type, method): the most confident one; self references vanish."""
    clean = relations.filter("source_document_id <> target_document_id")
    capped = with_rounded(clean, 3, confidence=F.greatest(F.lit(0.0), F.least("confidence", F.lit(1.0))))
    return strongest(
        capped.select(*RELATION).withColumn("_o", F.lit(0)),
        ["source_document_id", "target_document_id", "relation_type", "method"], "confidence", "_o",
    ).select(*RELATION)


def _group_pairs(members: DataFrame, key: str, bounds: tuple[int, int], extra: list[str]) -> DataFrame:
    """Ordered pairs inside groups whose size lies within ``bounds``; larger groups carry no relation.

    Sizes are counted first, so a huge group never reaches the self-join.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n").between(*bounds)).select(key)
    small = members.join(sizes, key, "left_semi")
    left = small.select(key, F.col("document_id").alias("source_document_id"), *[F.col(c).alias(f"source_{c}") for c in extra])
    right = small.select(key, F.col("document_id").alias("target_document_id"), *[F.col(c).alias(f"target_{c}") for c in extra])
    return left.join(right, key).filter("source_document_id <> target_document_id")


def relation_members(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(kind, group_key, document_id, representative, size): one row a member of each quote, series and number, of any group size.

    ``docs``: document_id, title, own_numbers. ``quotes``: document_id, quote.
    """
    own = (
        quotes.select(F.lit("quote").alias("kind"), tx.relation_text_key(F.col("quote")).alias("group_key"), "document_id").filter(F.length("group_key") >= 6)
        .unionByName(docs.select(F.lit("series").alias("kind"), tx.series_key(F.col("title")).alias("group_key"), "document_id").filter(F.length("group_key") >= 8))
        .unionByName(docs.select(F.lit("number").alias("kind"), F.explode("own_numbers").alias("group_key"), "document_id"))
    ).distinct()
    sizes = own.groupBy("kind", "group_key").agg(F.min("document_id").alias("representative"), F.count("*").alias("size"))
    return own.join(sizes, ["kind", "group_key"]).select("kind", "group_key", "document_id", "representative", "size")


def focus_pairs(members: DataFrame, focus: DataFrame) -> DataFrame:
    """(kind, group_key, source_document_id, target_document_id) of the asked documents with all others of their groups, large ones too."""
    asked = members.join(focus.select("document_id").distinct(), "document_id", "left_semi")
    source = asked.select("kind", "group_key", F.col("document_id").alias("source_document_id"))
    target = members.select("kind", "group_key", F.col("document_id").alias("target_document_id"))
    return source.join(target, ["kind", "group_key"]).filter("source_document_id <> target_document_id")


def shared_references(quotes: DataFrame) -> DataFrame:
    """Documents that quote the same title. ``quotes``: document_id, quote."""
    keyed = quotes.withColumn("quote_key", tx.relation_text_key(F.col("quote"))).filter(F.length("quote_key") >= 6)
    pairs = _group_pairs(keyed.select("document_id", "quote_key"), "quote_key", QUOTE_GROUP, [])
    return pairs.select(
        "source_document_id", "target_document_id", F.lit("shared_reference").alias("relation_type"),
        F.least(F.lit(0.84), F.lit(0.62) + F.length("quote_key") / 80).alias("confidence"), F.lit("rule").alias("method"),
    )


def series_relations(docs: DataFrame) -> DataFrame:
    """Documents of one matter or one series by normalised title. ``docs``: document_id, title."""
    keyed = docs.select(
        "document_id", tx.series_key(F.col("title")).alias("series_key"), tx.title_key(F.col("title")).alias("title_key")
    ).filter(F.length("series_key") >= 8)
    pairs = _group_pairs(keyed, "series_key", SERIES_GROUP, ["title_key"])
    same = F.col("source_title_key") == F.col("target_title_key")
    return pairs.select(
        "source_document_id", "target_document_id", F.when(same, "same_matter").otherwise("same_series").alias("relation_type"),
        F.when(same, 0.78).otherwise(0.68).alias("confidence"), F.lit("rule").alias("method"),
    )


def number_citations(docs: DataFrame) -> DataFrame:
    """Citations by document number, typed by the title and the words around it.

    ``docs``: document_id, title, own_numbers, cited_numbers, relation_text.
    """
    own = docs.select("document_id", F.explode("own_numbers").alias("number")).distinct()
    sizes = own.groupBy("number").agg(F.count("*").alias("_n")).filter(F.col("_n").between(*NUMBER_GROUP)).select("number")
    targets = own.join(sizes, "number", "left_semi").withColumnRenamed("document_id", "target_document_id")
    cited = docs.select(F.col("document_id").alias("source_document_id"), "title", "relation_text", F.explode("cited_numbers").alias("number"))
    j = cited.join(targets, "number").filter("source_document_id <> target_document_id")
    wording = F.concat_ws("\n", "title", context_around(F.col("relation_text"), F.col("number")))
    kind = relation_type(F.lit(""), wording, "cites_by_doc_no")
    staged = j.withColumn("relation_type", kind)
    return staged.select(
        "source_document_id", "target_document_id", "relation_type",
        relation_confidence(F.lit(""), F.col("relation_type")).alias("confidence"), F.lit("doc_number").alias("method"),
    )


def _grams(text: Column) -> Column:
    """All distinct grams of a key of at least gram length."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def title_matches(quote_keys: DataFrame, title_keys: DataFrame) -> DataFrame:
    """(quote_key, title_key) where one contains the other; both hold distinct keys.

    The shorter text opens with a gram that must occur in the longer one, so a
    join on grams finds every containment without comparing all pairs. Spark
    takes the exploded side for as small as its keys and would broadcast it,
    so these joins are merged.
    """
    q = quote_keys.filter(F.length("quote_key") >= GRAM)
    t = title_keys.filter(F.length("title_key") >= GRAM)
    inside = q.withColumn("_g", F.substring("quote_key", 1, GRAM)).join(
        t.withColumn("_g", F.explode(_grams(F.col("title_key")))).hint("merge"), "_g"
    ).filter(F.col("title_key").contains(F.col("quote_key")))
    around = q.withColumn("_g", F.explode(_grams(F.col("quote_key")))).hint("merge").join(
        t.withColumn("_g", F.substring("title_key", 1, GRAM)), "_g"
    ).filter(F.col("quote_key").contains(F.col("title_key")))
    return inside.select("quote_key", "title_key").unionByName(around.select("quote_key", "title_key")).distinct()


def title_citations(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Citations by quoted title: up to twelve targets per quote, by path.

    ``docs``: document_id, path, title, relation_text. ``quotes``: document_id, quote.
    """
    keyed = quotes.withColumn("quote_key", tx.relation_text_key(F.col("quote"))).filter(F.length("quote_key") >= GRAM)
    titles = docs.select("document_id", "path", "title", tx.title_key(F.col("title")).alias("title_key"))
    hits = title_matches(keyed.select("quote_key").distinct(), titles.select("title_key").distinct())
    # A title shared by many documents contributes at most its first twelve.
    firsts = top_per_group(titles, ["title_key"], [F.col("path")], TITLE_TARGETS).drop("rank")
    targets = top_per_group(hits.join(firsts, "title_key"), ["quote_key"], [F.col("path")], TITLE_TARGETS).select(
        "quote_key", F.col("document_id").alias("target_document_id"), relation_role(F.col("title")).alias("_target_role")
    )
    source = keyed.join(docs.select("document_id", "title", "relation_text"), "document_id").select(
        F.col("document_id").alias("source_document_id"), "quote", "quote_key", "title", "relation_text",
        relation_role(F.col("title")).alias("_role"),
    )
    j = source.join(targets, "quote_key").filter(
        (F.col("source_document_id") != F.col("target_document_id"))
        & ((F.col("_role") == "") | (F.col("_role") != F.col("_target_role")))
    )
    wording = F.concat_ws("\n", "title", context_around(F.col("relation_text"), F.col("quote")))
    staged = j.withColumn("relation_type", relation_type(F.col("_role"), wording))
    return staged.select(
        "source_document_id", "target_document_id", "relation_type",
        relation_confidence(F.col("_role"), F.col("relation_type")).alias("confidence"), F.lit("rule").alias("method"),
    )


def _term_vectors(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, sig) and (sig, entries): equal vectors share one row of the second table.

    ``terms``: document_id, term, score (at most 24 per document). Entries are
    u with u^2 = score / total, ordered from rare to frequent terms. ``sig`` is
    the last document that has the vector.
    """
    # The term table is a stored object; vectors are read by several branches.
    terms = stored(terms, "terms")
    useful = (F.length("term") >= 3) & ~tx.classify_term(F.col("term")).isin("form", "short")
    totals = terms.groupBy("document_id").agg(F.sum("score").alias("_total"))
    # Sizes of exploded tables are guessed far too low: what is joined here is merged, not broadcast through the driver.
    unit = terms.filter(useful).join(totals.hint("merge"), "document_id").select(
        "document_id", "term", F.sqrt(F.col("score") / F.col("_total")).alias("u")
    )
    vectors = unit.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("term", "u"))).alias("vec"))
    signed = stored(vectors.withColumn("_sha", F.sha1(F.to_json("vec").cast("binary"))), "signed")
    kinds = stored(signed.groupBy("_sha").agg(F.max("document_id").alias("sig"), F.first("vec").alias("vec")), "vectors")
    entries = kinds.select("sig", F.inline("vec"))
    # Terms get number ids: comparing numbers keeps the dot products cheap.
    frequency = cut_lineage(
        entries.groupBy("term").agg(F.count("*").alias("df")).withColumn("tid", F.monotonically_increasing_id())
    )
    ranked = stored(entries.join(frequency.hint("merge"), "term").groupBy("sig").agg(
        F.array_sort(F.collect_list(F.struct("df", "tid", "u"))).alias("_e")
    ), "ranked")
    return signed.select("document_id", "_sha").join(kinds.select("_sha", "sig").hint("merge"), "_sha").drop("_sha"), ranked


def _lengths(ranked: DataFrame) -> DataFrame:
    """(sig, overlap_score) of each vector with itself."""
    return ranked.select("sig", F.round(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["u"] * e["u"]), 9).alias("overlap_score"))


def _shared_entries(ranked: DataFrame) -> DataFrame:
    """(sig, t, u): ids and values of the terms that other vectors have too, in the order of the entries."""
    shared = F.filter("_e", lambda e: e["df"] > 1)
    return ranked.select("sig", F.transform(shared, lambda e: e["tid"]).alias("t"), F.transform(shared, lambda e: e["u"]).alias("u"))


def _dealt(members: DataFrame, sizes: DataFrame, few: int, block: int) -> DataFrame:
    """``members`` (place, sig, side) in the groups in which they meet: _g, _i, _j.

    ``sizes``: place, lefts, rights (stored). Places of at most ``few`` members are
    packed into groups of about ``2 * few``; larger ones are dealt into blocks, and
    each pair of a block of the left with one of the right is a group of its own.
    Side 0 is on both sides.
    """
    members_of = F.col("lefts") + F.col("rights")
    small = sizes.filter(members_of <= few).agg(F.sum(members_of)).first()[0] or 0
    packs = max(1, -(-small // (2 * few)))
    met = members.join(sizes.hint("merge"), "place")
    packed = met.filter(members_of <= few).select(
        "place", "sig", "side", (-1 - F.pmod(F.xxhash64("place"), F.lit(packs))).alias("_g"), F.lit(0).alias("_i"), F.lit(0).alias("_j")
    )
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("sig"), blocks(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    large = met.filter(members_of > few)
    # A place whose members are on both sides needs each pair of its blocks once.
    alike = large.filter("side = 0").withColumn("_b", own("lefts")).withColumn("_o", others("lefts")).select(
        "place", "sig", F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2).alias("side"),
        F.col("place").alias("_g"), F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"),
    )
    lefts = large.filter("side = 1").select("place", "sig", "side", F.col("place").alias("_g"), own("lefts").alias("_i"), others("rights").alias("_j"))
    rights = large.filter("side = 2").select("place", "sig", "side", F.col("place").alias("_g"), others("lefts").alias("_i"), own("rights").alias("_j"))
    return packed.unionByName(alike).unionByName(lefts).unionByName(rights)


def _met(groups: DataFrame, vectors: DataFrame, sizes: DataFrame, threshold: float, targets: int | None, apart: bool) -> DataFrame:
    """Pairs of the vectors of a group whose overlap reaches the threshold: source_sig, target_sig, overlap_score.

    ``groups``: as from :func:`_dealt`. ``vectors``: sig, t, u. Each group is a
    product of two sparse matrices in one task, in tiles. With ``targets`` a tile
    gives only so many of a source: those of the highest overlap, of these the last.
    With ``apart`` sources are on side 1, targets on side 2, and a pair must have
    its place in common; without, a pair is given both ways, by the group that
    holds its first common term.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = vectors.schema["sig"].dataType.simpleString()
    side_rows = 1024
    each = 4  # a term that a tile's rows share more often than one in ``each ** 3`` pairs is multiplied densely

    def meet(table: pa.Table) -> pa.Table:
        coded = table["sig"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary, order="descending").to_numpy()
        names = coded.dictionary.take(pa.array(order))
        back = np.empty(len(order), "int64")
        back[order] = np.arange(len(order))
        code = back[coded.indices.to_numpy(zero_copy_only=False)]  # the last sig is 0
        place = table["place"].to_numpy()
        # Rows by sig, so that the first of equal ones is the last sig; a sig that came by several terms stays once.
        given = pc.list_value_length(table["u"]).to_numpy().astype("int64")
        rows = np.lexsort((-given, code))  # of equal ones the one with the most values first
        if not apart:
            rows = rows[np.unique(code[rows], return_index=True)[1]]
        here = np.unique(place)
        code, place, side = code[rows], place[rows], table["side"].to_numpy()[rows]
        lists = table["t"].combine_chunks().take(pa.array(rows))
        sizes_of = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")
        owner = np.repeat(np.arange(len(rows)), sizes_of)
        known, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        value = np.zeros(len(owner))
        left_out = sizes_of - given[rows]
        begins = np.cumsum(sizes_of) - sizes_of
        value[np.arange(len(owner)) - begins[owner] >= left_out[owner]] = table["u"].combine_chunks().take(pa.array(rows)).flatten().to_numpy()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        within = not side.any()
        on_left = np.bincount(term[side[owner] != 2], minlength=len(known))
        on_right = np.bincount(term[side[owner] != 1], minlength=len(known))
        both = on_left * on_right > (1 if within else 0)
        dense = both & (on_left * on_right * each**3 >= len(left) * len(right))
        column = np.cumsum(dense) - 1
        matrix = np.zeros((len(rows), int(dense.sum())))
        is_dense = dense[term]
        matrix[owner[is_dense], column[term[is_dense]]] = value[is_dense]
        thin = np.flatnonzero(both[term] & ~dense[term])
        thin_owner, thin_term, thin_value = owner[thin], term[thin], value[thin]
        by_term = np.argsort(thin_term, kind="stable")
        width = int(sizes_of.max(initial=0))
        padded = np.full((len(rows), width), -1)
        padded[owner, np.arange(len(owner)) - begins[owner]] = term
        ours = np.isin(known, here)

        def local(at, entries):
            """Entries of the rows ``at``: row within the tile, term, value."""
            spot = np.full(len(rows), -1)
            spot[at] = np.arange(len(at))
            r = spot[thin_owner[entries]]
            kept = r >= 0
            return r[kept], thin_term[entries][kept], thin_value[entries][kept]

        def product(xs, ys):
            acc = matrix[xs] @ matrix[ys].T
            xr, xt, xv = local(xs, slice(None))
            yr, yt, yv = local(ys, by_term)
            low, high = np.searchsorted(yt, xt, "left"), np.searchsorted(yt, xt, "right")
            n = high - low
            if n.sum():
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                cells = np.repeat(xr, n) * len(ys) + yr[at]
                acc += np.bincount(cells, np.repeat(xv, n) * yv[at], acc.size).reshape(acc.shape)
            return acc

        def best(scores):
            """Cells that reach the threshold, of each row only the first ``targets``."""
            hit = scores >= threshold
            if targets is not None and scores.shape[1] > targets:
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > targets)
                if len(many):
                    of = scores[many]
                    last = np.partition(of, of.shape[1] - targets, axis=1)[:, [of.shape[1] - targets]]
                    above, equal = of > last, of == last
                    free = targets - np.count_nonzero(above, axis=1)[:, None]
                    hit[many] = above | (equal & (np.cumsum(equal, axis=1) <= free))
            return np.nonzero(hit)

        def first_here(i, j):
            """Whether the first common term of the pairs brought them here."""
            kept = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                a, b = padded[i[at : at + (1 << 14)]], padded[j[at : at + (1 << 14)]]
                common = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0)
                kept[at : at + (1 << 14)] = ours[a[np.arange(len(a)), common.argmax(axis=1)]]
            return kept

        found = []

        def give(scores, xs, ys):
            x, y = best(scores)
            i, j, score = xs[x], ys[y], scores[x, y]
            if not apart and len(i):
                kept = first_here(i, j)
                i, j, score = i[kept], j[kept], score[kept]
            found.append((code[i], code[j], score))

        for at in range(0, len(left), side_rows):
            xs = left[at : at + side_rows]
            for to in range(at if within else 0, len(right), side_rows):
                ys = right[to : to + side_rows]
                scores = np.round(product(xs, ys), 9)
                scores[code[xs][:, None] == code[ys]] = 0.0
                if apart:
                    scores[place[xs][:, None] != place[ys]] = 0.0
                give(scores, xs, ys)
                if not apart and (not within or to > at):
                    give(scores.T, ys, xs)
        parts = [np.concatenate(p) for p in zip(*found)] if found else [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]
        return pa.table({"source_sig": names.take(pa.array(parts[0])), "target_sig": names.take(pa.array(parts[1])), "overlap_score": pa.array(parts[2])})

    # Few bytes make many pairs here, so the number of tasks follows the pairs.
    pairs = sizes.agg(F.sum(F.col("lefts").cast("double") * F.when(F.col("rights") > 0, F.col("rights")).otherwise(F.col("lefts")))).first()[0] or 0
    tasks = tasks_for(vectors.sparkSession, int(pairs), PAIRS_A_TASK)
    rows = groups.join(vectors.hint("merge"), "sig")
    if not apart:
        # The first common term of a pair brings it here, so no earlier value is needed.
        rows = rows.withColumn("u", F.slice("u", F.array_position("t", F.col("place")).cast("int"), F.size("u")))
    rows = rows.repartition(tasks, "_g", "_i", "_j")
    return rows.groupBy("_g", "_i", "_j").applyInArrow(
        lambda key, table: meet(table), f"source_sig {kind}, target_sig {kind}, overlap_score double"
    )


def _overlaps(ranked: DataFrame, threshold: float, targets: int | None = None, few: int = 256, block: int = 4096) -> DataFrame:
    """All ordered pairs of vectors whose overlap reaches the threshold.

    The frequent tail of a vector whose squared weight stays below threshold^2
    cannot carry a pair on its own, so vectors meet on the remaining prefixes only,
    and are scored where they meet. With ``targets`` pairs that cannot be among
    the best so many of a source (highest overlap, then last sig) may be left out.
    """
    tail = lambda i: F.aggregate(F.slice("_e", i + 1, F.size("_e")), F.lit(0.0), lambda acc, e: acc + e["u"] * e["u"])
    prefix = ranked.select("sig", F.inline(F.filter(
        F.transform("_e", lambda e, i: F.struct(e["tid"].alias("place"), e["df"].alias("df"), tail(i).alias("mass"))),
        lambda t: (t["df"] > 1) & (t["mass"] >= threshold * threshold * 0.999999),
    ))).select("sig", "place", F.lit(0).alias("side"))
    sizes = cut_lineage(prefix.groupBy("place").agg(F.count("*").alias("lefts")).filter("lefts > 1").withColumn("rights", F.lit(0)))
    met = _met(_dealt(prefix, sizes, few, block), _shared_entries(ranked), sizes, threshold, targets, apart=False)
    own = _lengths(ranked).filter(F.col("overlap_score") >= threshold)
    return met.unionByName(own.select(F.col("sig").alias("source_sig"), F.col("sig").alias("target_sig"), "overlap_score"))


def soft_term_relations(
    terms: DataFrame, threshold: float = SOFT_THRESHOLD, targets: int = SOFT_TARGETS
) -> DataFrame:
    """The best ``targets`` documents with weighted term overlap at or above the threshold.

    Documents with equal vectors are compared once, and as targets only the
    ``targets + 1`` last ids of such a group can ever be listed.
    """
    signed, ranked = _term_vectors(terms)
    listed = top_per_group(signed, ["sig"], [F.col("document_id").desc()], targets + 1).select(
        F.col("sig").alias("target_sig"), F.col("document_id").alias("target_document_id")
    )
    shortlist = top_per_group(
        _overlaps(ranked, threshold, targets + 1).join(listed, "target_sig"), ["source_sig"],
        [F.col("overlap_score").desc(), F.col("target_document_id").desc()], targets + 1,
    ).drop("rank", "target_sig")
    mine = signed.select(F.col("sig").alias("source_sig"), F.col("document_id").alias("source_document_id"))
    own = mine.join(shortlist, "source_sig").filter("source_document_id <> target_document_id")
    best = top_per_group(own, ["source_document_id"], [F.col("overlap_score").desc(), F.col("target_document_id").desc()], targets)
    return best.select(
        "source_document_id", "target_document_id", F.lit("topically_related").alias("relation_type"),
        F.least(F.lit(0.76), F.lit(0.5) + F.col("overlap_score")).alias("confidence"), F.lit("lexical_profile").alias("method"),
    )


def role_profile_relations(docs: DataFrame, terms: DataFrame, targets: int = PROFILE_TARGETS) -> DataFrame:
    """Feedback, approval, request and attachment documents with the documents their terms and titles point to.

    Score is the term overlap, plus a bonus when one series title contains the
    other; at least one common term is needed. The best ``targets`` are taken
    first, then those of the source's own role are left out. Documents with
    equal vector and series title are one kind and compared once; the kind of the
    first title and document has the highest id. ``docs``: document_id, title.
    """
    signed, ranked = _term_vectors(terms)
    keyed = cut_lineage(docs.join(signed.hint("merge"), "document_id").select(
        "document_id", "title", "sig", tx.series_key(F.col("title")).alias("key"), relation_role(F.col("title")).alias("role")
    ))
    kinds = cut_lineage(keyed.groupBy("sig", "key").agg(
        F.min(F.struct("title", "document_id")).alias("_first"), F.max(F.col("role") != "").alias("asks")
    ).orderBy(F.col("_first").desc()).select(F.monotonically_increasing_id().alias("kind"), "sig", "key", "asks"))
    keyed = cut_lineage(keyed.join(kinds.select("sig", "key", "kind").hint("merge"), ["sig", "key"]).drop("sig", "key"))
    firsts = kinds.groupBy("sig").agg(F.max("kind").alias("first"))
    vectors = cut_lineage(ranked.join(firsts.hint("merge"), "sig").select(F.col("first").alias("sig"), "_e"))
    kinds = kinds.join(firsts.hint("merge"), "sig").drop("sig")
    sources = kinds.filter("asks").select(F.col("first").alias("source_sig"), F.col("kind").alias("source_kind"), F.col("key").alias("source_key"))
    sinks = kinds.select(F.col("first").alias("target_sig"), F.col("kind").alias("target_kind"), F.col("key").alias("target_key"))
    contains = (F.col("source_key") != "") & (F.col("target_key") != "") & (
        F.col("source_key").contains(F.col("target_key")) | F.col("target_key").contains(F.col("source_key"))
    )
    # A title's bonus is given where titles contain each other, which by_title does whatever the overlap, and within one vector.
    by_terms = _overlaps(vectors, PROFILE_THRESHOLD, targets + 1).filter("source_sig <> target_sig").join(
        sources.drop("source_key").hint("merge"), "source_sig"
    ).join(sinks.drop("target_key").hint("merge"), "target_sig").select("source_kind", "target_kind", F.col("overlap_score").alias("score"))
    by_title = _title_overlaps(vectors, sources, sinks, targets + 1).select(
        "source_kind", "target_kind", F.round(F.col("overlap_score") + TITLE_BONUS, 9).alias("score")
    )
    alike = sources.withColumnRenamed("source_sig", "sig").join(sinks.withColumnRenamed("target_sig", "sig").hint("merge"), "sig").join(
        _lengths(vectors).filter("overlap_score > 0").hint("merge"), "sig"
    ).select("source_kind", "target_kind", F.round(F.col("overlap_score") + F.when(contains, TITLE_BONUS).otherwise(0.0), 9).alias("score"))
    scored = by_terms.unionByName(by_title).unionByName(alike).groupBy("source_kind", "target_kind").agg(F.max("score").alias("score")).filter(
        F.col("score") >= PROFILE_THRESHOLD
    )
    order = [F.col("title"), F.col("document_id")]
    listed = top_per_group(keyed.select("kind", "title", "document_id", "role"), ["kind"], order, targets + 1).select(
        F.col("kind").alias("target_kind"), F.col("title").alias("target_title"),
        F.col("document_id").alias("target_document_id"), F.col("role").alias("target_role"),
    )
    best_first = [F.col("score").desc(), F.col("target_title"), F.col("target_document_id")]
    shortlist = top_per_group(scored.join(listed.hint("merge"), "target_kind"), ["source_kind"], best_first, targets + 1).drop("rank")
    mine = keyed.filter("role <> ''").select(F.col("kind").alias("source_kind"), F.col("document_id").alias("source_document_id"), "role")
    own = mine.join(shortlist.hint("merge"), "source_kind").filter("source_document_id <> target_document_id")
    best = top_per_group(own, ["source_document_id"], best_first, targets).filter(F.col("target_role") != F.col("role"))
    return best.select(
        "source_document_id", "target_document_id", _lookup(F.col("role"), ROLE_TYPES, "cites").alias("relation_type"),
        (_lookup(F.col("role"), ROLE_CONFIDENCE, DEFAULT_CONFIDENCE) - 0.08).alias("confidence"), F.lit("lexical_profile").alias("method"),
    )


def _title_overlaps(
    ranked: DataFrame, sources: DataFrame, sinks: DataFrame, targets: int, few: int = 256, block: int = 4096
) -> DataFrame:
    """Best pairs of kinds whose titles contain each other and whose vectors have a term in common: source_kind, target_kind, overlap_score.

    Sources and targets meet at the target's title. ``sources``: source_sig,
    source_kind, source_key; ``sinks`` likewise.
    """
    numbered = cut_lineage(sinks.groupBy("target_key").agg(F.min("target_kind").alias("place")))
    found = title_containment(sources.select("source_key").distinct(), numbered.select("target_key"))
    found = cut_lineage(found.join(numbered.hint("merge"), "target_key").select("source_key", "place"))
    lefts = sources.join(found.hint("merge"), "source_key").select("place", F.col("source_kind").alias("sig"), F.lit(1).alias("side"))
    rights = sinks.join(numbered.hint("merge"), "target_key").join(found.select("place").distinct().hint("merge"), "place").select(
        "place", F.col("target_kind").alias("sig"), F.lit(2).alias("side")
    )
    members = cut_lineage(lefts.unionByName(rights))
    sizes = cut_lineage(members.groupBy("place").agg(F.count_if(F.col("side") == 1).alias("lefts"), F.count_if(F.col("side") == 2).alias("rights")))
    kinds = sinks.select(F.col("target_sig").alias("sig"), F.col("target_kind").alias("kind"))
    vectors = _shared_entries(ranked).join(kinds.hint("merge"), "sig").select(F.col("kind").alias("sig"), "t", "u")
    return _met(_dealt(members, sizes, few, block), vectors, sizes, 1e-9, targets, apart=True).toDF("source_kind", "target_kind", "overlap_score")


def title_containment(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, target_key) pairs of distinct series titles where one contains the other.

    A key opens with a piece of one of a few lengths that must occur in the
    longer one. Pieces travel as numbers with the number of their key, and are
    merged, never broadcast.
    """
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = lambda df, c: cut_lineage(
        df.filter(F.col(c) != "").select(F.col(c).alias("key")).repartition(tasks, "key").withColumn("id", F.monotonically_increasing_id())
    )
    a, b = numbered(sources, "source_key"), numbered(targets, "target_key")
    inner = lambda df: df.select(F.col("id").alias("inner_id"), F.xxhash64(_opening(F.col("key"))).alias("_g"))
    outer = lambda df: df.repartition(tasks, "id").select(F.col("id").alias("outer_id"), F.explode(_pieces(F.col("key"))).alias("_g"))
    held = outer(b).hint("merge").join(inner(a), "_g").select(F.col("inner_id").alias("source_id"), F.col("outer_id").alias("target_id"))
    holds = outer(a).hint("merge").join(inner(b), "_g").select(F.col("outer_id").alias("source_id"), F.col("inner_id").alias("target_id"))
    return held.unionByName(holds).distinct().join(
        a.select(F.col("id").alias("source_id"), F.col("key").alias("source_key")).hint("merge"), "source_id"
    ).join(
        b.select(F.col("id").alias("target_id"), F.col("key").alias("target_key")).hint("merge"), "target_id"
    ).filter(F.col("source_key").contains(F.col("target_key")) | F.col("target_key").contains(F.col("source_key"))).select("source_key", "target_key")


def _opening(key: Column) -> Column:
    """The opening piece of a key, of the longest of the lengths that it has."""
    return F.substring(key, F.lit(1), reduce(lambda size, n: F.when(F.length(key) >= n, n).otherwise(size), PIECES, F.lit(0)))


def _pieces(key: Column) -> Column:
    """Numbers of all pieces of a key."""
    texts = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in PIECES])))
    return F.transform(texts, lambda t: F.xxhash64(t))


def semantic_relations(
    vectors: DataFrame, focus: DataFrame, threshold: float = 0.64, targets: int = 3, block_rows: int = 4096
) -> DataFrame:
    """Nearest documents of the focus documents by cosine of unit vectors.

    ``vectors`` and ``focus``: document_id, vector. Both sides are dealt into
    blocks of about ``block_rows`` rows; each pair of blocks is one matrix
    product in one task, which keeps the best ``targets`` of each of its rows.
    """
    import numpy as np
    import pandas as pd

    def dealt(df: DataFrame, own: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block_rows))
        return df.select("document_id", "vector", F.pmod(F.xxhash64("document_id"), F.lit(n)).alias(own)), n

    def spread_over(df: DataFrame, other: str, n: int) -> DataFrame:
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))

    asked, n_asked = dealt(focus, "_f")
    corpus, n_corpus = dealt(vectors, "_c")
    kind = vectors.schema["document_id"].dataType.simpleString()

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"source_document_id": [], "target_document_id": [], "similarity": []})
        sims = np.stack(left["vector"].to_numpy()).astype("float64") @ np.stack(right["vector"].to_numpy()).astype("float64").T
        ids, other = left["document_id"].to_numpy(), right["document_id"].to_numpy()
        i, j = np.nonzero((sims >= threshold) & (ids[:, None] != other[None, :]))
        frame = pd.DataFrame({"source_document_id": ids[i], "target_document_id": other[j], "similarity": sims[i, j]})
        order = ["source_document_id", "similarity", "target_document_id"]
        return frame.sort_values(order, ascending=[True, False, False]).groupby("source_document_id").head(targets)

    found = (
        spread_over(asked, "_c", n_corpus).groupBy("_f", "_c").cogroup(spread_over(corpus, "_f", n_asked).groupBy("_f", "_c"))
        .applyInPandas(nearest, f"source_document_id {kind}, target_document_id {kind}, similarity double")
    )
    best = top_per_group(found, ["source_document_id"], [F.col("similarity").desc(), F.col("target_document_id").desc()], targets)
    return best.select(
        "source_document_id", "target_document_id", F.lit("semantically_related").alias("relation_type"),
        F.least(F.lit(0.82), F.col("similarity")).alias("confidence"), F.lit("embedding").alias("method"),
    )


def relation_stats(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type", "method").agg(
        F.count("*").alias("relations"), F.sum(F.col("confidence").cast("decimal(18,3)")).cast("double").alias("confidence_sum")
    )


def find_relations(relations: DataFrame, focus: DataFrame, direction: str = "both") -> DataFrame:
    """Relations of the focus documents, seen from them. ``focus``: document_id."""
    out = relations.join(focus.withColumnRenamed("document_id", "source_document_id"), "source_document_id", "left_semi").select(
        F.col("source_document_id").alias("document_id"), F.col("target_document_id").alias("other_document_id"),
        F.lit("outgoing").alias("direction"), "relation_type", "confidence", "method",
    )
    into = relations.join(focus.withColumnRenamed("document_id", "target_document_id"), "target_document_id", "left_semi").select(
        F.col("target_document_id").alias("document_id"), F.col("source_document_id").alias("other_document_id"),
        F.lit("incoming").alias("direction"), "relation_type", "confidence", "method",
    )
    return {"source": out, "outgoing": out, "target": into, "incoming": into}.get(direction, out.unionByName(into))


def expand_context(relations: DataFrame, focus: DataFrame) -> DataFrame:
    """Best relation per neighbouring document."""
    found = find_relations(relations, focus)
    order = F.struct(F.col("confidence"), F.col("relation_type"), F.col("direction"))
    best = found.groupBy("document_id", "other_document_id").agg(F.max(order).alias("_b"))
    return best.select("document_id", "other_document_id", "_b.*")


def relation_groups(
    relations: DataFrame, docs: DataFrame, min_relations: int = 2, max_documents: int = 8
) -> DataFrame:
    """Connected groups of related documents, reduced to their best documents and scored.

    ``docs``: document_id, title. Documents with equal titles count once. All
    steps are joins and mergeable aggregates on group or document keys.
    """
    # Relations are a stored object: the components and the groups read the same copy.
    relations = cut_lineage(relations)
    components = connected_components(
        relations.select(F.col("source_document_id").alias("src"), F.col("target_document_id").alias("dst"))
    )
    rel = relations.join(components.select(F.col("node").alias("source_document_id"), "component"), "source_document_id")
    ends = rel.select("component", F.explode(F.array_distinct(F.array("source_document_id", "target_document_id"))).alias("document_id"))
    counted = ends.groupBy("component", "document_id").agg(F.count("*").alias("relation_count"))
    titled = counted.join(docs.select("document_id", "title"), "document_id").withColumn(
        "_key", F.coalesce(F.nullif(tx.title_key(F.col("title")), F.lit("")), F.col("document_id").cast("string"))
    )
    order = F.struct((-F.col("relation_count")).alias("n"), "title", "document_id")
    kept = titled.groupBy("component", "_key").agg(F.min(order).alias("_o"))
    top = top_per_group(kept, ["component"], [F.col("_o")], max_documents).select("component", F.col("_o.document_id").alias("document_id"))
    inside = rel.join(top.withColumnRenamed("document_id", "source_document_id"), ["component", "source_document_id"], "left_semi").join(
        top.withColumnRenamed("document_id", "target_document_id"), ["component", "target_document_id"], "left_semi"
    )
    hard = ~F.col("relation_type").isin(SOFT_TYPES)
    scored = inside.groupBy("component").agg(
        F.count("*").alias("relation_count"), F.sum(edge_score().cast("decimal(20,6)")).cast("double").alias("_edges"),
        F.count(F.when(hard, 1)).alias("_hard"), F.count_distinct("relation_type").alias("_types"),
        F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("relation_types"),
    ).filter(F.col("relation_count") >= min_relations)
    members = top.groupBy("component").agg(F.count("*").alias("document_count")).filter("document_count >= 2")
    j = scored.join(members, "component")
    total = F.col("_edges") + F.col("_hard") * 0.25 + F.col("document_count") * 0.12 + F.col("_types") * 0.35
    return with_rounded(j, 3, score=total).select("component", "score", "document_count", "relation_count", "relation_types")
