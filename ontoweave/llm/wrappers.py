"""Main text of HTML pages through wrappers inferred per host.

A page's markup is a tree in which adjacent equal subtrees are folded into a repeated
group and texts are slots. The distinct trees of a host are aligned, by parts and then the
parts, into a union-free expression: what only some pages have becomes optional, what follows
itself becomes repeated, and text slots stay. Slots inside the article that no menu, form,
notice or other side matter encloses are the main text; a host without an article falls
back to the slots of its body whose text differs between pages. A page's text is read from
its own tree at the main slots of its host's wrapper.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm.base import query, stored, table
from ontoweave.llm.url_filter import host_of

LEVELS = 100  # elements nested deeper are transparent to the wrapper: their texts are slots of their ancestor at this level
SALTS = 64  # parts of a host whose shapes are aligned first, each on its own
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)|([^<>]*))(?:>|$|(?=<))", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
# elements that an opening element ends without a closing tag
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
}
SIDE_ELEMENTS = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg canvas object head title dialog menu".split())
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|footnav|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter"
    r"|notice|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget|site-header|page-header)(?:$|[\s_-])",
    re.IGNORECASE,
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())


@dataclass
class Node:
    """An element: ``key`` is its name with classes and id, ``items`` its child elements and texts in order."""

    name: str
    key: str
    side: bool
    items: list[Node | str] = field(default_factory=list)


def parse(page: str) -> Node:
    """Tree of a page. Unclosed and stray tags are taken as browsers take the common cases; a tag with an unclosed quote ends at its first ``>``."""
    root = Node("", "", False)
    stack, at = [root], 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if name in INLINE and stack[depth].name not in INLINE:
                    break
            continue
        if name not in INLINE:
            while len(stack) > 1 and stack[-1].name in INLINE:
                stack.pop()
            while len(stack) > 1 and name in ENDED_BY.get(stack[-1].name, ()):
                stack.pop()
        attributes = m[4] if m[3] is None else m[3]
        node = _element(name, attributes)
        stack[-1].items.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].items.append(page[at:])
    return root


def _element(name: str, attributes: str) -> Node:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    marks = " ".join(filter(None, (found.get("class"), found.get("id"))))
    side = (
        name in SIDE_ELEMENTS or bool(marks and SIDE_WORDS.search(marks)) or found.get("role", "").lower() in SIDE_ROLES
        or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    )
    key = name + "".join("." + c for c in sorted(set(found.get("class", "").split())))
    return Node(name, key, side)


Shape = tuple  # (key, flags, (child shapes)); flags: "" once, "?" optional, "+" repeated, "*" both


def shape_of(node: Node, level: int = 0) -> Shape:
    """Folded structure of an element: inline elements vanish, texts are slots, adjacent equals are one repeated group."""
    out: list[Shape] = []

    def add(child: Shape) -> None:
        if out and out[-1][0] == child[0] and out[-1][2] == child[2]:
            if child[0] != "#":
                out[-1] = (child[0], "+", child[2])
        else:
            out.append(child)

    open_ = [iter(node.items)]
    while open_:
        item = next(open_[-1], None)
        if item is None:
            open_.pop()
        elif isinstance(item, str):
            if not item.isspace():
                add(("#", "", ()))
        elif item.name in INLINE or (level == LEVELS and item.name not in RAW):
            open_.append(iter(item.items))
        elif item.name not in RAW:
            add(shape_of(item, level + 1))
    return (node.key, "", tuple(out))


def _flags(a: str, b: str) -> str:
    optional, repeated = set("?*") & {a, b}, set("+*") & {a, b}
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _optional(s: Shape) -> Shape:
    return (s[0], "*" if s[1] in ("+", "*") else "?", s[2])


def _repeated(s: Shape) -> Shape:
    return (s[0], "*" if s[1] in ("?", "*") else "+", s[2])


def align(a: Shape, b: Shape) -> Shape:
    """The expression that covers both elements, which have one key."""
    left, right, out = a[2], b[2], []

    def put(s: Shape) -> None:
        if out and out[-1][0] == s[0] and s[0] != "#":  # the mismatch is a repeat of what stands before it
            merged = align(out[-1], (s[0], out[-1][1], s[2]))
            out[-1] = _repeated((s[0], out[-1][1], merged[2]))
        elif not (out and out[-1][0] == s[0] == "#"):
            out.append(s)

    i = j = 0
    while i < len(left) and j < len(right):
        if left[i][0] == right[j][0]:
            same = align(left[i], right[j]) if left[i][0] != "#" else left[i]
            put((same[0], _flags(left[i][1], right[j][1]), same[2]))
            i, j = i + 1, j + 1
            continue
        ahead_right = next((k for k in range(j, len(right)) if right[k][0] == left[i][0]), None)
        ahead_left = next((k for k in range(i, len(left)) if left[k][0] == right[j][0]), None)
        if ahead_right is not None and (ahead_left is None or ahead_right - j <= ahead_left - i):
            for s in right[j:ahead_right]:
                put(_optional(s))
            j = ahead_right
        elif ahead_left is not None:
            for s in left[i:ahead_left]:
                put(_optional(s))
            i = ahead_left
        else:
            put(_optional(left[i]))
            put(_optional(right[j]))
            i, j = i + 1, j + 1
    for s in (*left[i:], *right[j:]):
        put(_optional(s))
    return (a[0], _flags(a[1], b[1]), tuple(out))


def expression(s: Shape) -> str:
    """The wrapper written as a union-free regular expression."""
    if s[0] == "#":
        return "#" + s[1]
    body = "".join(map(expression, s[2]))
    return (f"({s[0]}:{body})" if body else f"({s[0]})") + s[1]


def slots(s: Shape, path: str = "") -> list[str]:
    """Paths of the text slots of a wrapper."""
    if s[0] == "#":
        return [path]
    own = f"{path}/{s[0]}" if s[0] else path
    return list(dict.fromkeys(p for child in s[2] for p in slots(child, own)))


@dataclass
class Block:
    path: str
    text: str
    main: bool
    side: bool


@dataclass
class Frame:
    """An element whose items are being read; ``block`` is false for inline elements, which belong to the block around them."""

    items: Iterator[Node | str]
    path: str
    main: bool
    side: bool
    level: int
    block: bool = True


def blocks_of(root: Node) -> list[Block]:
    """Texts of the page in order, one for each run of inline content, with white space collapsed.

    Character references are decoded within each text of the markup. Any depth is read.
    """
    out: list[Block] = []
    held: list[str] = []
    open_ = [Frame(iter(root.items), "", False, False, 0)]

    def flush(at: Frame) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(at.path, text, at.main, at.side))

    while open_:
        at = open_[-1]
        item = next(at.items, None)
        if item is None:
            open_.pop()
            if at.block:
                flush(at)
        elif isinstance(item, str):
            held.append(html.unescape(item))
        elif item.name == "br":
            held.append(" ")
        elif item.name in INLINE:
            if not item.side:
                open_.append(Frame(iter(item.items), at.path, at.main, at.side, at.level, False))
        elif item.name not in RAW and item.name not in VOID:
            flush(at)
            side = at.side or item.side or (item.name == "header" and not at.main)
            path = f"{at.path}/{item.key}" if at.level < LEVELS else at.path
            open_.append(Frame(iter(item.items), path, at.main or item.name in ("article", "main"), side, at.level + 1))
        elif item.name == "hr":
            flush(at)
    return out


def _encode(s: Shape) -> str:
    return json.dumps(s, ensure_ascii=False, separators=(",", ":"))


def _decode(text: str) -> Shape:
    def shape(x):
        return (x[0], x[1], tuple(shape(c) for c in x[2]))

    return shape(json.loads(text))


def _column(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _shapes(batches):
    """(host, shape, path, low, high, first, last): distinct shapes, and at each path the range of text hashes and of the hashes of the pages that hold it."""
    names = ("host", "shape", "path", "low", "high", "first", "last")
    for batch in batches:
        shapes: set[tuple[str, str]] = set()
        texts: dict[tuple[str, str], list[int]] = {}
        for host, page in zip(_column(batch, "host"), _column(batch, "html")):
            root = parse(page)
            shapes.add((host, _encode(shape_of(root))))
            found = blocks_of(root)
            whole = xxhash.xxh64_intdigest("\n".join(b.text for b in found)) >> 1  # pages of equal texts are copies
            for b in found:
                h = xxhash.xxh64_intdigest(b.text) >> 1
                seen = texts.setdefault((host, b.path), [h, h, whole, whole])
                seen[:] = min(seen[0], h), max(seen[1], h), min(seen[2], whole), max(seen[3], whole)
        rows = [(h, s, *[None] * 5) for h, s in sorted(shapes)] + [(h, None, p, *seen) for (h, p), seen in texts.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, r)) for r in rows], pa.schema([(c, pa.string() if c in names[:3] else pa.int64()) for c in names])
        )


def _fold(batches):
    """(host, shape): one expression of the shapes of each key, whose rows stand together."""
    key, wrapper = None, None
    for batch in batches:
        out = []
        for host, salt, text in zip(_column(batch, "host"), batch.column(batch.schema.get_field_index("salt")).to_pylist(), _column(batch, "shape")):
            shape = _decode(text)
            if key == (host, salt):
                wrapper = align(wrapper, shape)
                continue
            if key is not None:
                out.append((key[0], _encode(wrapper)))
            key, wrapper = (host, salt), shape
        yield _expressions(out)
    yield _expressions([] if key is None else [(key[0], _encode(wrapper))])


def _expressions(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["host", "shape"])


def folded(shapes: DataFrame, salt: Column) -> DataFrame:
    """The (host, shape) of each host and salt aligned into one, largest first and then in text order, however they arrive."""
    keyed = shapes.select("host", "shape", salt.alias("salt")).repartition("host", "salt")
    return keyed.sortWithinPartitions("host", "salt", F.length("shape").desc(), "shape").mapInArrow(_fold, "host string, shape string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, constant): expression of each host's pages, and the paths whose text several different pages hold and none changes."""
    kinds = "host string, shape string, path string, low long, high long, first long, last long"
    spread = stored(pages.select("host", "html").mapInArrow(_shapes, kinds), "shapes")
    shapes = spread.filter("shape is not null").select("host", "shape").distinct()
    partial = folded(shapes, F.pmod(F.xxhash64("shape"), F.lit(SALTS)))
    wrappers = folded(partial, F.lit(0).cast("long")).withColumnRenamed("shape", "wrapper")
    fixed = (
        spread.filter("path is not null").groupBy("host", "path")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"))
        .filter("low = high and first < last").groupBy("host").agg(F.collect_set("path").alias("constant"))
    )
    return wrappers.join(fixed, "host", "left")


def main_slots(wrapper: Shape | None, constant: frozenset[str]) -> frozenset[str]:
    """Paths of the wrapper that hold main text: those in the article, or without one those of changing text."""
    paths = slots(wrapper) if wrapper is not None else []
    inside = [p for p in paths if re.search(r"/(?:article|main)(?:[./]|$)", p)]
    return frozenset(inside) if inside else frozenset(p for p in paths if p not in constant)


def main_text(page: str, slots_: frozenset[str]) -> str:
    """Texts of the page at the main slots and outside side matter, joined by line feeds."""
    found = [b for b in blocks_of(parse(page)) if not b.side]
    inside = [b for b in found if b.main]
    if not any(b.path in slots_ for b in found):  # a page unlike the others of its host
        return "\n".join(b.text for b in inside or found)
    return "\n".join(b.text for b in found if b.path in slots_ and (b.main or not inside))


def _extract(batches):
    known: dict[tuple[str, str], frozenset[str]] = {}
    for batch in batches:
        texts = []
        constants = batch.column(batch.schema.get_field_index("constant")).to_pylist()
        for page, wrapper, constant in zip(_column(batch, "html"), _column(batch, "wrapper"), constants):
            key = (wrapper, "\n".join(sorted(constant or ())))
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                known[key] = main_slots(_decode(wrapper) if wrapper else None, frozenset(constant or ()))
            texts.append(main_text(page, known[key]))
        ids = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null html is empty and gives an empty text. Pages whose url is null or has no host
    share one wrapper. Markup may be nested to any depth; the wrapper knows its first ``LEVELS``
    levels and no text is lost below them. Repeated rows and null ids stay, each as its own row; an empty
    table gives an empty result.
    """
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    wrappers = stored(infer_wrappers(own), "wrappers")
    return own.join(wrappers, "host", "left").drop("host").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
