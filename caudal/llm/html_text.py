"""Main text of web pages by a site style tree.

Pages of one host are merged into one tree: a node is a path of elements with their classes.
For each node Spark counts how often each arrangement of children (presentation) and each text
or link (content) occurs among the host's pages; copies of a page count as one, so an article is not
what its copies repeat. The entropy of the presentation and the
spread of the content give the node's importance: what stays the same on page after page has
none. Branches of low importance are removed from each page, as are those that their element
or class declares to be no article (fixed lists below). What is left is cut into blocks.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from caudal.llm.common import stored
from caudal.llm.urls import host_of

# A node is judged from this many different pages of its host on.
MIN_PAGES = 4
LOW_IMPORTANCE = 0.3
# Weight of content against presentation.
CONTENT_WEIGHT = 0.9

# Fixed lists: elements by kind.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = set(
    "nav footer aside form button select dialog menu iframe object canvas video audio map head "
    "datalist fieldset label".split()
)
_RAW = "script style noscript template textarea title svg math xmp"
_BLOCKS = set(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 "
    "h6 header hr html li main ol p pre section summary table tbody tfoot thead tr ul "
    "caption".split()
)
_SPACED = {"br", "td", "th", "img"}
_INLINE = set("a abbr b bdi bdo cite code data dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
_ROOTS = {"article", "main"}
# Elements that class words do not silence; an article only if it lies in no other root.
_WHOLE = {"html", "body", "main"}
# An element that ends when one of its own kind, or one of these, begins.
_ENDS = {
    "p": _BLOCKS | _DROPPED - {"button", "label", "map", "object", "canvas", "video", "audio", "iframe", "select", "datalist"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
# Elements such an end does not reach through.
_SCOPES = set("ul ol dl table div section article main body html blockquote".split())
# Words of class and id that declare a branch to be no part of an article.
_NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion sidebar sidebars aside rail menu nav navbar navigation breadcrumb breadcrumbs "
    "footer foot cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond login search widget widgets pager pagination "
    "copyright legal skip toolbar".split()
)
# These only outside the article itself, which may have a header with its title.
_OUTER_WORDS = set("header masthead topbar top-bar site-header".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW.split())})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden)\s*=?\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class _Open:
    tag: str
    path: str
    noise: bool
    claims: tuple[int, ...]
    inside: bool
    plain: bool


@dataclass
class Page:
    """A page's text pieces in order, and its nodes."""

    # (path, text, noise, inside an article, plain element); None ends a block.
    pieces: list = field(default_factory=list)
    children: dict = field(default_factory=dict)
    has_root: bool = False


def _declared(tag: str, rest: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is no article by its kind, and by words of class and id; its classes."""
    names, claimed = "", False
    noise = tag in _DROPPED or (tag == "header" and not inside)
    if rest and ("=" in rest or "hidden" in rest):
        for m in _NAMES.finditer(rest):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "class":
                names = ".".join(sorted(value.split()))
            if kind == "hidden":
                noise = True
                continue
            if kind == "role":
                noise |= value in ("navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog")
                continue
            words = set(_SPLIT.split(value))
            claimed |= bool(words & _NOISE_WORDS) or (not inside and bool(words & _OUTER_WORDS))
    return noise, claimed and tag not in _WHOLE and (inside or tag != "article"), names


def parse(source: str) -> Page:
    """One pass over the tags with a stack of open elements; broken markup is taken as it is."""
    page = Page()
    stack = [_Open("", "", False, (), False, True)]
    # What each open root and each branch claimed by class words lies in.
    roots: list[tuple[int, ...]] = []
    claims = 0
    at = 0

    def say(text: str) -> None:
        top = stack[-1]
        page.pieces.append((top.path, text, top.noise, top.inside, top.plain, top.claims))

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            say(source[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS or tag in _DROPPED
        if m["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
        else:
            depth = len(stack) - 1
            while depth > 0:
                open_ = stack[depth].tag
                if tag in _ENDS.get(open_, ()):
                    del stack[depth:]
                    break
                if open_ in _SCOPES or open_ in _ENDS:
                    break
                depth -= 1
            top = stack[-1]
            page.children.setdefault(top.path, []).append(tag)
            if tag not in _VOID:
                noise, claimed, names = _declared(tag, m["rest"] or "", top.inside)
                inside = top.inside or tag in _ROOTS
                within = top.claims
                if claimed:
                    within, claims = (*within, claims), claims + 1
                if tag in _ROOTS and not (noise or top.noise):
                    roots.append(within)
                step = f"{tag}.{names}" if names else tag
                stack.append(_Open(
                    tag, f"{top.path}/{step}", top.noise or noise, within, inside, not names,
                ))
        if block:
            page.pieces.append(None)
        elif tag in _SPACED:
            say(" ")
    if at < len(source):
        say(source[at:])
    _settle(page, roots)
    return page


def _settle(page: Page, roots: list[tuple[int, ...]]) -> None:
    """Decides which claims hold: not that of a branch with most of the page's text, unless an
    article or main lies outside all claims."""
    free = any(not x for x in roots)
    held: dict[int, int] = {}
    total = 0
    for piece in page.pieces:
        if piece and not piece[2]:
            size = len("".join(piece[1].split()))
            total += size
            for claim in piece[5]:
                held[claim] = held.get(claim, 0) + size
    void = set() if free else {claim for claim, size in held.items() if 2 * size > total}
    page.pieces = [
        piece and (piece[0], piece[1], piece[2] or not void.issuperset(piece[5]), *piece[3:5])
        for piece in page.pieces
    ]
    page.has_root = any(void.issuperset(x) for x in roots)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _ancestors(path: str) -> Iterator[str]:
    """A node's path and those above it, as branches."""
    at = len(path)
    while at > 0:
        yield path[:at] + "/*"
        at = path.rfind("/", 0, at)


def _said(page: Page) -> dict[str, list[str]]:
    """The texts of each node that no list declares to be noise."""
    texts: dict[str, list[str]] = {}
    for piece in page.pieces:
        if piece and not piece[2] and not piece[1].isspace():
            texts.setdefault(piece[0], []).append(" ".join(piece[1].split()))
    return texts


def node_features(page: Page) -> Iterator[tuple[int, bool, int]]:
    """(path, is content, feature) of a page, each once: arrangements of children, and texts.

    A path stands for a node's own texts; with ``/*`` behind it for all texts of its branch.
    """
    texts = _said(page)
    below: dict[str, set[int]] = {}
    for path, said in texts.items():
        found = {_number(t) for t in said}
        for branch in _ancestors(path):
            below.setdefault(branch, set()).update(found)
    for branch, found in below.items():
        number = _number(branch)
        yield number, False, _number(" ".join(page.children.get(branch[:-2], [])))
        for feature in found:
            yield number, True, feature
    for path, said in texts.items():
        number = _number(path)
        yield number, False, _number(" ".join(page.children.get(path, [])))
        for feature in {_number(t) for t in said}:
            yield number, True, feature


def same_article(page: Page) -> int:
    """A number that copies of a page share: of the texts of its articles, or of all if it has none."""
    texts = [" ".join(p[1].split()) for p in page.pieces if p and not p[2] and (p[3] or not page.has_root)]
    return _number("\n".join(t for t in texts if t))


def main_text(source: str, low: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the branches that are left, joined by an empty line.

    An article or main, where there is one, is all of the text; the tree never empties it.
    """
    page = parse(source)
    known: dict[str, bool] = {}
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(open_)).split())
        if text:
            blocks.append(text)
        open_.clear()

    for piece in page.pieces:
        if piece is None:
            end()
            continue
        path, text, noise, inside, plain = piece
        if noise or (page.has_root and not inside):
            continue
        if low:
            # Plain words marked within a paragraph of an article stay or go with it.
            while inside and plain and (cut := path.rfind("/")) > 0 and path[cut + 1:] in _INLINE:
                path = path[:cut]
            if path not in known:
                known[path] = _number(path) in low or any(_number(x) in low for x in _ancestors(path))
            if known[path]:
                continue
        open_.append(text)
    end()
    if low and page.has_root and not blocks:
        return main_text(source)
    return "\n\n".join(blocks)


_SEEN = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("source", T.LongType()),
    T.StructField("article", T.LongType()), T.StructField("template", T.LongType()),
    T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("paths", T.ArrayType(T.LongType())),
    T.StructField("contents", T.ArrayType(T.BooleanType())), T.StructField("features", T.ArrayType(T.LongType())),
])
_KINDS = (
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
    pa.list_(pa.bool_()), pa.list_(pa.int64()),
)
# Pages parsed at a time.
_STEP = 256


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _STEP):
            batch = whole.slice(at, _STEP)
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source or "")
                nodes = page_nodes(page)
                paths, contents, features = zip(*node_features(page), strict=True) if nodes else ((), (), ())
                rows.append((
                    host, _number(source or ""), same_article(page), _template(nodes), list(nodes),
                    paths, contents, features,
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_SEEN.names
            )


def parsed_pages(pages: DataFrame) -> DataFrame:
    """What the tree needs of each page, as numbers, stored: every page is parsed once for it."""
    seen = pages.select("host", "html").mapInArrow(_parsed, _SEEN)
    return stored(seen.withColumn("row", F.monotonically_increasing_id()), "parsed-pages")


def style_tree(seen: DataFrame) -> DataFrame:
    """(host, path, on, importance) of the nodes of each host's merged tree.

    Pages of a host with the same article are one page, of which that with the smallest number
    stands for all. ``on`` is the number of pages with the node. A feature on n of m pages has
    the entropy log n / log m; the node's content counts for one minus the mean of its features'
    entropies, its presentation for the entropy of its arrangements.
    """
    first = seen.groupBy("host", "article").agg(F.min(F.struct("source", "row")).alias("first"))
    one = seen.join(first.select("first.row"), "row", "left_semi")
    zipped = F.explode(F.arrays_zip("paths", "contents", "features")).alias("f")
    features = one.select("host", zipped).groupBy(
        "host", F.col("f.paths").alias("path"), F.col("f.contents").alias("is_content"),
        F.col("f.features").alias("feature"),
    ).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    sums = features.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("is_content"), n)).alias("on"),
        F.sum(F.when(~F.col("is_content"), n * F.log(n))).alias("n_log_n"),
        F.avg(F.when(F.col("is_content"), F.log(n))).alias("mean_log"),
    )
    scale = F.log("on")
    presentation = 1 - F.col("n_log_n") / (F.col("on") * scale)
    content = 1 - F.coalesce("mean_log", F.lit(0.0)) / scale
    importance = (1 - CONTENT_WEIGHT) * presentation + CONTENT_WEIGHT * content
    return sums.select(
        "host", "path", F.col("on").cast("long").alias("on"),
        F.when(F.col("on") <= 1, 1.0).otherwise(importance).alias("importance"),
    )


def page_nodes(page: Page) -> set[int]:
    """The numbers of a page's nodes and branches with text."""
    paths = {p[0] for p in page.pieces if p and not p[2] and not p[1].isspace()}
    return {_number(x) for x in paths.union(*map(_ancestors, paths))}


def _template(nodes: set[int]) -> int:
    return _number(",".join(map(str, sorted(nodes))))


def low_branches(
    pages: DataFrame, *, low: float = LOW_IMPORTANCE, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, template, low): the paths to remove from the pages with just these nodes.

    A list holds no more than one page's nodes, however many a host has.
    """
    seen = parsed_pages(pages)
    judged = style_tree(seen).filter((F.col("on") >= min_pages) & (F.col("importance") < low))
    paths = seen.select("host", "template", F.explode("nodes").alias("path")).distinct()
    return paths.join(judged.select("host", "path"), ["host", "path"]).groupBy("host", "template").agg(
        F.collect_list("path").alias("low")
    )


def extract_main_text(pages: DataFrame, **params) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, whole pages read.

    A NULL or empty html gives an empty text. Pages without an address form one host. Repeated
    rows are returned each and count as one page in the tree; other columns are not looked at; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    # Stored, so that Spark knows its size when it chooses how to join it.
    branches = stored(low_branches(rows, **params), "low-branches")
    schema = T.StructType([
        *[f for f in rows.schema if f.name in ("page_id", "url")],
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                sources, lows = (batch.column(i).to_pylist() for i in (2, 3))
                texts = [main_text(s or "", set(x or ())) for s, x in zip(sources, lows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=schema.names,
                )

    marked = T.StructType([*rows.schema.fields, T.StructField("template", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                numbers = [_template(page_nodes(parse(s or ""))) for s in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=marked.names)

    joined = rows.mapInArrow(mark, marked).join(branches, ["host", "template"], "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(run, schema)
