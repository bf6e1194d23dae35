"""Main text of web pages by a style tree per site.

All pages of a host are merged into one tree of styled paths. A path whose presentation and content
hardly vary between the pages (low entropy) is template; a branch of a page made of such paths only
is removed, as is every branch that its tag or class names as something other than the article.
"""

from __future__ import annotations

import html
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# A path is judged from this many different pages on, and is template below this importance.
MIN_PAGES = 8
MIN_IMPORTANCE = 0.35
# The share of the content in a path's importance; the rest is its presentation.
CONTENT_SHARE = 0.9
# A path inside one of these counts as so much more important. Outside, on a page that has one, a
# path needs so much more; where it cannot be judged, the tag decides.
ARTICLE = {"article", "main"}
PRIOR = 0.2

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|textarea|iframe|svg|object|canvas|math|xmp|noembed"
# An element of the key's kind closes an open one of the set when it starts.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = {"ul", "ol", "menu", "dl", "table", "select", "article", "body", "html"}

# Elements and class words that are not the article.
DROP_TAGS = set("head title nav header footer aside form button select menu dialog search label fieldset".split())
DROP_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside rail ad ads adv advert adverts "
    "advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments "
    "commentlist reply replies respond disqus discussion form search login widget copyright disclaimer "
    "toolbar pagination pager skip".split()
)
DROP_ROLES = set("navigation banner contentinfo complementary search alert dialog form menu".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
# Class names that say what a layout has, not what the element is.
_MODIFIER = re.compile(r"(?:has|no|with|without)-")


class Node(NamedTuple):
    """An element, by number: its parent's number, styled path and roles."""

    parent: int
    path: int
    dropped: bool
    article: bool
    by_part: bool = False  # named as no part of the article, but only by a part of a class name


class Page(NamedTuple):
    """The elements of a page in order, and its texts as (element, text); None ends a block."""

    nodes: list[Node]
    texts: list[tuple[int, str | None]]


def _style(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """The styled name of an element, whether it is named as no part of the article, or its name has such a part."""
    found = {}
    if attrs:
        for m in _ATTR.finditer(attrs):
            found[m[1].lower()] = (m[2] or m[3] or m[4] or "").lower()
    whole = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = _WORD.findall(" ".join(w for w in whole if not _MODIFIER.match(w)))
    dropped = tag in DROP_TAGS or found.get("role") in DROP_ROLES
    classes = sorted(found.get("class", "").split())
    if tag in ARTICLE:  # only by whole class names, as in class="comment"
        whole = parts = classes
    if tag not in ("body", "html"):
        dropped = dropped or any(w in DROP_WORDS for w in whole)
        by_part = not dropped and any(w in DROP_WORDS for w in parts)
    else:
        by_part = False
    return f"{tag}.{'.'.join(classes)}", dropped, by_part


def parse(source: str) -> Page:
    """Read markup leniently: unclosed, misnested and cut-off elements are accepted."""
    nodes = [Node(-1, 0, False, False)]
    texts: list[tuple[int, str | None]] = []
    open_: list[tuple[str, int]] = [("", 0)]
    kept: dict[tuple[int, str], int] = {}
    at = 0

    def text(piece: str) -> None:
        if piece:
            texts.append((open_[-1][1], html.unescape(piece)))

    def close(names, until=()) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth][0] in names:
                del open_[depth:]
                return
            if open_[depth][0] in until:
                return

    for m in _TOKEN.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            texts.append((open_[-1][1], None))
        if m["end"]:
            close((tag,))
            continue
        if tag in BLOCK and tag != "br":
            close(("p",), SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES)
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        name, dropped, by_part = _style(tag, m["attrs"])
        parent = open_[-1][1]
        above = nodes[parent]
        key = (above.path, name)
        if key not in kept:
            kept[key] = zlib.crc32(name.encode(), above.path)
        nodes.append(
            Node(parent, kept[key], above.dropped or dropped, above.article or tag in ARTICLE, by_part)
        )
        open_.append((tag, len(nodes) - 1))
    text(source[at:])
    return Page(_named(nodes, texts), texts)


def _named(nodes: list[Node], texts: list[tuple[int, str | None]]) -> list[Node]:
    """The elements, dropped by parts of names too, but never with an article of half of the text."""
    if not any(n.by_part for n in nodes):
        return nodes
    size = [0] * len(nodes)
    for at, piece in texts:
        if piece and not nodes[at].dropped:
            size[at] += len(piece.strip())
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
    holds = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        outermost = n.article and not nodes[n.parent].article and not n.dropped
        holds[k] = holds[k] or (outermost and 2 * size[k] >= size[0])
        holds[n.parent] = holds[n.parent] or holds[k]
    out = list(nodes)
    for k in range(1, len(out)):
        gone = out[out[k].parent].dropped or (nodes[k].by_part and not holds[k])
        if gone and not out[k].dropped:
            out[k] = out[k]._replace(dropped=True)
    return out


def features(source: str) -> list[tuple[int, int, int, int, bool]]:
    """(page, path, presentation, content) hashes of a page's styled paths, and whether in an article.

    The presentation of a path is the set of its children's paths, its content the texts of its
    elements in order.
    """
    page = parse(source)
    style: dict[int, set[int]] = {}
    content: dict[int, int] = {}
    article = {n.path: n.article for n in page.nodes}
    for node in page.nodes[1:]:
        style.setdefault(page.nodes[node.parent].path, set()).add(node.path)
        style.setdefault(node.path, set())
        content.setdefault(node.path, 0)
    for at, piece in page.texts:
        if piece and not piece.isspace():
            path = page.nodes[at].path
            content[path] = zlib.crc32(piece.strip().encode("utf-8", "replace"), content.get(path, 0))
    whole = zlib.crc32(source.encode("utf-8", "replace"))
    return [
        (whole, path, hash(tuple(sorted(style[path]))), content.get(path, 0), article[path]) for path in style if path
    ]


def extract(source: str, template: frozenset[int] = frozenset(), telling: frozenset[int] = frozenset()) -> str:
    """The text of the article: one block a line.

    ``template`` holds the host's paths of low importance; a branch goes if all its paths are among
    them. ``telling`` are paths outside articles that stay on a page that has an article.
    """
    page = parse(source)
    low = [False] * len(page.nodes)
    if template:
        low = [n.path in template for n in page.nodes]
        for k in range(len(page.nodes) - 1, 0, -1):  # children follow their parents
            if not low[k]:
                low[page.nodes[k].parent] = False
        for k in range(1, len(page.nodes)):
            low[k] = low[k] or low[page.nodes[k].parent]
    inside = any(n.article and not n.dropped for n in page.nodes)
    kept = []
    for at, piece in page.texts:
        node = page.nodes[at]
        if piece is None or not (node.dropped or low[at] or (inside and not node.article and node.path not in telling)):
            kept.append(piece)
    blocks = (" ".join(b.split()) for b in _blocks(kept))
    return "\n".join(b for b in blocks if b)


def _blocks(pieces: list[str | None]):
    """Join the pieces between the ends of blocks."""
    held: list[str] = []
    for piece in pieces:
        if piece is None:
            yield "".join(held)
            held = []
        else:
            held.append(piece)
    yield "".join(held)


def host_of(url) -> F.Column:
    """The host of a URL in lower case; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(found)


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged style trees: host, path, n_pages, article and importance in 0..1 of every styled path.

    Equal pages of a host count once. The importance is the entropy of a path's contents over the
    pages, mixed with that of its presentations, each divided by the entropy of all pages differing.
    """

    def read(batches):
        names = ["host", "page", "path", "style", "content", "article"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = [
                (host.as_py(), *row)
                for host, source in zip(batch.column(0), batch.column(1))
                for row in features(source.as_py() or "")
            ]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    source = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    rows = source.where("host <> ''").mapInArrow(
        read, "host string, page long, path long, style long, content long, article boolean"
    )
    rows = rows.distinct()

    def entropy(column: str) -> DataFrame:
        each = rows.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("n"), F.max("article").alias("article"))
        return each.groupBy("host", "path").agg(
            F.sum("n").alias("n_pages"),
            F.max("article").alias("article"),
            F.sum(F.col("n") * F.log("n")).alias("weight"),
        )

    def relative(weight: str, n: str):
        # log(m) - sum(n log n) / m is the entropy of the counts n with the sum m.
        return F.when(
            F.col(n) > 1, (F.log(n) - F.col(weight) / F.col(n)) / F.log(n)
        ).otherwise(F.lit(1.0))

    content = entropy("content")
    style = entropy("style").select("host", "path", F.col("weight").alias("style_weight"))
    return content.join(style, ["host", "path"]).select(
        "host",
        "path",
        "n_pages",
        "article",
        (
            CONTENT_SHARE * relative("weight", "n_pages")
            + (1 - CONTENT_SHARE) * relative("style_weight", "n_pages")
        ).alias("importance"),
    )


def extract_pages(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    min_importance: float = MIN_IMPORTANCE,
    scratch: Scratch | None = None,
) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    ``pages`` has page_id, url and html. Null or empty html gives an empty text; pages without a
    host in their URL are judged by the names of their elements alone. Equal rows stay as often as
    they occur, other columns are ignored, an empty table gives no rows.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    prior = F.when(F.col("article"), F.lit(PRIOR)).otherwise(F.lit(0.0))
    template = F.col("importance") + prior < min_importance
    telling = ~F.col("article") & (F.col("importance") >= min_importance + PRIOR)
    judged = style_tree(pages).where(F.col("n_pages") >= min_pages).where(template | telling)
    # One row per host, with the paths of its templates and those that stay outside articles; Spark broadcasts it where it is small
    # and splits a hot host where it is not.
    lists = [F.collect_list(F.when(c, F.col("path"))).alias(k) for k, c in (("paths", template), ("telling", telling))]
    low = scratch.write(judged.groupBy("host").agg(*lists), "template")
    own = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    joined = own.join(low, "host", "left").select("page_id", "url", "html", "paths", "telling")

    def take(batches):
        sets: dict = {}
        for batch in batches:
            texts = []
            for source, paths, telling in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                key = tuple(paths or ()), tuple(telling or ())
                if key not in sets:
                    sets = {key: (frozenset(key[0]), frozenset(key[1]))}
                texts.append(extract(source.as_py() or "", *sets[key]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    types = dict(joined.dtypes)
    return joined.mapInArrow(
        take, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    )
