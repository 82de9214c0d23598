"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores positive, more so in surroundings that are content on labelled pages; a tag
scores negative, more so if it is seldom within content there. A linear scan finds the contiguous region of the highest score; it
is widened to the element that holds it. Names of classes have no part in that: they only tell what is left out of the region
(adverts, notices, comments within it), and have the scan repeated without what they mark if that is most of the region.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_texts, unit_hash

# HTML's elements by how their text counts.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label output picture source".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption".split())
OTHER_BLOCKS = frozenset("html body main article section div header footer nav aside form ul ol dl table thead tbody tfoot tr figure address fieldset hr br details summary center dialog menu".split())
NOT_CONTENT = frozenset("head nav footer aside form script style noscript template svg math iframe object button select textarea title dialog menu audio video canvas map noembed noframes xmp datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit adcontainer adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion cookie cookies "
    "consent gdpr notice notices disclaimer announcement notification notifications alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars rail "
    "widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond replies share "
    "sharing social related recommended recommendations trending toolbar pagination pager login copyright masthead topbar header".split()
)
#: A word of a class or id after one of these says what a page has or lacks, not what the element is.
ABOUT = frozenset("has no with without is show hide".split())
#: An element that begins one of these ends an open paragraph; and what ends an open element of the same list.
ENDS_P = (TEXT_BLOCKS | OTHER_BLOCKS) - {"br", "td", "th", "caption", "html", "body", "tr", "thead", "tbody", "tfoot"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

MARKUP = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*+>)""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Scores without labelled pages.
PLAIN_IN, LINK_IN, TAG_IN = 0.9, 0.2, 0.5


@dataclass
class Weights:
    """Of words by (block, in a link) and of tags by name: the share of them that is within content on labelled pages."""

    words: dict[tuple[str, bool], float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, block: str, link: bool) -> float:
        """Positive: up to 1."""
        return max(0.02, 2.0 * self.words.get((block, link), LINK_IN if link else PLAIN_IN) - 1.0)

    def tag(self, name: str) -> float:
        """Negative: -1 for a tag that is always within content, to -4."""
        return -4.0 + 3.0 * self.tags.get(name, TAG_IN)


@dataclass
class Node:
    name: str
    out: bool  # no content by its element, itself or by what holds it
    marked: bool  # no content by the words of its class or id, itself or by what holds it
    link: bool
    block: str
    parent: Node | None
    first: int = 0  # tokens from first to before last are its own
    last: int = -1


@dataclass
class Token:
    text: str | None  # of a text
    name: str  # of a tag
    node: Node
    words: int = 0


def left_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't content, by its name, role and what hides it; inside: within an article or the main element."""
    if name in NOT_CONTENT:
        return True
    if name == "header":
        return not inside
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
    return False


def marked_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether the words of an element's class or id say that it isn't content."""
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            value = value.strip("\"'")
            for own in value.split():
                parts = [p.lower() for p in PARTS.findall(own)]
                for before, p in zip([""] + parts, parts, strict=False):
                    if p in CLASS_WORDS and before not in ABOUT and not (p == "header" and inside) and not (name == "article" and p not in ("comment", "comments")):
                        return True
    return False


def tokens(page: str, attributes_count: bool = True) -> list[Token]:
    """Texts and tags in page order. Comments, scripts and tags that the page's end cuts off are none."""
    root = Node("", False, False, False, "", None)
    top, open_, out, at = root, defaultdict(int), [], 0

    def close(until: Node) -> None:
        nonlocal top
        while top is not until:
            open_[top.name] -= 1
            top.last = len(out)
            top = top.parent

    def nearest(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> Node | None:
        if not any(open_[n] for n in names):
            return None
        node = top
        while node is not root and node.name not in stop:
            if node.name in names:
                return node
            node = node.parent
        return None

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            out.append(Token(plain, "", top, len(plain.split())))

    closed = page.rfind(">")  # no markup ends beyond it
    while at < len(page):
        m = MARKUP.search(page, at, closed + 1)
        if not m:
            cut = re.search(r"<[a-zA-Z/!?][^<]*$", page[at:])
            text(page[at : at + cut.start()] if cut else page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2)
            at = len(page) if end < 0 else end + 3
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            node = nearest((name,), ("table",) if name not in ("table", "body", "html") else ())
            if node is not None:
                close(node.parent)
                out.append(Token(None, name, top))
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            after = page.find(">", end.start()) if end else -1
            at = after + 1 if after >= 0 else len(page)
            continue
        if name in ENDS_P and (p := nearest(("p",), ("table", "article", "section"))):
            close(p.parent)
        if name in SIBLINGS and (other := nearest(SIBLINGS[name], HOLDERS[name])):
            close(other.parent)
        inside = bool(open_["article"] or open_["main"])
        out_ = top.out or (left_out(name, attributes, inside) if attributes_count else name in NOT_CONTENT)
        node = Node(name, out_, top.marked or (attributes_count and marked_out(name, attributes, inside)), top.link or name == "a", name if name in TEXT_BLOCKS or name in OTHER_BLOCKS else top.block, top, len(out))
        out.append(Token(None, name, top if name in VOID else node))
        if name not in VOID and not attributes.endswith("/"):
            top = node
            open_[name] += 1
    close(root)
    root.last = len(out)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest positive sum, in one scan; (0, 0) if there is none. The first of equals."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0.0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def _scores(page: list[Token], weights: Weights, marks: bool) -> list[float]:
    return [0.0 if t.node.out or marks and t.node.marked else t.words * weights.word(t.node.block, t.node.link) if t.text is not None else weights.tag(t.name) for t in page]


def _container(page: list[Token], start: int, end: int) -> Node:
    """The deepest element that holds a region and isn't a text block, a list or part of a table."""
    texts = [i for i in range(start, end) if page[i].text is not None and page[i].words and not page[i].node.out]
    node = page[texts[0]].node if texts else page[start].node
    while node.parent is not None and not (node.first <= start and end <= node.last and node.name not in TEXT_BLOCKS and node.name not in INLINE and node.name not in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr")):
        node = node.parent
    return node


def _widened(page: list[Token], start: int, end: int) -> tuple[int, int]:
    """A region widened to its container; in the body itself, over adjoining paragraphs and headings."""
    node = _container(page, start, end)
    if node.parent is not None and node.name not in ("body", "html"):
        return node.first, node.last
    plain = lambda t: t.node.out or not t.words and (t.text is not None or t.name in TEXT_BLOCKS or t.name in INLINE or t.name in ("br", "hr")) or t.words and not t.node.link and (t.node.block in TEXT_BLOCKS and t.node.block not in ("li", "td", "th"))
    while start > 0 and plain(page[start - 1]):
        start -= 1
    while end < len(page) and plain(page[end]):
        end += 1
    return start, end


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, joined by line feeds, each with its white space made one space. Empty if there is none."""
    if not page:
        return ""
    found, drop = tokens(page), True
    start, end = best_region(_scores(found, weights, False))
    words = lambda marked: sum(t.words for t in found[start:end] if t.text is not None and not t.node.out and t.node.marked == marked)
    if words(True) > words(False):
        start, end = best_region(_scores(found, weights, True))
    if start >= end:  # names that leave nothing mislead
        found, drop = tokens(page, False), False
        start, end = best_region(_scores(found, weights, False))
    if start >= end:
        return ""
    start, end = _widened(found, start, end)
    blocks, parts = [], []
    for t in found[start:end]:
        if t.text is None:
            if t.name == "br" and not (t.node.out or drop and t.node.marked):
                parts.append(" ")
            elif t.name not in INLINE:
                blocks.append("".join(parts))
                parts = []
        elif not (t.node.out or drop and t.node.marked):
            parts.append(t.text)
    blocks.append("".join(parts))
    return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def counted(page: str) -> dict[tuple[str, str, bool], list[int]]:
    """Of a labelled page, by (kind, name, in a link): words or tags in all, and within its article or main element's content."""
    out: dict[tuple[str, str, bool], list[int]] = {}
    holds: dict[int, bool] = {}

    def within(node: Node | None) -> bool:
        path = []
        while node is not None and id(node) not in holds:
            path.append(node)
            if node.name in ("article", "main"):
                holds[id(node)] = True
                break
            node = node.parent
        known = holds.get(id(node), False) if node is not None else False
        for n in path:
            holds.setdefault(id(n), known)
        return known

    for t in tokens(page):
        n = t.words if t.text is not None else 1
        if n:
            key = ("word", t.node.block, t.node.link) if t.text is not None else ("tag", t.name, False)
            count = out.setdefault(key, [0, 0])
            count[0] += n
            count[1] += n * (not t.node.out and not t.node.marked and within(t.node) and t.name not in ("article", "main"))
    return out


LABELLED = re.compile(r"<(?:article|main)[\s>]", re.I)
KNOWN = INLINE | TEXT_BLOCKS | OTHER_BLOCKS | NOT_CONTENT | VOID | {""}


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", fit_pages: int = 2000) -> Weights:
    """Weights from the labelled pages, which mark their content as an article or main element, among fit_pages pages.

    These are the pages whose key's hash is below a threshold, which is counted so that there are about as many, however large the
    table; pages without a key aren't among them. Counts are of HTML's own elements only, so that what comes to the driver stays
    as small. Without labelled pages the weights are those set above.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.where(F.col(key).isNotNull()).count()
    some = pages.where(F.col(key).isNotNull() & (unit_hash(F.col(key), "pages") < min(1.0, fit_pages / max(1, rows)))).select(F.col(page).alias("page"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, bool], list[int]] = {}
        for b in batches:
            for p in b.column(0).to_pylist():
                if p and LABELLED.search(p):
                    for k, (n, m) in counted(p).items():
                        if k[1] in KNOWN:
                            s = sums.setdefault(k, [0, 0])
                            s[0] += n
                            s[1] += m
        rows = [(*k, *v) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["kind", "name", "link", "n", "m"])

    rows = some.mapInArrow(count, "kind string, name string, link boolean, n long, m long").groupBy("kind", "name", "link").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
    share = lambda r, prior: (r["m"] + 5.0 * prior) / (r["n"] + 5.0)
    return Weights(
        {(r["name"], r["link"]): share(r, LINK_IN if r["link"] else PLAIN_IN) for r in rows if r["kind"] == "word"},
        {r["name"]: share(r, TAG_IN) for r in rows if r["kind"] == "tag"},
    )


TEXT = T.StructType([T.StructField("main_text", T.StringType())])


def main_text(pages: DataFrame, weights: Weights, page: str = "html", keep_page: bool = True) -> DataFrame:
    """pages with main_text; empty for null and empty pages and those without content. Whole pages count.

    All rows stay, repeated ones and those of null keys too; other columns pass through, and one of the new name is replaced. An
    empty table gives no rows.
    """

    def make():
        return lambda texts: [pa.array([extract(t, weights) for t in texts], pa.string())]

    return map_texts(pages, page, TEXT, make, keep_page)
