"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold; the best one's generalised path
(tags and classes from the root, numbers masked) is the page's vote. Spark sums the votes
per host, and each page is extracted again from the containers on the strongest path of
its host that it has; a page without any falls back on its own best container.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.base import arrow, cut

#: HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article body div main section td".split())
NOT_TEXT = frozenset("nav header footer aside form button select menu dialog fieldset audio video canvas object head figure-none".split())
#: Words in classes, ids and roles of what isn't the article.
NOT_TEXT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share captcha comment comments consent contentinfo complementary
    cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification
    pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription tags toolbar widget widgets""".split()
)
TEXT_WORDS = frozenset("article body content entry main post story text".split())
#: A start tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = frozenset("ul ol dl table select".split())

#: The bound only keeps the usual tag in the pattern: what it leaves goes through _tag_end.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]{0,8192}"|'[^']{0,8192}'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
_MARK = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d+")


@dataclass
class Node:
    tag: str
    parent: int
    path: str
    skip: bool
    score: float = 0.0
    links: int = 0
    size: int = 0
    bonus: float = 1.0


@dataclass
class Page:
    """nodes in page order; runs: (node, text or None where a block begins or ends)."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" \t\r\n/") else {}


def _open(page: Page, parent: int, tag: str, raw: str) -> int:
    attrs = _attributes(raw)
    up = page.nodes[parent] if parent >= 0 else None
    classes = sorted(_NUMBER.sub("#", entities.unescape(attrs.get("class", ""))).split())
    step = tag + "".join("." + c for c in classes)
    words = {w.lower() for w in _WORDS.findall(" ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))))} if attrs else set()
    skip = bool(up and up.skip) or tag in NOT_TEXT
    if not skip and words and tag not in ("html", "body", "main", "article"):
        skip = not words.isdisjoint(NOT_TEXT_WORDS)
    if not skip and attrs:
        style = attrs.get("style", "").replace(" ", "").lower()
        skip = "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or (attrs.get("aria-hidden") == "true" and tag in CONTAINER)
    bonus = 1.0
    if tag in ("article", "main") or not words.isdisjoint(TEXT_WORDS):
        bonus = 1.25
    elif tag in ("body", "html"):
        bonus = 0.6
    page.nodes.append(Node(tag, parent, f"{up.path}>{step}" if up else step, skip, bonus=bonus))
    return len(page.nodes) - 1


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where the `>` stands that ends a tag, outside quotes; -1 if a quote or the tag never
    closes. dead: opening quotes from which no end is reached, so that none is tried twice."""
    tried = []
    while m := _MARK.search(source, at):
        at = m.start()
        if m[0] == ">":
            return at
        if at in dead:
            break
        tried.append(at)
        at = source.find(m[0], at + 1) + 1
        if not at:
            break
    dead.update(tried)
    return -1


def parse(source: str) -> Page:
    """Reads markup as browsers roughly do: unclosed and stray tags are put up with, an
    incomplete tag at the end is dropped, character references stay for later."""
    page = Page()
    stack = [_open(page, -1, "#root", "")]
    page.nodes[0].path = ""
    at, n, lowered = 0, len(source), None
    dead: set[int] = set()

    def block() -> None:
        page.runs.append((stack[-1], None))

    def close(tag: str, stops: frozenset) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            t = page.nodes[stack[i]].tag
            if t == tag:
                del stack[i:]
                return True
            if t in stops:
                return False
        return False

    while at < n:
        m = _TAG.search(source, at)
        end = m.start() if m else n
        if end > at:
            page.runs.append((stack[-1], source[at:end]))
        if not m:
            break
        at, end = m.end(), -1
        if m[5]:
            end = _tag_end(source, m.end(5), dead)
            at = end + 1 or at
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    t = page.nodes[stack[i]].tag
                    if t == tag:
                        del stack[i]
                        break
                    if t not in INLINE:
                        break
            else:
                block()
                close(tag, frozenset())
                block()
            continue
        raw = m[3] if m[2] else m[6] if end < 0 else source[m.end(5) : end]
        if tag in RAW:
            if not raw.endswith("/") or tag in ("script", "style", "title", "textarea"):
                lowered = source.lower() if lowered is None else lowered
                if len(lowered) != n:  # a letter whose lower case is longer
                    lowered = "".join([c.lower() if c.isascii() else c for c in source])
                stop = lowered.find(f"</{tag}", at)
                if stop < 0:
                    at = n
                else:
                    stop = source.find(">", stop)
                    at = n if stop < 0 else stop + 1
            block()
            continue
        if tag not in INLINE:
            block()
            for x in ENDS.get(tag, ()):
                close(x, STOPS)
            # a block ends an open paragraph, and what is open within it
            for i in range(len(stack) - 1, 0, -1):
                t = page.nodes[stack[i]].tag
                if t in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (t == "p" or tag[0] == "h" and tag[1:].isdigit()):
                    del stack[i:]
                    break
                if t not in INLINE and t not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    break
        if tag in VOID:
            continue
        stack.append(_open(page, stack[-1], tag, raw))
        if tag not in INLINE:
            block()
        elif raw.endswith("/"):
            stack.pop()
    return page


def score(page: Page) -> int:
    """The node of the best container, -1 if the page has no text. Text counts for the
    containers around it, less the farther out; linked text counts against them."""
    for node, text in page.runs:
        if text is None or page.nodes[node].skip:
            continue
        size = len(text.strip())
        if not size:
            continue
        linked, i, weight = False, node, 1.0
        while i >= 0:
            x = page.nodes[i]
            linked |= x.tag == "a"
            if x.tag in CONTAINER or not i:
                x.size += size
                if linked:
                    x.links += size
                else:
                    x.score += weight * size
                    weight *= 0.85
            i = x.parent
    best, top = -1, 0.0
    for i, x in enumerate(page.nodes):
        if (x.tag in CONTAINER or not i) and x.size:
            s = x.score * x.bonus * (1 - 0.5 * x.links / x.size) * (0.5 if not i else 1.0)
            if s > top:
                best, top = i, s
    return best


def text_of(page: Page, chosen: list[int]) -> str:
    """Text within the chosen nodes, blocks joined by one blank."""
    if not chosen:
        return ""
    inside = [False] * len(page.nodes)
    pick = set(chosen)
    for i, x in enumerate(page.nodes):  # parents stand before their children
        inside[i] = (i in pick or (x.parent >= 0 and inside[x.parent])) and not (x.skip and i not in pick)
    parts = []
    for node, text in page.runs:
        if inside[node]:
            parts.append(" " if text is None else text)
    joined = "".join(parts)
    return " ".join((entities.unescape(joined) if "&" in joined else joined).split())


def outermost(page: Page, path: str) -> list[int]:
    """Nodes on a path that aren't within another one or within what isn't text."""
    found: list[int] = []
    within = [False] * len(page.nodes)
    for i, x in enumerate(page.nodes):
        up = x.parent >= 0 and within[x.parent]
        if x.path == path and not up and not x.skip:
            found.append(i)
        within[i] = up or (x.path == path and not x.skip)
    return found


def host_of(url: str | None) -> str:
    """Lower-case host without port; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@dataclass(frozen=True)
class HtmlParams:
    """paths: how many of a host's paths, by votes, are tried on a page; a path needs
    least_share of its host's votes."""

    paths: int = 3
    least_share: float = 0.05


def votes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, size) of each page's best container."""

    def vote(batches):
        for batch in batches:
            host, path, size = [], [], []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(h.as_py() or "")
                best = score(page)
                if best >= 0:
                    host.append(host_of(u))
                    path.append(page.nodes[best].path)
                    size.append(page.nodes[best].size)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(size, pa.int64())], ["host", "path", "size"])

    return arrow(pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")), vote, "host string, path string, size long")


def winning_paths(ballots: DataFrame, p: HtmlParams) -> DataFrame:
    """(host, paths): a host's strongest paths, most votes first; a vote is a page."""
    sums = ballots.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("size"), "path")
    ranked = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.paths)
    top = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "path", "n"))).alias("best"))
    strong = F.filter("best", lambda b: b["n"] >= p.least_share * F.element_at("best", 1)["n"])
    return top.select("host", F.transform(strong, lambda b: b["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: HtmlParams | None = None) -> DataFrame:
    """(id, url, text, n_chars, path) of every page.

    Null or empty html gives an empty text; pages with a null or invalid url share the host
    of no name. Rows that repeat are repeated; an empty table is empty. Paths with as many votes
    rank by text, then by name; other columns, whatever their names, play no part. path is the
    path used.
    """
    p = params or HtmlParams()
    # a table of its own: Spark knows its size, broadcasts it where that is small, and otherwise
    # splits a host whose pages fill a partition, as it can where both sides are shuffled anew
    winners = cut(winning_paths(votes(pages, url_col, html_col), p).withColumnRenamed("host", "_host"), "paths")
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")

    def hosts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], ["id", "url", "html", "_host"])

    def run(batches):
        for batch in batches:
            text, used = [], []
            for h, paths in zip(batch.column("html"), batch.column("paths").to_pylist()):
                page = parse(h.as_py() or "")
                got, path = "", ""
                for w in paths or []:
                    got, path = text_of(page, outermost(page, w)), w
                    if got:
                        break
                if not got:
                    best = score(page)
                    if best >= 0:
                        got, path = text_of(page, [best]), page.nodes[best].path
                text.append(got)
                used.append(path if got else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(used, pa.string())], ["id", "url", "text", "n_chars", "path"])

    placed = arrow(pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html")), hosts, f"id {kind}, url string, html string, _host string")
    return arrow(placed.join(winners, "_host", "left").select("id", "url", "html", "paths"), run, f"id {kind}, url string, text string, n_chars long, path string")
