"""Main text of web pages: what a site repeats goes, what is left is the article.

First pass: each page becomes a tree (implied ends of paragraphs, list items and cells; unclosed tags
end with their parent), and each element that could be furniture is hashed with all that is in it (tags
and text, no attributes). Spark counts a host's hashes. A hash is a template where

* ``min_pages`` different pages of the host have it, and ``min_share`` of the host's different pages, and
* its pages are mostly different ones: pages whose longest block has the same smallest shingle count as one,
  so what recurs only because an article was copied, or copied and edited, is no template.

Second pass: template subtrees are deleted. Markup settles what recurrence cannot (a host of one page):
scripts, forms and navigation by their tags, menus, notices, adverts, comments by their class, id or role, hidden
elements, lists of links. Where a page marks its article, only the article is searched, and paragraphs in it
are no candidates: a sentence that many articles quote stays. Left blocks follow page order.

Templates found are sent to all tasks as sorted 64-bit keys while they fit ``room_bytes``. Beyond that each page
sends the keys of its candidates, templates meet them in a join, and pages get their own list back. Counts are
combined in the task and again before the shuffle, so a host with a third of all pages is no hot key.

Cases: null html is an empty page (text ''); a null url belongs to the host ''. A tag or comment that never
ends reaches to the end of the page. Pages of any length and depth are read whole, without recursion; repeated
rows get the same result each; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import Scratch, per_batch, shingles, word_hashes

# Element kinds of HTML, and the words sites name their furniture with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav noscript ol optgroup option p pre search section select summary table tbody template tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset("nav aside footer form noscript template svg math object canvas audio video button select option datalist dialog menu head applet map".split())
PROSE = frozenset("p blockquote pre figure figcaption caption ul ol li dl dt dd table thead tbody tfoot tr details summary address".split()) | HEADING
SURE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments "
    "disqus respond newsletter subscribe popup modal related recommended recommendations pagination pager masthead".split()
)
LIKELY = frozenset(
    "header banner notice notices alert promo promotion share sharing social widget widgets toolbar login signup search teaser teasers skip overlay toast disclaimer copyright reply replies topbar tags hidden "
    "complementary contentinfo".split()
)
# What an element of this kind ends when it begins, and where that stops.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("table",))),
    "th": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "body": (frozenset(("head",)), frozenset()),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Node:
    __slots__ = ("chars", "hint", "inside", "key", "links", "main", "parts", "role", "tag")

    def __init__(self, tag: str, attributes: str, inside: bool):
        self.tag, self.inside = tag, inside  # inside an article
        self.parts: list = []
        self.chars = self.links = self.key = 0
        self.hint, self.role, self.main = 0, None, False
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        found = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'"))
        role = found.get("role", "").lower()
        if role == "main" or "articlebody" in found.get("itemprop", "").lower():
            self.role = "main"
        elif role == "article":
            self.role = "article"
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NONE.search(found.get("style", "").lower()):
            self.hint = 3
            return
        for name in (found.get("class", ""), found.get("id", ""), role):
            for one in name.split():
                words = _WORD.findall(_CAMEL.sub(" ", one).lower())
                if words and words[0] in ("has", "with", "no", "without", "is", "js"):
                    continue
                self.hint = max(self.hint, 2 if not SURE.isdisjoint(words) else 1 if not LIKELY.isdisjoint(words) else 0)

    def close(self) -> None:
        """Sizes and the hash of all that is inside; its children are closed already."""
        h = xxhash.xxh3_64(self.tag.encode())
        for part in self.parts:
            if isinstance(part, str):
                words = " ".join(part.split())
                self.chars += len(words)
                h.update(b"\x01" + words.encode("utf-8", "replace"))
            else:
                self.chars += part.chars
                self.links += part.links
                self.main = self.main or part.main or part.is_article() or part.role == "main" or part.tag == "main"
                h.update(b"\x02" + part.key.to_bytes(8, "big"))
        if self.tag == "a":
            self.links = self.chars
        self.key = h.intdigest()

    def is_article(self) -> bool:
        return (self.tag == "article" or self.role == "article") and self.hint < 2

    def candidate(self) -> bool:
        """Whether recurrence may delete it: no page as a whole, and in an article nothing that reads as its text."""
        if not self.chars or self.tag not in BLOCK or self.tag in ("html", "body", "main", "article") or self.role or self.main:
            return False
        return not (self.inside and self.tag in PROSE and 2 * self.links < self.chars)


def tree(html: str) -> tuple[Node, list[Node]]:
    """The page's root and its elements, children before parents."""
    root = Node("html", "", False)
    stack, closed, articles = [root], [], 0
    opened: Counter = Counter()  # so the stack is searched only for what is in it

    def pop() -> None:
        nonlocal articles
        node = stack.pop()
        opened[node.tag] -= 1
        node.close()
        closed.append(node)
        articles -= node.is_article()

    def pop_to(tags: frozenset, stop: frozenset) -> None:
        if not any(opened[t] > 0 for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in stop:
                return

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            if tag in ("html", "body") or tag in VOID or opened[tag] <= 0:
                continue
            block = tag in BLOCK or tag in CELL
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
                if not block and (stack[k].tag in BLOCK or stack[k].tag in CELL):
                    break  # an inline end does not end the block around it
                if stack[k].tag in CELL and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            if end is None:
                break
            at = html.find(">", end.end())
            if at < 0:
                break
            at += 1
            continue
        if tag == "html":
            continue
        if tag in BLOCK and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in BLOCK or stack[k].tag in CELL:
                    break
        if tag in ENDS:
            pop_to(*ENDS[tag])
        if tag in VOID:
            stack[-1].parts.append("\n" if tag == "hr" else " ")
            if tag == "hr":
                stack[-1].parts.append(_BREAK)
            continue
        node = Node(tag, m.group(3), articles > 0)
        articles += node.is_article()
        stack[-1].parts.append(node)
        stack.append(node)
        opened[tag] += 1
    while stack:
        pop()
    return root, closed


_BREAK = Node("hr", "", False)
_BREAK.close()


def walk(start: Node, gone) -> list[str]:
    """Texts of the blocks under an element, in order, without the elements that ``gone`` names."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    todo: list = [start]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item is start or not gone(item):
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            elif item.tag in CELL:
                line.append(" ")
                todo.append(" ")
            todo.extend(reversed(item.parts))
    flush()
    return blocks


def main_blocks(root: Node, nodes: list[Node], template: frozenset | set) -> list[str]:
    """Blocks of the main text; ``template`` holds the hashes to delete."""
    articles = [n for n in nodes if n.is_article() and not n.inside and n.hint < 3]
    marked = articles or [n for n in nodes if (n.tag == "main" or n.role == "main") and n.hint < 3]
    if not articles and len(marked) > 1:
        within = {id(p) for n in marked for p in _below(n)}
        marked = [n for n in marked if id(n) not in within]
    marked.sort(key=_order(root))

    def gone_from(start: Node):
        soup = not marked

        def gone(n: Node) -> bool:
            if n.tag in DROPPED:
                return not n.main
            if n.tag == "header" and not start.is_article() and not n.main:
                return not any(isinstance(p, Node) and p.tag == "h1" for p in n.parts)
            if n.hint == 3:
                return True
            if n.hint == 2 and not n.main and n is not root:
                return n.tag != "body"
            if n.hint == 1 and not n.main and n.tag != "body" and 2 * n.chars <= start.chars and not any(isinstance(p, Node) and p.tag in HEADING for p in n.parts):
                return True
            if n.key in template and n.candidate():
                return True
            if soup and n.tag in BLOCK and not n.main and n.tag != "body":
                if n.links and 5 * n.links >= 3 * n.chars and (n.tag in ("ul", "ol", "li", "div", "table", "tr", "section") or n.links == n.chars):
                    return True
                if n.tag in ("p", "div", "small") and n.parts and isinstance(n.parts[0], str) and _RIGHTS.match(n.parts[0].lstrip()):
                    return True
            return False

        return gone

    out: list[str] = []
    for start in marked or [root]:
        out += walk(start, gone_from(start))
    return out


def _below(node: Node) -> Iterator[Node]:
    todo = [p for p in node.parts if isinstance(p, Node)]
    while todo:
        n = todo.pop()
        yield n
        todo += [p for p in n.parts if isinstance(p, Node)]


def _order(root: Node):
    """Page order of elements."""
    place, todo = {}, [root]
    while todo:
        n = todo.pop()
        place[id(n)] = len(place)
        todo += [p for p in reversed(n.parts) if isinstance(p, Node)]
    return lambda n: place[id(n)]


def host_of(url: str | None) -> str:
    """The host of an address, lower-cased, without port and user."""
    rest = (url or "").partition("//")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def _key(host: str, node: int) -> int:
    """64 bits of a host and a subtree, as a signed number."""
    k = xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace"), seed=node)
    return k - (1 << 64) if k >> 63 else k


def _keys(host: str, nodes: list[Node]) -> list[int]:
    return [_key(host, k) for k in sorted({n.key for n in nodes if n.candidate()})]


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(host, subtree, sketch of the page) and its pages; the host itself counts as subtree 0."""
    found, longest = [], []
    for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
        root, nodes = tree(html or "")
        host = host_of(url)
        found.append([_key(host, 0), *_keys(host, nodes)])
        longest.append(max(walk(root, lambda n: n.tag in DROPPED), key=len, default="").encode("utf-8", "replace"))
    h, count = shingles(*word_hashes(longest, lower=True), 3)
    begin = np.cumsum(count) - count
    sketch = np.zeros(len(longest), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        sketch[some] = np.minimum.reduceat(h, begin[some])
    c = Counter((keys[0], k, s) for keys, s in zip(found, sketch.view(np.int64).tolist(), strict=True) for k in keys)
    columns = [*zip(*c, strict=True)] if c else [(), (), ()]
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array(list(c.values()), pa.int64())], ["host", "k", "sketch", "n"])


def templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1) -> DataFrame:
    """Keys ``k`` of the subtrees that recur on their host."""
    counted = per_batch(pages.select("url", "html"), _count, "host long, k long, sketch long, n long", 4000, 16 << 20)
    distinct = counted.groupBy("host", "k", "sketch").agg(F.sum("n").alias("n"))
    totals = distinct.groupBy("host", "k").agg(F.count("*").alias("different"), F.sum("n").alias("pages")).filter(F.col("different") >= min_pages)
    hosts = totals.filter("host = k").select("host", F.col("different").alias("host_different"))
    met = totals.filter("host <> k").join(hosts, "host")
    return met.filter((F.col("different") >= min_share * F.col("host_different")) & (2 * F.col("different") >= F.col("pages"))).select("k")


_OUT = "page_id long, url string, text string, n_chars long"


def _texts(batch: pa.RecordBatch, template_of) -> pa.RecordBatch:
    ids, urls, texts = batch.column("page_id"), batch.column("url"), []
    for row, (url, html) in enumerate(zip(urls.to_pylist(), batch.column("html").to_pylist(), strict=True)):
        root, nodes = tree(html or "")
        host = host_of(url)
        keys = {n.key: _key(host, n.key) for n in nodes if n.candidate()}
        known = template_of(row, np.array(list(keys.values()), np.int64)) if keys else ()
        texts.append("\n".join(main_blocks(root, nodes, {n for n, hit in zip(keys, known, strict=True) if hit})))
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, room_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = Scratch(spark, "html-text").table(templates(rows, min_pages, min_share), "templates")
    if 8 * found.count() <= room_bytes:
        sent = spark.sparkContext.broadcast(np.sort(found.toArrow().column("k").to_numpy()))

        def known(_, keys: np.ndarray) -> np.ndarray:
            all_keys = sent.value
            at = np.searchsorted(all_keys, keys)
            return all_keys[np.minimum(at, len(all_keys) - 1)] == keys if len(all_keys) else np.zeros(len(keys), bool)

        return per_batch(rows, lambda b: [_texts(b, known)], _OUT, 1000)
    return _by_join(rows, found)


def _by_join(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same where templates are too many for one machine: each page gets its own."""
    keyed = rows.withColumn("_h1", F.xxhash64("html")).withColumn("_h2", F.xxhash64(F.coalesce("url", F.lit("")), "html"))

    def candidates(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for h1, h2, url, html in zip(*(batch.column(c).to_pylist() for c in ("_h1", "_h2", "url", "html")), strict=True):
            out += [(h1, h2, k) for k in _keys(host_of(url), tree(html)[1])]
        columns = [*zip(*dict.fromkeys(out), strict=True)] if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["_h1", "_h2", "k"])

    own = per_batch(keyed.drop("page_id"), candidates, "_h1 long, _h2 long, k long", 1000).join(found, "k", "left_semi")
    own = own.groupBy("_h1", "_h2").agg(F.collect_set("k").alias("template"))  # no more than the page's own elements

    def known_of(batch: pa.RecordBatch):
        lists = batch.column("template").to_pylist()
        return lambda row, keys: np.isin(keys, np.array(lists[row] or [], np.int64))

    return per_batch(keyed.join(own, ["_h1", "_h2"], "left"), lambda b: [_texts(b, known_of(b))], _OUT, 1000)
