"""Main text of web pages by removal of site templates.

Every element with text has a hash of its whole subtree. Spark counts, per host, the different pages on which a subtree occurs;
subtrees on ``MANY_PAGES`` of them belong to one of the host's layouts, however many it has, and are deleted. What a single page
shows to be no part of the article (menus, footers, forms, comments, by element, role and class) is deleted as well, and the
article's blocks are joined.

Equal pages count once, so a page copied all over a host does not become its template. An article, or what holds one, is never
deleted for being on many pages. Recurring subtrees stay rows and are joined to the subtrees that each page's text hangs on, so a page's
list is bounded by its own elements. Pages are shuffled once, packed.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze

#: Different pages of a host on which a subtree must be to belong to a template.
MANY_PAGES = 5
#: Inside an article only containers on nearly all pages are deleted: a paragraph that recurs still is text.
INSIDE_SHARE = 0.8

# Elements of HTML, and the words in classes, ids and roles that mark what is no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                  "hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINER = frozenset("aside details div fieldset figure footer form header menu nav ol section table ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas dialog menu "
                    "noembed noframes xmp map audio video".split())
MARKS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored "
                  "promo promotion cookie cookies consent notice notices gdpr comment comments replies respond disqus share sharing social newsletter subscribe "
                  "subscription signup related recommended recommendations popup modal overlay toolbar pagination pager skip login contentinfo complementary "
                  "search masthead topbar".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
              "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table html body div section article".split())
_P_SCOPE = _SCOPE | {"td", "th", "li"}
_LISTS = frozenset({"ul", "ol", "dl", "table"})
_ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAME = re.compile(r"</?[a-zA-Z][^\s/><]*+")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "marks", "hidden", "children", "digest", "size", "article", "heading")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.digest = tag, [], b""
        # Set by hash_subtrees: characters below, whether an article or main element, and a first or second heading, is here or below.
        self.size, self.article, self.heading = 0, False, False
        self.marks, self.hidden = "", False
        if attributes.strip():
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            self.marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip().lower()
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


class _Tags:
    """Where tags begin and whether they end. Each look costs a tag's own length, also on pages whose tags never end."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.places: list[int] | None = None

    def _learn(self) -> None:
        """For each quote and bracket whether a tag that is read up to there ends: at a bracket, or behind the quote's partner."""
        self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.ends = [False] * (len(self.places) + 1)
        after = {'"': -1, "'": -1}
        for k in range(len(self.places) - 1, -1, -1):
            c = self.page[self.places[k]]
            if c == ">":
                self.ends[k] = True
            else:
                self.ends[k] = after[c] >= 0 and self.ends[after[c] + 1]
                after[c] = k

    def next(self, at: int) -> re.Match | None:
        while (at := self.page.find("<", at)) >= 0:
            if self.places is None:
                if m := _TOKEN.match(self.page, at):
                    return m
                if name := _NAME.match(self.page, at):
                    self._learn()
            elif name := _NAME.match(self.page, at):
                if self.ends[bisect_left(self.places, name.end())]:
                    return _TOKEN.match(self.page, at)
            elif (at < self.last or self.page.startswith("<!--", at)) and (m := _TOKEN.match(self.page, at)):
                return m
            if self.places is None and at > self.last:
                self._learn()
            at += 1
        return None


def parse(page: str) -> Node:
    """A tree of the page's elements and texts. Unclosed and misplaced tags are put right as browsers do, roughly.

    The time follows the page's length, however deep its elements lie and whatever of its tags is never closed.
    """
    root = Node("#root")
    stack, at, tags = [root], 0, _Tags(page)
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name

    def close(which: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        inner = max((depths[t][-1] for t in which if depths.get(t)), default=0)
        if inner and inner >= max((depths[t][-1] for t in scope if depths.get(t)), default=0):
            for node in stack[inner:]:
                depths[node.tag].pop()
            del stack[inner:]

    while m := tags.next(at):
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, frozenset())
            continue
        if tag in _ENDS_P:
            close({"p"}, _P_SCOPE)
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag], _LISTS)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, tags.last + 1)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            depths[tag].append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def walk(root: Node) -> Iterator[Node]:
    """All elements, children before parents; without recursion, for trees of any depth."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return reversed(order)


def hash_subtrees(root: Node) -> set[int]:
    """Sets the digest of each element with text and returns them; white space and attributes but the marks do not count."""
    found = set()
    for node in walk(root):
        below = [c for c in node.children if isinstance(c, Node)]
        node.size = sum(c.size if isinstance(c, Node) else len(c) for c in node.children)
        node.article = node.tag in ("article", "main") or any(c.article for c in below)
        node.heading = node.tag in ("h1", "h2") or any(c.heading for c in below)
        inner = [c.digest if isinstance(c, Node) else " ".join(c.split()).encode() for c in node.children]
        if node is not root and node.tag not in RAW and any(inner):
            node.digest = hashlib.blake2b(b"\x00".join([node.tag.encode(), node.marks.encode(), *inner]), digest_size=8).digest()
            if node.tag not in ("html", "body"):
                found.add(int.from_bytes(node.digest, "big", signed=True))
    return found


def _marked(node: Node) -> bool:
    return bool(node.marks) and not MARKS.isdisjoint(_PART.split(node.marks))


def main_text(page: str, template: dict[int, float]) -> str:
    """Blocks of the article joined by line ends. ``template``: subtree hash to share of the host's pages that have it."""
    root = parse(page)
    hash_subtrees(root)
    dropped, articles, mains, _ = _survey(root, template)
    # All articles of the page in their order; without one, the longest main element or the page.
    tops = articles or [max(mains or [root], key=lambda n: n.size)]

    blocks, run, stack = [], [], [(top, False) for top in reversed(tops)]

    def flush() -> None:
        if words := "".join(run).split():
            blocks.append(" ".join(words))
        run.clear()

    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            run.append(node)
        elif done or node.tag in VOID:
            flush() if node.tag in BLOCK else run.append(" " if node.tag in ("br", "td", "th") else "")
        elif id(node) not in dropped and node.tag not in RAW:
            if node.tag in BLOCK:
                flush()
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children)]
    flush()
    return "\n".join(blocks)


def _survey(root: Node, template: dict[int, float]) -> tuple[set[int], list[Node], list[Node], set[int]]:
    """Deleted elements, articles and main elements, and the subtrees whose share in ``template`` the text may hang on.

    Articles are found whatever the template, and where there is one, nothing outside of them counts.
    """
    dropped, stack, articles, mains, asked = set(), [(root, False)], [], [], (set(), set())
    while stack:
        node, inside = stack.pop()
        holds = node.tag in ("#root", "html", "body") or (not inside and node.tag not in ("article", "main") and (node.marks or node.tag == "form") and node.article)
        key = int.from_bytes(node.digest, "big", signed=True) if node.digest else None
        share = template.get(key, 0.0) if node.digest else 0.0
        recurs = share >= INSIDE_SHARE and node.tag in CONTAINER if inside else share > 0 and not node.article
        if not holds and (
            node.hidden or node.tag in DROPPED or _marked(node) or recurs
            or ((node.tag == "header" or "header" in _PART.split(node.marks)) and not (inside and node.heading))
        ):
            dropped.add(id(node))
            continue
        if node.digest and not holds and (node.tag in CONTAINER if inside else not node.article):
            asked[inside].add(key)
        if node.tag == "article" and not inside:
            articles.append(node)
        elif node.tag == "main" or "main" in node.marks.split():
            mains.append(node)
        stack += [(c, inside or node.tag == "article") for c in reversed(node.children) if isinstance(c, Node)]
    return dropped, articles, mains, asked[bool(articles)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            rows: list[tuple] = []
            for host, raw, seed, page in zip(*(part.column(c).to_pylist() for c in ("host", "raw", "seed", "html"))):
                found = hash_subtrees(tree := parse(page or ""))
                whole = hashlib.blake2b(b"".join(c.digest for c in tree.children if isinstance(c, Node)), digest_size=8).digest()
                whole = int.from_bytes(whole, "big", signed=True) ^ seed
                rows.append((host, raw, whole, [h ^ seed for h in found], [h ^ seed for h in found & _survey(tree, {})[3]]))
            kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "raw", "page", "subtrees", "asked"])


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    """``raw`` names a page's html, ``seed`` its host: subtrees and pages of different hosts are told apart by it."""
    rows = pages.select(*[c for c in ("page_id", "url") if c in pages.columns], host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumns({"raw": F.xxhash64("html"), "seed": F.xxhash64("host")})


def templates(pages: DataFrame) -> DataFrame:
    """(host, raw, template) of pages whose text may hang on recurring subtrees: template maps these to the share of the host's different pages that have them."""
    rows = _pages(pages).select("host", "raw", "seed", "html")
    seen = freeze(rows.mapInArrow(_count, "host string, raw long, page long, subtrees array<long>, asked array<long>"), "subtrees")
    # Equal pages have equal subtrees. A hot host's subtrees are spread, only its page keys meet in one join.
    subtrees = seen.select("page", "subtrees").dropDuplicates(["page"]).select(F.explode("subtrees").alias("subtree"))
    many = subtrees.groupBy("subtree").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MANY_PAGES}")
    asked = seen.select("host", "raw", F.explode("asked").alias("subtree")).distinct()
    of_page = asked.join(many, "subtree").groupBy("host", "raw").agg(F.collect_list(F.struct("subtree", "n")).alias("found"))
    whole = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    share = F.transform("found", lambda x: F.struct(x["subtree"], x["n"] / F.col("pages")))
    return of_page.join(whole, "host").select("host", "raw", F.map_from_entries(share).alias("template"))


def _pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([zlib.compress(page.as_py().encode()) for page in pages], pa.binary())


def _texts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, seeds, found in batches:
        yield pa.array([main_text(zlib.decompress(page.as_py()).decode(), {k ^ seed.as_py(): share for k, share in t.as_py() or ()}) for page, seed, t in zip(pages, seeds, found)], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, any others) as (page_id, url, text). A null or empty page has an empty text; a page whose url is
    null or has no host belongs to a host of no name. Of several articles all are kept, in page order. Pages may be of any length and depth. Equal rows give equal texts; other columns are not read."""
    known = freeze(templates(pages), "templates")
    packed = _pages(pages).withColumn("packed", F.arrow_udf(_pack, "binary")("html")).drop("html")
    rows = packed.join(known, ["host", "raw"], "left")
    return rows.select("page_id", "url", F.arrow_udf(_texts, "string")("packed", "seed", "template").alias("text"))
