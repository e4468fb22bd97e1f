"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is the path of container elements
(tag, classes and id) below the root, with how often each presentation (sequence of child tags)
and each content (digest of the text that stands in the element itself) occurred there, over
distinct pages.  The entropy of either, as a share of the largest possible, is a node's own importance: a
menu shows the same few contents everywhere, an article another one on each page.  On a page the importance of a
branch is composed bottom-up: the mean of its nodes' own importance by the text that stands in them.  A
branch whose importance is low, and that holds none whose importance is not, is removed.  What remains
is cut by element and name rules, which alone decide where a host has too few pages to tell.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import batches, scratch

#: Distinct pages from which on a host's tree tells a node's importance, and the importance below which a branch
#: goes: outside the article element, and inside it.
PAGES, LOW, LOW_INSIDE = 6, 0.5, 0.05

# The element classes of the HTML standard, and names that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
CLOSES_P = BLOCKS - frozenset("body head html caption legend li dd dt tbody td tfoot th thead tr".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]),
    "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"]), "body": frozenset(["head"]),
}
BARRIER = {"li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"])}
NEVER = frozenset("nav aside footer form dialog search menu head button object audio video canvas fieldset legend label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promotions sidebar sidenav "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist respond reply replies discussion disqus widget widgets toolbar pagination pager search searchbox copyright disclaimer "
    "skip skiplink aside form".split()
)
#: Of these, the names that mark even an element that holds an article.
READERS = frozenset("comment comments commentlist respond reply replies discussion disqus related recommended recommendations".split())

_comment = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?", re.S)
_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_to_value, _spaces, _bare = re.compile(r"[^>=]*"), re.compile(r"\s*"), re.compile(r"[^\s>]*")
_attr = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_names = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "path", "parent", "start", "end", "names", "gone", "style", "holds", "number")

    def __init__(self, tag, parent, names, gone, path, start):
        self.tag, self.parent, self.names, self.gone, self.path, self.start = tag, parent, names, gone, path, start
        self.end, self.style, self.holds, self.number = -1, [], False, -1


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tag_end(source: str, at: int) -> int:
    """Where the ">" of a tag stands whose name ends at ``at``; quotes count where a value begins.  The end of the page if it is nowhere."""
    n = len(source)
    while (at := _to_value.match(source, at).end()) < n:
        if source[at] == ">":
            return at
        at = _spaces.match(source, at + 1).end()
        if at < n and source[at] in "\"'":
            at = source.find(source[at], at + 1) + 1 or n
        else:
            at = _bare.match(source, at).end()
    return n


class Stack:
    """Open elements, with the places of each tag and of the nearest block."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.block = [root], {}, [0]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.places.setdefault(node.tag, []).append(k)
        self.block.append(k if node.tag in BLOCKS else self.block[-1])
        self.nodes.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, k: int, end: int) -> None:
        """Close the elements from place k on."""
        for x in self.nodes[k:]:
            x.end = end
            if k:
                self.places[x.tag].pop()
        del self.nodes[k:], self.block[k:]


class Page:
    """Elements of a page, and its text as pieces (block number, node, text); one pass, in time of the page's length."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.pieces: list[tuple[int, Node, str]] = []
        self._read(source)

    def _open(self, tag: str, attrs: str, up: Node) -> Node:
        path, names, gone, label = up.path, frozenset(), False, ""
        if attrs.strip():
            found = {k.lower(): htmllib.unescape(v.strip("\"'")) for k, v in _attr.findall(attrs)}
            label = f"{found.get('class', '')} {found.get('id', '')}".lower()
            names = frozenset(_names.split(label))
            gone = (
                "hidden" in found
                or found.get("aria-hidden", "").lower() == "true"
                or found.get("role", "").lower() in ROLES
                or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))
            )
        if tag in CONTAINERS:
            path = _digest(str(up.path), tag, " ".join(sorted(label.split())))
        node = Node(tag, up, names, gone, path, len(self.pieces))
        up.style.append(tag)
        if tag in CONTAINERS:
            node.number = len(self.nodes)
            self.nodes.append(node)
        return node

    def _read(self, source: str) -> None:
        stack = Stack(Node("#root", None, frozenset(), False, 0, 0))
        pieces, block, at, n, low = self.pieces, 0, 0, len(source), None
        while at < n:
            if source[at] != "<":
                end = source.find("<", at)
                end = n if end < 0 else end
                pieces.append((block, stack.nodes[-1], source[at:end]))
                at = end
                continue
            m = _name.match(source, at)
            if m is None:
                if found := _comment.match(source, at):
                    at = found.end()
                else:
                    pieces.append((block, stack.nodes[-1], "<"))
                    at += 1
                continue
            end = _tag_end(source, m.end())
            attrs, at = source[m.end() : end], min(n, end + 1)
            if end == n:  # a tag without an end is none
                break
            tag = m[2].lower()
            if m[1]:
                block += tag in BLOCKS
                k = stack.last((tag,))
                if k and (tag in BLOCKS or k > stack.block[-1]):  # an inline end tag ends nothing beyond its block
                    stack.cut(k, len(pieces))
                continue
            if tag == "br":
                pieces.append((block, stack.nodes[-1], " "))
            block += tag in BLOCKS
            ends = ("p",) if tag in CLOSES_P else CLOSED_BY.get(tag, ())
            if ends:
                stop = stack.last(BARRIER.get(tag, ("table",) if tag in CLOSED_BY else ("table", "td", "th", "caption", "button")))
                if tag in ("tr", "tbody", "tfoot"):  # all of them that are open
                    inside = [x[k] for t in ends if (x := stack.places.get(t)) and (k := bisect_right(x, stop)) < len(x)]
                    k = min(inside, default=0)
                else:
                    k = stack.last(ends)
                if k > stop:
                    stack.cut(k, len(pieces))
            node = self._open(tag, attrs, stack.nodes[-1])
            if tag in VOID or attrs.endswith("/") and tag in RAW:
                continue
            if tag in RAW:  # its text is no markup
                if low is None:
                    low = source.lower()
                    if len(low) != n:  # lowering may change lengths
                        low = "".join(c.lower() if c.isascii() else c for c in source)
                end = low.find(f"</{tag}", at)
                at = n if end < 0 else (source.find(">", end) + 1 or n)
                continue
            stack.push(node)
        stack.cut(0, len(pieces))
        for x in self.nodes:
            if x.end < 0:
                x.end = len(pieces)

    def _own(self) -> list[list[str]]:
        """The text that stands in each container itself, in pieces."""
        out: list[list[str]] = [[] for _ in self.nodes]
        for _, x, text in self.pieces:
            while x is not None and x.number < 0:
                x = x.parent
            if x is not None and (text := " ".join(htmllib.unescape(text).split())):
                out[x.number].append(text)
        return out

    def contents(self) -> Iterator[tuple[Node, int, int]]:
        """Containers that hold text themselves, with digests of their presentation and content."""
        for x, own in zip(self.nodes, self._own()):
            if own:
                same = [t for k, t in enumerate(x.style) if not k or t != x.style[k - 1]]
                yield x, _digest(*same), _digest(" ".join(own))

    def branches(self, importance: dict[int, float]) -> tuple[list[float], list[float]]:
        """The importance of each container's branch, composed bottom-up, and the largest of a branch in it.

        A branch without text has none to lose: importance 0.  Nodes that the tree does not tell count as 1.
        """
        weight = [float(sum(map(len, own))) for own in self._own()]
        value = [w * importance.get(x.path, 1.0) for w, x in zip(weight, self.nodes)]
        most = [0.0] * len(self.nodes)
        for x in reversed(self.nodes):  # children stand behind their parents
            k = x.number
            value_here = value[k] / weight[k] if weight[k] else 0.0
            most[k] = max(most[k], value_here)
            up = x.parent
            while up is not None and up.number < 0:
                up = up.parent
            if up is not None:
                value[up.number] += value[k]
                weight[up.number] += weight[k]
                most[up.number] = max(most[up.number], most[k])
        return [v / w if w else 0.0 for v, w in zip(value, weight)], most

    def main_text(self, importance: dict[int, float], removed: list[str] | None = None) -> str:
        """Blocks of the article, joined by line feeds.

        ``importance``: that of the host's tree at each path of this page, where it has enough pages.
        ``removed`` gets the pieces of text in branches that the tree removes.
        """
        total = [0]
        for _, _, t in self.pieces:
            total.append(total[-1] + len(t))
        size = lambda x: total[x.end] - total[x.start]
        for x in self.nodes:
            if x.tag in ("article", "main") and not x.names & READERS:
                up = x.parent
                while up is not None and not up.holds:
                    up.holds, up = True, up.parent
        named = lambda x: bool(x.names & (READERS if x.holds else NOISE)) and x.tag not in ("html", "body", "main")
        wraps = lambda x: x.tag == "form" and (x.holds or 2 * size(x) > total[-1])  # noqa: E731  a form around the page
        noisy = lambda x: x.gone or x.tag in NEVER and not wraps(x) or named(x)

        composed, most = self.branches(importance) if importance else ([1.0] * len(self.nodes), [1.0] * len(self.nodes))
        pruned, dropped = [False] * len(self.nodes), {id(None): False}
        inside = [False] * len(self.nodes)  # an article
        for x, own, branch in zip(self.nodes, composed, most):
            up = x.parent
            while up is not None and up.number < 0:
                up = up.parent
            inside[x.number] = x.tag in ("article", "main") or up is not None and inside[up.number]
            low = LOW_INSIDE if inside[x.number] else LOW
            pruned[x.number] = up is not None and pruned[up.number] or own < low and branch < low and size(x) > 0 and x.tag not in ("article", "main") and not x.holds

        def settled(x: Node | None, state: dict[int, bool], rule) -> bool:
            """A state that an element has by the rule or from the one above it."""
            chain = []
            while id(x) not in state:
                chain.append(x)
                x = x.parent
            found = state[id(x)]
            for x in reversed(chain):
                found = state[id(x)] = rule(x, found)
            return found

        out = lambda x, above: above or x.number >= 0 and pruned[x.number] or noisy(x)
        best, largest = None, 0
        for wanted in ("article", "main"):
            for x in self.nodes:
                if x.tag == wanted and size(x) > largest and not settled(x, dropped, out):
                    best, largest = x, size(x)
            if best is not None:
                break
        keeps = {id(None): False}
        if best is not None:
            keeps[id(best)] = False

        def lost(x: Node, above: bool) -> bool:
            outside_header = best is None and (x.tag == "header" or "header" in x.names)
            return above or outside_header or x.number >= 0 and pruned[x.number] or noisy(x)

        if removed is not None:
            for _, x, text in self.pieces:
                while x is not None and x.number < 0:
                    x = x.parent
                if x is not None and pruned[x.number] and text.strip():
                    removed.append(" ".join(htmllib.unescape(text).split()))
        lo, hi = (best.start, best.end) if best is not None else (0, len(self.pieces))
        blocks: list[str] = []
        last, own = None, []
        for block, node, text in [*self.pieces[lo:hi], (-1, None, "")]:
            if block != last:
                if own and (line := " ".join(htmllib.unescape("".join(own)).split())):
                    blocks.append(line)
                last, own = block, []
            if node is not None and not settled(node, keeps, lost):
                own.append(text)
        return "\n".join(blocks)


def parsed(pages: DataFrame) -> DataFrame:
    """key, host, sig (digest of a page's contents), and of its containers with text paths, styles and contents, of ``pages`` (key, host, html)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in batches.runs(batch, "html"):
                sigs, lists = [], [[], [], []]
                for source in batches.texts(part.column("html")):
                    own = list(Page(source).contents())
                    sigs.append(_digest(*[str(c) for _, _, c in own]))
                    for column, values in zip(lists, ([x.path for x, _, _ in own], [s for _, s, _ in own], [c for _, _, c in own])):
                        column.append(values)
                columns = [part.column("key"), part.column("host"), pa.array(sigs, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in lists)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "host", "sig", "paths", "styles", "contents"])

    return pages.select("key", "host", "html").mapInArrow(run, "key long, host string, sig long, paths array<long>, styles array<long>, contents array<long>")


def importances(nodes: DataFrame) -> DataFrame:
    """Own importance of the nodes of each host's style tree: host, path, importance; ``nodes``: of :func:`parsed`.

    Counts are over distinct pages of the host (by their content), so copies of a page count once; a hot
    host's rows add up before and after the shuffle.
    """
    pages = nodes.groupBy("host", "sig").agg(F.first(F.struct("paths", "styles", "contents")).alias("p")).select("host", "p.*")
    each = pages.select("host", F.explode(F.arrays_zip("paths", "styles", "contents")).alias("x"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("x.styles").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("x.contents").alias("v")))
    both = each.select("host", F.col("x.paths").alias("path"), F.explode(kinds).alias("y"))
    counts = both.groupBy("host", "path", "y.kind", "y.v").agg(F.count("*").alias("c"))
    m = F.sum("c")
    entropy = (F.log(m) - F.sum(F.col("c") * F.log("c")) / m) / F.log(m)
    found = counts.groupBy("host", "path", "kind").agg(m.alias("m"), entropy.alias("h")).where(F.col("m") >= PAGES)
    return found.groupBy("host", "path").agg(F.max("h").alias("importance"))


def trees(rows: DataFrame) -> DataFrame:
    """key, low: the importance of those nodes of each page that its host's tree holds to be low; ``rows``: key, host, html."""
    nodes, _ = scratch.store(parsed(rows), "style-tree-nodes")
    low, _ = scratch.store(importances(nodes).where(F.col("importance") < LOW), "style-tree")
    on_page = nodes.select("key", "host", F.explode("paths").alias("path")).distinct()
    found = on_page.join(low, ["host", "path"]).groupBy("key").agg(F.collect_list(F.struct("path", "importance")).alias("low"))  # at most a page's own paths
    return scratch.store(found, "style-tree-pages")[0]


def extract(pages: DataFrame) -> DataFrame:
    """The main text of each row of ``pages`` (page_id, url, html): page_id, url, text.

    Null html is empty and has empty text; a null url, or one without a host, is of the host "".
    Repeated rows give repeated results, an empty table gives no row, and other columns are ignored.
    Elements nest to any depth, and a page of any length is read once from end to end.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).withColumn("key", F.xxhash64("url", "html"))
    found = trees(rows)

    def texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for run in batches.runs(batch, "html"):
                out = []
                for source, low in zip(batches.texts(run.column("html")), run.column("low").to_pylist()):
                    out.append(Page(source).main_text({x["path"]: x["importance"] for x in low or ()}))
                yield pa.RecordBatch.from_arrays([run.column("page_id"), run.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(found, "key", "left").select("page_id", "url", "html", "low")
    kinds = dict(pages.dtypes)
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url string, text string")
