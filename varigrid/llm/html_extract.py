"""Main text of web pages by site style trees (operator 5).

All pages of a host are merged into one style tree. A node is a path of block
elements, each named by tag, class and id without digits, and is known by a hash of
its parent and its name; inline elements belong to the text of their block. For
each node are counted, over distinct pages:

* presentation: the sequences of child elements; their entropy, with the number
  of pages as base, is the node's presentation importance;
* content: its sentences; 1 less the mean entropy of a sentence's spread over the
  pages is its content importance. A sentence that all pages share has none,
  sentences that each occur on one page have all.

A node's composite importance mixes its own presentation importance and that of
its children, by GAMMA to the number of its child sequences. A branch is noise if
its node and all measured nodes below have an importance below ``LOW``; a node is
measured if at least ``MIN_PAGES`` pages have it. Noise is cut from each page,
inside ``article`` and ``main`` too. A host that is all noise keeps everything.

Hosts of few pages say little about a node, so the same counts are also summed
over all hosts, by path: where at least ``MIN_PAGES`` pages have a node and its
content importance is below ``LOW`` there, its own text is cut on every host.

What is left may still hold parts that are never main text though each page has
its own, as readers' comments and forms: the element's tag or a class, id or role
that is one of ``_ROLES`` as a whole tells them. ``html``, ``body``, ``article``
and ``main`` are never dropped for their classes. If ``article`` or ``main``
elements are left, only text inside them counts.

Counts are sums over (host, node, feature), so a host with a third of all pages
has its pages counted where they are read and its distinct features spread over
all tasks. A host's measured nodes, not its pages, meet in one task. Pages are not
shuffled: what is to be cut is broadcast if its counted size is at most
``BROADCAST_BYTES``; beyond, pages meet it by host and a part of page_id's hash.

Defined cases: null or empty html gives an empty text. A page without url is on
a host of its own name, the empty one. Repeated rows count as pages; ties don't
arise, as no order of pages is used. Text is decoded, white space in a block
becomes one space, blocks are joined by one newline; nothing else is changed or
capped. Unclosed and misplaced tags are closed as far as block nesting needs; a
page is read in time linear in its length, however deep or broken. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.blocks import bounded, stored

LOW = 0.8
GAMMA = 0.9
MIN_PAGES = 20
BROADCAST_BYTES = 16 << 20
PARTS = 64
# Element names of the HTML standard by how they are treated.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes select button".split())
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
_FAMILY = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "tr": "tr", "td": "td", "th": "td"}
_BARRIER = {"td": ("p",), "th": ("p",), "body": ("p",), "ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dd",), "table": ("tr", "td"), "tr": ("td",)}
_NEVER = frozenset("nav aside footer form dialog menu search head".split())
_ALWAYS = frozenset("html body article main".split())
_ROLES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies consent cookie-banner cookie-notice comment-list disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related related-posts respond share sharing sidebar signup site-footer site-header site-nav social sponsor sponsored subscribe toolbar widget".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in _RAW}
_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"(?<=[.!?:;|·•])\s+")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
CONTENT, STYLE, THERE = 0, 1, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Node:
    """A block element: ``never`` by its tag or words, ``near`` the open elements that a start tag below may close."""

    __slots__ = ("id", "name", "near", "never", "parent", "parts", "tag")

    def __init__(self, tag: str, name: str, never: bool, parent: Node | None):
        self.tag, self.name, self.never, self.parent = tag, name, never, parent
        self.id = xxhash.xxh64_intdigest(name, parent.id if parent else 0)
        self.parts: list[str | Node] = []
        self.near: dict[str, Node] = parent.near if parent else {}
        if tag in _FAMILY or tag in _BARRIER:
            self.near = {k: v for k, v in self.near.items() if k not in _BARRIER.get(tag, ())}
            if tag in _FAMILY:
                self.near[_FAMILY[tag]] = self


def _named(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's name in the style tree, and whether its tag or words say that it isn't main text."""
    words, label = set(), []
    for m in _ATTR.finditer(attrs) if "=" in attrs else ():
        value = (m[1] or m[2] or m[3] or "").lower()
        words.update(value.split())
        label.append(_DIGITS.sub("", value))
    return tag + "".join(f".{x}" for x in label), tag not in _ALWAYS and (tag in _NEVER or bool(words & _ROLES))


class _Open:
    """The open element, and how many of each tag are open, so that no search for one runs up in vain."""

    def __init__(self, root: Node):
        self.node = root
        self.tags: Counter[str] = Counter()

    def enter(self, node: Node) -> None:
        self.node.parts.append(node)
        self.node = node
        self.tags[node.tag] += 1

    def leave(self, stop) -> None:
        """Close elements up to and with the first for which stop holds; there is one."""
        while True:
            node = self.node
            self.tags[node.tag] -= 1
            self.node = node.parent
            if stop(node):
                return

    def make_room(self, tag: str) -> None:
        """Close what a start tag closes by itself."""
        near = self.node.near
        if tag in _CLOSES_P and "p" in near:
            p = near["p"]
            self.leave(lambda n: n is p)
        family = _FAMILY.get(tag)
        if family and family != "p":
            near = self.node.near
            old = near.get("tr") or near.get("td") if tag == "tr" else near.get(family)
            if old is not None:
                self.leave(lambda n: n is old)
        if tag == "body" and self.tags["head"]:
            self.leave(lambda n: n.tag == "head")


def parse(page: str) -> Node:
    """The page's block elements as a tree; inline elements dissolve into text."""
    root = Node("#", "#", False, None)
    open_, at, pos, plain = _Open(root), 0, 0, False
    while (lt := page.find("<", pos)) >= 0:
        if page[lt + 1 : lt + 2] in ("!", "?"):
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + 2)
            open_.node.parts.append(page[at:lt])
            at = pos = end + len(close) if end >= 0 else len(page)
            continue
        m = _NAME.match(page, lt)
        if m is None:
            pos = lt + 1
            continue
        # the tag's end, not counting > in quoted values; where a quote never ends, quotes count no more
        end = m.end()
        while not plain:
            stop = _STOP.search(page, end)
            if stop is None:
                plain = True
            elif stop[1] is None:
                end = stop.start()
                break
            else:
                end = page.find(stop[1], stop.end()) + 1
                plain = not end
        if plain:
            end = page.find(">", m.end())
            if end < 0:
                break
        open_.node.parts.append(page[at:lt])
        at = pos = end + 1
        tag = m[2].lower()
        if m[1]:
            if open_.tags[tag] > 0:
                open_.leave(lambda n, tag=tag: n.tag == tag)
        elif tag in _RAW:
            close = _RAW_END[tag].search(page, at)
            at = pos = close.end() if close else len(page)
            open_.node.parts.append(" ")
        elif tag == "br":
            open_.node.parts.append(" ")
        elif tag in _BLOCKS and tag not in _VOID:
            open_.make_room(tag)
            name, never = _named(tag, page[m.end() : end])
            node = Node(tag, name, never or (tag == "header" and not open_.tags["article"]), open_.node)
            open_.enter(node)
            if tag == "hr":
                open_.leave(lambda n: True)
    open_.node.parts.append(page[at:])
    return root


def _text(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw)).strip()


def _runs(node: Node):
    """A node's own texts, split by its child elements, and the children, in page order."""
    run: list[str] = []
    for part in node.parts:
        if isinstance(part, Node):
            if run and (text := _text("".join(run))):
                yield text
            run = []
            yield part
        else:
            run.append(part)
    if run and (text := _text("".join(run))):
        yield text


def features(root: Node) -> set[tuple[int, int, int]]:
    """(node, kind, feature) of a page: sentences and child sequences by their hashes, and each node's parent."""
    out, work = set(), [root]
    while work:
        node = work.pop()
        me, names = _signed(node.id), []
        out.add((me, THERE, _signed(node.parent.id) if node.parent else 0))
        for x in _runs(node):
            if isinstance(x, str):
                out.update((me, CONTENT, _signed(xxhash.xxh64_intdigest(s))) for s in _SENTENCE.split(x))
            else:
                names.append(x.name)
                work.append(x)
        if names:
            out.add((me, STYLE, _signed(xxhash.xxh64_intdigest(" ".join(names)))))
    return out


def main_text(page: str | None, branches: frozenset[int] = frozenset(), muted: frozenset[int] = frozenset(), names: bool = True) -> tuple[str, int]:
    """A page's main text, and how many code points the style tree took from it.

    ``branches`` are cut with all below, of ``muted`` nodes only the own text.
    ``names=False`` leaves all to the style tree.
    """
    if not page:
        return "", 0
    root = parse(page)
    tops: list[Node] = []
    if names:
        tops = _find(root, "article", branches) or _find(root, "main", branches)
    wanted = {id(t) for t in tops}
    out: list[str] = []
    removed = 0
    # each with: inside a top, in a part that is never main text, in a branch that is cut
    work: list[tuple[Node | str, bool, bool, bool]] = [(root, not tops, False, False)]
    while work:
        x, inside, never, cut = work.pop()
        if isinstance(x, str):
            if cut:
                removed += len(x)
            elif inside and not never:
                out.append(x)
            continue
        me = _signed(x.id)
        inside = inside or id(x) in wanted
        never = never or (names and x.never)
        cut = cut or me in branches
        mute = cut or me in muted
        work += [(p, inside, never, mute if isinstance(p, str) else cut) for p in reversed(list(_runs(x)))]
    return "\n".join(out), removed


def _find(root: Node, tag: str, branches: frozenset[int]) -> list[Node]:
    """Outermost elements of this tag that aren't below parts that are never main text or cut."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if x.never or _signed(x.id) in branches:
            continue
        if x.tag == tag:
            out.append(x)
        else:
            work += reversed([p for p in x.parts if isinstance(p, Node)])
    return out


def page_features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, n): on how many pages a feature is, summed for each batch."""
    schema = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in bounded(batches):
            seen: defaultdict[str, Counter] = defaultdict(Counter)
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := page.as_py():
                    seen[host].update(features(parse(text)))
            for host, count in seen.items():
                node, kind, feature = zip(*count, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(count), pa.string()), pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64()), pa.array(list(count.values()), pa.int64())], schema=schema)

    found = pages.select("host", "html").mapInArrow(run, "host string, node long, kind int, feature long, n long")
    return found.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))


def style_tree(counts: DataFrame, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """(by..., node, parent, pages, content, n_content, spread, n_style, n_shown): the sums from which importance follows."""
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x).otherwise(0.0))
    there = F.col("kind") == THERE
    return counts.groupBy(*by, "node").agg(
        F.max(F.when(there, F.col("feature"))).alias("parent"), F.max(F.when(there, F.col("n"))).alias("pages"),
        of(CONTENT, F.log("n")).alias("content"), of(CONTENT, F.lit(1.0)).alias("n_content"),
        of(STYLE, F.col("n") * F.log("n")).alias("spread"), of(STYLE, F.lit(1.0)).alias("n_style"), of(STYLE, F.col("n").cast("double")).alias("n_shown"),
    )


def importance(nodes: list[dict], gamma: float = GAMMA) -> tuple[dict[int, float], list[int], dict[int, list[int]]]:
    """Composite importance of each node of one host, the nodes from the leaves up, and each node's children."""
    by_id = {n["node"]: n for n in nodes}
    below: dict[int, list[int]] = defaultdict(list)
    order = []
    for n in nodes:
        if n["parent"] in by_id:
            below[n["parent"]].append(n["node"])
        else:
            order.append(n["node"])
    for node in order:  # grows as it is read
        order.extend(below[node])
    order.reverse()
    out: dict[int, float] = {}
    for node in order:
        n = by_id[node]
        base = math.log(n["pages"]) if n["pages"] > 1 else 0.0
        content = 1 - n["content"] / n["n_content"] / base if n["n_content"] and base else 1.0
        parts = [(out[c], by_id[c]["pages"]) for c in below[node]]
        if not parts:
            out[node] = content if n["n_content"] else 0.0
            continue
        shown = n["n_shown"]
        style = (math.log(shown) - n["spread"] / shown) / base if base and shown else 1.0
        inner = sum(i * p for i, p in parts) / sum(p for _, p in parts)
        if n["n_content"]:
            inner = max(inner, content)
        weight = gamma ** n["n_style"]
        out[node] = (1 - weight) * style + weight * inner
    return out, order, below


def _branches(low: float):
    """The noise branches of one host from its measured nodes: their highest nodes would do, all are given."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.to_pylist()
        imp, order, below = importance(nodes)
        noise: set[int] = set()
        for node in order:
            if imp[node] < low and all(c in noise for c in below[node]):
                noise.add(node)
        roots = {n["node"] for n in nodes} - {c for kids in below.values() for c in kids}
        cut = sorted(noise) if not roots <= noise else []
        return pa.table({"host": table["host"][:1], "node": pa.array([cut], pa.list_(pa.int64()))})

    return run


def noise(counts: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, branches, muted): what is cut from each page of a host; hosts without noise have no row."""
    nodes = style_tree(counts).filter(F.col("pages") >= min_pages)
    of_host = nodes.groupBy("host").applyInArrow(_branches(low), "host string, node array<long>").select("host", F.explode("node").alias("node"), F.lit(True).alias("branch"))
    everywhere = counts.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n"))
    shared = style_tree(everywhere, ()).filter((F.col("pages") >= min_pages) & (F.col("n_content") > 0) & (1 - F.col("content") / F.col("n_content") / F.log("pages") < low))
    of_all = counts.filter(F.col("kind") == THERE).select("host", "node").join(shared.select("node"), "node", "left_semi").select("host", "node", F.lit(False).alias("branch"))
    both = of_host.unionByName(of_all)
    collect = lambda which: F.collect_list(F.when(which, F.col("node")))
    return both.groupBy("host").agg(collect(F.col("branch")).alias("branches"), collect(~F.col("branch")).alias("muted"))


def _beside(pages: DataFrame, cuts: DataFrame, most: int) -> DataFrame:
    """Pages with the cuts of their host; a broadcast only up to a counted size."""
    held = cuts.agg(F.sum(F.size("branches") + F.size("muted") + 8), F.sum(F.length("host"))).first()
    if 8 * int(held[0] or 0) + int(held[1] or 0) <= most:
        return pages.join(F.broadcast(cuts), "host", "left")
    dealt = pages.withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    return dealt.join(cuts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["host", "_part"], "left")


def extract(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES, names: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_tree): the main text and the code points that the style tree cut."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    counts = stored(page_features(pages), "styles")
    cuts = stored(noise(counts, low, min_pages), "noise")

    def run(batches):
        for batch in bounded(batches):
            text, removed = [], []
            for page, branches, muted in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                t, n = main_text(page.as_py(), frozenset(branches.as_py() or ()), frozenset(muted.as_py() or ()), names)
                text.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_tree"])

    joined = _beside(pages, cuts, broadcast_bytes).select("page_id", "url", "html", "branches", "muted")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_tree long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_tree")
