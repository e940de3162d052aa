"""Main text of web pages by a site style tree: what a host repeats is told from what a page says."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.scratch import materialize
from .blocks import beside, blocks, runs, store

#: Share of a node's importance that passes on to its children, by their number; branches below ``LEAST`` go.
GAMMA, LEAST = 0.9, 0.2
#: Levels over which importance is passed up.
DEEPEST = 256
#: Hosts of fewer pages say nothing about what they repeat.
LEAST_PAGES = 5
_HELD = 1 << 17

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes svg math object".split())
#: Raw elements in which a slash closes an element as it opens.
FOREIGN = frozenset(("svg", "math"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img "
    "ruby rt rp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section summary table ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NEVER = frozenset("head nav footer aside form button select option input dialog menu canvas audio video map".split())
CONTENT = frozenset("article main".split())
# Words in class, id and role that name what is no article.
OTHER_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promotion recommended related respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
OWN_PARTS = frozenset("article body content entry main post story text".split())
OWN_HEADERS = frozenset("header masthead".split())
ALWAYS_OTHER = frozenset("ad ads advert adverts advertisement comment comments cookie disqus newsletter related respond share sponsored".split())

# Words that say where a part stands or what it is made of. A class, id or role names another part if
# it consists of such words, own parts and at least one other part; any other word in it says that it means something else.
AROUND = frozenset(
    "area bar block blocks bottom box button buttons col column container element fixed form global group holder icon icons inner item items left "
    "level link links list local mobile outer page panel posts primary right row secondary section site slot sticky top unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<[!/a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "names", "ids", "parent", "items", "path", "children", "holds", "height")

    def __init__(self, tag: str, names: list[str], ids: list[str], parent: Node | None):
        """``names``: the words of class and role as they stand; ``ids``: those of id."""
        self.tag, self.names, self.ids, self.parent, self.items = tag, names, ids, parent, []
        parts = frozenset(p for name in names + ids for p in _pieces(name))
        self.children, self.holds = 0, tag in CONTENT
        label = tag + "." + ".".join(sorted(re.sub(r"\d+", "0", p) for p in parts)) if parts else tag
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0}/{label}".encode()) >> 1


def _pieces(name: str) -> list[str]:
    return [p for p in re.split(r"[_-]+", name) if p]


def parse(html: str | None) -> Node:
    """The element tree of a page (``holds``: an article or main element is in it); unclosed and stray tags are borne as browsers do, in the main."""
    root = here = Node("#", [], [], None)
    text, at, size = html or "", 0, len(html or "")
    while at < size:
        found = _TAG.search(text, at)
        if found is None:
            here.items.append(text[at:])
            break
        if found.start() > at:
            here.items.append(text[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            here = _closed(here, tag)
            continue
        if tag in CLOSES_P:
            here = _closed(here, "p", stop=CLOSES_P - {"p"})
        elif tag in CLOSES_SAME:
            for same in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                here = _closed(here, same, stop=CLOSES_SAME[tag])
        names, ids = [], []
        for a in _ATTRIBUTE.finditer(found[3] or ""):
            (ids if a[1].lower() == "id" else names).extend((a[2] or a[3] or a[4] or "").lower().split())
        node = Node(tag, names, ids, here)
        here.items.append(node)
        if node.holds:
            up = here
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        closed = (found[3] or "").rstrip().endswith("/")
        if tag in RAW and not (tag in FOREIGN and closed):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not closed or tag in CLOSES_P:
            here = node
    return root


def _closed(here: Node, tag: str, stop: frozenset | tuple = ()) -> Node:
    """Where the parser stands once the innermost open ``tag`` is closed; a tag that is not open changes nothing."""
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if node.tag in stop:
            return here
        node = node.parent
    return here


def other(node: Node, inside: str) -> bool:
    """Whether the presentation alone tells that a branch is no main text; ``inside`` is the innermost of article and main around it, or empty.

    No name and no form takes away an article or main element, save articles within an article. Headings are not
    judged by their ids, nor are sections within article or main: ids are made from what a heading says.
    """
    holds = node.holds and inside != "article"
    if node.tag in RAW or node.tag in NEVER and not (node.tag == "form" and holds) or node.tag == "header" and not inside:
        return True
    if holds or node.tag in CONTENT or node.tag in ("#", "html", "body"):
        return False
    judged = node.names if node.tag in HEADINGS or inside and node.tag == "section" else node.names + node.ids
    others = OTHER_PARTS - OWN_HEADERS if inside else OTHER_PARTS
    named, own = set(), False
    for name in judged:
        pieces = _pieces(name)
        own = own or not OWN_PARTS.isdisjoint(pieces)
        if all(p in OTHER_PARTS or p in AROUND or p in OWN_PARTS or p.isdigit() for p in pieces):
            named.update(others.intersection(pieces))
    return not named.isdisjoint(ALWAYS_OTHER) or bool(named) and not own


def dominant(root: Node) -> set[int]:
    """The forms and named branches, by ``id``, that hold more than half of the text of a page without article and main.

    Such a branch is the page's own frame. What is never text, and names that always mean another part, end the way down to it.
    """
    found: set[int] = set()
    if root.holds:
        return found
    order, sizes = [root], {}
    for node in order:
        order += [x for x in node.items if not isinstance(x, str) and x.tag not in RAW and (x.tag not in NEVER or x.tag == "form")]
    for node in reversed(order):
        sizes[id(node)] = sum(len(x.strip()) if isinstance(x, str) else sizes.get(id(x), 0) for x in node.items)
    here, whole = root, sizes[id(root)]
    while True:
        here = next((x for x in here.items if not isinstance(x, str) and 2 * sizes.get(id(x), 0) > whole), None)
        if here is None or any(not ALWAYS_OTHER.isdisjoint(_pieces(n)) for n in here.names + here.ids):
            return found
        found.add(id(here))


def text_blocks(root: Node, removed=frozenset()) -> list[str]:
    """Texts of the blocks in page order, without the branches that are other parts or in ``removed``.

    On a page without article and main a form or named branch stays that holds most of its text (``dominant``).
    """
    out: list[str] = []
    frame = dominant(root)
    held: list[str] = []
    if removed:
        heights(root)

    def flush():
        if line := " ".join(unescape("".join(held)).split()):
            out.append(line)
        held.clear()

    stack = [(root, "", iter(root.items))]
    while stack:
        node, inside, items = stack[-1]
        for item in items:
            if isinstance(item, str):
                held.append(item)
            elif item.tag == "br":
                held.append(" ")
            elif other(item, inside) and id(item) not in frame or not inside and item.path in removed and not item.holds and item.height < DEEPEST:
                if item.tag not in INLINE:
                    flush()
            else:
                if item.tag not in INLINE:
                    flush()
                stack.append((item, _around(item.tag, inside), iter(item.items)))
                break
        else:
            stack.pop()
            if node.tag not in INLINE:
                flush()
    return out


def _around(tag: str, inside: str) -> str:
    """Within an article a main element changes nothing."""
    return tag if tag in CONTENT and inside != "article" else inside


def heights(root: Node) -> None:
    """How many levels lie below each element."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.height = 0
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node)]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.height = max(node.parent.height, node.height + 1)


def host(url: str | None) -> str:
    """The host in lower case without port; pages without one form a site of their own."""
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _value(texts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(texts).encode("utf-8", "surrogatepass")) >> 1


def site_tree(root: Node) -> tuple[set[tuple[int, int]], Counter, Counter]:
    """What a page adds to the style tree of its host.

    Features (path, hash): of an element the row of its children's tags, of the text right below it that
    text. Weights (path, path below): what the importance of the lower node adds to that of the upper.
    Times each path occurs. Text nodes have the negated path of their element.
    """
    features, weights, times = set(), Counter(), Counter()
    stack = [root]
    while stack:
        node = stack.pop()
        children = [x for x in node.items if isinstance(x, Node) and x.tag not in RAW]
        stack += children
        words = " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())
        count = len(children) + bool(words)
        node.children = count
        times[node.path] += 1
        kinds = [c.tag for c in children]
        features.add((node.path, _value(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)))
        if words:
            features.add((-node.path, _value([words])))
            times[-node.path] += 1
        own = 1 - GAMMA ** count if count else 1.0
        for below, weight, up in ((node.path, own, False), (-node.path, 1.0, True)):
            if up and not words:
                continue
            at = node
            if up:
                weight *= GAMMA ** count / count
            weights[at.path, below] += weight
            for _ in range(DEEPEST):  # beyond, a weight is nothing, and no branch so deep is ever removed
                if at.parent is None:
                    break
                at = at.parent
                weight *= GAMMA ** at.children / at.children
                weights[at.path, below] += weight
    return features, weights, times


_SCHEMA = "_file long, _block int, host string, kind byte, node long, other long, value double"
_FEATURE, _WEIGHT, _TIMES, _PAGES = range(4)


def _collect(batches):
    """Rows of the style trees, summed per block: kind tells what ``other`` and ``value`` are."""
    held, current = Counter(), None

    def rows():
        table = [(*current, h, k, n, o, float(v)) for (h, k, n, o), v in held.items()]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int8(), pa.int64(), pa.int64(), pa.float64())
        names = ["_file", "_block", "host", "kind", "node", "other", "value"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), kinds)], names)

    for block, batch in runs(batches, 256):
        if held and (block != current or len(held) > _HELD):
            yield rows()
            held.clear()
        current = block
        for url, html in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist()):
            site = host(url)
            features, weights, times = site_tree(parse(html))
            for node, value in features:
                held[site, _FEATURE, node, value] += 1
            for (node, below), weight in weights.items():
                held[site, _WEIGHT, node, below] += weight
            for node, n in times.items():
                held[site, _TIMES, node, 0] += n
                held[site, _PAGES, node, 0] += 1
    if held:
        yield rows()


def importance(trees: DataFrame) -> DataFrame:
    """host, node, pages, importance, most (of the node and all below it) for the merged style trees.

    A node's own importance is the entropy of its features over the host's pages, between 0 where all pages
    show the same and 1 where each shows its own; an element's adds those of all nodes below it by their
    weights, averaged over its occurrences.
    """
    kind = lambda k: trees.where(F.col("kind") == k)
    alike = kind(_FEATURE).groupBy("host", "node", "other").agg(F.sum("value").alias("c"))
    alike = alike.groupBy("host", "node").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    counts = kind(_TIMES).unionAll(kind(_PAGES)).groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == _TIMES, F.col("value"))).alias("times"), F.sum(F.when(F.col("kind") == _PAGES, F.col("value"))).alias("pages"))
    own = alike.join(counts, ["host", "node"]).select(
        "host", F.col("node").alias("other"),
        F.when(F.col("pages") > 1, 1 - F.col("clogc") / (F.col("all") * F.log("pages"))).otherwise(1.0).alias("own"))
    weights = kind(_WEIGHT).groupBy("host", "node", "other").agg(F.sum("value").alias("w"))
    total = weights.join(own, ["host", "other"]).groupBy("host", "node").agg(F.sum(F.col("w") * F.col("own")).alias("total"))
    each = materialize(total.join(counts, ["host", "node"]).select("host", "node", "pages", (F.col("total") / F.col("times")).alias("importance")))
    text = own.where("other < 0").select("host", "other", F.col("own").alias("importance"))
    below = each.select("host", F.col("node").alias("other"), "importance").unionAll(text)
    most = weights.join(below, ["host", "other"]).groupBy("host", "node").agg(F.max("importance").alias("most"))
    return each.join(most, ["host", "node"])


_REMOVED = pa.schema([("host", pa.string()), ("node", pa.int64())])


def _extract(folder: str):
    def run(batches):
        load, current, removed = beside(folder, _REMOVED), None, {}
        for block, batch in runs(batches, 256):
            if block != current:
                current, removed = block, {}
                for row in load(block).to_pylist():
                    removed.setdefault(row["host"], set()).add(row["node"])
            texts = ["\n\n".join(text_blocks(parse(html), removed.get(host(url), frozenset())))
                     for url, html in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["_id", "_url", "text", "n_chars"])
    return run


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = LEAST, least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """Per page: id, url, text, n_chars (code points); null html is empty, and so is the text of a page without any.

    All pages of a host are merged into one tree of element paths. Branches in which no node has an importance
    of ``least`` go, on hosts with at least ``least_pages`` pages that have them, and on any host those that their
    tag, class, id or role names as another part. What stands within an article or main element is only judged
    by such names, so passages that pages share stay. Blocks are joined by two line feeds.

    The pages are not shuffled. Trees are summed per block before they are merged, and each block then reads
    the removed branches of its own hosts; a host of any size has one row a block and node.
    """
    rows = blocks(pages, {"_id": F.col(id_col), "_url": F.col(url_col).cast("string"), "_html": F.col(html_col).cast("string")})
    trees = materialize(rows.mapInArrow(_collect, _SCHEMA))
    low = importance(trees).where((F.col("most") < least) & (F.col("pages") >= least_pages)).select("host", "node")
    there = trees.where(F.col("kind") == _PAGES).select("_file", "_block", "host", "node").distinct()
    folder = store(there.join(low, ["host", "node"]))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_extract(folder), f"_id {kind}, _url string, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
