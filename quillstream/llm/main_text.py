"""Main text of raw HTML pages by a site style tree.

The whole DOMs of one host are merged into a style tree: a style node is the path of tags with their class and id, so equal
layout on many pages falls on one node, named or not. For each node the blocks that stand there on the host's pages are counted by what they
show (hash of all text below) and how (hash of the children's tags). The entropy of these two distributions, to
the base of the number of blocks, is the node's importance: 0 where all pages show the same, 1 where each shows its own. The content of a single block is a
feature of its node too: one that stands on n of the node's m pages has the entropy log_m n over the pages, and the importance 1 - log_m n.
Branches of low importance, of either kind, are template and are cut from each page, inside the article as well. What is left of the article
element (or main, or else body) is the main text.

In addition, branches go whose tag, role, class or id names them menu, header, footer, sidebar, notice, advert, form or reader comments, and link lists
outside the article: menus and adverts may show other words on every page, which no entropy of their content gives away, and hosts with few pages have no
tree. The columns n_template and n_named say how many branches of a page fall to the tree and, of the rest, to the names.

A node must be seen on LEAST_PAGES different pages before its entropy counts; pages of one host with the same main text count once.

Counting is an aggregate by (host, node, content) with partial sums, so a hot host meets in no single task. The table of
template nodes is broadcast when it has at most BROADCAST_NODES rows, and joined by page beyond that, with the same result.

Defined results: null html = empty text; null url = no host, pages of that kind are judged alone; repeated ids are extracted one by one; broken
markup is repaired as browsers do (implied ends, unclosed comments); columns other than the three are not read; an empty table gives none.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_written, prepare, with_row, written

LEAST_PAGES = 5
LOW = 0.2
PRESENTATION_WEIGHT = 0.1
BROADCAST_NODES = 50_000

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+|[0-9]+")
WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements that never hold article text.
DROPPED = frozenset(
    "head script style noscript template svg math iframe object embed canvas audio video map nav aside footer form button select textarea input dialog menu title xmp noembed noframes".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
DROPPED_NAMES = frozenset(
    """nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored
    promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup share sharing social related recommended
    comment comments disqus replies widget widgets pagination pager login paywall skip""".split()
)
#: Elements that are the page itself.
KEPT = frozenset("html body article main".split())
#: Content of an element without text.
EMPTY = xxhash.xxh64_intdigest(b"")
OUTER_NAMES = frozenset("header footer masthead banner topbar".split())


class Node:
    __slots__ = ("tag", "names", "attrs", "children", "parent", "key", "content")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.content = 0
        if attrs:
            words = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
            self.names = frozenset(NAME.findall(words))
            tag = f"{tag}.{'.'.join(sorted(attrs.get('class', '').lower().split()))}#{re.sub('[0-9]+', '0', attrs.get('id', ''))}"
        else:
            self.names = frozenset()
            tag += ".#"
        self.key = xxhash.xxh64_intdigest(tag.encode("utf-8", "replace"), parent.key if parent else 0)


def parse(source: str) -> Node:
    """The DOM as nested nodes; text is str children, references not yet decoded."""
    root = Node("#root", {}, None)
    at, stack, size = 0, [root], len(source)
    lowered = None
    while at < size:
        m = TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag not in INLINE:
                    break
        if tag in SAME_ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME_ENDS[tag]:
                    del stack[depth:]
                    if tag != "tr":
                        break
                elif stack[depth].tag in ENDS_SCOPE[tag]:
                    break
        attrs = {}
        if given := m["attrs"]:
            for a in ATTRIBUTE.finditer(given):
                attrs.setdefault(a[1].lower(), markup.unescape(a[2] or a[3] or a[4] or ""))
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            if lowered is None:
                lowered = source.lower() if len(source.lower()) == size else source
            end = lowered.find(f"</{tag}", at)
            node.children.append(source[at : end if end >= 0 else size])
            if end < 0:
                break
            close = source.find(">", end)
            at = close + 1 if close >= 0 else size
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/") or tag in CLOSES_P:
            stack.append(node)
    return root


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def find(node: Node, tags: tuple[str, ...], roles: tuple[str, ...] = ()) -> list[Node]:
    """The outermost elements of these tags or roles that are not in a dropped branch."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag in tags or n.attrs.get("role", "").lower() in roles:
            if not unwanted(n, False):
                out.append(n)
        elif not unwanted(n, False):
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def unwanted(node: Node, inside: bool) -> bool:
    """Its tag, role, class or id says that it is no article text. inside: within the article."""
    attrs = node.attrs
    if node.tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I):
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES or (node.tag not in ("html", "body", "main") and node.names & DROPPED_NAMES):
        return True
    return not inside and (node.tag == "header" or node.tag not in ("html", "body", "main", "article") and bool(node.names & OUTER_NAMES))


def main_nodes(root: Node) -> tuple[list[Node], bool]:
    """(elements that hold the article, whether they are marked up as such)."""
    for tags, roles in ((("article",), ("article",)), (("main",), ("main",))):
        if found := [n for n in find(root, tags, roles) if shown(n)]:
            return found, True
    return [root], False


def shown(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if not unwanted(c, True):
                    todo.append(c)
            elif c.strip():
                return True
    return False


def link_list(node: Node) -> bool:
    """A list all of whose text stands in links."""
    linked, todo = False, [(node, False)]
    while todo:
        n, in_link = todo.pop()
        for c in n.children:
            if isinstance(c, Node):
                todo.append((c, in_link or c.tag == "a"))
            elif c.strip():
                if not in_link:
                    return False
                linked = True
    return linked


def in_order(root: Node) -> list[Node]:
    """All elements below root, each before its children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out[1:]


def digest(root: Node) -> list[Node]:
    """Sets the hash of the text below each element, from the leaves up; returns the elements."""
    nodes = in_order(root)
    for n in (*reversed(nodes), root):
        shows = [f"\0{c.content:x}" if isinstance(c, Node) else " ".join(c.split()) for c in n.children]
        n.content = xxhash.xxh64_intdigest("".join(shows).encode("utf-8", "replace"))
    return nodes


def feature(key: int, content: int) -> int:
    """Style node together with the content of a block."""
    return (key ^ content * 0x9E3779B97F4A7C15) & (2**64 - 1)


#: Template nodes of a page's host: (style nodes, features).
Template = tuple[set[int] | frozenset[int], set[int] | frozenset[int]]
NONE: Template = (frozenset(), frozenset())


def is_template(n: Node, template: Template) -> bool:
    return n.key in template[0] or bool(template[1]) and feature(n.key, n.content) in template[1]


def branches(root: Node, template: Template) -> tuple[int, int]:
    """(branches of the page that are template, branches among the others that their names rule out)."""
    cut = named = 0
    todo = [c for c in root.children if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        if n.tag not in KEPT and is_template(n, template):
            cut += 1
        elif n.tag != "head" and unwanted(n, False):
            named += 1
        else:
            todo.extend(c for c in n.children if isinstance(c, Node))
    return cut, named


def blocks(root: Node, template: Template = NONE) -> list[str]:
    """Texts of the blocks of the main text, in page order, without branches of template nodes (features need digest())."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = WHITE.sub(" ", markup.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    mains, marked = main_nodes(root)
    for main in mains:
        end()
        todo: list = [main]
        while todo:
            n = todo.pop()
            if n is None:
                end()
                continue
            if isinstance(n, str):
                line.append(n)
                continue
            if n is not main and (unwanted(n, marked) or n.tag not in KEPT and is_template(n, template) or not marked and n.tag in ("ul", "ol") and link_list(n)):
                if n.tag not in INLINE:
                    end()
                continue
            if n.tag in ("br", "hr"):
                line.append(" ")
            if n.tag not in INLINE:
                end()
                todo.append(None)
            todo.extend(reversed(n.children))
        end()
    return out


def style_rows(nodes: list[Node]) -> list[tuple[int, int, int, int]]:
    """(style node, content, look, 1 at the node's first row) of each different block of the page; nodes as digest() returns them."""
    seen: set[tuple[int, int]] = set()
    met: set[int] = set()
    out = []
    for n in nodes:
        if n.tag in KEPT or n.tag in INLINE or n.tag in VOID or (n.key, n.content) in seen or n.content == EMPTY:
            continue
        look = xxhash.xxh64_intdigest(",".join(c.tag for c in n.children if isinstance(c, Node)))
        out.append((n.key, n.content, look, int(n.key not in met)))
        seen.add((n.key, n.content))
        met.add(n.key)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


NODES = "key long, host string, page long, nodes array<struct<node: long, content: long, look: long, first: int, feature: long>>"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (*[pa.int64()] * 3, pa.int32(), pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            keys, hosts, pages, limits, rows = [], [], [], [0], []
            for key, url, source in zip(part.column("key").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist()):
                host = host_of(url)
                if not host or not source:
                    continue
                root = parse(source)
                rows += [(_signed(n), _signed(c), _signed(x), f, _signed(feature(n, c))) for n, c, x, f in style_rows(digest(root))]
                keys.append(key)
                hosts.append(host)
                pages.append(_signed(xxhash.xxh64_intdigest(",".join(str(n.content) for n in main_nodes(root)[0]))))
                limits.append(len(rows))
            columns = list(zip(*rows)) or [()] * 5
            nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["node", "content", "look", "first", "feature"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), nodes)], names=["key", "host", "page", "nodes"]
            )


def importance(rows: DataFrame) -> DataFrame:
    """rows(host, node, content, look, first, feature), pages of one text once -> (host, node, is_feature, pages, importance) of style nodes and of features."""
    shown = rows.groupBy("host", "node", "feature").agg(F.count("*").alias("n"), F.sum("first").alias("f"))
    looks = rows.groupBy("host", "node", "look").agg(F.count("*").alias("n"))
    sums = lambda t, *more: t.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), *more)
    # -sum (n/m) log_m (n/m) = (log m - s/m) / log m
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log("m")).otherwise(1.0)
    content = sums(shown, F.sum("f").alias("pages"), F.max("n").alias("most")).select("host", "node", "pages", "most", entropy.alias("hc"))
    look = sums(looks).select("host", "node", entropy.alias("hl"))
    # all that can matter: nodes on few pages are template at no entropy
    nodes = content.where(F.col("pages") >= LEAST_PAGES).join(look, ["host", "node"])
    nodes = nodes.select("host", "node", "pages", "most", ((1 - PRESENTATION_WEIGHT) * F.col("hc") + PRESENTATION_WEIGHT * F.col("hl")).alias("importance"))
    often = shown.where(F.col("n") >= LEAST_PAGES).select("host", "node", "feature", "n").join(nodes.select("host", "node", "pages"), ["host", "node"])
    features = often.select("host", F.col("feature").alias("node"), F.lit(True).alias("is_feature"), F.col("n").alias("pages"), (1 - F.log("n") / F.log("pages")).alias("importance"))
    return nodes.select("host", "node", F.lit(False).alias("is_feature"), "pages", "importance").unionByName(features)


EXTRACTED = "key long, url string, text string, n_blocks long, n_template long, n_named long"


def _extract(template: dict[str, Template] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                own = part.column("template").to_pylist() if template is None else None
                texts, counts, cuts = [], [], []
                for i, (url, source) in enumerate(zip(part.column("url").to_pylist(), part.column("html").to_pylist())):
                    cut = tuple({x["node"] % 2**64 for x in own[i] or () if x["is_feature"] == k} for k in (False, True)) if own is not None else template.get(host_of(url), NONE)
                    root = parse(source or "")
                    if cut[1]:
                        digest(root)
                    found = blocks(root, cut)
                    cuts.append(branches(root, cut))
                    texts.append("\n\n".join(found).encode("utf-8", "replace").decode("utf-8"))
                    counts.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*cuts))],
                    names=["key", "url", "text", "n_blocks", "n_template", "n_named"],
                )

    return run


def extract(pages: DataFrame, most_broadcast: int = BROADCAST_NODES) -> DataFrame:
    """pages(key, url, html) -> (key, url, text, n_blocks, n_template, n_named); keys may repeat."""
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select("key", "url", "html")
    seen = written(pages.mapInArrow(_nodes, NODES).groupBy("host", "page").agg(F.min("nodes").alias("nodes")), "page-nodes")
    low = importance(seen.select("host", F.inline("nodes"))).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LOW)).select("host", "node", "is_feature")
    low = written(low, "template-nodes")
    drop_written(seen)
    if low.count() <= most_broadcast:
        template: dict[str, Template] = {}
        for row in low.collect():
            template.setdefault(row.host, (set(), set()))[row.is_feature].add(row.node % 2**64)
        return pages.mapInArrow(_extract(template), EXTRACTED)
    pages = with_row(pages, "key")
    nodes = pages.select(F.col("__row").alias("key"), "url", "html").mapInArrow(_nodes, NODES).select("key", "host", F.inline("nodes"))
    kinds = F.array(F.struct("node", F.lit(False).alias("is_feature")), F.struct(F.col("feature").alias("node"), F.lit(True).alias("is_feature")))
    own = nodes.select("key", "host", F.explode(kinds).alias("x")).select("key", "host", "x.*").distinct().join(low, ["host", "node", "is_feature"])
    own = own.groupBy("key").agg(F.collect_list(F.struct("node", "is_feature")).alias("template"))
    return pages.join(own.withColumnRenamed("key", "__row"), "__row", "left").select("key", "url", "html", "template").mapInArrow(_extract(None), EXTRACTED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("key"), "url", "html")
    return extract(pages).select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_template", "n_named")
