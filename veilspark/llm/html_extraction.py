"""Operator 3: main text by a site style tree.

Pages are parsed into trees by a tolerant parser. The trees of one host are merged: a node of the site style tree is a path
of tags, classes, ids and places among like siblings; each page adds to it the sequence of child tags it has there (its
presentation) and the text it has there (its content). A node's importance is the mean of the two normalised entropies over
the host's distinct pages. Menus, notices and footers look alike everywhere and score 0.5 at most, however their words
differ; what differs in looks and words from page to page, as articles do, scores near 1.

On a host of LEAST_PAGES pages or more importance alone decides, of articles as of all else: text stays if it is in a
container that reaches BAR, and a branch goes if neither it nor a container in it does. Within a container that reaches
it, containers below LOW go, and so do those that call themselves menus, adverts, notices or the like and do not reach BAR. Where
nothing on a page reaches it, only containers below LOW go. Paragraphs, headings, lists and tables are the
text of their container and are not judged apart. On hosts with fewer pages, what branches say of themselves (by tag,
role, class or id) decides. Scripts, styles, forms and reader comments (whose entropy is that of an article) go always.

A host may have any number of pages but its articles only so many layouts, so the entropy of looks counts as full once it
is that of FULL different ones.

Text of blocks has its character references decoded and white space runs turned into one space, and is
joined in page order by one space. Nothing else is dropped or capped.

Node statistics are plain aggregations over (host, path), pre-aggregated before their shuffle. What they decide of
nodes (that they reach BAR, are below LOW, or that a host is known) is broadcast if it is little (checked), else joined with
each page's own nodes.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows count once in
the statistics and get equal results; an empty table gives no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored
from veilspark.llm.words import slices

LEAST_PAGES = 5
BAR = 0.7
LOW = 0.35
FULL = 16
BROADCAST_DECIDED = 1_000_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead br hr".split()) | INLINE
TEXTUAL = FLOW | frozenset("ul ol dl table tfoot caption colgroup col figcaption address".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NEVER = frozenset("script style noscript template title head form button select input textarea iframe object embed svg canvas dialog audio video map datalist option".split())
ASIDE = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class or id of what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist respond reply replies discussion disqus related recommended recommendations widget pagination pager search skiplink hidden".split()
)
REMARKS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
CONTENT = frozenset("article articlebody content maincontent main post postbody entry entrycontent story storybody".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|</?[a-zA-Z][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Za-z0-9]+")


class Node:
    __slots__ = ("tag", "names", "role", "label", "children", "parent", "drop", "doubt", "holds", "around")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.names: tuple[str, ...] = ()
        self.role, self.label = "", tag
        self.drop = self.doubt = False  # whether it goes always, and whether it says that it is no text
        self.holds = self.around = False  # whether a declared article is below it, and whether the chosen one is
        if attributes and "=" in attributes:
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            own = f"{found.get('class', '')} {found.get('id', '')}"
            self.role = found.get("role", "").lower()
            self.names = tuple(own.lower().split())
            self.label = f"{tag}.{'.'.join(self.names)}" if self.names else tag

    def named(self, words: frozenset) -> bool:
        """Whether a class or id is one of words, whole or in a part of it set off by - or _."""
        return any(n.replace("-", "").replace("_", "") in words or any(w in words for w in WORD.findall(n)) for n in self.names)


def parse(text: str) -> Node:
    """The tree of a page; wrong nesting and missing end tags are tolerated."""
    root = node = Node("#root", "", None)
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            node.children.append(text[at:])
            break
        if m.start() > at:
            node.children.append(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            node.children.append(html.escape(m[1]))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(Node("p", "", node))
            continue
        if tag in CLOSES_P:
            up = node
            while up.parent is not None and (up.tag == "p" or up.tag in INLINE):
                up = up.parent
                if up.tag != "p" and up.tag not in INLINE:
                    break
            passed, x = False, node
            while x is not up:
                passed |= x.tag == "p"
                x = x.parent
            if passed:
                node = up
        elif tag in SIBLING:
            own, stops = SIBLING[tag]
            up = node
            while up.parent is not None and up.tag not in stops and up.tag not in own.split(" "):
                up = up.parent
            if up.tag in own.split(" "):
                node = up.parent
        child = Node(tag, m[4], node)
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(text, at)
            if tag in ("title", "textarea") or end:
                stop = end.start() if end else n
                child.children.append(text[at:stop])
                at = end.end() if end else n
            else:
                at = n
        elif tag not in VOID and not m[4].rstrip().endswith("/") or (tag not in VOID and tag in ("div", "p", "span", "a", "script")):
            node = child
    return root


def walk(node: Node) -> Iterator[Node]:
    """node and all below, parents first, without recursion."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def mark(root: Node) -> list[Node]:
    """Set drop, doubt and around by what branches say of themselves; return what the page declares to be its article."""
    every = list(walk(root))
    declared = [x for x in every if (x.tag in ("article", "main") or x.role in ("article", "main")) and not (x.tag == "article" and x.named(NAMES))]
    for x in declared:
        up = x.parent
        while up is not None and not up.holds:
            up.holds = True
            up = up.parent
    inside: set[int] = set()
    for x in every:
        here = x.parent is not None and id(x.parent) in inside
        if here or x in declared:
            inside.add(id(x))
        if x.holds and x.tag not in ("script", "style"):
            continue
        named = x.tag not in ("#root", "html", "body", "main") and x.named(NAMES) and x not in declared
        x.drop = x.tag in NEVER or x.role == "form" or (named and x.named(REMARKS))
        x.doubt = not x.drop and (x.tag in ASIDE or x.role in ROLES or (x.tag == "header" and not here) or named)
    alive = []
    gone: set[int] = set()
    for x in every:
        if x.drop or x.doubt or (x.parent is not None and id(x.parent) in gone):
            gone.add(id(x))
        else:
            alive.append(x)
    for kind in (("article",), ("main",)):
        chosen = [x for x in alive if x in declared and (x.tag in kind or x.role in kind)]
        if chosen:
            break
    else:
        chosen = [x for x in alive if x.tag in ("div", "section", "td") and any(n.replace("-", "").replace("_", "") in CONTENT for n in x.names)]
    outer: list[Node] = []
    for x in chosen:
        up, nested = x.parent, False
        while up is not None and not nested:
            nested = up in outer
            up = up.parent
        if not nested:
            outer.append(x)
    for x in outer:
        up = x.parent
        while up is not None and not up.around:
            up.around = True
            up = up.parent
    return outer


def blocks(top: Node, skip=lambda node: False) -> list[str]:
    """Texts of the blocks below top in page order, without dropped and skipped branches and what stands loose around an article."""
    out: list[str] = []
    line: list[str] = []

    def ended() -> None:
        words = html.unescape("".join(line)).split()
        if words:
            out.append(" ".join(words))
        line.clear()

    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            ended()
        elif isinstance(x, str):
            line.append(x)
        elif x.drop or skip(x):
            if x.tag not in INLINE:
                ended()
        elif x.around:
            ended()
            for c in reversed(x.children):
                if isinstance(c, Node):
                    stack += (None, c)
        elif x.tag in INLINE:
            stack += reversed(x.children)
        else:
            ended()
            stack.append(None)
            stack += reversed(x.children)
    ended()
    return out


HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def keys_of(root: Node, host: str) -> dict[int, int]:
    """Key of each node's place in its host's style tree, by the node's id()."""
    out: dict[int, int] = {}
    nth: Counter = Counter()
    for x in walk(root):
        if x.parent is None:
            out[id(x)] = xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace"))
            continue
        nth[id(x.parent), x.label] += 1
        own = f"{x.label}#{nth[id(x.parent), x.label]}"
        out[id(x)] = xxhash.xxh3_64_intdigest(own.encode("utf-8", "replace"), seed=out[id(x.parent)])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def containers(root: Node) -> list[Node]:
    """Nodes that importance is worked out of, parents first: the page itself, then all but text, its parts, and what goes always."""
    out: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        if not x.drop:
            if x.parent is None or x.tag not in TEXTUAL:
                out.append(x)
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def declared_skips(root: Node, tops: list[Node]) -> set[int]:
    """Branches that go by what the page says of itself, by their id()."""
    chosen = {id(t) for t in tops}
    out: set[int] = set()
    stack = [(root, not tops)]
    while stack:
        x, inside = stack.pop()
        if x.drop:
            continue
        if id(x) in chosen:
            inside = True
        elif not (x.around or x.tag in ("#root", "html", "body")) and (x.doubt or not inside):
            out.add(id(x))
            continue
        stack += [(c, inside) for c in reversed(x.children) if isinstance(c, Node)]
    return out


def judged_skips(root: Node, keys: dict[int, int], decided: dict[int, bool]) -> set[int]:
    """Branches that go by their importance, by their id(); sets around on what is kept for what is in it only.

    decided: by key, whether a node reaches BAR (true) or is below LOW (false).
    """
    boxes = containers(root)[1:]
    reaching = {id(x) for x in boxes if decided.get(_signed(keys[id(x)])) is True}
    leads: set[int] = set()
    for x in boxes:
        if id(x) in reaching:
            while x is not None and id(x) not in leads:
                leads.add(id(x))
                x = x.parent
    for x in walk(root):
        x.around = False
    out: set[int] = set()
    stack = [(root, not reaching)]
    while stack:
        x, inside = stack.pop()
        if x.drop:
            continue
        if id(x) in reaching:
            inside = True
        elif inside:
            if x.parent is not None and x.tag not in TEXTUAL and id(x) not in leads and (x.doubt and reaching or decided.get(_signed(keys[id(x)])) is False):
                out.add(id(x))
                continue
        elif id(x) in leads:
            x.around = True
        else:
            out.add(id(x))
            continue
        stack += [(c, inside) for c in reversed(x.children) if isinstance(c, Node)]
    return out


def contents(root: Node) -> dict[int, int]:
    """Hash of the text at and below each node, by the node's id(), from the leaves up."""
    out: dict[int, int] = {}
    for x in reversed(list(walk(root))):
        parts = []
        for c in () if x.drop else x.children:
            if isinstance(c, str):
                parts += html.unescape(c).split()
            elif out[id(c)]:
                parts.append(f"\0{out[id(c)]}")
        out[id(x)] = xxhash.xxh3_64_intdigest(" ".join(parts).encode("utf-8", "replace")) if parts else 0
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, page, style, content, host): for each page and each of its places in the style tree; host: it is the root's."""
    for batch in slices(batches, "html"):
        rows: set[tuple[int, int, int, int, bool]] = set()
        for url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            root = parse(text)
            mark(root)
            keys, content_of = keys_of(root, host_of(url)), contents(root)
            page = content_of[id(root)]
            merged: dict[int, tuple[list[str], list[str]]] = {}
            for x in containers(root):
                own = merged.setdefault(keys[id(x)], ([], []))
                own[0].append(",".join(c.tag for c in x.children if isinstance(c, Node)))
                own[1].append(str(content_of[id(x)]))
            for k, (style, content) in merged.items():
                rows.add((_signed(k), _signed(page), _signed(xxhash.xxh3_64_intdigest("|".join(style).encode())), _signed(xxhash.xxh3_64_intdigest("|".join(content).encode())), k == keys[id(root)]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.bool_()], strict=True)], names=["key", "page", "style", "content", "host"])


def importance(pages: DataFrame) -> DataFrame:
    """(key, host, pages, importance) of each node of the style trees; host: it is the root of its host's tree."""
    nodes = stored(pages.select("url", "html").mapInArrow(_nodes, "key long, page long, style long, content long, host boolean").distinct(), "style-nodes")

    def entropy(column: str, full: Column, *more: Column) -> DataFrame:
        c = nodes.groupBy("key", column).agg(F.count(F.lit(1)).alias("c"), F.max("host").alias("host"))
        total = c.groupBy("key").agg(*more, F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        bits = F.log("m") - F.col("s") / F.col("m")
        return total.withColumn(column, F.when(F.col("m") > 1, F.least(bits / full, F.lit(1.0))).otherwise(1.0)).drop("s")

    both = entropy("style", F.log(F.least("m", F.lit(FULL))), F.max("host").alias("host")).join(entropy("content", F.log("m")).drop("m"), "key")
    return both.select("key", "host", F.col("m").alias("pages"), ((F.col("style") + F.col("content")) / 2).alias("importance"))


def extract(pages: DataFrame, bar: float = BAR, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = importance(pages).filter((F.col("pages") >= LEAST_PAGES) & (F.col("host") | (F.col("importance") >= F.lit(bar)) | (F.col("importance") < F.lit(low))))
    decided = stored(known.select("key", F.when(~F.col("host"), F.col("importance") >= F.lit(bar)).alias("worth")), "decided-nodes")
    schema = "page_id long, url string, text string, n_chars long"
    few = decided.limit(BROADCAST_DECIDED + 1).count() <= BROADCAST_DECIDED
    shared = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in decided.collect()} if few else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            urls, bodies = (batch.column(i).to_pylist() for i in (1, 2))
            own = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(urls)
            out = []
            for url, text, mine in zip(urls, bodies, own, strict=True):
                known = {x["key"]: x["worth"] for x in mine} if mine else shared.value
                root = parse(text or "")
                tops = mark(root)
                keys = keys_of(root, host_of(url)) if known else {}
                skip = judged_skips(root, keys, known) if known and _signed(keys[id(root)]) in known else declared_skips(root, tops)
                out.append(" ".join(blocks(root, lambda x, skip=skip: id(x) in skip)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if few:
        return pages.mapInArrow(run, schema)
    row = F.xxhash64("page_id", "url", "html")

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            for r, url, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root = parse(text or "")
                mark(root)
                keys = keys_of(root, host_of(url))
                rows += {(r, _signed(keys[id(x)])) for x in containers(root)}
            columns = list(zip(*rows, strict=True)) if rows else [(), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["row", "key"])

    mine = pages.select(row.alias("row"), "url", "html").mapInArrow(own_keys, "row long, key long").distinct().join(decided, "key")
    own = mine.groupBy("row").agg(F.collect_list(F.struct("key", "worth")).alias("own"))
    return pages.withColumn("row", row).join(own, "row", "left").select("page_id", "url", "html", "own").mapInArrow(run, schema)
