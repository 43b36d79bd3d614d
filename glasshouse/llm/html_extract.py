"""Main-text extraction by wrapper induction.

Pages of a host are parsed into trees of blocks; runs of like siblings become one repeated node.  The distinct trees of a host are
folded, by simple tree matching, into one template tree, in an order that their content alone decides.  Then every page is aligned with its
host's template and the texts of each template node are counted exactly, a text once for each distinct page body.  Texts that stay
the same are template; slots whose text varies are content.  The content roots are the template nodes that hold varying,
unlinked text: one for each layout or sibling that has some.  A page gives what its nodes have under the roots; nodes that the
template does not have vary by definition, and a page without text under a root gives all its varying slots.

A text is constant where the share of the slot's bodies that have it is over one half, by Wilson's lower bound at 95%:
one rule for slots with few and with many bodies (all of 3, 14 of 20, 527 of 1000).

Page furniture: the elements nav, aside, footer, form and their like are never content.  Elsewhere words of class, id and role may name
it.  Outside of the content roots any word of a name counts (class="site-notice"), and so does the element header, unless an h1 that differs between
pages lies in it.
Under a root only a whole name counts, and only of a container (class="comments", not class="comments-policy", and no paragraph).

A node that fewer than two pages, or fewer than one in a thousand of the host's, have is not in the template: with each node on that share,
a template has at most a thousand times the nodes of an average page.  Elements nested deeper than DEEPEST are not nodes of
their own; their text stays where it is, in blocks.

Nulls: null html is empty text; pages without a url are one host.  A host with one page has nothing to compare, so
only furniture is dropped; so it is if all its pages are copies of one.  Long pages are read whole.
Repeated rows get equal values.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import steps, strings, written

RARE = 0.001  # share of a host's pages below which a node is not in the template
FOLD = 500  # trees that one task folds
DEEPEST = 256  # levels of a tree
BROADCAST_BYTES = 32 << 20  # templates are broadcast up to this measured size
Z = 1.6448536269514722  # of a one-sided 95% bound
BODY_WORDS = 8  # texts of so many words make a page's body (all texts if none has them)
NOT, NAMED, WHOLE, ELEMENT = range(4)  # furniture: none, by a word of a name (or header), by a whole name, by the element

# Fixed values of HTML: elements by how they lay out or end.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript object script style svg template textarea title xmp audio video canvas".split())
CLOSES_P = BLOCKS - {"body", "caption", "head", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
# Furniture: elements, and words of class, id and role.
FURNITURE = set("nav footer aside form head menu dialog select option button fieldset legend".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header"
    " login masthead menu menubar modal nav navbar navigation navigational newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies"
    " respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert cta".split()
)
# Of these, names of parts that an article has too.
PARTS = set("header banner masthead topbar".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote html body main".split())  # elements that a whole name does not make furniture
# Words that only say how a page is laid out, and words of content containers.
MODIFIERS = set("has with no without is js".split())
LAYOUT = set("layout page wrapper grid".split())
CONTENT_WORDS = set("content article post story entry text main body".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "label", "kind", "items", "up", "depth", "linked", "template")

    def __init__(self, tag: str, label: str, kind: int, up: Node | None):
        self.tag, self.label, self.kind, self.up = tag, label, kind, up
        self.depth = up.depth + 1 if up is not None else 0
        self.items: list = []  # texts and nodes in page order
        self.linked = 0  # characters inside links
        self.template: Template | None = None

    def nodes(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _marks(tag: str, attributes: str) -> tuple[str, int]:
    """The label by which nodes are aligned, and the kind of page furniture that the element is."""
    plain = ELEMENT if tag in FURNITURE else NAMED if tag == "header" else NOT
    if not attributes.strip():
        return tag, plain
    words: list[str] = []
    hidden = False
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() in ("hidden", "aria-hidden"):
            hidden |= value in ("", "true", "hidden")
        elif name.lower() != "itemprop":
            words += value.split()
    label = tag + "".join("." + re.sub(r"\d+", "0", w) for w in words[:3])
    if hidden or plain == ELEMENT:
        return label, ELEMENT
    whole = FURNITURE_WORDS.intersection(words) - PARTS
    if tag == "article":
        return label, WHOLE if whole & {"comment", "ad", "advert", "promo", "related", "sponsored"} else NOT
    if tag in ("html", "body", "main"):
        return label, NOT
    if whole and tag not in RUNNING:
        return label, WHOLE
    parts = [p for w in words if (p := [x for x in _SPLIT.split(w) if x])]
    marked = [p for p in parts if p[0] not in MODIFIERS and p[-1] not in LAYOUT and FURNITURE_WORDS.intersection(p)]
    # a container of content stays if furniture is only named in passing: class="content sidebar-left"
    if marked and any(p[-1] in CONTENT_WORDS and p not in marked for p in parts):
        marked = [p for p in marked if p[-1] in FURNITURE_WORDS]
    return label, NAMED if marked else plain


def parse(page: str) -> Node:
    """The tree of blocks; inline elements leave only their text."""
    root = here = Node("#", "#", NOT, None)
    at, links = 0, 0
    deep: list[str] = []  # open elements below the deepest level

    def text(piece: str) -> None:
        if piece:
            if links:
                here.linked += len(piece)
            if here.items and isinstance(here.items[-1], str):
                here.items[-1] += piece
            else:
                here.items.append(piece)

    def close(node: Node) -> None:
        nonlocal here
        deep.clear()
        here = node.up or root

    def open_(tags: set[str], until: set[str]) -> Node | None:
        n = here
        while n is not root:
            if n.tag in tags:
                return n
            if n.tag in until:
                return None
            n = n.up
        return None

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            elif deep and tag in deep:
                while deep.pop() != tag:
                    pass
                text("\n")
            elif tag in BLOCKS or tag in ("span", "b", "i", "strong", "em", "button", "label"):
                n = open_({tag}, {"table", "td"} - {tag} if tag not in ("table", "tr", "tbody", "body", "html", "article", "main", "div", "section") else set())
                if n is not None:
                    close(n)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else size if tag in ("script", "style", "textarea", "title", "xmp") else at
            continue
        if tag == "br" or tag == "hr":
            text("\n")
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        block = tag in BLOCKS
        if here.depth >= DEEPEST:
            if block:
                deep.append(tag)
                text("\n")
            continue
        if block:
            if tag in CLOSES_P and (n := open_({"p"}, {"table", "td", "li", "button"})) is not None:
                close(n)
                links = 0
            if tag in ENDS and (n := open_(*ENDS[tag])) is not None:
                close(n)
        label, kind = _marks(tag, attributes)
        if block or kind > NAMED:
            child = Node(tag, label, kind, here)
            here.items.append(child)
            here = child
    return root


def clean(piece: str) -> str:
    return " ".join(entities.unescape(piece).split()) if "&" in piece else " ".join(piece.split())


def _digest(piece: str) -> int:
    return int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1


# --- templates ---


class Template:
    """A node of a host's template and, once texts are counted, its constant texts and varying characters."""

    __slots__ = ("label", "kind", "children", "at", "constant", "varying", "differs", "root")

    def __init__(self, label: str, kind: int):
        self.label, self.kind = label, kind
        self.children: list[Template] = []
        self.at, self.differs, self.root = -1, False, False  # place in the template, no text on most of two bodies or more, content root
        self.constant: set[int] = set()
        self.varying = 0  # characters of unlinked texts that are not constant

    def pack(self) -> list:
        return [self.label, self.kind, [c.pack() for c in self.children]]

    @classmethod
    def unpack(cls, x: list) -> Template:
        t = cls(x[0], x[1])
        t.children = [cls.unpack(c) for c in x[2]]
        return t


class Group:
    """Like siblings of a page, as the one repeated node that they are in the template."""

    __slots__ = ("label", "kind", "members", "children")

    def __init__(self, members: list[Node]):
        self.label, self.kind, self.members = members[0].label, members[0].kind, members
        merged: list[Group] = []
        for m in members:
            own = [Group(run) for run in _runs(m.nodes())]
            merged = own if not merged else _merge_groups(merged, own)
        self.children = merged

    def pack(self) -> list:
        return [self.label, self.kind, [c.pack() for c in self.children]]


def _runs(nodes: list[Node]) -> list[list[Node]]:
    out: list[list[Node]] = []
    for n in nodes:
        if out and out[-1][0].label == n.label:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def _merge_groups(a: list[Group], b: list[Group]) -> list[Group]:
    out, i = [], 0
    for x, y in match(a, b):
        if x is not None and y is not None:
            x.members = x.members + y.members
            x.children = _merge_groups(x.children, y.children)
        out.append(x if x is not None else y)
        i += 1
    return out


def similarity(a, b) -> int:
    """Simple tree matching: the size of the largest order-preserving mapping of two trees with like roots."""
    if a.label != b.label:
        return 0
    return 1 + _table(a.children, b.children)[-1][-1]


def _table(a: list, b: list) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(max(last[j + 1], row[j], last[j] + similarity(x, y) if x.label == y.label else 0))
        rows.append(row)
    return rows


def match(a: list, b: list) -> list[tuple]:
    """The children of two aligned nodes in order: pairs, and those on one side only."""
    if [x.label for x in a] == [y.label for y in b]:
        return list(zip(a, b, strict=True))
    rows = _table(a, b)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1].label == b[j - 1].label and rows[i][j] == rows[i - 1][j - 1] + similarity(a[i - 1], b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and rows[i][j] == rows[i - 1][j]:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def own_texts(node: Node) -> list[str]:
    return [t for x in node.items if isinstance(x, str) and (t := clean(x))]


def join(t: Template, other: Template) -> None:
    """Adds another tree of the same host to a template."""
    children = []
    for x, y in match(t.children, other.children):
        if x is not None and y is not None:
            join(x, y)
        children.append(x if x is not None else y)
    t.children = children


def paths(packed: list, above: str = "") -> Iterator[str]:
    """The labels from the root down to each node; a node stands for all that have the same."""
    here = f"{above}/{packed[0]}"
    yield here
    for c in packed[2]:
        yield from paths(c, here)


def common_part(packed: list, known: set[str], above: str = "") -> list:
    """A tree without the nodes that the template does not take; siblings that then stand side by side are one."""
    here = f"{above}/{packed[0]}"
    merged: list[Template] = []
    for c in packed[2]:
        if f"{here}/{c[0]}" in known:
            own = Template.unpack(common_part(c, known, here))
            if merged and merged[-1].label == own.label:
                join(merged[-1], own)
            else:
                merged.append(own)
    return [packed[0], packed[1], [t.pack() for t in merged]]


def align(t: Template, g: Group) -> None:
    """Points the page's nodes at their template nodes."""
    for m in g.members:
        m.template = t
    for x, y in match(t.children, g.children):
        if x is not None and y is not None:
            align(x, y)


# --- the wrapper ---


def numbered(t: Template) -> list[Template]:
    """The nodes of a template in order; each knows its place."""
    out = [t]
    t.at = 0
    for n in out:
        for c in n.children:
            c.at = len(out)
            out.append(c)
    return out


def slots(root: Node) -> tuple[int, dict[int, dict[int, int]]]:
    """The digest of an aligned page's body; its template nodes with their texts and the texts' lengths (0 in blocks that are mostly links)."""
    found: dict[int, dict[int, int]] = {}
    texts: list[str] = []
    todo = [(root, False)]
    while todo:
        n, named = todo.pop()
        if n.kind == ELEMENT:
            continue
        named = named or n.kind != NOT
        own = own_texts(n)
        if not named:
            texts += own
        if n.template is not None:
            free = n.linked * 2 <= sum(len(x) for x in n.items if isinstance(x, str))
            found.setdefault(n.template.at, {}).update((_digest(x), len(x) if free else 0) for x in own)
        todo += [(c, named) for c in reversed(n.nodes())]
    return _digest("\n".join([x for x in texts if x.count(" ") >= BODY_WORDS - 1] or texts)), found


def constant(n: int, bodies: int) -> bool:
    """Whether a text on n of a slot's bodies is on more than half of such bodies, by Wilson's lower bound."""
    p = n / bodies
    return (p + Z * Z / (2 * bodies) - Z * math.sqrt(p * (1 - p) / bodies + Z * Z / (4 * bodies * bodies))) / (1 + Z * Z / bodies) > 0.5


def _headline(t: Template) -> bool:
    """Whether an h1 that differs between pages lies in a node, outside of other furniture."""
    return any(c.kind < WHOLE and (c.label.split(".")[0] == "h1" and c.differs or _headline(c)) for c in t.children)


def _content(t: Template, named: bool) -> int:
    """Varying, unlinked characters below a template node, without furniture; with `named`, named parts count."""
    if t.kind > NAMED or t.kind == NAMED and not named and not _headline(t):
        return 0
    return t.varying + sum(_content(c, named) for c in t.children)


def content_roots(t: Template, named: bool = False) -> list[Template]:
    """The template nodes that hold the host's content: the deepest ones that have varying text of their own or a fifth of theirs in paragraphs, on every branch."""
    total = _content(t, named)
    if not total:
        return []
    paragraphs = sum(_content(c, named) for c in t.children if c.label.split(".")[0] in ("p", "h1", "h2", "h3", "li", "pre", "td"))
    if t.varying or paragraphs > 0.2 * total:
        return [t]
    return [r for c in t.children for r in content_roots(c, named)]


def wrapper(packed: str) -> Template:
    """A template with its counted texts: the content roots are marked, constant texts known."""
    x = json.loads(packed)
    t = Template.unpack(x["template"])
    nodes = numbered(t)
    for s in x.get("slots", ()):
        n = nodes[s["slot"]]
        found = [c for c in s["often"] if constant(c["n"], s["bodies"])]
        n.constant = {c["text"] for c in found}
        n.varying = s["chars"] - sum(c["chars"] for c in found)
        n.differs = s["bodies"] > 1 and not s["often"]
    for r in content_roots(t) or content_roots(t, True):
        r.root = True
    return t


def extract(page: str, template: Template) -> str:
    """The page's content slots, in page order."""
    root = parse(page)
    align(template, Group([root]))

    def texts(everywhere: bool, named: bool) -> Iterator[str]:
        todo: list = [(root, False, False)]
        while todo:
            x, inside, under = todo.pop()
            if isinstance(x, str):
                if piece := clean(x):
                    yield piece
                continue
            chosen = x.template is not None and x.template.root
            under = under or chosen
            if x.kind > NAMED or x.kind == NAMED and not (under or named):
                continue
            inside = inside or chosen or x.template is None
            known = x.template.constant if x.template is not None else ()
            todo += [(i, inside, under) for i in reversed(x.items) if isinstance(i, Node) or (inside or everywhere) and not (known and _digest(clean(i)) in known)]

    for everywhere, named in ((False, False), (True, False), (True, True)):  # all varying slots if nothing of this page is under a root
        if found := " ".join(texts(everywhere, named)):
            return found
    return ""


# --- on columns ---


def _host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1), F.lit("")))


def _small(table: DataFrame) -> DataFrame:
    """A table for a join on the host: broadcast if its measured size allows, else Spark splits hot hosts."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("host")).cast("long"), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def induce(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """host and template (JSON), from every page: pages(host, html).  The same whatever the partitions and the order of the pages."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        known: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[i] for k in known], pa.string()) for i in range(2)] + [pa.array(list(known.values()), pa.int64())], names=["host", "template", "n"])
            known.clear()
            return out

        for b in steps(batches, "html", 1 << 20):
            for host, page in zip(b.column("host").to_pylist(), strings(b.column("html")).to_pylist(), strict=True):
                known[host, json.dumps(Group([parse(page)]).pack(), separators=(",", ":"))] += 1
            if len(known) > 2000:
                yield rows()
        yield rows()

    found = pages.mapInArrow(shapes, "host string, template string, n long").groupBy("host", "template").agg(F.sum("n").alias("n"))
    found = written(spark, found, "shapes")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            count: Counter = Counter()
            for host, packed, n in zip(*(b.column(c).to_pylist() for c in ("host", "template", "n")), strict=True):
                for p in set(paths(json.loads(packed))):
                    count[host, p] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in count], pa.string()) for i in range(2)] + [pa.array(list(count.values()), pa.int64())], names=["host", "path", "n"])

    nodes = found.mapInArrow(of, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))
    # the root's path is on every page; a known path is on RARE of them, so a host has a bounded list
    total = F.max(F.when(F.col("path") == "/#", F.col("n")))
    often = nodes.join(nodes.groupBy("host").agg(total.alias("total")), "host").where((F.col("path") == "/#") | (F.col("n") >= F.greatest(F.least(F.lit(2), F.col("total")), F.col("total") * RARE)))
    known_paths = written(spark, often.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("path"))).alias("template")), "paths")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        sets: dict[str, set[str]] = {}
        for b in batches:
            out = []
            for packed, known in zip(b.column("shape").to_pylist(), b.column("template").to_pylist(), strict=True):
                if known not in sets:
                    if len(sets) > 500:
                        sets.clear()
                    sets[known] = set(json.loads(known))
                out.append(json.dumps(common_part(json.loads(packed), sets[known]), separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.string())], names=["host", "template"])

    pruned = found.select("host", F.col("template").alias("shape")).join(_small(known_paths), "host").select("host", "shape", "template").mapInArrow(prune, "host string, template string").distinct()

    def merge(table: pa.Table) -> pa.Table:
        sys.setrecursionlimit(20_000)
        packed = sorted(table.column("template").to_pylist(), key=lambda x: (len(x), x))  # by content, not by arrival
        t = Template.unpack(json.loads(packed[0]))
        for p in packed[1:]:
            join(t, Template.unpack(json.loads(p)))
        return pa.table({"host": table.column("host")[:1], "template": [json.dumps(t.pack(), separators=(",", ":"))]})

    while True:
        pruned = written(spark, pruned, "trees")
        count = pruned.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
        if (count.agg(F.max("of")).first()[0] or 0) <= FOLD:
            return pruned.groupBy("host").applyInArrow(merge, "host string, template string")
        # about half of FOLD trees a group, dealt by their content
        dealt = pruned.join(count, "host").withColumn("salt", F.pmod(F.xxhash64("template"), F.ceil(F.col("of") * 2 / FOLD).cast("long")))
        pruned = dealt.select("host", "salt", "template").groupBy("host", "salt").applyInArrow(merge, "host string, template string").distinct()


def counted(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """host and slots (places in the template with their bodies, characters and frequent texts): pages(host, html, template)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        known: dict[str, Template] = {}
        for b in steps(batches, "html", 1 << 20):
            out: list[tuple] = []
            for host, page, packed in zip(b.column("host").to_pylist(), strings(b.column("html")).to_pylist(), b.column("template").to_pylist(), strict=True):
                t = known.get(packed)
                if t is None:
                    if len(known) > 500:
                        known.clear()
                    t = known[packed] = Template.unpack(json.loads(packed))
                    numbered(t)
                root = parse(page)
                align(t, Group([root]))
                body, found = slots(root)
                for slot, texts in found.items():
                    out.append((host, slot, 0, body, 0))  # text 0 is the slot itself
                    out += [(host, slot, d, body, n) for d, n in texts.items()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "slot", "text", "body", "chars"])

    once = pages.mapInArrow(run, "host string, slot int, text long, body long, chars long").groupBy("host", "slot", "text", "body").agg(F.max("chars").alias("chars"))
    texts = written(spark, once.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "texts")
    itself = F.col("text") == 0
    sums = texts.groupBy("host", "slot").agg(F.max(F.when(itself, F.col("n"))).alias("bodies"), F.sum("chars").alias("chars"))
    often = texts.where(~itself & (F.col("n") >= 2)).select("host", "slot", F.struct("text", "n", "chars").alias("c"))
    often = often.join(sums.select("host", "slot", "bodies"), ["host", "slot"]).where(F.col("c.n") * 2 > F.col("bodies")).groupBy("host", "slot").agg(F.sort_array(F.collect_list("c")).alias("often"))
    slot = F.struct("slot", "bodies", "chars", F.coalesce("often", F.array().cast(often.schema["often"].dataType)).alias("often"))
    return sums.join(often, ["host", "slot"], "left").groupBy("host").agg(F.sort_array(F.collect_list(F.to_json(slot))).alias("slots"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host("url").alias("host"))
    spark = pages.sparkSession

    templates = written(spark, induce(spark, rows.select("host", "html")), "templates")
    texts = counted(spark, rows.join(_small(templates), "host", "inner").select("host", "html", "template"))
    both = F.concat(F.lit('{"template":'), F.col("template"), F.lit(',"slots":['), F.array_join(F.coalesce("slots", F.array().cast("array<string>")), ","), F.lit("]}"))
    wrappers = written(spark, templates.join(texts, "host", "left").select("host", both.alias("template")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        known: dict[str, Template] = {}
        for b in steps(batches, "html", 1 << 20):
            texts = []
            for page, packed in zip(strings(b.column("html")).to_pylist(), b.column("template").to_pylist(), strict=True):
                t = known.get(packed)
                if t is None:
                    if len(known) > 500:
                        known.clear()
                    t = known[packed] = wrapper(packed)
                texts.append(extract(page, t))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(_small(wrappers), "host", "inner").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
