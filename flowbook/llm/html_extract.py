"""Main text of web pages by wrapper induction (op6).

A page is read once, into its text blocks and the skeleton of the elements around
them.  The distinct skeletons of a host are merged by simple tree matching (``trees``),
some at a time and then the results of those, into the host's template tree, and each
skeleton is aligned with it: a node of the template is a slot.  For each slot the
distinct pages and, of each text, the distinct pages that hold it are counted, exactly
and for all texts.  Pages with one article are one page, whatever is around it.

Texts that stand in nearly all distinct pages of their slot are constant; slots of
mostly linked text are menus; the others vary and hold content.  If a page has an
``article`` or ``main`` element, its content is what varies inside; else it is the
varying slots below the template's smallest node that holds most varying text.
If no more than headings would be left of an article, the host repeats it as a whole
and it is kept.  Elements that are no article text by their tag, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, comments) never count.

Null html, or one without text, gives the empty string.  A null or odd url belongs
to the host without a name.  Rows are extracted one by one; copies of a page count
once in a template.  Elements below ``DEEPEST`` levels belong to the node at that
level; their text is kept.  Other columns pass through ``extract``.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbook.llm import trees
from flowbook.llm.store import columns, stored
from flowbook.llm.url_filter import host_of
from flowbook.operators import skew
from flowbook.operators.broadcast import bounded

# A quote opens a value only after an equals sign; nothing is tried twice, so broken pages take time in proportion.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?/][^<>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr "
                    "picture button math mi mn mo mrow ms mspace mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mtable mtr mtd semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object annotation annotation-xml".split())
_OUT_TAGS = frozenset("nav header footer aside form menu dialog select button head option".split()) | _RAW
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing "
    "social comment comments commentlist disqus respond footer masthead toolbar pagination pager copyright disclaimer teaser teasers".split())
#: What a class or id name may hold beside those words and still be one of them.
_PLAIN_WORDS = frozenset(
    "site main page container wrapper wrap box bar list links link section block area top bottom left right button buttons post posts article articles "
    "slot unit inner outer item items global content text primary secondary header head panel row col group js id the".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
#: Open elements that a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MIN_PAGES, CONSTANT, MENU = 5, 0.8, 0.5
#: Levels of a skeleton, and how many trees of a host a task merges at once.
DEEPEST, AT_ONCE = 100, 64


def digest(data: str | bytes) -> int:
    return int.from_bytes(blake2b(data.encode() if isinstance(data, str) else data, digest_size=8).digest(), "little")


def signed(data: str) -> int:
    """``digest`` as a long."""
    n = digest(data)
    return n - 2**64 if n >= 2**63 else n


class Block:
    """A run of text of one block: its node, whether it is in an article and whether
    it is out by the elements around it."""

    __slots__ = ("node", "text", "linked", "inside", "out")

    def __init__(self, node: trees.Node, text: str, linked: int, inside: bool, out: bool):
        self.node, self.text, self.linked, self.inside, self.out = node, text, linked, inside, out


class _Open:
    """An open element; ``block`` is the place of the nearest one that is not inline (-1: none)."""

    __slots__ = ("tag", "node", "level", "inside", "out", "block")

    def __init__(self, tag: str, node: trees.Node, level: int, inside: bool, out: bool, block: int):
        self.tag, self.node, self.level, self.inside, self.out, self.block = tag, node, level, inside, out, block


def _is_out(name: str, words: frozenset[str] | set[str] = _OUT_WORDS) -> bool:
    """A whole class or id name says so: its parts are listed words, and plain ones beside them."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in words for x in parts) and all(x in words or x in _PLAIN_WORDS for x in parts)


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag and classes, and whether the element is out by them."""
    out = tag in _OUT_TAGS
    if not attributes.strip():
        return tag, out
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "article", "main"):
        out = out or any(map(_is_out, names)) or hidden or a.get("role", "").lower() in _OUT_ROLES
    elif tag == "article":
        out = any(_is_out(x, {"comment", "comments", "related", "teaser", "ad", "sponsored"}) for x in names)
    if a.get("role") == "main":
        tag = "main"
    classes = ".".join(sorted({m[0] for x in a.get("class", "").lower().split() if (m := re.match("[a-z][a-z_-]*", x))}))  # without numbers and what follows
    return f"{tag}.{classes}" if classes else tag, out


def blocks(page: str, nodes: list[trees.Node] | None = None) -> list[Block]:
    """The text blocks of a page, in order; ``nodes`` takes the elements, the root first."""
    out: list[Block] = []
    root = trees.Node("")
    nodes = [] if nodes is None else nodes
    nodes.append(root)
    base = _Open("", root, 0, False, False, -1)
    stack: list[_Open] = []
    count: dict[str, int] = {}  # open elements by tag
    parts: list[str] = []
    state = {"linked": 0}
    made: dict[tuple[str, str], tuple[str, bool]] = {}

    def around() -> _Open:
        """The nearest block."""
        return stack[stack[-1].block] if stack and stack[-1].block >= 0 else base

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = around()
                if not own.out:
                    own.node.grow()
                out.append(Block(own.node, text, min(len(text), state["linked"]), own.inside, own.out))
            parts.clear()
        state["linked"] = 0

    def pop(n: int) -> None:
        if stack[-1].block >= n:
            flush()
        for x in stack[n:]:
            count[x.tag] -= 1
        del stack[n:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        data = page[at:m.start() if m else len(page)]
        if data:
            if around().out or not stack or not stack[-1].out:  # else an inline element is out of a block that isn't
                data = entities.unescape(data) if "&" in data else data
                parts.append(data)
                if count.get("a"):
                    state["linked"] += len(data.strip())
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                pop(n)
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag in ("title", "textarea"):
                flush()
            continue
        block = tag not in _INLINE
        if block:
            open_ = around().tag
            if open_ == "p" or open_ in _ENDS.get(tag, ()):
                pop(stack[-1].block)
            flush()
        key = (tag, m[3])
        if key not in made:
            made[key] = _signature(tag, m[3])
        signature, gone = made[key]
        up = stack[-1] if stack else base
        if up.inside and tag == "header":
            gone = False  # an article's own header holds its heading
        node, level = up.node, up.level
        if block and level < DEEPEST:
            node, level = trees.Node(signature, up.node), level + 1
            nodes.append(node)
        inside = up.inside or (not up.out and not gone and (tag == "article" or signature.split(".")[0] == "main"))
        stack.append(_Open(tag, node, level, inside, up.out or gone, len(stack) if block else up.block))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return out


def page_blocks(page: str) -> tuple[int, trees.Node, list[tuple[int, Block]]]:
    """What stands for the page (its article, if it has one, so that an article in
    several frames is one page), its skeleton, and its blocks that are not out, each
    with the number of its node in the skeleton's preorder."""
    nodes: list[trees.Node] = []
    own = [b for b in blocks(page, nodes) if not b.out]
    trees.fold([n for n in nodes if n.seen or n is nodes[0]])
    numbers = {id(n): i for i, n in enumerate(trees.preorder(nodes[0]))}
    article = "\n".join(b.text for b in own if b.inside)
    return signed(article or page), nodes[0], [(numbers[id(b.node.now())], b) for b in own]


class Slot:
    """A node of a host's template: the distinct pages that have text there, its text
    and link characters, how many texts it holds and which are constant."""

    __slots__ = ("pages", "chars", "linked", "texts", "fixed")

    def __init__(self, pages: int, chars: int, linked: int, texts: int, fixed: list[int]):
        self.pages, self.chars, self.linked, self.texts, self.fixed = pages, chars, linked, texts, fixed


def wrapper(template: trees.Node, slots: dict[int, Slot]) -> dict:
    """What extraction needs of a host's template: the constant texts by slot, the
    slots of menus, and the smallest node with most varying text (the range of its
    slots, none if there is no such node)."""
    nodes = trees.preorder(template)
    tags = [n.label.split(".")[0] for n in nodes]
    ends, inside = [0] * len(nodes), [False] * len(nodes)
    numbers = {id(n): i for i, n in enumerate(nodes)}
    varying = [0] * len(nodes)
    menus = []
    for i, node in enumerate(nodes):
        inside[i] = inside[i] or tags[i] in ("article", "main")
        for c in node.children:
            inside[numbers[id(c)]] = inside[i]
        n = slots.get(i)
        if n is None:
            continue
        varying[i] = 0 if n.texts and len(n.fixed) == n.texts else n.chars
        if n.chars and n.linked > MENU * n.chars and tags[i] not in (*_HEADINGS, "p"):
            varying[i] = 0
            if n.pages >= MIN_PAGES or not inside[i]:  # a few articles' list of links is no menu yet
                menus.append(i)
    for i in range(len(nodes) - 1, -1, -1):
        ends[i] = max((ends[numbers[id(c)]] for c in nodes[i].children), default=i + 1)
        varying[i] += sum(varying[numbers[id(c)]] for c in nodes[i].children)
    most = [i for i in range(1, len(nodes)) if varying[0] and varying[i] >= 0.7 * varying[0] and tags[i] not in ("p", *_HEADINGS)]
    main = max(most, default=0)  # they lie in one another, since each has over half
    return {"constant": {str(i): sorted(n.fixed) for i, n in sorted(slots.items()) if n.fixed}, "menus": menus, "main": [main, ends[main]] if main else []}


def main_text(own: list[tuple[int, str, int, bool]], known: dict | None, tags: list[str]) -> str:
    """The content of a page's blocks (slot, text, its hash, inside), joined by line
    feeds.  ``tags`` are those of the template's slots."""
    known = known or {"constant": {}, "menus": (), "main": ()}
    constant, menus, main = known["constant"], known["menus"], known["main"]
    inside = any(b[3] for b in own)
    if inside:
        own = [b for b in own if b[3]]
    elif main:
        own = [b for b in own if main[0] <= b[0] < main[1]] or own
    kept = [b for b in own if b[0] not in menus and b[2] not in constant.get(str(b[0]), ())]
    if inside and all(tags[b[0]] in _HEADINGS for b in kept):
        kept = own  # not template text around an article, but an article that the host repeats
    return "\n".join(b[1] for b in kept)


_READ = [("flowbook_host", pa.string()), ("flowbook_skel", pa.string()), ("flowbook_skeleton", pa.string()), ("flowbook_page", pa.int64()),
         ("flowbook_nodes", pa.list_(pa.int32())), ("flowbook_texts", pa.list_(pa.string())), ("flowbook_hashes", pa.list_(pa.int64())),
         ("flowbook_chars", pa.list_(pa.int64())), ("flowbook_linked", pa.list_(pa.int64())), ("flowbook_inside", pa.list_(pa.bool_()))]
_READ_SCHEMA = ("flowbook_host string, flowbook_skel string, flowbook_skeleton string, flowbook_page long, flowbook_nodes array<int>, flowbook_texts array<string>, "
                "flowbook_hashes array<long>, flowbook_chars array<long>, flowbook_linked array<long>, flowbook_inside array<boolean>")


def read(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` without the html, and of each its host, what stands for it, its
    skeleton's key and its blocks; a task tells a skeleton itself once."""
    names = [c for c in pages.columns if c != html_col]
    own = pages.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{html_col}`").alias("flowbook_html"), host_of(F.col(f"`{url_col}`")).alias("flowbook_host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = []
                for host, page in zip(part.column("flowbook_host").to_pylist(), part.column("flowbook_html").to_pylist(), strict=True):
                    stands, root, found = page_blocks(page or "")
                    if not found:
                        rows.append((host, None, None, None, [], [], [], [], [], []))
                        continue
                    tree = trees.dumps(root)
                    key = f"{digest(f'{host}\0{tree}'):016x}"
                    if len(told) > 200_000:
                        told.clear()
                    rows.append((host, key, None if key in told else tree, stands, [i for i, _ in found], [x.text for _, x in found], [signed(x.text) or 1 for _, x in found],
                                 [len(x.text) for _, x in found], [x.linked for _, x in found], [x.inside for _, x in found]))
                    told.add(key)
                new = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _READ, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *new], names=[*names, *[n for n, _ in _READ]])

    return own.mapInArrow(run, columns(pages.select(*[F.col(f"`{c}`") for c in names])) + _READ_SCHEMA)


def templates(skeletons: DataFrame) -> DataFrame:
    """(host, tree): a host's (host, skel, skeleton) merged, at most some ``AT_ONCE``
    trees in a task; the results are merged again until each host has one."""

    def merged(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [df["host"].iloc[0]], "tree": [trees.template(df["tree"].tolist())]})

    level = skeletons.select("host", F.col("skeleton").alias("tree"))
    parts = level.groupBy("host").count().agg(F.max("count")).first()[0] or 0  # one value
    while True:
        parts = max(1, -(-parts // AT_ONCE))
        level = stored(level.groupBy("host", F.pmod(F.xxhash64("tree"), F.lit(parts)).alias("part")).applyInPandas(merged, "host string, tree string"), "templates")
        if parts == 1:
            return level


def alignment(skeletons: DataFrame, whole: DataFrame) -> DataFrame:
    """(skel, slots): for each node of a skeleton its number in the host's template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, root, numbers = None, None, {}
        for b in batches:
            out = []
            for tree, skeleton in zip(b.column("tree").to_pylist(), b.column("skeleton").to_pylist(), strict=True):
                if tree != text:
                    text, root = tree, trees.loads(tree)
                    numbers = {id(n): i for i, n in enumerate(trees.preorder(root))}
                out.append(trees.places(root, numbers, trees.loads(skeleton)))
            yield pa.RecordBatch.from_arrays([b.column("skel"), pa.array(out, pa.list_(pa.int32()))], names=["flowbook_skel", "flowbook_slots"])

    return _with(skeletons, whole, "host").select("skel", "skeleton", "tree").mapInArrow(run, "flowbook_skel string, flowbook_slots array<int>")


def _with(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``small``, one row a key: broadcast within the
    bounds of ``broadcast``, else joined with hot keys of ``rows`` measured and salted."""
    small, fits = bounded(small)
    if fits:
        return rows.join(small, key, "left")
    hot = skew.measure(rows, k=F.col(key))["k"]
    drawn = rows.withColumn(skew.SALT, hot.draw(F.col(key), F.monotonically_increasing_id()))
    return drawn.join(hot.repeated(small, key), [key, skew.SALT], "left").drop(skew.SALT)


def wrappers(placed: DataFrame, whole: DataFrame) -> DataFrame:
    """(host, tree, wrapper) of the pages read, with their slots."""

    def last(df: pd.DataFrame) -> pd.DataFrame:
        tree = next(t for t in df["tree"] if t is not None)
        slots = {int(i): Slot(int(n), int(c), int(k), int(t), [x for x in map(int, f)])
                 for i, n, c, k, t, f in zip(df["slot"], df["pages"], df["chars"], df["linked"], df["texts"], df["fixed"], strict=True) if n}
        return pd.DataFrame({"host": [df["host"].iloc[0]], "tree": [tree], "wrapper": [json.dumps(wrapper(trees.loads(tree), slots))]})

    block = lambda name: F.get(F.col(f"flowbook_{name}"), F.col("i"))
    key = lambda slot: F.xxhash64("host", slot)
    each = placed.filter("flowbook_skel IS NOT NULL").select("*", F.posexplode("flowbook_nodes").alias("i", "node")).select(
        key(F.get("flowbook_slots", F.col("node"))).alias("slot"), F.col("flowbook_page").alias("page"), block("chars").alias("chars"), block("linked").alias("linked"), block("hashes").alias("text"))
    rows = each.select("slot", "page", F.explode(F.array(  # text 0: the slot itself
        F.struct(F.lit(0).cast("long").alias("text"), "chars", "linked"), F.struct("text", F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("linked")))).alias("r")).select("slot", "page", "r.*")
    # exact counts over distinct pages, summed from partial counts: no host's, slot's or text's rows are gathered
    counts = stored(rows.groupBy("slot", "text", "page").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
                    .groupBy("slot", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "slot-counts")
    nodes = counts.groupBy("slot").agg(F.max(F.when(F.col("text") == 0, F.col("n"))).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
                                       F.count(F.when(F.col("text") != 0, 1)).alias("texts"))
    fixed = (counts.filter((F.col("text") != 0) & (F.col("n") >= CONSTANT * MIN_PAGES)).select("slot", "text", "n")
             .join(nodes.filter(F.col("pages") >= MIN_PAGES).select("slot", "pages"), "slot").filter(F.col("n") >= CONSTANT * F.col("pages"))
             .groupBy("slot").agg(F.collect_list("text").alias("fixed")))
    n = F.size(F.regexp_extract_all("tree", F.lit(r'\["'), 0))  # nodes
    names = whole.select("host", "tree", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "host", F.when(F.col("k") == 0, F.col("tree")).alias("tree"), F.col("k").alias("slot_no"), key(F.col("k")).alias("slot"))
    one = names.join(nodes, "slot", "left").join(fixed, "slot", "left").select(
        "host", "tree", F.col("slot_no").alias("slot"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "chars", "linked", "texts")],
        F.coalesce("fixed", F.array().cast("array<long>")).alias("fixed"))
    return one.groupBy("host").applyInPandas(last, "host string, tree string, wrapper string")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "main_text") -> DataFrame:
    """``pages`` without the html and with ``main_text``."""
    names = [c for c in pages.columns if c != html_col]
    own = stored(read(pages, html_col, url_col), "page-blocks")
    skeletons = stored(own.filter("flowbook_skeleton IS NOT NULL").select(
        F.col("flowbook_host").alias("host"), F.col("flowbook_skel").alias("skel"), F.col("flowbook_skeleton").alias("skeleton")).distinct(), "skeletons")
    whole = templates(skeletons)
    slots = stored(alignment(skeletons, whole), "alignment")
    counted = own.select(F.col("flowbook_host").alias("host"), *[f"flowbook_{c}" for c in ("skel", "page", "nodes", "hashes", "chars", "linked")])
    known = stored(wrappers(_with(counted, slots, "flowbook_skel"), whole), "wrappers").toDF("flowbook_host", "flowbook_tree", "flowbook_wrapper")
    parts = ("nodes", "texts", "hashes", "inside", "slots", "tree", "wrapper")
    given = own.select(*[F.col(f"`{c}`") for c in names], *[f"flowbook_{c}" for c in ("host", "skel", "nodes", "texts", "hashes", "inside")])
    joined = _with(_with(given, slots, "flowbook_skel"), known, "flowbook_host").select(*[F.col(f"`{c}`") for c in names], *[f"flowbook_{c}" for c in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapped: dict[tuple, tuple[dict, list[str]]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = []
                for nodes, said, hashes, inside, places, tree, w in zip(*[part.column(f"flowbook_{c}").to_pylist() for c in parts], strict=True):
                    if not nodes:
                        texts.append("")
                        continue
                    if (tree, w) not in wrapped:
                        if len(wrapped) > 2000:
                            wrapped.clear()
                        wrapped[tree, w] = json.loads(w), [n.label.split(".")[0] for n in trees.preorder(trees.loads(tree))]
                    texts.append(main_text([(places[i], t, h, x) for i, t, h, x in zip(nodes, said, hashes, inside, strict=True)], *wrapped[tree, w]))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(texts, pa.string())], names=[*names, text_col])

    return joined.mapInArrow(run, f"{columns(pages.select(*[F.col(f'`{c}`') for c in names]))}{text_col} string")
