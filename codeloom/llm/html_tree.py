"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: its elements are the paths of tags and classes, with the
presentations (sequences of child elements) seen under each, and its leaves the texts seen at each
path. An element is worth little where all pages present it alike and show the same texts in it,
and much where pages differ: importance is one less the normalised entropy with which
texts repeat over pages, combined with that of its presentations. A single text is worth little where most pages that have
its element show it, too. Pages are told apart by their two longest texts, so that copies of a page say nothing of what pages share.

Names are a prior that weighs as much as some pages: article and main speak for an element and all in it, a
part of a class name like ``footer`` in ``site-footer`` against it; without either the tree of all hosts is the prior.
Only tags and whole class names that always mean something else (nav, script, form; ads, comments, ...) settle it, as adverts
and readers' comments differ from page to page like the text itself. Elements and texts of low importance are cut from each page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, materialize, skew_join

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option legend".split())
CUT = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input label menu nav noembed noframes noscript object "
    "option script select style svg template textarea title video".split()
)
#: Class names and ids that say that an element is no main text; as a part of a longer name they only speak against it.
CUT_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tags toolbar topbar widget".split()
)
CUT_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
KEEP_WORDS = frozenset("articlebody".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Node:
    """An element: its name in the tree, children in page order (nodes and texts), and what its names say of it."""

    tag: str
    name: str
    fixed: bool = False  # settled to be no main text
    main: bool = False
    against: bool = False  # a part of a class name says that it is no main text
    children: list = field(default_factory=list)


def _make(tag: str, attributes: str) -> Node:
    node = Node(tag, tag, fixed=tag in CUT, main=tag in ("article", "main"))
    if attributes.strip():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        labels = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        parts = {w for label in labels for w in WORD.findall(label)}
        if parts:
            node.name = f"{tag}.{' '.join(sorted(parts))}"
            if tag not in ("html", "body"):
                node.fixed |= not CUT_WORDS.isdisjoint(labels)
                node.against = not CUT_WORDS.isdisjoint(parts)
        role = found.get("role", "").lower()
        node.fixed |= role in CUT_ROLES
        node.main |= role == "main" or found.get("itemprop", "").lower() in KEEP_WORDS
        if node.main and tag not in ("article", "main"):
            node.name += "@main"
    return node


def parse(page: str | None) -> Node:
    """The tree of a page, closed the way browsers close it: ends nobody opened are passed over,
    a new block ends an open paragraph, list items and cells end their like, and the page's end ends all."""
    root = Node("#", "#")
    open_ = [root]
    page = page or ""
    at = 0

    def text(raw: str) -> None:
        if raw:
            open_[-1].children.append(html.unescape(raw))

    def close(tags: frozenset[str] | set[str], within: frozenset[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return
            if open_[k].tag in within:
                return

    scopes = frozenset("article section div main aside nav header footer body table td th blockquote form".split())
    lists = frozenset("ul ol menu dl table".split())
    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            close({tag}, frozenset() if tag in scopes or tag in lists else scopes)
            continue
        if tag in CLOSES_P:
            close({"p"}, scopes | lists | {"li", "button"})
        if tag == "li":
            close({"li"}, lists)
        elif tag in ("dt", "dd"):
            close({"dt", "dd"}, frozenset({"dl"}))
        elif tag in ("td", "th"):
            close({"td", "th"}, frozenset({"tr", "table"}))
        elif tag == "tr":
            close({"tr"}, frozenset({"table"}))
        node = _make(tag, m[3])
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.append(node)
    rest = page[at:]
    cut = rest.rfind("<")
    if cut >= 0 and re.match(r"</?[a-zA-Z!?]|</?$", rest[cut:]):  # a tag that the page's end breaks off
        rest = rest[:cut]
    text(rest)
    return root


def path_id(parent: int, name: str) -> int:
    return _hash(name, parent)


def _hash(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed & (1 << 64) - 1)
    return x - (1 << 64) if x >> 63 else x


def _prior(node: Node, above: float | None) -> float | None:
    """What names say of an element's importance: its own and those of what it is in; None if they say nothing."""
    if node.main:
        return 1.0
    if node.against:
        return 0.5 if above else 0.0
    return above


def _host() -> Column:
    """Host of the URL in lower case, without user and port; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _spaced(text: str) -> str:
    return " ".join(text.split())


def tree_rows(root: Node) -> tuple[int, set[tuple[int, float | None, int, int]]]:
    """Hash of the page's two longest texts, and (path, prior, what, feature) of its presentations (0) and texts (1), hashed."""
    todo: list[tuple[Node, int, float | None]] = [(root, 0, None)]
    found, told = set(), set()
    while todo:
        node, path, prior = todo.pop()
        names = []
        for child in node.children:
            if isinstance(child, Node):
                names.append(child.name)
                if child.tag not in RAW and not child.fixed:
                    todo.append((child, path_id(path, child.name), _prior(child, prior)))
            elif said := _spaced(child):
                found.add((path, prior, 1, _hash(said)))
                told.add(said)
        # Repeats of a child present alike, however many there are.
        kinds = [n for k, n in enumerate(names) if not k or names[k - 1] != n]
        found.add((path, prior, 0, _hash(" ".join(kinds))))
    longest = nlargest(2, told, key=lambda t: (len(t), t))
    return _hash("\n".join(longest)), found


def page_features(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), story (hash of the two longest texts), path, prior, what, feature; distinct."""

    def rows(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: list[tuple] = []
                for host, page, text in zip(*(part[c].to_pylist() for c in ("host", "page", "html")), strict=True):
                    story, found = tree_rows(parse(text))
                    out += [(host, page, story, *each) for each in found]
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["host", "page", "story", "path", "prior", "what", "feature"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
    schema = "host string, page long, story long, path long, prior double, what int, feature long"
    keyed = pages.select(_host().alias("host"), F.xxhash64("html").alias("page"), "html")
    return keyed.mapInArrow(rows, schema).distinct()


def style_tree(features: DataFrame, lean: int = 8) -> DataFrame:
    """host, path, feature, importance (0 to 1), shown and against: elements (feature null) and single texts.

    For m pages at a path and a feature on k of them, the feature's entropy over pages is
    log k / log m; an element's text importance is 1 less the mean over its texts, its presentation
    importance the entropy of its presentations. A single text is worth the share of these pages without it, as
    entropy would cut on a large host what a small part of its pages tells alike. All lean on a prior as ``lean``
    pages would weigh: what names say, else what the tree of all hosts has for the path. ``shown``: pages that have
    the element or text; ``against``: a name speaks against the element and none for what it is in.
    """
    stories = features.select("host", "story", "path", "prior", "what", "feature").distinct()
    found = stories.groupBy("host", "path", "what", "feature").agg(F.count("*").alias("k"), F.max("prior").alias("prior"))
    everywhere = found.groupBy("path", "what", "feature").agg(F.sum("k").alias("k"), F.max("prior").alias("prior"))
    both = found.unionByName(everywhere.withColumn("host", F.lit("*")))
    log = lambda c: F.log(F.col(c).cast("double"))
    # A page shows one presentation of an element that it has: their sum is the element's number of pages.
    shown = both.groupBy("host", "path").agg(
        F.sum(F.when(F.col("what") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("what") == 0, F.col("k") * log("k"))).alias("styled"),
        F.avg(F.when(F.col("what") == 1, log("k"))).alias("told"),
        F.max("prior").alias("prior"),
    )
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    one_less = lambda x: F.when(F.col("m") <= 1, 1.0).otherwise(F.greatest(1 - x / log_m, F.lit(0.0)))
    own = shown.select("host", "path", "m", "prior", one_less(F.coalesce("told", F.col("styled") / F.col("m"))).alias("w"))
    general = own.filter("host = '*'").select("path", F.col("w").alias("w_all"))
    leaned = own.filter("host <> '*'").join(general, "path")
    leaned = leaned.withColumns({"against": F.col("prior").eqNullSafe(0.0), "prior": F.coalesce("prior", "w_all")})
    lean_on = lambda w: (w * F.col("m") + F.col("prior") * lean) / (F.col("m") + lean)
    elements = leaned.select("host", "path", F.lit(None).cast("long").alias("feature"), lean_on(F.col("w")).alias("importance"), F.col("m").alias("shown"), "against")
    texts = found.filter("what = 1 AND k > 1").select("host", "path", "feature", "k").join(leaned.select("host", "path", "m", "prior"), ["host", "path"])
    texts = texts.select("host", "path", "feature", lean_on(1 - F.col("k") / F.col("m")).alias("importance"), F.col("k").alias("shown"), F.lit(False).alias("against"))
    return elements.unionByName(texts)


def main_text(root: Node, elements: dict[int, float], texts: set[tuple[int, int]]) -> str:
    """Blocks of the page that are left, one a line, after cutting unimportant branches.

    ``elements`` has the importance of paths of low importance, ``texts`` the (path, feature) of such texts. An element goes
    when it and every element below it are in ``elements``. Where the page has main elements, only what is in them is left.
    """
    has_main = False
    todo = [root]
    while todo and not has_main:
        for child in todo.pop().children:
            if isinstance(child, Node) and not child.fixed:
                has_main |= child.main
                todo.append(child)

    # Composite importance, leaves first: an element is worth the most of itself and of what is below it.
    order: list[tuple[Node, int, int]] = [(root, 0, -1)]
    for k, (node, path, _) in enumerate(order):
        order.extend((c, path_id(path, c.name), k) for c in node.children if isinstance(c, Node) and not c.fixed)
    low = [path in elements for _, path, _ in order]
    for k in range(len(order) - 1, 0, -1):
        low[order[k][2]] &= low[k]
    paths = {id(node): None if cut else path for (node, path, _), cut in zip(order, low, strict=True)}

    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if said := _spaced("".join(line)):
            blocks.append(said)
        line.clear()

    # Frames of (node or text or end marker, inside a main element, path of the element it is in).
    stack: list = [(root, not has_main, 0)]
    while stack:
        item, inside, path = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            if inside and not (texts and (path, _hash(_spaced(item))) in texts):
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        else:
            own = paths.get(id(item)) if item is not root else 0
            if own is None:
                if item.tag in BLOCK:
                    end_block()
                continue
            inside = inside or item.main
            if item.tag in BLOCK:
                end_block()
                stack.append((None, inside, own))
            stack.extend((child, inside, own) for child in reversed(item.children))
    end_block()
    return "\n".join(blocks)


#: So many low rows of all hosts together are broadcast; beyond, each page gets those that it has.
BROADCAST_ROWS = 100_000
FEWEST = 3  # pages of a host that must show an element or text before it may be cut for what they share


def _low_of_pages(low: DataFrame, features: DataFrame, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with ``low``: rows of the tree of low importance, of the page's host or, where these are many, of the page itself."""
    entry = F.struct("path", "feature", "importance")
    if low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(low.groupBy("host").agg(F.collect_list(entry).alias("low"))), "host", "left")
    keys = ["host", "path", F.when(F.col("what") == 1, F.col("feature")).alias("feature")]
    key = lambda *c: F.xxhash64(*c)
    has = features.select("host", "page", *keys[1:]).distinct().withColumn("key", key("host", "path", "feature"))
    counted = has.groupBy("key").agg(F.count("*").alias("n"))
    named = low.withColumn("key", key("host", "path", "feature")).join(counted, "key").select("key", "n", "importance")
    met = skew_join(scratch.write(has, "has"), scratch.write(named, "named"), "key", "n", has.count(), F.col("page"))
    lists = met.groupBy("host", "page").agg(F.collect_list(entry).alias("low")).withColumn("key", key("host", "page"))
    pages = pages.withColumn("key", key("host", "page"))
    copies = pages.groupBy("key").agg(F.count("*").alias("n"))
    lists = materialize(lists.select("key", "low").join(copies, "key"), "lists")
    return skew_join(pages, lists, "key", "n", pages.count(), F.xxhash64("page_id", "url"), "left")


def extract_pages(pages: DataFrame, least: float = 0.35, lean: int = 8) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    - A null or empty page has the empty text; a null url belongs to the host of no name.
    - White space, as Python's split() has it, becomes one space inside a block; br counts as one.
    - Rows that repeat are extracted each for itself; an empty table gives no rows.
    - Other columns are ignored, whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    features = scratch.write(page_features(pages), "features")
    tree = style_tree(features, lean)
    low = tree.filter((F.col("importance") < least) & ((F.col("shown") >= FEWEST) | F.col("against")))
    low = materialize(low.select("host", "path", "feature", "importance"), "low")
    keyed = pages.withColumns({"host": _host(), "page": F.xxhash64("html")})
    joined = _low_of_pages(low, features, keyed, scratch)
    scratch.clear()

    def run(batches):
        for batch in batches:
            texts = []
            for page, cut in zip(batch["html"].to_pylist(), batch["low"].to_pylist(), strict=True):
                elements = {x["path"]: x["importance"] for x in cut or () if x["feature"] is None}
                said = {(x["path"], x["feature"]) for x in cut or () if x["feature"] is not None}
                texts.append(main_text(parse(page), elements, said))
            counts = pa.array(np.array([len(t) for t in texts], np.int64))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
