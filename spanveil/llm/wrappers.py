"""Main texts of web pages by wrapper induction.

The pages of a host come from a few templates. A page's DOM tree is aligned with trees of other
pages of its host by simple tree matching: equal tags match, and the
children of matched nodes are aligned in order so that most nodes match; runs of
sibling leaves with one tag are one repeated slot. Text that stays the same at matched nodes is
template, text that varies is content. The region of the content is the lowest
node that holds all varying text. Articles that a page marks are a hint: they are the region
if at least half of the varying text is in them, and else don't widen it;
navigation, forms, notices, adverts and reader comments, by tag, role or class, are never content.

Templates come from all pages. Distinct pages of a host, told by all their texts, are counted with partial
sums: by skeleton (the tree without texts), slot and text, and by the tags that lead to a slot and text.
What half of the pages with a slot have there is template. A page is aligned with the
template of its skeleton, or where that has none with the most common one of its host; what
the counts by path tell holds for every page. Pages are joined with templates by
host and skeleton, small rows, so that a host with very many pages is split by the join.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle
from spanveil.llm.url_templates import host_and_path

#: Share of the distinct pages with a slot that have a text there, from which it is template.
SHARE = 0.5
#: Share of a page's text, constant against one other page alone, from which that is a near copy and
#: tells nothing.
COPY = 0.7
#: Distinct pages that must have a slot before a text that half of them share is taken out of a marked
#: article, too; unless less than this share of the article is left, as the pages are then near copies.
FIRM, LEAST_LEFT = 5, 0.3
#: Share of a block's characters in links, outside an article, from which it is navigation.
LINKS = 0.7
#: Pages that a Python worker holds at a time.
PAGES_PER_BATCH = 500

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SKIPPED = {
    "script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object",
    "select", "canvas", "math", "audio", "video",
}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
#: An open element of the first kind ends where one of these begins.
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
#: An element outside of these is not ended by one inside.
_HOLDS_BACK = {"table", "ul", "ol", "dl", "article", "section", "div", "body"}
_ARTICLE = {"article", "main"}
#: Elements, and words of their class, id and role, that hold no content.
_APART = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "search", "fieldset"}
_APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
    "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sidebar", "aside", "complementary", "widget", "footer", "contentinfo", "masthead", "topbar",
    "comment", "comments", "commentlist", "disqus", "replies", "respond", "share", "sharing",
    "social", "related", "recommended", "toolbar", "search", "skip", "tracking",
}


class Node:
    """An element that makes a block of its own."""

    __slots__ = ("apart", "kids", "tag")

    def __init__(self, tag: str, apart: bool) -> None:
        self.tag, self.apart = tag, apart
        #: Nodes and blocks of text (text, characters in links) in page order.
        self.kids: list = []


def _set_apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _APART:
        return True
    # A header of the page; that of an article holds its title.
    if tag == "header" and not in_article:
        return True
    if attributes and tag not in ("html", "body") and tag not in _ARTICLE:
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            if _APART_WORDS.intersection(re.split(r"[\s_-]+", (a or b or c).lower())):
                return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; ends that are missing are put where the next element needs them."""
    root = Node("", False)
    stack, run, linked, link = [root], [], 0, 0
    # How often a tag is open, and for each place of the stack the last place that may end or hold
    # back an element, so that neither takes a walk through a deep stack.
    opened: Counter[str] = Counter()
    edges = [0]

    def cut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:], edges[k:]

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1].kids.append((text, linked))
            run.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        run.append(text)
        if link:
            linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag, closing = name.lower(), bool(m.group(1))
        if tag in _SKIPPED:
            if not closing and not m.group(3).endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            run.append(" ")
        elif tag == "hr":
            flush()
        elif tag in _BLOCKS:
            flush()
            link = 0
            if closing:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    cut(k)
                continue
            k = edges[-1]
            while k:
                open_tag = stack[k].tag
                if open_tag == "p" or tag in _ENDED_BY.get(open_tag, ()):
                    cut(k)
                    break
                if open_tag in _HOLDS_BACK:
                    break
                k = edges[k - 1]
            in_article = any(opened[t] for t in _ARTICLE)
            node = Node(tag, _set_apart(tag, m.group(3), in_article))
            stack[-1].kids.append(node)
            stack.append(node)
            opened[tag] += 1
            told = tag == "p" or tag in _ENDED_BY or tag in _HOLDS_BACK
            edges.append(len(stack) - 1 if told else edges[-1])
    flush()
    return root


def _digest(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Shape:
    """A node for matching: a slot of texts, or a node with children."""

    __slots__ = ("blocks", "digests", "kids", "pages", "size", "tag")

    def __init__(self, tag: str, kids: list[Shape] | None) -> None:
        self.tag, self.kids = tag, kids
        self.digests: list[int] = []
        self.blocks: list[int] = []
        self.size = 1 + sum(k.size for k in kids or ())
        #: Of a root: the distinct pages that the tree stands for.
        self.pages = 1


def shape_of(node: Node, texts: list[str]) -> Shape:
    """The shape of a tree of any depth; its blocks of text are numbered in page order."""
    open_nodes: list[tuple[Node, Iterator, list[Shape]]] = [(node, iter(node.kids), [])]
    while True:
        node, rest, kids = open_nodes[-1]
        for kid in rest:
            if isinstance(kid, Node) and any(isinstance(k, Node) for k in kid.kids):
                open_nodes.append((kid, iter(kid.kids), []))
                break
            tag = kid.tag if isinstance(kid, Node) else "#"
            if not (kids and kids[-1].kids is None and kids[-1].tag == tag):
                kids.append(Shape(tag, None))
            for text, _ in kid.kids if isinstance(kid, Node) else [kid]:
                kids[-1].blocks.append(len(texts))
                kids[-1].digests.append(_digest(text))
                texts.append(text)
        else:
            open_nodes.pop()
            shape = Shape(node.tag, kids)
            if not open_nodes:
                return shape
            open_nodes[-1][2].append(shape)


def packed(shape: Shape) -> list:
    """Tag, digests and number of children (null for a slot) of each node, the outer ones first."""
    out, rest = [], [shape]
    while rest:
        one = rest.pop()
        out.append([one.tag, one.digests, None if one.kids is None else len(one.kids)])
        rest.extend(reversed(one.kids or ()))
    return out


def unpacked(data: list) -> Shape:
    done: list[Shape] = []
    for tag, digests, count in reversed(data):
        kids = None if count is None else [done.pop() for _ in range(count)]
        done.append(Shape(tag, kids))
        done[-1].digests = digests
    return done[0]


def _comparable(one: Shape, two: Shape) -> bool:
    return one.tag == two.tag and (one.kids is None) == (two.kids is None)


def match_trees(one: Shape, two: Shape, pairs: list[tuple[Shape, Shape]] | None = None) -> int:
    """Simple tree matching: most nodes that match in order; fills in the pairs of leaves."""
    if not _comparable(one, two):
        return 0
    memo: dict[tuple[int, int], tuple] = {}
    rest = [(one, two)]
    while rest:
        x, y = rest[-1]
        if x.kids is None or (id(x), id(y)) in memo:
            rest.pop()
            continue
        inner = [q for q in y.kids if q.kids is not None]
        missing = [
            (p, q)
            for p in x.kids
            if p.kids is not None
            for q in inner
            if p.tag == q.tag and (id(p), id(q)) not in memo
        ]
        if missing:
            rest.extend(missing)
        else:
            memo[id(x), id(y)] = _align(x.kids, y.kids, memo)
            rest.pop()
    if pairs is not None:
        rest = [(one, two)]
        while rest:
            x, y = rest.pop()
            if x.kids is None:
                pairs.append((x, y))
            else:
                rest.extend((x.kids[i], y.kids[j]) for i, j in memo[id(x), id(y)][1])
    return 1 if one.kids is None else 1 + memo[id(one), id(two)][0]


def _align(a: list[Shape], b: list[Shape], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Most matching nodes of two rows of children, and which children match.

    Exact for rows of any length: of the table only some rows are kept, and those
    between are made again on the way back.
    """
    slots: dict[str, np.ndarray] = {}
    inner: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        if y.kids is None:
            slots.setdefault(y.tag, np.zeros(len(b), dtype=np.int64))[j] = 1
        else:
            inner.setdefault(y.tag, []).append(j)
    none = np.zeros(len(b), dtype=np.int64)

    def weights(x: Shape) -> np.ndarray:
        if x.kids is None:
            return slots.get(x.tag, none)
        row = none.copy()
        for j in inner.get(x.tag, ()):
            row[j] = 1 + memo[id(x), id(b[j])][0]
        return row

    def after(best: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros(len(b) + 1, dtype=np.int64)
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights(a[i])), out=row[1:])
        return row

    step = max(1, isqrt(len(a)))
    best, kept = np.zeros(len(b) + 1, dtype=np.int64), {}
    for i in range(len(a)):
        if i % step == 0:
            kept[i] = best
        best = after(best, i)
    matched, j, total = [], len(b), int(best[-1])
    for start in reversed(kept):
        end = min(start + step, len(a))
        rows = [kept[start]]
        for i in range(start, end):
            rows.append(after(rows[-1], i))
        i = end
        while i > start and j:
            row, above = rows[i - start], rows[i - start - 1]
            weight = weights(a[i - 1])[j - 1]
            if weight and row[j] == above[j - 1] + weight:
                i, j = i - 1, j - 1
                matched.append((i, j))
            elif row[j] == above[j]:
                i -= 1
            else:
                j -= 1
    return total, matched[::-1]


def slots_of(shape: Shape) -> list[tuple[int, Shape]]:
    """The slots of a tree in page order, each with a hash of the tags that lead to it."""
    out, rest = [], [(0, shape)]
    while rest:
        path, one = rest.pop()
        path = zlib.crc32(f"/{one.tag}".encode("utf-8", "surrogatepass"), path)
        if one.kids is None:
            out.append((path, one))
        rest.extend((path, kid) for kid in reversed(one.kids or ()))
    return out


def constant_blocks(
    shape: Shape,
    texts: list[str],
    references: list[Shape],
    known: dict[tuple[int, int], int] | None = None,
) -> dict[int, int]:
    """Blocks of template text: those that stand at the same place in a reference, or are `known`, each
    with the number of distinct pages that tell it.

    `known` has (hash of the path, digest of the text) with the number of distinct pages that have the
    path. What only one other page tells doesn't count if that is a near copy.
    """
    total = sum(map(len, texts))
    constant: dict[int, int] = {}

    def add(same: dict[int, int], copies: bool) -> None:
        if not copies or sum(len(texts[b]) for b in same) < COPY * total:
            for b, pages in same.items():
                constant[b] = max(pages, constant.get(b, 0))

    for reference in references:
        pairs: list[tuple[Shape, Shape]] = []
        match_trees(shape, reference, pairs)
        same: dict[int, int] = {}
        for mine, other in pairs:
            there = set(other.digests)
            found = (b for b, d in zip(mine.blocks, mine.digests, strict=True) if d in there)
            same.update(dict.fromkeys(found, reference.pages))
        add(same, reference.pages <= 2)
    if known:
        told: dict[bool, dict[int, int]] = {True: {}, False: {}}
        for path, slot in slots_of(shape):
            for b, d in zip(slot.blocks, slot.digests, strict=True):
                if (path, d) in known:
                    told[known[path, d] > 2][b] = known[path, d]
        add(told[True], False)
        add(told[False], True)
    return constant


def main_text(
    page: str | None,
    references: list[Shape],
    known: dict[tuple[int, int], int] | None = None,
) -> str:
    """The blocks of a page's content, joined by empty lines."""
    root = parse(page or "")
    texts: list[str] = []
    shape = shape_of(root, texts)
    constant = constant_blocks(shape, texts, references, known)
    blocks: list[tuple[str, int, bool, bool]] = []
    spans: list[tuple[Node, int, int, int]] = []

    # The open elements: node, children to come, first block, set apart.
    path = [(root, iter(root.kids), 0, root.apart)]
    while path:
        node, rest, first, apart = path[-1]
        for kid in rest:
            if isinstance(kid, Node):
                path.append((kid, iter(kid.kids), len(blocks), apart or kid.apart))
                break
            blocks.append((*kid, apart, len(blocks) in constant))
        else:
            path.pop()
            spans.append((node, first, len(blocks), len(path)))

    def loose(k: int) -> bool:
        text, linked, apart, same = blocks[k]
        return not apart and not same and linked <= LINKS * len(text)

    def lowest(some: list[int]) -> tuple[Node, int, int, int]:
        """The lowest node that holds all these blocks."""
        return max((s for s in spans if s[1] <= some[0] and some[-1] < s[2]), key=lambda s: s[3])

    # An article inside another, such as a reader's comment, is no article of its own.
    seen = [0, *accumulate(not b[2] for b in blocks)]
    articles = [s for s in spans if s[0].tag in _ARTICLE and seen[s[1]] < seen[s[2]]]
    inner = {id(s[0]) for s in articles if s[0].tag == "article"}
    wanted = [s for s in articles if id(s[0]) in inner] or articles
    marked = {b for s in wanted for b in range(s[1], s[2])}
    varying = [k for k in range(len(blocks)) if loose(k)]
    inside = [k for k in varying if k in marked]
    # The varying text chooses; what a page marks only decides between what varies. Where
    # nothing varies, nothing is known of the page but its marks.
    chars = [sum(len(blocks[k][0]) for k in some) for some in (inside, varying)]
    if marked and 2 * chars[0] >= chars[1]:
        own = [b for b in sorted(marked) if not blocks[b][2]]
        # Notices within the article are template as well.
        left = [b for b in own if constant.get(b, 0) < FIRM]
        if sum(len(blocks[b][0]) for b in left) < LEAST_LEFT * sum(len(blocks[b][0]) for b in own):
            left = own
        return "\n\n".join(blocks[b][0] for b in left)
    if not varying:
        return ""
    # Marked boxes with the lesser part of it, such as teasers, don't widen the region.
    region = lowest([k for k in varying if k not in marked])
    whole = region[0].tag not in ("", "html", "body")
    kept = [k for k in range(region[1], region[2]) if loose(k) or whole and not blocks[k][2]]
    return "\n\n".join(blocks[k][0] for k in kept)


def _hash(data: str) -> int:
    digest = hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def skeleton_of(shape: Shape) -> tuple[int, str]:
    """A hash of a tree without its texts, and the tree."""
    tree = json.dumps([[tag, [], count] for tag, _, count in packed(shape)])
    return _hash(tree), tree


def _templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per host and skeleton, and per host: the texts that are template, counted over all pages."""

    def described(page: str | None) -> tuple:
        texts: list[str] = []
        shape = shape_of(parse(page or ""), texts)
        skeleton, tree = skeleton_of(shape)
        # (own, slot, digest): slots of the skeleton by number, of the host by path; without a
        # digest a row counts the page.
        rows: set[tuple] = set()
        for k, (path, slot) in enumerate(slots_of(shape)):
            for own, place in ((True, k), (False, path)):
                rows.add((own, place, None))
                rows.update((own, place, d) for d in slot.digests)
        places = [{"own": own, "slot": place, "digest": d} for own, place, d in rows]
        return skeleton, _hash(json.dumps(texts)), zlib.compress(tree.encode(), 1), places

    kind = pa.list_(
        pa.struct([("own", pa.bool_()), ("slot", pa.int64()), ("digest", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(page) for page in batch.column(1).to_pylist()]
            columns = [[r[k] for r in rows] for k in range(4)]
            types = (pa.int64(), pa.int64(), pa.binary(), kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, types)],
                names=["host", "skeleton", "page", "tree", "places"],
            )

    shapes = pages.select("host", "html").mapInArrow(
        run,
        "host string, skeleton long, page long, tree binary,"
        " places array<struct<own:boolean,slot:long,digest:long>>",
    )
    with rows_per_batch(pages.sparkSession, PAGES_PER_BATCH):
        shapes = settle(shapes, "page-shapes")
    # Copies of a page, told by all its texts, are one.
    distinct = shapes.groupBy("host", "page").agg(
        F.min_by(F.struct("skeleton", "places"), "skeleton").alias("one")
    )
    counts = (
        distinct.select("host", "one.skeleton", F.explode("one.places").alias("p"))
        .select("host", F.when(F.col("p.own"), F.col("skeleton")).alias("skeleton"), "p.*")
        .groupBy("host", "skeleton", "own", "slot", "digest")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    counts = settle(counts, "page-counts")
    totals = counts.where("digest is null").select(
        F.col("host").alias("h"), F.col("skeleton").alias("s"), F.col("slot").alias("t"),
        F.col("n").alias("pages"),
    )
    # A slot has few texts that half of its pages share, so a template has the size of a page or two.
    at = F.col("host").eqNullSafe(F.col("h")) & (F.col("slot") == F.col("t"))
    constant = (
        counts.where("digest is not null")
        .join(totals, at & F.col("skeleton").eqNullSafe(F.col("s")))
        .where(F.col("n") >= F.lit(SHARE) * F.col("pages"))
        .groupBy("host", "skeleton")
        .agg(F.collect_list(F.struct("slot", "digest", "pages")).alias("constant"))
    )
    constant = settle(constant, "page-constants")
    trees = shapes.groupBy("host", "skeleton").agg(F.min("tree").alias("tree"))
    own = (
        constant.where("skeleton is not null")
        .join(trees, ["host", "skeleton"])
        .select("host", "skeleton", F.struct("tree", "constant").alias("own"))
    )
    # Written, so that the joins with them have a plain shuffle on both sides and can split a host.
    own = settle(own, "page-templates")
    most = F.struct(F.col("own.constant")[0]["pages"], F.col("skeleton"))
    common = own.groupBy("host").agg(F.max_by("own", most).alias("common"))
    known = constant.where("skeleton is null").select("host", F.col("constant").alias("known"))
    return own, settle(known.join(common, "host", "full"), "page-hosts")


def _tree_of(template: dict) -> Shape:
    shape = unpacked(json.loads(zlib.decompress(template["tree"])))
    slots = slots_of(shape)
    for one in template["constant"]:
        slots[one["slot"]][1].digests.append(one["digest"])
        shape.pages = one["pages"]
    return shape


def extract_main_texts(pages: DataFrame) -> DataFrame:
    """The main text of each page.

    `pages` has `page_id` (integer), `url` and `html`; other columns are not looked at. A null or
    empty html, or one without content, has the empty text. Pages without a
    host are of one empty host. Repeated rows and null ids give a row each; an empty table
    gives an empty result.

    Returns page_id, url, text, n_chars (code points). The texts are made as the result is read;
    where pages are very large, the session's spark.sql.execution.arrow.maxRecordsPerBatch says how many
    a worker is handed at a time.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
        host.alias("host"),
    )
    own, hosts = _templates(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(2).to_pylist()
            skeletons = [skeleton_of(shape_of(parse(page or ""), []))[0] for page in pages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(skeletons, pa.int64())],
                names=["page_id", "url", "html", "host", "skeleton"],
            )

    placed = rows.mapInArrow(
        place, "page_id long, url string, html string, host string, skeleton long"
    )
    both = placed.join(own, ["host", "skeleton"], "left").join(hosts, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text_of(page: str | None, mine: dict | None, common: dict | None, known: list | None) -> str:
            # The only page of its skeleton is aligned with the most common one of its host.
            template = mine or common
            counted = {(k["slot"], k["digest"]): k["pages"] for k in known or ()}
            return main_text(page, [_tree_of(template)] if template else [], counted)

        for whole in batches:
            for start in range(0, whole.num_rows, PAGES_PER_BATCH):
                batch = whole.slice(start, PAGES_PER_BATCH)
                columns = [batch.column(k).to_pylist() for k in range(2, 6)]
                texts = [text_of(*row) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return both.select("page_id", "url", "html", "own", "common", "known").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
