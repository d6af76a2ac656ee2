"""Main text of web pages by wrapper induction.

The pages of a host share up to ``REFERENCES`` reference pages, one of each of its commonest shapes, empty pages left out.
Every page's DOM tree is aligned with them by simple tree matching: equal tags match, children align in order so that
most nodes match. A block's slot is the node of the first reference that it is aligned with, or the place of its nearest
aligned ancestor. A text that stands in one slot on nine tenths of the host's pages (with different main texts, four at
least; whether or not a reference has it) belongs to
the template; blocks that vary are content. Only then element names
count: of the blocks that vary, regions that by their element or name are no article (page headers, sidebars, notices,
adverts, forms, reader comments) are left out unless they hold the page's title or most of its varying text, and where an
article or main element holds enough of that text only what lies in it counts. Menus, footers, asides, controls and
scripts, known by their element, never count.

Counts of a host's nodes are partial sums of one row per page and block, so a hot host is no hot task. Trees are walked with stacks, however deep;
what lies more than ``DEPTH`` levels below where two trees differ is not aligned and counts by its nearest aligned ancestor.

Defined results. Null or empty html has the empty text. A null url, or one without ``://``, belongs to the host "".
Pages repeat as they are repeated in the table. Character references are decoded, white space inside a block (line
breaks included) becomes one space. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import slices
from panelyard.llm.url_filter import host_of
from panelyard.session import cut_lineage

DEPTH, PAGES, SHARE, REFERENCES = 80, 4, 0.9, 3
#: Child lists whose product is larger are halved before the quadratic table.
CELLS = 40_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
#: Elements whose text is never prose of the page.
NO_TEXT = frozenset("""head script style noscript template nav footer aside button select option textarea input iframe svg canvas object
menu dialog title""".split())
NO_NAME = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation
breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent popup modal newsletter subscribe subscription
comment comments reply replies respond disqus related share sharing social login search form complementary contentinfo alert toolbar""".split())
#: An opening tag closes these elements when they stand open, up to the elements behind them.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*>""", re.S)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "name", "items", "number", "size", "shape")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.items, self.number, self.size, self.shape = tag, name, [], -1, 1, 0

    def children(self):
        return [x for x in self.items if not isinstance(x, str)]


def parse(text: str) -> Node:
    """A DOM tree; items of a node are child nodes and texts."""
    root = Node("html")
    stack = [root]
    standing: dict[str, int] = {}  # open elements by tag, so that no search goes through the stack in vain
    at, n = 0, len(text)

    def cut(i):
        for node in stack[i:]:
            standing[node.tag] -= 1
        del stack[i:]

    def close(tags, behind):
        if not any(standing.get(tag) for tag in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i)
                return
            if stack[i].tag in behind:
                return

    while at < n:
        found = TOKEN.search(text, at)
        if found is None:
            end = text.find("<", at)  # an opening tag that the page breaks off in is no text
            broken = end >= 0 and re.match(r"</?[A-Za-z]", text[end:end + 3]) and ">" not in text[end:]
            stack[-1].items.append(text[at:end] if broken else text[at:])
            break
        if found.start() > at:
            stack[-1].items.append(text[at:found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1) if standing.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag == "p" and stack[i].tag in ("article", "body", "td"):
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1 and tag == "html":
            continue
        if tag in BLOCKS:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "main", "aside", "body", "table"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        names = found[3]
        node = Node(tag, " ".join(x.strip("\"'") for x in CLASS.findall(names)).lower() if names and not names.isspace() else "")
        parent = stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            parent.items.append(node)
            at = end.end() if end else n
        elif tag in VOID or names.endswith("/"):
            parent.items.append(node)
        else:
            parent.items.append(node)
            stack.append(node)
            standing[tag] = standing.get(tag, 0) + 1
    return root


def number(root: Node) -> list[Node]:
    """Nodes in page order; sets their numbers, sizes and shapes (equal for equal trees of tags)."""
    nodes, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        node.number = len(nodes)
        nodes.append(node)
        waiting += reversed(node.children())
    for node in reversed(nodes):
        below = node.children()
        node.size = 1 + sum(c.size for c in below)
        node.shape = hash((node.tag, *[c.shape for c in below]))
    return nodes


def matching(a: Node, b: Node, pairs: dict[int, int] | None = None, depth: int = 0) -> int:
    """Simple tree matching of numbered trees: the most nodes that match in order; ``pairs`` takes a's number to b's.

    Equal trees match as a whole. Others are aligned down to ``DEPTH`` levels."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape and a.size == b.size:
        if pairs is not None:
            pairs.update(zip(range(a.number, a.number + a.size), range(b.number, b.number + b.size), strict=True))
        return a.size
    if pairs is not None:
        pairs[a.number] = b.number
    left, right = a.children(), b.children()
    if not left or not right or depth >= DEPTH:
        return 1
    # equal trees at both ends belong together in a best alignment
    total, front, back, n = 1, 0, 0, min(len(left), len(right))
    while front < n and left[front].shape == right[front].shape:
        total += matching(left[front], right[front], pairs, depth + 1)
        front += 1
    while back < n - front and left[-1 - back].shape == right[-1 - back].shape:
        back += 1
        total += matching(left[-back], right[-back], pairs, depth + 1)
    left, right = left[front:len(left) - back], right[front:len(right) - back]
    known: dict[tuple[int, int], int] = {}

    def weight(x, y):
        of = x.shape, y.shape
        if of not in known:
            known[of] = matching(x, y, None, depth + 1)
        return known[of]

    if pairs is None:
        return total + (int(scores(left, right, weight)[-1]) if left and right else 0)
    for x, y in best_pairs(left, right, weight):
        total += matching(x, y, pairs, depth + 1)
    return total


def scores(left: list[Node], right: list[Node], weight) -> np.ndarray:
    """The best sums of weights of ``left`` with each beginning of ``right``."""
    rows: dict[int, np.ndarray] = {}
    _, first, of = np.unique(np.array([y.shape for y in right]), return_index=True, return_inverse=True)
    best = np.zeros(len(right) + 1, np.int64)
    for x in left:
        row = rows.get(x.shape)
        if row is None:
            row = rows[x.shape] = np.array([weight(x, right[i]) for i in first], np.int64)
        now = np.maximum(best[1:], best[:-1] + row[of])
        np.maximum.accumulate(now, out=now)
        best[1:] = now
    return best


def best_pairs(left: list[Node], right: list[Node], weight):
    """Pairs, in order, whose weights have the largest sum. Long lists are halved where the sums of both halves are best
    (Hirschberg), so memory grows with the length and nothing is left out."""
    waiting = [(left, right)]
    while waiting:
        left, right = waiting.pop()
        if not left or not right:
            continue
        if len(left) > 1 and len(left) * len(right) > CELLS:
            middle = len(left) // 2
            at = int(np.argmax(scores(left[:middle], right, weight) + scores(left[middle:][::-1], right[::-1], weight)[::-1]))
            waiting += [(left[middle:], right[at:]), (left[:middle], right[:at])]
            continue
        table = [[0] * (len(right) + 1)]
        for x in left:
            last, now = table[-1], [0]
            for j, y in enumerate(right):
                now.append(max(last[j] + weight(x, y), last[j + 1], now[j]))
            table.append(now)
        found, i, j = [], len(left), len(right)
        while i and j:
            w = weight(left[i - 1], right[j - 1])
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                found.append((left[i], right[j]))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        yield from reversed(found)


def doubtful(node: Node, in_article: bool) -> bool:
    """Whether the element or its name hints that the node is no part of an article."""
    if node.tag == "form" or node.tag == "header" and not in_article:
        return True
    return bool(node.name) and node.tag not in ("html", "body", "main", "article") and not NO_NAME.isdisjoint(WORD.findall(node.name))


def measured(root: Node) -> dict[int, tuple[int, bool, bool]]:
    """By number of the node: length of its text (without elements of no text), whether it holds a block, an h1 or main."""
    known: dict[int, tuple[int, bool, bool]] = {}
    waiting = [(root, False)]
    while waiting:
        node, done = waiting.pop()
        if not done:
            waiting.append((node, True))
            waiting += [(c, False) for c in node.children() if c.tag not in NO_TEXT]
            continue
        below = [(c, known[c.number]) for c in node.children() if c.tag not in NO_TEXT]
        length = sum(len(x.strip()) for x in node.items if isinstance(x, str)) + sum(k[0] for _, k in below)
        known[node.number] = (length, any(c.tag in BLOCKS or k[1] for c, k in below), any(c.tag in ("h1", "main") and k[0] or k[2] for c, k in below))
    return known


def marked(root: Node) -> list[dict]:
    """Every block of text of a numbered page, in page order: number of its element, text, the doubtful regions round it
    (outermost first), the outermost article and main round it (-1: none), whether it is a title (in an h1), and whether
    it lies loose in the page's root or body."""
    out: list[dict] = []
    held: list[str] = []
    sizes = measured(root)

    def flush(owner, regions, article, main, title, loose):
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append({"node": owner, "text": text, "regions": list(regions), "article": article, "main": main, "title": title, "loose": loose})

    # a frame: items left, what the text in it belongs to, and whether its end closes a block
    top = (root.number, (), -1, -1, False, True)
    stack = [(iter(root.items), top, True)]
    while stack:
        items, at, block = stack[-1]
        item = next(items, None)
        if item is None:
            stack.pop()
            if block:
                flush(*at)
            continue
        if isinstance(item, str):
            held.append(item)
            continue
        if item.tag in ("br", "wbr"):
            held.append(" " if item.tag == "br" else "")
            continue
        owner, regions, article, main, title, loose = at
        part = item.tag in BLOCKS
        if item.tag in NO_TEXT:
            if part:
                flush(*at)
            continue
        length, holds_block, holds_title = sizes[item.number]
        if doubtful(item, article >= 0 or main >= 0) and not holds_title:
            if not part and not holds_block and 2 * length <= sizes[root.number][0]:
                continue  # a few words within a line
            regions, part = (*regions, item.number), True
        if part:
            flush(*at)
            below = (item.number, regions, item.number if item.tag == "article" and article < 0 else article,
                     item.number if item.tag == "main" and main < 0 else main, title or item.tag == "h1", loose and item.tag in ("html", "body"))
        else:
            below = at
        stack.append((iter(item.items), below, part))
    return out


def chosen(found: list[dict], varies: list[bool]) -> list[dict]:
    """The blocks of the article among the blocks of a page. Only blocks that vary over the host weigh and stay.

    A doubtful region goes unless it holds most of the varying text; if there is an article, main or title outside, only
    a region that holds nine tenths of it stays. Articles, or main, count alone if they hold enough of what is left."""
    left = [b for b, v in zip(found, varies, strict=True) if v]
    total = sum(len(b["text"]) for b in left)
    weights: dict[int, int] = {}
    for b in left:
        for region in b["regions"]:
            weights[region] = weights.get(region, 0) + len(b["text"])
    gone: set[int] = set()
    for region in weights:
        if 2 * weights[region] <= total:
            gone.add(region)
    lead = [set(b["regions"]) for b in left if b["title"] or b["article"] >= 0 or b["main"] >= 0]
    for region, weight in weights.items():
        if region not in gone and 10 * weight <= 9 * total and any(region not in around and gone.isdisjoint(around) for around in lead):
            gone.add(region)
    left = [b for b in left if gone.isdisjoint(b["regions"])]

    def weight(blocks):
        return sum(len(b["text"]) for b in blocks if not b["loose"])

    articles, mains = [b for b in left if b["article"] >= 0], [b for b in left if b["main"] >= 0]
    if mains and weight(articles) <= weight(mains):
        inner = [b for b in mains if b["article"] >= 0]
        if 4 * weight(mains) >= weight(left):
            left = inner if 2 * weight(inner) >= weight(mains) else mains
    elif articles and 4 * weight(articles) >= weight(left):
        left = articles
    return left


def blocks(root: Node) -> list[tuple[int, str]]:
    """(number of the element, text) of every block of a page that no other page is compared with."""
    found = marked(root)
    return [(b["node"], b["text"]) for b in chosen(found, [True] * len(found))]


@functools.lru_cache(maxsize=256)
def numbered(page: str) -> Node:
    root = parse(page)
    number(root)
    return root


def slots_of(page: Node, references: list[str]) -> dict[int, int]:
    """A slot for each node of a numbered page: the node of the first reference that it is aligned with, or a negative
    number for the place of its nearest aligned ancestor."""
    slots: dict[int, int] = {}
    for r, reference in enumerate(references):
        pairs: dict[int, int] = {}
        matching(page, numbered(reference), pairs)
        for node, other in pairs.items():
            slots.setdefault(node, r << 32 | other)
    waiting = [page]
    while waiting:
        node = waiting.pop()
        own = slots.setdefault(node.number, -1)
        for child in node.children():
            slots.setdefault(child.number, -2 - own if own >= 0 else own)
            waiting.append(child)
    return slots


def aligned(page: str, references: list[str]) -> list[dict]:
    """All blocks of a page, with the slot of the block's element."""
    root = parse(page)
    number(root)
    own = marked(root)
    slots = slots_of(root, references) if own else {}
    return [{"slot": slots[b["node"]], **b} for b in own]


def references(pages: DataFrame) -> DataFrame:
    """host and up to ``REFERENCES`` pages of it that have text: one of each of the commonest shapes (sets of tags)."""
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))
    shaped = pages.where(F.trim("html") != "").select("host", "html", F.xxhash64(tags).alias("shape"), F.xxhash64("html").alias("hash"))
    counts = shaped.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("times"), F.min("hash").alias("hash"))
    # tasks send no more than so many of a host
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("times"), "hash"))
    chosen = cut_lineage(counts.withColumn("place", place).where(F.col("place") <= REFERENCES).select("host", "hash", "place"))
    found = shaped.select("host", "hash", "html").join(chosen, ["host", "hash"]).dropDuplicates(["host", "place"])
    found = found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "html"))).alias("found"))
    return cut_lineage(found.select("host", F.col("found.html").alias("reference")))


def main_text(pages: DataFrame, min_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    identity = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string"
    block = "slot:bigint,text:string,regions:array<int>,article:int,main:int,title:boolean,loose:boolean"
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string()), ("regions", pa.list_(pa.int32())), ("article", pa.int32()), ("main", pa.int32()), ("title", pa.bool_()), ("loose", pa.bool_())]))

    def run(batches):
        for part in slices(batches, column="html"):
            both = zip(part.column("html").to_pylist(), part.column("reference").to_pylist(), strict=True)
            found = pa.array([aligned(page, reference or []) for page, reference in both], kind)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), found], names=["page_id", "url", "host", "blocks"])

    parsed = cut_lineage(rows.join(references(rows), "host", "left").select("page_id", "url", "host", "html", "reference").mapInArrow(run, f"{identity}, host string, blocks array<struct<{block}>>"))
    marks = F.transform("blocks", lambda b: F.xxhash64(b["slot"], b["text"]))
    # pages of a host with the same main text count once
    narrow = parsed.where(F.size("blocks") > 0).select("host", F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("digest"), F.array_distinct(marks).alias("marks"))
    narrow = narrow.groupBy("host", "digest").agg(F.first("marks").alias("marks"))
    per_host = narrow.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    per_mark = narrow.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("times"))
    fixed = per_mark.where(F.col("times") >= min_pages).join(per_host, "host").where(F.col("times") >= F.col("pages") * share)
    template = cut_lineage(fixed.groupBy("host").agg(F.collect_list("mark").alias("template")))
    varies = F.transform("blocks", lambda b: ~F.coalesce(F.array_contains("template", F.xxhash64(b["slot"], b["text"])), F.lit(False)))

    def choose(batches):
        for part in slices(batches):
            both = zip(part.column("blocks").to_pylist(), part.column("varies").to_pylist(), strict=True)
            texts = pa.array(["\n".join(b["text"] for b in chosen(*of)) for of in both], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], names=["page_id", "url", "text"])

    told = parsed.join(template, "host", "left").select("page_id", "url", "blocks", varies.alias("varies")).mapInArrow(choose, f"{identity}, text string")
    return told.withColumn("n_chars", F.length("text").cast("bigint"))
