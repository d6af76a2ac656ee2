"""Ranked lexical search without a document index: one Aho-Corasick automaton reads the texts.

The terms of the query items form an automaton in which every term stands between two blanks. A text is reduced to its
terms, one blank round each, so an occurrence of `` term `` is a whole term and nothing else; neighbours share a blank,
which the automaton allows. Two scans of the documents do the work:

1. counts: documents with terms, all terms, and for each item term the documents that hold it (partial sums per task);
2. scores: occurrences are counted again from the text, weighed, and added to the items that the automaton's outputs map
   to. A task keeps the best ``top`` documents of each item; these meet in two steps, first by (item, part), then by item.

Only item terms are sent to the executors, ``SHARD_BYTES`` of them at a time (or one longer item): the items are dealt
into shards, and each shard is a search of its own over all documents. The corpus is never moved.

Score. With N documents that have terms, L terms in them, n terms of a document, df documents with a term and tf its
occurrences: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L, and a document's score is the sum of
w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

Defined results. Null and blank texts have no terms and are never found. Rows with one item_id are one item (null is an
item too); items without terms have no rows. Repeated documents are ranked row by row. A null doc_id comes after others
of its score. Empty tables give an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelyard.llm.common import id_and_text, ranges, raw, slices
from panelyard.session import cut_lineage

TOP = 50
#: Bytes of item terms sent at a time, and cells of a (documents x items) block of scores.
SHARD_BYTES, CELLS = 1 << 22, 1 << 21
#: Occurrences taken from the automaton at a time, and parts that the best rows of tasks meet in first.
HITS, PARTS = 1 << 18, 64
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
#: Lower-case letters, digits and everything beyond ASCII stay, other bytes become blanks.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reduced(text: bytes) -> bytes:
    """The terms of a text, one blank before each and one at the end."""
    out = b" " + text.translate(KEPT) + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def automaton(terms: list[str]):
    """Gives the number of a term for `` term ``, and -1 for the two blanks between texts."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    found.add_word("  ", -1)
    for number, term in enumerate(terms):
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def occurrences(machine, size: int, texts: list[bytes]):
    """Number of terms of each text, and (text, term, tf) of the item terms in them; ``size`` item terms exist."""
    parts = [reduced(t) for t in texts]
    n = np.array([max(p.count(b" ") - 1, 0) for p in parts], np.int64)
    hits = machine.iter(b"".join(parts).decode())
    keys, times, text = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while block := [v for _, v in islice(hits, HITS)]:
        term = np.array(block, np.int64)
        of = text + np.cumsum(term < 0)
        text = int(of[-1])
        new, k = np.unique((of * size + term)[term >= 0], return_counts=True)
        if len(keys):  # a text may go on in the next block
            new, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            k = np.bincount(at, np.concatenate([times, k]), len(new)).astype(np.int64)
        keys, times = new, k
    return n, keys // size, keys % size, times


def term_counts(docs: DataFrame, machine, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and the documents of each item term."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        df, total, words = np.zeros(size, np.int64), 0, 0
        for part in slices(batches, column="text"):
            n, _, term, _ = occurrences(sent.value, size, raw(part.column("text")))
            df += np.bincount(term, minlength=size)
            total += int((n > 0).sum())
            words += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *seen.tolist()], pa.int64()), "n": pa.array([total, words, *df[seen].tolist()], pa.int64())})

    rows = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one per item term
    got = {r["term"]: r["n"] for r in rows}
    df = np.zeros(size, np.int64)
    for term, n in got.items():
        if term >= 0:
            df[term] = n
    return got.get(-2, 0), got.get(-1, 0), df


class Best:
    """The best documents of each item so far: score descending, then doc_id with null last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.held, self.size, self.room = [], 0, max(1 << 18, 4 * top * items)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray):
        """scores: (documents x items)."""
        doc, item = np.nonzero(scores >= self.least)
        self.held.append((item, scores[doc, item], ids[doc], null[doc]))
        self.size += len(doc)
        if self.size > self.room:
            self.prune()

    def prune(self):
        item, score, ids, null = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((ids, null, -score, item))
        of = item[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        place = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]  # of items that have enough
        stay = order[place < self.top]
        self.held, self.size = [(item[stay], score[stay], ids[stay], null[stay])], len(stay)

    def rows(self):
        if not self.held:
            return None
        self.prune()
        return self.held[0]


def search(docs: DataFrame, items: list[tuple], kind, top: int) -> DataFrame:
    """One shard of (item_id, terms): the best rows of every task."""
    sc = docs.sparkSession.sparkContext
    terms = sorted({t for _, found in items for t in found})
    place, size = {t: i for i, t in enumerate(terms)}, len(terms)
    machine = automaton(terms)
    total, words, df = term_counts(docs, machine, size)
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    pairs = sorted((place[t], i) for i, (_, found) in enumerate(items) for t in found)
    of_term = np.array([p[0] for p in pairs], np.int64)
    outputs = (np.searchsorted(of_term, np.arange(size)), np.bincount(of_term, minlength=size), np.array([p[1] for p in pairs], np.int64))
    sent = sc.broadcast((machine, weights, outputs, [i for i, _ in items]))
    arrow, step = to_arrow_type(kind), max(1, CELLS // len(items))

    def run(batches):
        machine, weights, (first, fan, targets), names = sent.value
        best = Best(len(names), top)
        for part in slices(batches, column="text"):
            n, doc, term, tf = occurrences(machine, size, raw(part.column("text")))
            m = np.array([50 + 50 * int(k) * total // words if words else 0 for k in n], np.int64)
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            null = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = part.column("doc_id").fill_null(0).to_numpy()
            for at in range(0, len(ids), step):
                lo, hi = np.searchsorted(doc, [at, at + step])
                held, wide = slice(lo, hi), min(step, len(ids) - at)
                fans = fan[term[held]]
                scores = np.zeros(wide * len(names), np.int64)
                cells = np.repeat((doc[held] - at) * len(names), fans) + targets[ranges(first[term[held]], fans)]
                np.add.at(scores, cells, np.repeat(gain[held], fans))
                best.add(scores.reshape(wide, len(names)), ids[at:at + wide], null[at:at + wide])
        if (rows := best.rows()) is not None:
            item, score, ids, null = rows
            n = len(item)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([names[i] for i in item.tolist()], arrow), "doc_id": pa.array(ids, pa.int64(), mask=null),
                                              "score": pa.array(score, pa.int64()), "part": pa.array([TaskContext.get().partitionId() % PARTS] * n, pa.int32())})

    return docs.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id bigint, score bigint, part int")


def shards(benchmark: DataFrame, limit: int):
    """Lists of (item_id, terms) with at most ``limit`` bytes of terms, or of one item."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = benchmark.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), 1)).alias("term")).distinct()
    terms = cut_lineage(terms)
    sizes = cut_lineage(terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 2).alias("size")))
    n = max(1, -(-2 * (sizes.agg(F.sum("size")).first()[0] or 0) // limit))
    while True:
        of = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = sizes.groupBy(of.alias("shard")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"))
        if not over.where((F.col("size") > limit) & (F.col("items") > 1)).limit(1).count():
            break
        n *= 2
    for shard in range(n):
        rows = terms.where(of == shard).groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
        if rows:
            yield [(r["item_id"], r["terms"]) for r in rows]


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``top`` documents of each item with a score above 0."""
    docs, kind = id_and_text(docs), benchmark.schema["item_id"].dataType
    found = None
    for items in shards(benchmark, shard_bytes):
        rows = search(docs, items, kind, top)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
