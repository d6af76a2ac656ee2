"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of the benchmark items, grouped by length. For one length m the table has, for each hash
of a block of neighbouring words, how far the search may jump: to where the block could stand in the nearest pattern,
m - B + 1 words if it stands in none. Where the jump is 0 the hash of the block, with the hash of the first block, selects
a bucket of patterns, and comparing the words confirms an occurrence. Documents are only read; all work is in the pass
over their texts. Blocks have two words and one more for each of ``BLOCK_GROWS`` that the number of windows exceeds, and
the table has at least eight places for each block, so jumps stay long when there are many patterns.

The benchmark is dealt into shards of at most ``SHARD_WORDS`` words; the driver builds a shard's tables once, as arrays
of a bounded size, and each shard is one pass. After ``PASSES`` passes the rows found so far are written, so neither the
plan nor what executors hold grows with the benchmark. Items longer than a shard are cut into pieces that overlap by a
window less one word.

Defined results. A null or empty text has no words and is not contaminated. An item without words has no window. Rows
with one item_id are one item; those with a null or empty one are together the item named by the empty string. Repeated
documents are judged row by row. Empty tables give empty or all-clean results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, per_text
from panelyard.session import cut_lineage

WINDOW = 13
#: Words of a shard, and shards that are searched in one plan.
SHARD_WORDS, PASSES = 200_000, 8
#: Numbers of windows beyond which blocks are a word longer.
BLOCK_GROWS = (4_000, 100_000)
#: Least and most bits of a shift table.
TABLE_BITS = 16, 26
#: Columns that travel with the rows while they are searched.
SPANS, ITEMS = "__wm_spans", "__wm_items"
#: Bytes of words after lower-casing: digits, a to z and everything beyond ASCII; others become a blank.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(KEPT).split()


@dataclass
class Patterns:
    """The windows of one length: shift table, sorted bucket keys, and each window's place in the shard and its items."""

    length: int
    block: int
    shift: bytes
    keys: np.ndarray
    starts: np.ndarray
    owners: list[list[int]]

    def ready(self, flat: list[bytes], names: list[str]) -> Patterns:
        """With the words and item names of the shard, and the buckets as a dictionary."""
        self.flat, self.names = flat, names
        first, at = np.unique(self.keys, return_index=True)
        ends = np.append(at[1:], len(self.keys))
        self.buckets = dict(zip(first.tolist(), zip(at.tolist(), ends.tolist(), strict=True), strict=True))
        return self

    def search(self, text: list[bytes]):
        """(start, items) of every occurrence."""
        shift, buckets, crc, join = self.shift, self.buckets, zlib.crc32, b" ".join
        m, block, n, at, mask = self.length, self.block, len(text), self.length - 1, len(self.shift) - 1
        while at < n:
            h = crc(join(text[at - block + 1:at + 1]))
            jump = shift[h & mask]
            if jump:
                at += jump
                continue
            start = at - m + 1
            found = buckets.get(h << 32 | crc(join(text[start:start + block])))
            if found:
                for i in range(*found):
                    held = self.starts[i]
                    if text[start:at + 1] == self.flat[held:held + m]:
                        yield start, [self.names[o] for o in self.owners[i]]
            at += 1


def patterns(length: int, flat: list[bytes], ids: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> Patterns:
    """The tables of the windows of ``length`` words that begin at ``starts`` in the shard."""
    windows = np.lib.stride_tricks.sliding_window_view(ids, length)[starts]
    _, one, of = np.unique(windows, axis=0, return_index=True, return_inverse=True)
    owners: list[set[int]] = [set() for _ in one]
    for i, o in zip(of.ravel().tolist(), owner.tolist(), strict=True):
        owners[i].add(o)
    starts = starts[one]
    block = min(length, 2 + sum(len(starts) > n for n in BLOCK_GROWS))
    hashes = np.array([zlib.crc32(b" ".join(flat[i:i + block])) for i in range(len(flat) - block + 1)], np.uint64)
    used = np.unique(hashes).size
    bits = min(max((8 * used - 1).bit_length(), TABLE_BITS[0]), TABLE_BITS[1])
    shift = np.full(1 << bits, min(length - block + 1, 255), np.uint8)
    for end in range(block, length + 1):  # the last and nearest end of a block decides
        shift[(hashes[starts + end - block] & np.uint64((1 << bits) - 1)).astype(np.int64)] = min(length - end, 255)
    keys = hashes[starts + length - block] << np.uint64(32) | hashes[starts]
    order = np.argsort(keys, kind="stable")
    return Patterns(length, block, shift.tobytes(), keys[order], starts[order], [sorted(owners[i]) for i in order.tolist()])


@dataclass
class Shard:
    """What is sent of some items: their words once, their names, and the tables of each length."""

    words: bytes
    names: list[str]
    tables: list[Patterns]

    def ready(self) -> list[Patterns]:
        flat = self.words.split(b" ")
        return [table.ready(flat, self.names) for table in self.tables]


def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Shard:
    flat, names = [], sorted({item for item, _ in items})
    number = {name: i for i, name in enumerate(names)}
    starts, owner = defaultdict(list), defaultdict(list)
    for item, found in items:
        size = min(window, len(found))
        n = len(found) - size + 1 if size else 0
        starts[size].extend(range(len(flat), len(flat) + n))
        owner[size].extend([number[item]] * n)
        flat += found
    code: dict[bytes, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in flat], np.int32)
    return Shard(b" ".join(flat), names, [patterns(size, flat, ids, np.array(starts[size]), np.array(owner[size])) for size in sorted(starts) if starts[size]])


def pieces(found: list[bytes], size: int, window: int):
    """Parts of at most ``size`` words that hold each window once."""
    step = size - window + 1
    for at in range(0, max(len(found) - window + 1, 1), step):
        yield found[at:at + size]


def shards(benchmark: DataFrame, window: int = WINDOW):
    """Items in turn, as words, in shards of at most SHARD_WORDS words."""
    held, size, most = [], 0, max(SHARD_WORDS, window)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        for part in pieces(words(row["text"].encode()), most, window):
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            if part:
                held.append((row["item"] or "", part))
                size += len(part)
    if held:
        yield held


def scan(docs: DataFrame, sent) -> DataFrame:
    """Adds the occurrences in one broadcast shard to SPANS (start, length pairs) and ITEMS; the rows stay as they are."""
    def make():
        tables = sent.value.ready()

        def work(part, texts):
            spans, found = part.column(SPANS).to_pylist(), part.column(ITEMS).to_pylist()
            for i, text in enumerate(texts):
                split = words(text)
                for table in tables:
                    for start, of in table.search(split):
                        spans[i] += (start, table.length)
                        found[i] += of
                found[i] = sorted(set(found[i]))
            return {**dict(zip(part.schema.names, part.columns, strict=True)), SPANS: pa.array(spans, pa.list_(pa.int32())),
                    ITEMS: pa.array(found, pa.list_(pa.string()))}
        return work

    return per_text(docs, docs.schema, make)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    out = docs.withColumn(SPANS, F.array().cast("array<int>")).withColumn(ITEMS, F.array().cast("array<string>"))
    held = []
    for items in shards(benchmark, window):
        if len(held) == PASSES:
            out = cut_lineage(out)
            for sent in held:
                sent.unpersist()
            held = []
        held.append(docs.sparkSession.sparkContext.broadcast(build(items, window)))
        out = scan(out, held[-1])
    return out


def covered(flat: list[int]) -> list[list[int]]:
    """The [start, end) runs of words that lie inside an occurrence."""
    runs = []
    for start, size in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + size)
        else:
            runs.append([start, start + size])
    return runs


def judged(part, texts, share: int):
    """(words, hit words, runs, contaminated) of each row."""
    for text, flat in zip(texts, part.column(SPANS).to_pylist(), strict=True):
        runs = covered(flat)
        n, hit = len(words(text)), sum(b - a for a, b in runs)
        yield n, hit, runs, hit > 0 and share * hit >= n


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), items, spans."""
    def make():
        def work(part, texts):
            items = part.column(ITEMS).to_pylist()
            rows = list(judged(part, texts, share))
            return {"doc_id": part.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()),
                    "n_hit": pa.array([r[1] for r in rows], pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                    "contaminated": pa.array([r[3] for r in rows], pa.bool_()), "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array([[x for run in r[2] for x in run] for r in rows], pa.list_(pa.int32()))}
        return work

    return per_text(scanned(id_and_text(docs), benchmark, window),
                    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
                    "items array<string>, spans array<int>", make)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; rows are judged one by one."""
    def make():
        def work(part, texts):
            clean = pa.array([not r[3] for r in judged(part, texts, share)], pa.bool_())
            return dict(zip(part.schema.names, part.filter(clean).columns, strict=True))
        return work

    found = scanned(docs, benchmark, window)
    return per_text(found, found.schema, make).select(*docs.columns)
