"""Repeated word sequences found with compressed FM-indexes.

Every word covered by a sequence of ``WINDOW`` words that also starts in a document with a smaller id is removed.

1. Texts that are the same as a whole are settled by their digests: the first stays for the search, the others go.
2. A window's anchor is the smallest hash of its eight-word grams, so equal windows have equal anchors. Only windows
   whose anchor occurs in two documents can repeat; one number per run of windows is counted, not the windows.
3. The windows left are cut into blocks of ``BLOCK`` neighbours at fixed distances from their anchor. All windows of a
   block share their middle words, whose hash is the block's key: equal windows have equal keys, so a key's blocks can
   be searched apart from all others. Equal blocks are sent once by a task and indexed once, with their smallest id.
   Keys stand for 64-bit hashes of words, the words behind a key for 32 bits of them.
4. Keys are dealt over shards. A shard's blocks, as word numbers, become FM-indexes of at most ``INDEX_WORDS`` words (at
   key boundaries; a key of more than ``KEY_ROWS`` blocks is not indexed but cut into single windows, whose digests meet
   in map-side sums): a Burrows-Wheeler transform from prefix doubling up to the window length, kept as a wavelet matrix
   of packed bits with popcount ranks. Backward search runs for all windows of the shard side by side and gives the
   length each can be matched beyond itself; for windows that match in full, the least id in the suffix interval.
5. The windows go back to their documents, which are rebuilt from the words that stay.

Anchors only choose what is searched; the search settles what repeats.

Defined results. A null text has no words. A document of fewer than ``WINDOW`` words keeps all. Null ids are neither
removed from nor a reason to remove. Rows with one id don't count as earlier than each other; repeated rows get the same
result each. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, mix64, per_text, ranges, slices, spans_hash
from panelyard.session import cut_lineage

WINDOW, GRAM, BLOCK = 50, 8, 16
#: Distinct blocks that a task holds back until it sends them.
HELD = 100_000
INDEX_WORDS = 1 << 20
#: Rows of a key, one per task and distinct block, above which its blocks become single windows.
KEY_ROWS = 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (parted by white space)."""
    buf = np.frombuffer(b" " + text + b" ", np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return spans_hash(buf, first, last) if len(first) else np.zeros(0, np.uint64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = min(len(left), len(right))
    return mix64(left[:n] * ODD + right[:n])


def gram_hashes(words: np.ndarray) -> np.ndarray:
    h = words
    for step in (1, 2, 4):
        h = joined(h, h[step:])
    return h


def anchors(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window the smallest gram hash in it, and the place of the first gram that has it."""
    grams = gram_hashes(words)
    span = window - GRAM + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, width = grams, 1
    while width * 2 <= span:
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    # the first place from the window's start on that has this hash
    numbers, inverse = np.unique(grams, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    ranked = inverse[order] * len(grams) + order
    place = order[np.searchsorted(ranked, np.searchsorted(numbers, low) * len(grams) + np.arange(n))]
    return low, place


def scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, key, digest, n_words, own_sha256 (of all words) and the distinct anchors of each document."""
    def make():
        def work(part, texts):
            split = [t.split() for t in texts]
            plain = [b" ".join(w) for w in split]
            found = [np.unique(anchors(word_hashes(t), window)[0]).view(np.int64) for t in plain]
            return {"doc_id": part.column("doc_id"), "key": part.column("key"), "digest": pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in plain], pa.binary()),
                    "n_words": pa.array([len(w) for w in split], pa.int64()), "own_sha256": [hashlib.sha256(p).hexdigest() for p in plain],
                    "anchors": pa.array(found, pa.list_(pa.int64()))}
        return work

    return per_text(docs, "doc_id bigint, key bigint, digest binary, n_words bigint, own_sha256 string, anchors array<bigint>", make)


def blocks_of(words: np.ndarray, wanted: np.ndarray, window: int):
    """(key, first window, number of windows) of each block of windows whose anchor is wanted."""
    low, place = anchors(words, window)
    n = len(low)
    keep = np.isin(low, wanted)
    if not n or not keep.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = (place - np.arange(n)) // BLOCK
    fresh = np.ones(n, bool)
    fresh[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (keep[1:] != keep[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    first, size = first[keep[first]], size[keep[first]]
    anchor, part = place[first], part[first]
    # words that all windows of the block would have: from its last start to its first end
    begin = anchor - BLOCK * part
    end = anchor - np.minimum(BLOCK * part + BLOCK - 1, window - GRAM) + window
    order = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers_of(len(words)))])
    key = (order[end] - order[begin]) * inverses_of(len(words))[begin]
    return mix64(key + part.astype(np.uint64)), first, size


_POWERS: dict[str, np.ndarray] = {}


def _series(name: str, base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS[name][:n]


def powers_of(n: int) -> np.ndarray:
    return _series("up", int(ODD), n)


def inverses_of(n: int) -> np.ndarray:
    return _series("down", pow(int(ODD), -1, 1 << 64), n)


def candidate_blocks(docs: DataFrame, window: int) -> DataFrame:
    """A row per block of a document: key, content (digest of its words), doc_id, doc_key, start, n. And once per task and
    distinct block: key, content, least and most (ids that have it in the task), words (32 bits of each word's hash)."""
    schema = "key bigint, content bigint, doc_id bigint, doc_key bigint, start bigint, n bigint, least bigint, most bigint, words binary"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        held: dict[tuple, list] = {}

        def table(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_pydict({name: pa.array(c, pa.binary() if name == "words" else pa.int64()) for name, c in zip(names, columns, strict=True)})

        def send():
            rows = [(k, c, None, None, None, None, *v) for (k, c), v in held.items()]
            held.clear()
            for at in range(0, len(rows), 4096):
                yield table(rows[at:at + 4096])

        for part in slices(batches, column="text"):
            rows = []
            for doc, doc_key, wanted, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), part.column("wanted"), part.column("text").to_pylist(), strict=True):
                words = word_hashes((text or "").encode())
                keys, first, size = blocks_of(words, np.asarray(wanted.values).view(np.uint64), window)
                codes = words.astype(np.uint32)
                for k, i, n in zip(keys.view(np.int64).tolist(), first.tolist(), size.tolist(), strict=True):
                    data = words[i:i + n + window - 1].tobytes()
                    content = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
                    rows.append((k, content, doc, doc_key, i, n, None, None, None))
                    known = held.get((k, content))
                    if known is None:
                        held[k, content] = [doc, doc, codes[i:i + n + window - 1].tobytes()]
                    else:
                        known[0], known[1] = min(known[0], doc), max(known[1], doc)
            if rows:
                yield table(rows)
            if len(held) >= HELD:
                yield from send()
        yield from send()

    return docs.mapInArrow(run, schema)


class Bits:
    """A bit row with ranks: packed words and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.words = packed
        counts = np.bitwise_count(packed).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in [0, at)."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Of a text of numbers below ``size``; patterns of up to ``depth`` numbers."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < depth:
            behind = np.zeros(n, np.int64)
            behind[:n - step] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + behind, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        last = text[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])

    def before(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before ``at``; both ends of an interval in one call."""
        low = np.zeros_like(at)
        for (shift, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = (symbols >> shift & 1).astype(bool)
            ones_low, ones_at = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - low

    def search(self, text: np.ndarray, ends: np.ndarray, length: int):
        """Backward search of the patterns text[end - length:end]. Gives how many words could be matched while another
        place still matched, and the suffix interval of those matched in full (alone: length of the match, interval of one)."""
        n = len(ends)
        matched, low, high = np.ones(n, np.int64), self.first[text[ends - 1]], self.first[text[ends - 1] + 1]
        open_ = np.flatnonzero(high - low > 1)
        for step in range(1, length):
            if not len(open_):
                break
            symbol = text[ends[open_] - 1 - step]
            both = self.before(np.concatenate([symbol, symbol]), np.concatenate([low[open_], high[open_]]))
            base = self.first[symbol]
            low[open_], high[open_] = base + both[:len(open_)], base + both[len(open_):]
            more = high[open_] - low[open_] > 1
            matched[open_[more]] += 1
            open_ = open_[more]
        return matched, low, high


def least_ids(contents: list[tuple[int, bytes]], window: int) -> list[np.ndarray]:
    """contents: (smallest id, 32-bit words) of distinct blocks; for each the smallest id that has each of its windows."""
    rows = [np.frombuffer(data, np.uint32) for _, data in contents]
    ids = np.array([i for i, _ in contents], np.int64)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    _, numbers, times = np.unique(flat, return_inverse=True, return_counts=True)
    alone = times[numbers] == 1
    places = ranges(np.cumsum(sizes + 1) - sizes - 1, sizes)
    text = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 stands behind each block
    text[places] = numbers + 1
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    counts = sizes - window + 1
    # windows as positions of ``flat``; one with a word that the index has once repeats nowhere
    starts = ranges(np.cumsum(sizes) - sizes, counts)
    before = np.concatenate([[0], np.cumsum(alone)])
    asked = np.flatnonzero(before[starts + window] == before[starts])
    least = np.repeat(ids, counts)
    if len(asked):
        index = FMIndex(text, len(times) + 1, window)
        ends = places[starts[asked] + window - 1] + 1
        matched, low, high = index.search(text, ends, window)
        full = np.flatnonzero(matched == window)
        if len(full):
            of = np.append(ids[owner[index.suffixes]], 0)
            bounds = np.stack([low[full], high[full]], axis=1).ravel()
            least[asked[full]] = np.minimum.reduceat(of, bounds)[::2]
    return np.split(least, np.cumsum(counts)[:-1])


def search_shards(contents: DataFrame, window: int) -> DataFrame:
    """contents: key, content, least, most, words, some of them from several tasks. Gives key, content and the smallest id of
    each of its windows, where there is a smaller one than some document's that has the block."""
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, size, last = {}, 0, None

        def answer():
            found = least_ids([(v[0], v[2]) for v in held.values()], window)
            rows = [(k, c, least) for ((k, c), v), least in zip(held.items(), found, strict=True) if (least < v[1]).any()]
            return pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.int64()), "content": pa.array([r[1] for r in rows], pa.int64()),
                                               "least": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

        for part in slices(batches, column="words"):
            for key, content, low, high, words in zip(*(part.column(c).to_pylist() for c in ("key", "content", "least", "most", "words")), strict=True):
                if size >= INDEX_WORDS and key != last:
                    yield answer()
                    held, size = {}, 0
                last, known = key, held.get((key, content))
                if known is None:
                    held[key, content] = [low, high, words]
                    size += len(words) // 4
                else:
                    known[0], known[1] = min(known[0], low), max(known[1], high)
        if held:
            yield answer()

    dealt = contents.repartition(n, "key").sortWithinPartitions("key").select("key", "content", "least", "most", "words")
    return dealt.mapInArrow(run, "key bigint, content bigint, least array<bigint>")


def split_windows(contents: DataFrame, window: int) -> DataFrame:
    """A row per window of each block: key, content, at (its place in the block), digest (of the key and its words), least, most."""
    def run(batches):
        for part in slices(batches, column="words"):
            sizes, digests = [], []
            for key, words in zip(part.column("key").to_pylist(), part.column("words").to_pylist(), strict=True):
                starts = range(0, len(words) - 4 * window + 1, 4)
                salt = key.to_bytes(8, "little", signed=True)
                digests += [hashlib.blake2b(words[i:i + 4 * window], digest_size=16, salt=salt).digest() for i in starts]
                sizes.append(len(starts))
            sizes = np.array(sizes, np.int64)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_pydict({**{c: part.column(c).take(row) for c in ("key", "content", "least", "most")},
                                              "at": pa.array(ranges(np.zeros(len(sizes), np.int64), sizes)), "digest": pa.array(digests, pa.binary())})

    return contents.mapInArrow(run, "key bigint, content bigint, least bigint, most bigint, at bigint, digest binary")


def least_of_windows(contents: DataFrame, window: int) -> DataFrame:
    """Like ``search_shards``, without an index: the least ids of single windows that repeat are joined back to the blocks.
    Windows that one document alone has are null in the array."""
    windows = cut_lineage(split_windows(contents, window))
    least = windows.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("digest", "first")
    parts = windows.select("key", "content", "at", "digest").distinct().join(least, "digest")
    found = parts.groupBy("key", "content").agg(F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("firsts"), F.max("at").alias("end"))
    return found.select("key", "content", F.transform(F.sequence(F.lit(0).cast("bigint"), "end"), lambda i: F.col("firsts")[i]).alias("least"))


def least_by_key(contents: DataFrame, window: int) -> DataFrame:
    """key, content and the smallest ids of the windows: by indexes, and window by window for keys with many blocks."""
    crowded = cut_lineage(contents.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > KEY_ROWS).select("key"))
    few = search_shards(contents.join(crowded, "key", "left_anti"), window)
    return few.unionByName(least_of_windows(contents.join(crowded, "key", "left_semi"), window))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words where any were removed; else null)."""
    rows = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    seen = cut_lineage(scan(rows, window).withColumn("row", F.monotonically_increasing_id()))
    ids = seen.where("doc_id IS NOT NULL").select("row", "doc_id", "key", "digest", "n_words", "anchors")
    firsts = cut_lineage(ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    known = ids.join(firsts, "digest", "left")
    copies = known.where(f"first < doc_id AND n_words >= {window}").select("doc_id", "key", F.lit(True).alias("copy")).distinct()
    pairs = known.where("first IS NULL OR first = doc_id").select("row", "doc_id", F.explode("anchors").alias("anchor"))
    shared = cut_lineage(pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    wanted = pairs.select("row", "anchor").join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("wanted"))
    wanted = wanted.join(ids.select("row", "doc_id", "key"), "row").drop("row")
    # the texts that the search concerns, written once for both later uses
    texts = cut_lineage(rows.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "wanted").dropDuplicates(["doc_id", "key"]))
    blocks = cut_lineage(candidate_blocks(texts, window))
    found = cut_lineage(least_by_key(blocks.where("words IS NOT NULL"), window))
    hits = blocks.where("words IS NULL").select("key", "content", "doc_id", "doc_key", "start").join(found, ["key", "content"])
    at = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = hits.select("doc_id", "doc_key", at.alias("at")).where(F.size("at") > 0)
    hits = hits.groupBy("doc_id", F.col("doc_key").alias("key")).agg(F.flatten(F.collect_list("at")).alias("at"))

    def make():
        def work(part, texts):
            out = []
            for text, at in zip(texts, part.column("at").to_pylist(), strict=True):
                words = text.split()
                edges = np.zeros(len(words) + window, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, np.asarray(at) + window, -1)
                gone = np.cumsum(edges)[:len(words)] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            return {"doc_id": part.column("doc_id"), "key": part.column("key"), "gone": pa.array([o[0] for o in out], pa.int64()),
                    "sha": pa.array([o[1] for o in out], pa.string()), "kept": pa.array([o[2] for o in out], pa.string())}
        return work

    cut = texts.select("doc_id", "key", "text").join(hits, ["doc_id", "key"])
    cut = per_text(cut, "doc_id bigint, key bigint, gone bigint, sha string, kept string", make)
    cut = cut.unionByName(copies.where("copy").join(seen.select("doc_id", "key", "n_words").distinct(), ["doc_id", "key"])
                          .select("doc_id", "key", F.col("n_words").alias("gone"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("").alias("kept")))
    cut = cut.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "gone", "sha", "kept")
    out = seen.join(cut, (F.col("doc_id") == F.col("of")) & F.col("key").eqNullSafe(F.col("of_key")), "left")
    return out.select("doc_id", "n_words", F.coalesce("gone", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("sha", "own_sha256").alias("kept_sha256"), "kept")
