"""Token ids in a binary format: canonical length-limited Huffman codes in independent blocks.

``write_ids`` encodes texts with a public tokenizer, counts all ids, gives each id a canonical code of at most
``LIMIT`` bits (package-merge) and writes two Parquet tables under one folder:

* ``codebook``: id, code length. Canonical codes follow from the lengths alone.
* ``blocks``: one row per block of whole documents in ascending doc_id order: shard, number of tokens of the shard
  before the block, doc_ids, tokens of each, the code bits (first bit highest), and the bit offset of every 64th token.

A block decodes by itself; its bit offsets let all 64-token stretches of a block decode side by side through one table
of 2^LIMIT entries. Only the counts (one row per id of the vocabulary) and one total per shard meet in one place.

Defined results. A null text is empty: it holds the end id alone. Null ids come first. Repeated rows are all written.
An empty table gives an empty file set. Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
import zlib
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.llm.common import give_back, id_and_text, per_text, ranges, raw, release, slices
from panelyard.session import cut_lineage

LIMIT, EVERY = 16, 64
BLOCK_TOKENS, SHARD_TOKENS = 1 << 17, 1 << 22
#: Distinct stretches that a worker keeps the ids of (a few more would double the dictionary), and bytes of them.
CACHED, CACHED_BYTES = 345_000, 8 << 20
#: Bytes of text encoded at a time, and after how many such parts freed memory is given back.
AT_ONCE, GIVE_BACK = 1 << 19, 4
FILE = ("shard int, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_bits bigint, bits binary, offsets binary")


class Kept:
    """Stretches already encoded: their number, their ids one after another, and whether they came again lately."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.place, self.used, self.held = {}, 0, 0
        self.begin, self.sizes, self.ids = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.uint32)
        self.again = np.zeros(1, bool)

    def trim(self):
        """Forgets what did not come again since the last time: most stretches of a text are rare ones."""
        words, at = list(self.place), np.flatnonzero(self.again[:len(self.place)])
        sizes = self.sizes[at]
        ids = self.ids[ranges(self.begin[at], sizes)]
        self.clear()
        self.add([words[i] for i in at.tolist()], sizes, ids)

    def add(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray):
        n, k = len(self.place), len(words)
        self.begin, self.sizes = self.room(self.begin, n + k), self.room(self.sizes, n + k)
        self.ids, self.again = self.room(self.ids, self.used + len(ids)), self.room(self.again, n + k)
        self.begin[n:n + k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n:n + k] = sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += sum(map(len, words))
        self.place.update(zip(words, range(n, n + k), strict=True))

    @staticmethod
    def room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        return np.concatenate([values, np.zeros(max(size, len(values) + len(values) // 4) - len(values), values.dtype)])


_KEPT: dict[str, Kept] = {}
_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """Ids of texts. Where tokens mark the ends of words, none crosses white space, so the tokenizer is asked once for
    each distinct stretch between white space, and answers are kept for the stretches that come again. Lower-case words
    of letters, which the tokenizer's rules leave as they are, are encoded many at a time behind a plain split at blanks,
    and the ids parted at the ends of words. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        self.kept = _KEPT.setdefault(path, Kept())  # a worker runs many tasks
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = self.bare = None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            rules = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": rules}}))
            letters = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïñóôöùûüß"
            probe = [*letters, letters, *(a + b for a in letters for b in letters)]
            same = self.alone(self.bare, probe) == self.alone(self.tokenizer, probe)
            any_case = self.alone(self.tokenizer, ["AbZ", "a.", "a1,"]) == self.alone(self.tokenizer, ["abz", "a .", "a1 ,"])
            self.bare = self.bare if same and any_case else None

    @staticmethod
    def alone(tokenizer, words: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def stretches(self, text: bytes) -> list[bytes]:
        """The stretches of a text, in lower case where that doesn't change what the tokenizer's own rules give."""
        if self.bare is None:
            return text.split()
        low = text.lower()
        if text.isascii() or unicodedata.is_normalized("NFC", low.decode()) and unicodedata.is_normalized("NFC", text.decode()):
            return low.split()
        return text.split()

    def learn(self, new: list[bytes]) -> None:
        texts = b" ".join(new).decode().split(" ")
        # a full stop or comma behind letters is a word of its own
        signs = [t[-1] in ".," for t in texts]
        cores = [t[:-1] if s else t for t, s in zip(texts, signs, strict=True)]
        # two bytes a letter at most: scripts whose letters no rule changes
        plain = np.array([c.islower() and c.isalpha() and len(w) <= 2 * len(c) for w, c in zip(new, cores, strict=True)], bool)
        if self.bare is None or not unicodedata.is_normalized("NFC", " ".join(texts)):
            plain[:] = False
        for at in np.array_split(np.flatnonzero(plain), max(1, plain.sum() // 250)):
            if len(at):
                some = at.tolist()
                spaced = " ".join([f"{cores[i]} {texts[i][-1]}" if signs[i] else texts[i] for i in some])
                ids = np.array(self.bare.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                upto = np.cumsum([1 + signs[i] for i in some])
                if len(ends) == upto[-1]:
                    self.kept.add([new[i] for i in some], np.diff(ends[upto - 1], prepend=0), ids)
                else:
                    plain[at] = False
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            ids = self.alone(self.tokenizer, [texts[i] for i in rest])
            self.kept.add([new[i] for i in rest], np.array([len(x) for x in ids]), np.fromiter(chain.from_iterable(ids), np.uint32))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.last is None:
            return [np.array([*ids, self.end], np.uint32) for ids in self.alone(self.tokenizer, [t.decode() for t in texts])]
        split = [self.stretches(t) for t in texts]
        words = list(chain.from_iterable(split))
        ends = np.cumsum([len(x) for x in split])

        def places(some):
            return np.fromiter(map(self.kept.place.get, some, repeat(-1)), np.int64, len(some))

        def lacking():
            at = places(words)
            missing = np.flatnonzero(at < 0)
            unknown = [words[i] for i in missing.tolist()]
            return at, missing, unknown, set(unknown)

        at, missing, unknown, new = lacking()
        self.kept.again[at[at >= 0]] = True
        for forget in (self.kept.trim, self.kept.clear):
            if len(self.kept.place) + len(new) > CACHED or self.kept.held + sum(map(len, new)) > CACHED_BYTES:
                forget()
                at, missing, unknown, new = lacking()
        if new:
            collecting = gc.isenabled()
            gc.disable()  # many small lists without cycles, beside which each collection walks through all that is held
            try:
                self.learn(list(new))
            finally:
                if collecting:
                    gc.enable()
            at[missing] = places(unknown)
        sizes = self.kept.sizes[at]
        ids = self.kept.ids[ranges(self.kept.begin[at], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
        end = np.array([self.end], np.uint32)
        return [np.concatenate([ids[i:j], end]) for i, j in zip(upto[:-1], upto[1:], strict=True)]


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker: reading a vocabulary twice over takes as long as a megabyte of text, and its parts' memory."""
    if (path, end_id) not in _ENCODERS:
        release()  # what tasks of other jobs left
        _ENCODERS[path, end_id] = Encoder(path, end_id)
        release()
    return _ENCODERS[path, end_id]


def vocabulary(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end_id + 1)


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (binary, two or four bytes each by the size of the vocabulary)."""
    kind = "<u2" if vocabulary(path, end_id) <= 1 << 16 else "<u4"

    def make():
        encode, parts = encoder(path, end_id), count(1)

        def work(part, texts):
            if next(parts) % GIVE_BACK == 0:
                give_back()  # what the parts before left would else add up in each worker
            ids = [x.astype(kind) for x in encode(texts)]
            return {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
        return work

    return per_text(id_and_text(docs), "doc_id bigint, n_tokens bigint, ids binary", make, limit=AT_ONCE)


def id_counts(tokens: DataFrame, size: int) -> DataFrame:
    """id, n over all rows; each task sends one row per id at most."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(size, np.int64)
        for part in slices(batches):
            total += np.bincount(np.frombuffer(b"".join(raw(part.column("ids"))), kind), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, levels = leaves, [np.zeros(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank >= n)
    take = 2 * n - 2
    for packed in reversed(levels):
        own = take - int(packed[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order].astype(np.uint64)
        spans = np.uint64(1) << (np.uint64(32) - sizes)
        codes[order] = (np.cumsum(spans) - spans) >> (np.uint64(32) - sizes)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[int, bytes, bytes]:
    """Number of bits, the bits, and the bit offset of every EVERY-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, value = starts >> 5, codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
    n = int(ends[-1])
    high = (value >> np.uint64(32)).astype(np.float64)  # sums of disjoint bits below 2^32 are exact
    low = (value & np.uint64(0xFFFFFFFF)).astype(np.float64)
    total = np.bincount(word, high, (n >> 5) + 2) + np.bincount(word + 1, low, (n >> 5) + 2)
    return n, total.astype(">u4").tobytes()[: (n + 7) // 8], starts[::EVERY].astype("<u4").tobytes()


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes


def unpack(bits: bytes, offsets: bytes, n: int, table, limit: int = LIMIT) -> np.ndarray:
    """The n ids of a block; all stretches between offsets go forward together."""
    data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = np.frombuffer(offsets, "<u4").astype(np.int64)
    out = np.zeros((len(at), EVERY), np.uint32)
    ids, sizes = table
    last = 8 * len(bits)
    for step in range(EVERY):
        next_bits = (window[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[:, step] = ids[next_bits]
        at = np.minimum(at + sizes[next_bits], last)  # only the last stretch can be shorter
    return out.ravel()[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, limit: int = LIMIT) -> None:
    spark, size = docs.sparkSession, vocabulary(tokenizer, end_id)
    tokens = cut_lineage(token_table(docs, tokenizer, end_id))
    counted = id_counts(tokens, size).toPandas()  # one row per id of the vocabulary at most
    counts = np.zeros(size, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    sent, kind = spark.sparkContext.broadcast(lengths), "<u2" if size <= 1 << 16 else "<u4"

    def encode(batches):
        lengths, codes = sent.value, canonical(sent.value)
        shard, before = TaskContext.get().partitionId(), 0
        doc_ids, sizes, held = [], [], []

        def block():
            nonlocal before, doc_ids, sizes, held
            n_bits, bits, offsets = pack(np.frombuffer(b"".join(held), kind), lengths, codes)
            row = {"shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                   "n_tokens": pa.array([sizes], pa.list_(pa.int64())), "n_bits": pa.array([n_bits], pa.int64()),
                   "bits": pa.array([bits], pa.binary()), "offsets": pa.array([offsets], pa.binary())}
            before += sum(sizes)
            doc_ids, sizes, held = [], [], []
            return pa.RecordBatch.from_pydict(row)

        filled = 0
        for part in slices(batches):
            for doc, ids in zip(part.column("doc_id").to_pylist(), raw(part.column("ids")), strict=True):
                n = len(ids) // np.dtype(kind).itemsize
                if held and filled + n > BLOCK_TOKENS:
                    yield block()
                    filled = 0
                doc_ids.append(doc)
                sizes.append(n)
                held.append(ids)
                filled += n
        if held:
            yield block()

    n_shards = max(1, -(-int(counts.sum()) // SHARD_TOKENS))
    ordered = tokens.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    ordered.mapInArrow(encode, FILE).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, ids: bool = True, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of every document, read from the files."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # one row per id of the vocabulary at most
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(FILE).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"))
    upto = F.sum("tokens").over(Window.orderBy("shard"))  # one row per shard of four million tokens
    starts = totals.select(F.col("shard").alias("of"), (upto - F.col("tokens")).alias("shard_start"))

    def decode(batches):
        table = decoding_table(sent.value, limit)
        for part in slices(batches, 1):
            docs, sizes = part.column("doc_ids")[0].as_py(), part.column("n_tokens")[0].as_py()
            got = unpack(part.column("bits")[0].as_py(), part.column("offsets")[0].as_py(), sum(sizes), table, limit).astype("<u4")
            ends = np.cumsum(sizes)
            each = [got[e - n:e] for e, n in zip(ends.tolist(), sizes, strict=True)]
            first = part.column("shard_start")[0].as_py() + part.column("before")[0].as_py()
            row = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(first + ends - np.array(sizes), pa.int64()),
                   "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
            if ids:
                row["ids"] = pa.array(each, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(row)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    placed = blocks.join(starts, F.col("shard") == F.col("of")).select("before", "doc_ids", "n_tokens", "bits", "offsets", "shard_start")
    return placed.mapInArrow(decode, schema)
