"""Quality score by a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so a document costs time in proportion to its features. Features are
the distinct words of the whole text, hashed and weighted by their counts, statistics of its structure (case, signs,
digits, repeats, lines, word lengths) and its stated length. Training sees at most ``PER_CLASS`` labelled documents of
either label, the first by hash of the id; their features are made on the executors and hold at most ``BUCKETS``
numbers each. Scoring is one pass over the texts without a shuffle.

Defined results. A null or blank text has statistics of zero and no words and gets a score like others. A missing or
null n_chars counts as the text's own length. Repeated and null ids are scored row by row. Without labelled rows of
both kinds all rows get the share of label 1 (0.0 without labels). Ids with two labels or a null label don't train.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import LOWER, per_text, spans_hash

PER_CLASS = 3000
BUCKETS, RANK = 1 << 14, 8
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.1, 11
_BYTES = np.arange(256)
_UPPER, _LETTER = (_BYTES >= 65) & (_BYTES <= 90), ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_DIGIT, _LINE = (_BYTES >= 48) & (_BYTES <= 57), _BYTES == 10
_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_SIGN = (_BYTES < 128) & ~_LETTER & ~_DIGIT & ~_BLANK
_STOP = np.isin(_BYTES, list(b".,;:"))
KINDS = np.stack([_UPPER, _DIGIT, _SIGN & ~_STOP, _STOP, _BYTES >= 128, _LINE]).astype(np.int32)
STATISTICS = len(KINDS) + 9


def features(texts: list[bytes], stated: list[int | None]):
    """(statistics (n, STATISTICS), row, bucket, weight of each distinct hashed word)."""
    n = len(texts)
    joined = b" " + b" ".join(texts) + b" "
    raw, buf = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(LOWER), np.uint8)
    blank = _BLANK[buf]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sizes = np.array([len(t) for t in texts])
    ends = 1 + np.cumsum(sizes + 1)
    owner = np.searchsorted(ends, first, side="right")
    counts = np.bincount(owner, minlength=n)
    bytes_of = np.stack([np.bincount(raw[e - s - 1:e - 1], minlength=256) for s, e in zip(sizes, ends, strict=True)]) @ KINDS.T
    chars = np.maximum(sizes, 1)
    hashes = spans_hash(buf, first, last) if len(first) else np.zeros(0, np.uint64)
    pairs = np.stack([owner.astype(np.uint64), hashes])
    order = np.lexsort(pairs[::-1])
    own, key = owner[order], hashes[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(own)))
    rows, words = own[at], np.maximum(counts, 1)
    top = np.zeros(n)
    np.maximum.at(top, rows, times)
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    length = (last - first).astype(float)
    mean = np.bincount(owner, length, n) / words
    ending = np.bincount(owner, (_SIGN & ~_STOP)[raw[last - 1]] if len(last) else None, n) / words
    alone = np.bincount(owner, (length == 1) & _SIGN[raw[first]] if len(first) else None, n) / words
    said = np.array([len(t.decode("utf-8", "replace")) if s is None else s for t, s in zip(texts, stated, strict=True)], float)
    stats = np.column_stack([*(bytes_of / chars[:, None]).T,
                             np.bincount(rows, minlength=n) / words, top / words, np.bincount(owner, same, n) / words, mean / 10,
                             np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / words - mean ** 2, 0)) / 10, ending, alone,
                             np.log1p(counts) / 10, np.log1p(np.maximum(said, 0)) / 10])
    # words of one text in one bucket add up
    slot, inverse = np.unique(rows * BUCKETS + (key[at] % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
    weight = 1 + np.log(np.bincount(inverse, times, len(slot)))
    row = slot // BUCKETS
    norm = np.sqrt(np.bincount(row, weight ** 2, n))
    return stats, row, slot % BUCKETS, weight / norm[row]


def design(stats, row, bucket, weight, centre, scale):
    """One sparse matrix: words first, then the scaled statistics. Sorted by row."""
    n = len(stats)
    dense = np.clip((stats - centre) / scale, -5, 5)
    rows = np.concatenate([row, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(rows, kind="stable")
    cols = np.concatenate([bucket, np.tile(BUCKETS + np.arange(STATISTICS), n)])[order]
    return rows[order], cols, np.concatenate([weight, dense.ravel()])[order]


def logits(m, rows, cols, x, n):
    """Linear-time factorisation machine; also the sums that the gradient needs."""
    begin = np.searchsorted(rows, np.arange(n))
    v = m["v"][cols] * x[:, None]
    total = np.add.reduceat(v, begin)
    pair = 0.5 * (total ** 2 - np.add.reduceat(v ** 2, begin)).sum(axis=1)
    return m["bias"] + np.add.reduceat(m["w"][cols] * x, begin) + pair, total


def train(rows: list[tuple]) -> dict:
    """rows: (label, statistics, buckets, weights). Their order doesn't matter."""
    rows = sorted(rows, key=lambda r: (r[0], list(r[1]), list(r[2])))
    y = np.array([r[0] for r in rows], float)
    if not len(y) or not 0 < y.mean() < 1:
        return {"share": float(y.mean()) if len(y) else 0.0}
    stats = np.array([r[1] for r in rows])
    r = np.random.default_rng(SEED)
    m = {"bias": 0.0, "w": np.zeros(BUCKETS + STATISTICS), "v": r.standard_normal((BUCKETS + STATISTICS, RANK)) * 0.02,
         "centre": stats.mean(axis=0), "scale": stats.std(axis=0) + 1e-3}
    gw, gv, gb = np.full(len(m["w"]), 1e-3), np.full(m["v"].shape, 1e-3), 1e-3
    push = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(EPOCHS, -(-2000 // -(-len(y) // BATCH)))):
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at:at + BATCH]
            sizes = [len(rows[i][2]) for i in some]
            row, cols, x = design(stats[some], np.repeat(np.arange(len(some)), sizes), np.concatenate([np.asarray(rows[i][2], np.int64) for i in some]),
                                  np.concatenate([np.asarray(rows[i][3], float) for i in some]), m["centre"], m["scale"])
            z, total = logits(m, row, cols, x, len(some))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * push[some] / len(some)
            dw = error[row] * x
            dv = dw[:, None] * (total[row] - m["v"][cols] * x[:, None])
            at_cols, inverse = np.unique(cols, return_inverse=True)
            dw = np.bincount(inverse, dw) + 1e-4 * m["w"][at_cols]
            dv = np.stack([np.bincount(inverse, dv[:, k]) for k in range(RANK)], axis=1) + 1e-4 * m["v"][at_cols]
            gw[at_cols] += dw ** 2
            gv[at_cols] += dv ** 2
            gb += error.sum() ** 2
            m["w"][at_cols] -= RATE * dw / np.sqrt(gw[at_cols])
            m["v"][at_cols] -= 0.2 * RATE * dv / np.sqrt(gv[at_cols])
            m["bias"] -= RATE * error.sum() / np.sqrt(gb)
    return m


def scores(m: dict, texts: list[bytes], stated: list) -> np.ndarray:
    if "share" in m or not texts:
        return np.full(len(texts), m.get("share", 0.0))
    rows, cols, x = design(*features(texts, stated), m["centre"], m["scale"])
    return 1 / (1 + np.exp(-np.clip(logits(m, rows, cols, x, len(texts))[0], -30, 30)))


def inputs(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("n_chars"))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple]:
    """Label and features of at most ``per_class`` documents of either label, the first by hash of the id."""
    clean = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    clean = clean.where("label = other").select(F.col("doc_id").cast("bigint").alias("of"), F.col("label").cast("int"))
    some = [clean.where(F.col("label") == y).orderBy(F.xxhash64("of"), "of").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows at most

    def make():
        def work(part, texts):
            stats, row, bucket, weight = features(texts, part.column("n_chars").to_pylist())
            cut = np.searchsorted(row, np.arange(1, len(texts)))
            return {"label": part.column("label"), "stats": pa.array(list(stats), pa.list_(pa.float64())),
                    "buckets": pa.array(np.split(bucket.astype(np.int32), cut), pa.list_(pa.int32())),
                    "weights": pa.array(np.split(weight.astype(np.float32), cut), pa.list_(pa.float32()))}
        return work

    found = per_text(inputs(docs).join(chosen, F.col("doc_id") == F.col("of")).select("text", "n_chars", "label"),
                     "label int, stats array<double>, buckets array<int>, weights array<float>", make)
    table = found.toArrow()
    return list(zip(*(table.column(c).to_pylist() for c in ("label", "stats", "buckets", "weights")), strict=True))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda part, texts: {"doc_id": part.column("doc_id"), "score": pa.array(scores(m, texts, part.column("n_chars").to_pylist()), pa.float64())}

    return per_text(inputs(docs), "doc_id bigint, score double", make)
