"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into windows of ``WINDOW`` words, ``STRIDE`` apart, the last ending with the text; every window is scored
and a document's score is that of its worst window. A word (lower-cased; ASCII signs separate words) enters as
the sum of a hashed word vector and of its hashed vectors of three and five bytes, blanks marking its ends. Two gated recurrent layers run over a window in both
directions, attention weights pool their states, and one unit gives the probability.

Training sees labelled documents only, at most ``PER_CLASS`` of either label by hash of the id, those of up to
``MOST_WINDOWS`` windows. A document's label is pushed into its worst window, so no window needs a label. The weights are
a few megabytes, whatever the input; scoring is one pass over the texts without a shuffle.

Defined results. A null or blank text is scored as one window without words. Repeated and null ids are scored row by
row. Without labelled rows of both kinds the score is the share of toxic labels (0.0 without labels) for all rows.
Labelled ids with two labels or null labels are left out of training. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, mix64, per_text, ranges, spans_hash

WINDOW, STRIDE = 48, 32
PER_CLASS, MOST_WINDOWS = 2000, 24
WORDS, GRAMS, WIDE, HIDDEN = 1 << 17, 1 << 15, 16, 8
STEPS, BATCH, RATE = 400, 48, 0.01
OFTEN, SEED = 4, 7
#: Bytes of texts that are scored at once.
AT_ONCE = 1 << 20
#: Bytes of words after lower-casing: digits, a to z and everything beyond ASCII; others become a blank.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words:
    """The distinct words of some texts with their hashes, and each text as a list of their numbers."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join([b"", *texts, b"   "]).translate(KEPT), np.uint8)
        blank = buf == 32
        first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(first, ends), prepend=0)
        hashes = spans_hash(buf, first, last)
        self.hash, at, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        size = last[at] - first[at]
        # the blanks around a word mark its ends
        grams = []
        for n in (3, 5):
            many = np.maximum(size + 3 - n, 0)
            where = ranges(first[at] - 1, many)
            grams.append((mix64(sum(buf[where + k].astype(np.uint64) << np.uint64(8 * k) for k in range(n))), many))
        self.row = (self.hash % np.uint64(WORDS)).astype(np.int64)
        self.sizes = size + np.maximum(size - 2, 0)
        owner = np.concatenate([np.repeat(np.arange(len(at)), n) for _, n in grams])
        flat = np.concatenate([(g % np.uint64(GRAMS)).astype(np.int64) for g, _ in grams])
        self.grams = flat[np.argsort(owner, kind="stable")]
        self.begin = np.cumsum(self.sizes) - self.sizes

    def texts(self) -> list[np.ndarray]:
        return np.split(self.ids, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


def starts(n: int) -> list[int]:
    """Starts of the windows that cover n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of word numbers, their masks, and the number of windows of each text."""
    n = words.counts
    base = np.cumsum(n) - n
    begins = [starts(int(x)) for x in n]
    counts = np.array([len(b) for b in begins])
    first = np.concatenate([np.asarray(b) + at for b, at in zip(begins, base, strict=True)])
    size = np.minimum(np.repeat(n, counts), WINDOW)
    mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
    padded = np.concatenate([words.ids, np.zeros(WINDOW, words.ids.dtype)])
    if not len(words.hash):  # no words at all; the mask hides what is read
        return np.zeros((len(first), WINDOW), np.int64), mask, counts
    return padded[first[:, None] + np.arange(WINDOW)], mask, counts


def new_model() -> dict[str, np.ndarray]:
    r = np.random.default_rng(SEED)
    draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return {"word": np.zeros((WORDS, WIDE), np.float32), "gram": draw(GRAMS, WIDE, scale=0.3), "w": draw(2, WIDE, 3 * HIDDEN, scale=0.4),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": draw(2, HIDDEN, 3 * HIDDEN, scale=0.2),
            "v": draw(2 * HIDDEN, scale=0.3), "c": draw(2 * HIDDEN, scale=0.5), "d": np.full(1, -1.0, np.float32)}


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def project(m, vectors: np.ndarray) -> np.ndarray:
    """The input side of the gates, by direction: (2, words, 3 * HIDDEN)."""
    return np.stack([vectors @ m["w"][d] + m["b"][d] for d in (0, 1)])


def vectors_of(m, words: Words, some: np.ndarray | slice = slice(None), keep: np.ndarray | None = None) -> np.ndarray:
    """Vectors of the words numbered ``some``; ``keep`` scales the word part."""
    sizes = words.sizes[some]
    if not len(sizes):
        return np.zeros((1, WIDE), np.float32)
    flat = words.grams if isinstance(some, slice) else words.grams[ranges(words.begin[some], sizes)]
    mean = np.add.reduceat(m["gram"][flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None].astype(np.float32)
    own = m["word"][words.row[some]]
    return mean + (own if keep is None else own * keep[:, None])


def forward(m, table: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. table: (2, words, 3H); windows, mask: (windows, T), mask 0 beyond the text."""
    n, steps = mask.shape
    size = HIDDEN
    h = np.zeros((2, n, size), np.float32)
    states = np.empty((steps, 2, n, size), np.float32)
    saved, full = [], bool(mask.all())
    turned, shown = np.ascontiguousarray(windows.T), np.ascontiguousarray(mask.T)
    g = np.empty((2, n, 3 * size), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        np.take(table[0], turned[t], axis=0, out=g[0])
        np.take(table[1], turned[back], axis=0, out=g[1])
        hu = h @ m["u"]
        zr = g[:, :, :2 * size] + hu[:, :, :2 * size]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, hn = zr[:, :, :size], zr[:, :, size:], hu[:, :, 2 * size:]
        new = r * hn
        new += g[:, :, 2 * size:]
        np.tanh(new, out=new)
        change = (new - h) * (1 - z)
        on = None
        if not full:
            on = np.stack([shown[t], shown[back]])[:, :, None]
            change *= on
        if keep:
            saved.append((h, z, r, hn, new, 1.0 if on is None else on))
        h = h + change
        states[t, 0], states[back, 1] = h[0], h[1]
    both = states.transpose(2, 0, 1, 3).reshape(n, steps, 2 * size)
    score = both @ m["v"] + (mask - 1) * 1e4
    weight = np.exp(score - score.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, None, :] @ both)[:, 0]
    logit = pooled @ m["c"] + m["d"][0]
    return (logit, (both, weight, pooled, saved)) if keep else logit


def backward(m, mask, kept, dlogit):
    """Gradients of the parameters but the embeddings, and of the gates' input (2, windows, T, 3H)."""
    both, weight, pooled, saved = kept
    n, steps = mask.shape
    size = HIDDEN
    grad = {"c": pooled.T @ dlogit, "d": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * m["c"]
    dweight = (both @ dpooled[:, :, None])[:, :, 0]
    dscore = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
    grad["v"] = np.einsum("nt,nth->h", dscore, both)
    dboth = (weight[:, :, None] * dpooled[:, None, :] + dscore[:, :, None] * m["v"]).reshape(n, steps, 2, size)
    dx = np.zeros((2, n, steps, 3 * size), np.float32)
    du = np.zeros_like(m["u"])
    dh = np.zeros((2, n, size), np.float32)
    turned = m["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        h, z, r, hn, new, on = saved[t]
        dh = dh + np.stack([dboth[:, t, 0], dboth[:, back, 1]])
        step = dh * on
        dnew = step * (1 - z) * (1 - new * new)
        dz = step * (h - new) * z * (1 - z)
        dr = dnew * hn * r * (1 - r)
        dg = np.concatenate([dz, dr, dnew], axis=2)
        dhu = np.concatenate([dz, dr, dnew * r], axis=2)
        dx[0, :, t], dx[1, :, back] = dg[0], dg[1]
        du += h.transpose(0, 2, 1) @ dhu
        dh = dh - step * (1 - z) + dhu @ turned
    grad["u"] = du
    return grad, dx


class Adam:
    """Adam for the small arrays, row-wise AdaGrad for the two hashed tables."""

    def __init__(self, m, fixed):
        self.m, self.t, self.fixed = m, 0, fixed
        self.a, self.b = ({k: np.zeros_like(v) for k, v in m.items() if k not in ("word", "gram")} for _ in range(2))
        self.rows = {k: np.full((len(m[k]), 1), 1e-6, np.float32) for k in ("word", "gram")}

    def step(self, grad, rate):
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grad.items():
            self.a[k] += 0.1 * (g - self.a[k])
            self.b[k] += 0.001 * (g * g - self.b[k])
            self.m[k] -= (rate * fix) * self.a[k] / (np.sqrt(self.b[k]) + 1e-8)

    def rows_step(self, k, rows, grads, rate):
        at, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(at), WIDE), np.float32)
        np.add.at(total, inverse, grads)
        self.rows[k][at] += (total * total).mean(axis=1, keepdims=True)
        self.m[k][at] -= self.fixed[k][at][:, None] * rate * total / np.sqrt(self.rows[k][at])


def common(words: Words) -> dict[str, np.ndarray]:
    """For each hashed table 1 for rows that occur in at least OFTEN texts; the others stay 0, so nothing is learnt by heart."""
    seen = {"word": np.zeros(WORDS, np.int32), "gram": np.zeros(GRAMS, np.int32)}
    for ids in words.texts():
        some = np.unique(ids)
        seen["word"][np.unique(words.row[some])] += 1
        seen["gram"][np.unique(words.grams[ranges(words.begin[some], words.sizes[some])])] += 1
    return {k: (v >= OFTEN).astype(np.float32) for k, v in seen.items()}


def train(rows: list[tuple[bytes, int]]) -> dict[str, np.ndarray]:
    """rows: text and label. The order of the rows doesn't matter."""
    if not rows:
        return new_model() | {"share": np.zeros(1)}
    rows = sorted(rows, key=lambda x: (zlib.crc32(x[0]), x[0]))
    words = Words([t for t, _ in rows])
    windows, masks, counts = windows_of(words)
    ends = np.cumsum(counts)
    kept = np.flatnonzero(counts <= MOST_WINDOWS)
    labels = np.array([y for _, y in rows], np.float32)
    m = new_model()
    fixed = common(words)
    for k, often in fixed.items():
        m[k] *= often[:, None]
    if not len(kept) or not 0 < labels[kept].mean() < 1:
        return m | {"share": np.array([labels.mean() if len(labels) else 0.0])}
    share = labels[kept].mean()
    push = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam, r, order = Adam(m, fixed), np.random.default_rng(SEED), np.zeros(0, int)
    for done in range(STEPS):
        if len(order) < BATCH:
            order = np.concatenate([order, r.permutation(kept)])
        some, order = order[:BATCH], order[BATCH:]
        sizes = counts[some]
        rows_of = ranges(ends[some] - sizes, sizes)
        used, inverse = np.unique(windows[rows_of], return_inverse=True)
        seen, mask = inverse.reshape(len(rows_of), WINDOW), masks[rows_of]
        logits = forward(m, project(m, vectors_of(m, words, used)), seen, mask)
        upto = np.cumsum(sizes)
        worst = np.array([e - n + int(np.argmax(logits[e - n:e])) for e, n in zip(upto, sizes, strict=True)])
        mask = mask[worst]
        near, inverse = np.unique(seen[worst], return_inverse=True)
        used, mine = used[near], inverse.reshape(-1, WINDOW)
        keep = (r.random(len(used)) > 0.3).astype(np.float32)  # words that no training text has must be judged by their grams
        vec = vectors_of(m, words, used, keep)
        logit, state = forward(m, project(m, vec), mine, mask, keep=True)
        dlogit = ((sigmoid(logit) - labels[some]) * push[some] / len(some)).astype(np.float32)
        grad, dx = backward(m, mask, state, dlogit)
        flat = np.zeros((2, len(used), 3 * HIDDEN), np.float32)
        for d in (0, 1):
            np.add.at(flat[d], mine.ravel(), dx[d].reshape(-1, 3 * HIDDEN))
        grad["w"] = vec.T[None] @ flat
        grad["b"] = flat.sum(axis=1, keepdims=True)
        dvec = sum(flat[d] @ m["w"][d].T for d in (0, 1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - 0.9 * done / STEPS)
        adam.step({k: g / max(norm, 1) for k, g in grad.items()}, rate)
        of = words.sizes[used]
        adam.rows_step("gram", words.grams[ranges(words.begin[used], of)], np.repeat(dvec / np.sqrt(of)[:, None], of, axis=0), 5 * rate)
        adam.rows_step("word", words.row[used], dvec * keep[:, None], 5 * rate)
    return m


class Scorer:
    def __init__(self, m):
        self.m = m

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if "share" in self.m or not texts:
            return np.full(len(texts), self.m.get("share", [0.0])[0])
        words = Words(texts)
        table = project(self.m, vectors_of(self.m, words))
        windows, masks, counts = windows_of(words)
        logits = np.concatenate([forward(self.m, table, windows[at:at + 1024], masks[at:at + 1024]) for at in range(0, len(windows), 1024)])
        return sigmoid(np.maximum.reduceat(logits, np.cumsum(counts) - counts).astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[bytes, int]]:
    """Text and label of at most ``per_class`` documents of either label, the first by hash of the id."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    clean = clean.where("toxic = other").select(F.col("doc_id").cast("bigint").alias("of"), "toxic")
    some = [clean.where(F.col("toxic") == y).orderBy(F.xxhash64("of"), "of").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * per_class rows at most
    found = id_and_text(docs).join(chosen, F.col("doc_id") == F.col("of")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    fits = found.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) <= (MOST_WINDOWS - 1) * STRIDE + WINDOW)
    return [(r["text"].encode(), int(r["toxic"])) for r in fits.collect()]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda part, texts: {"doc_id": part.column("doc_id"), "score": pa.array(scorer(texts), pa.float64())}

    return per_text(id_and_text(docs), "doc_id bigint, score double", make, limit=AT_ONCE)


def without_toxic(docs: DataFrame, model: dict, threshold: float) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)
        return lambda part, texts: dict(zip(part.schema.names, part.filter(pa.array(scorer(texts) < threshold)).columns, strict=True))

    return per_text(docs, docs.schema, make, limit=AT_ONCE)
