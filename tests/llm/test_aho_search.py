"""Ranked search against a plain count of terms."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from panelyard.llm import aho_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, w in split:
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def bench(spark):
    return lambda data: spark.createDataFrame([(i, t, 1, 2.0) for i, t in data], "item_id bigint, text string, doc_id int, score double")


ITEMS = [(1, "A b c"), (1, "x, the-the w0"), (2, "é 日本 nothing else"), (3, None), (4, " ,. "), (None, "other words"), (5, "w1")]


def test_messy_rows_and_items(messy, bench, documents):
    from tests.llm.conftest import MESSY

    assert rows(aho_search.ranked(messy, bench(ITEMS))) == brute(MESSY, ITEMS)
    assert rows(aho_search.ranked(messy, bench([]))) == []
    assert rows(aho_search.ranked(documents([]), bench(ITEMS))) == []


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_random_texts_in_one_and_many_shards(documents, bench, limit, monkeypatch):
    monkeypatch.setattr(aho_search, "HITS", 37)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["w", "1w", "Ä", "ä"]
    def text(n):
        return "".join(w + s for w, s in zip(rng.choice(vocabulary, n), rng.choice([" ", "  ", "\n", "-", "_", "."], n), strict=True))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in rng.integers(0, 90, 150)]
    items = [(i, text(int(rng.integers(1, 9)))) for i in range(12)]
    got = aho_search.ranked(documents(docs).repartition(7), bench(items), top=5, shard_bytes=limit)
    assert rows(got) == brute(docs, items, 5)


def test_the_best_are_kept_while_scores_pour_in():
    rng = np.random.default_rng(5)
    best, every = aho_search.Best(3, 4), []
    best.room = 10
    for block in range(30):
        scores, ids = rng.integers(0, 6, (8, 3)), rng.integers(0, 1000, 8)
        best.add(scores, ids, np.zeros(8, bool))
        every += [(j, -int(scores[i, j]), int(ids[i])) for i in range(8) for j in range(3) if scores[i, j] > 0]
    item, score, ids, _ = best.rows()
    want = [x for j in range(3) for x in sorted(x for x in every if x[0] == j)[:4]]
    assert list(zip(item.tolist(), (-score).tolist(), ids.tolist(), strict=True)) == want
