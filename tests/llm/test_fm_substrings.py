import hashlib
import random

import numpy as np
import pytest

from panelyard.llm import fm_substrings as S

from .conftest import MESSY


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[k:k + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[k:k + window])] < doc:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_words", [S.INDEX_WORDS, 100])
def test_against_brute_force(documents, monkeypatch, index_words):
    monkeypatch.setattr(S, "INDEX_WORDS", index_words)
    r = random.Random(index_words)
    word = lambda: "".join(r.choice("abcd") for _ in range(3))
    passages = [[word() for _ in range(r.randrange(8, 60))] for _ in range(6)]
    rows = list(MESSY)
    for i in range(60):
        words = []
        for _ in range(r.randrange(4)):
            words += [word() for _ in range(r.randrange(20))]
            p = r.choice(passages)
            words += p[r.randrange(4):len(p) - r.randrange(4)] * r.choice([1, 1, 2])
        if r.random() < 0.3 and words:
            words[r.randrange(len(words))] = word()
        rows.append((r.randrange(1000), " ".join(words)))
    rows += [(2000 + i, rows[-1 - i][1]) for i in range(5)] + [(3000, "same " * 200), (3001, "same " * 90 + "x")]
    for window in (10, 50):
        got = S.repeated_words(documents(rows), window).drop("kept").collect()
        assert sorted((tuple(x) for x in got), key=str) == brute(rows, window)


def test_kept_text_and_empty_table(documents):
    p = " ".join(f"p{i}" for i in range(50))
    got = {r.doc_id: r.kept for r in S.repeated_words(documents([(1, f"a {p} b"), (2, f"c {p} d"), (3, "short")])).collect()}
    assert got == {1: None, 2: "c d", 3: None}
    assert S.repeated_words(documents([])).count() == 0


def test_index_counts_like_a_scan():
    r = np.random.default_rng(5)
    text = np.concatenate([r.integers(1, 5, 300), [0], r.integers(1, 5, 200), [0]])
    index = S.FMIndex(text, 5, 7)
    ends = np.array([e for e in range(7, len(text)) if (text[e - 7:e] > 0).all()])
    matched, low, high = index.search(text, ends, 7)
    for e, m, a, b in zip(ends, matched, low, high, strict=True):
        places = [k for k in range(len(text) - 6) if (text[k:k + 7] == text[e - 7:e]).all()]
        if m == 7:
            assert sorted(index.suffixes[a:b].tolist()) == places
        else:
            assert len(places) == 1


@pytest.mark.parametrize("key_rows", [S.KEY_ROWS, 3])
def test_no_index_holds_a_whole_crowded_key(documents, monkeypatch, key_rows):
    """A passage between different texts makes as many distinct blocks at its ends as documents have it."""
    monkeypatch.setattr(S, "KEY_ROWS", key_rows)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(70)]
    rows = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(40)]
    rows += [(i, " ".join([word() for _ in range(30)] + passage[3:60] + [word() for _ in range(30)])) for i in range(40, 60)]
    got = S.repeated_words(documents(rows), 50).drop("kept").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 50)


def test_crowded_keys_reach_no_shard(documents, monkeypatch):
    monkeypatch.setattr(S, "KEY_ROWS", 8)
    seen = []
    search = S.search_shards
    monkeypatch.setattr(S, "search_shards", lambda contents, window: seen.append(contents) or search(contents, window))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(20)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(20))) for i in range(40)]
    assert sorted(x.n_removed for x in S.repeated_words(documents(rows)).collect()) == [0] + [60] * 39
    most = [x["count"] for x in seen[0].groupBy("key").count().collect()]
    assert max(most, default=0) <= 8
