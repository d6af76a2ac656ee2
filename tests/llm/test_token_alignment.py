"""Alignment of two tokenizers against a plain count over whole texts."""

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm import token_alignment as T

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@cache
def vocabularies():
    return T.Words(A, B)


@pytest.fixture
def words():
    return vocabularies()


def plain(words, text):
    """(ids of A, ids of B, groups, links) of a whole text, or None."""
    if not text:
        return None
    a = words.a.encode(" " + text, add_special_tokens=False).ids
    b = words.b.encode(text)
    known = (" " + text).encode()
    if b"".join(words.bytes_a[i] for i in a) != known or b"".join(words.bytes_b[i] for i in b) != known:
        return None
    spans = []
    for ids, of in ((a, words.bytes_a), (b, words.bytes_b)):
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(of[i]), i))
            at += len(of[i])
        spans.append(found)
    links = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if max(s, u) < min(e, v)]
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    told, low = [], 0
    for cut in cuts:
        told.append("|".join(",".join(str(i) for s, e, i in side if low < e <= cut) for side in spans))
        low = cut
    return len(a), len(b), len(cuts), ";".join(told), links


def brute(words, rows):
    found = [(doc, plain(words, text)) for doc, text in rows]
    counts = Counter(p for _, f in found if f for p in f[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, f[0], f[1], f[2], len(f[4]), sum(counts[p] == most[p[1]] for p in f[4]), sum(counts[p] for p in f[4]), hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


TEXTS = ["  two  blanks\tand\n\n lines   odd 　space", "<|endoftext|> <s></s> <unk>", "a▁b", "▁", " ", "\n", "it's don't 12,345.67!?", "日本語 😀 é́ ﬁ",
         "x\x00y\x1cz", "word  \nnext", "﻿bom", "plain words again and again", "\u0085\u0085 a", "naïve façade"]


def test_both_vocabularies_are_worked_on_in_stretches(words):
    assert words.parted


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*TEXTS, " ", "  ", "\n", "\t", "\xa0", "　", "'s", "ab", "é", "▁", ".", "\x1c", "x" * 40]), min_size=1, max_size=8).map("".join) | st.text(min_size=1, max_size=30))
def test_stretches_give_what_whole_texts_give(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    words = vocabularies()
    align = T.Aligned(words)
    want = plain(words, text)
    for got in (align([" " + text])[0], align.total([s] for s in words.stretch.findall(" " + text))):
        assert (got is None) == (want is None)
        if want:
            assert got[:3] == want[:3] and got[3] == hashlib.sha256(want[3].encode()).hexdigest()
            assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == Counter(a * words.size_b + b for a, b in want[4])


@pytest.mark.parametrize("common", [1 << 18, 5])
def test_against_a_plain_count(documents, words, common, monkeypatch):
    from tests.llm.conftest import MESSY

    monkeypatch.setattr(T, "COMMON", common)
    rng = np.random.default_rng(1)
    vocabulary = ["the", "house", "of", "Quarz", "straße", "12", "x,y", "...", "antidisestablishment"]
    data = [r for r in MESSY if r[0] != 7] + [(i, t) for i, t in enumerate(TEXTS, 20)] + [(40 + i % 30, " ".join(rng.choice(vocabulary, 1 + i % 9))) for i in range(60)] + [(100 + i, "same text") for i in range(50)]
    got, pairs = T.alignment(documents(data).repartition(5), A, B)
    assert rows(got) == brute(words, data)
    assert pairs.count() == len({p for _, t in data if (f := plain(words, t)) for p in f[4]})


def test_long_text_small_memory_and_empty_table(documents, words, monkeypatch):
    text = "w0 w1 " * 4000 + "z" * 5000
    want = plain(words, text[:3000])
    for kept, size, part, at_once in ((T.KEPT, T.KEPT_BYTES, T.PART, T.AT_ONCE), (8, 40, 3, 10)):
        for name, value in (("KEPT", kept), ("KEPT_BYTES", size), ("PART", part), ("AT_ONCE", at_once)):
            monkeypatch.setattr(T, name, value)
        long, short = T.Aligned(words)([" " + text, " " + text[:3000]])
        assert long[:2] == (len(words.a.encode(" " + text).ids), len(words.b.encode(text)))
        assert short[:4] == (*want[:3], hashlib.sha256(want[3].encode()).hexdigest())
        whole = T.Aligned(words)
        whole.words.parted = False
        assert whole([" " + text[:3000]])[0][:4] == short[:4]
        whole.words.parted = True
    assert T.alignment(documents([]), A, B)[0].count() == 0
    assert rows(T.alignment(documents([(1, None), (2, "")]), A, B)[0]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
