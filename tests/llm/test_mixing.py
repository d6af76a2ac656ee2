import hashlib
import re
from collections import defaultdict

import pytest

from panelyard.llm import mixing as M

from .conftest import MESSY


def brute(rows, sources, weights=(3, 1, 2), share=1.5, most=2.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    total = defaultdict(int)
    for s, n in zip(sources, size, strict=True):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * total[s]}
        for s in full or free:
            target[s] = most * total[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        free -= full
    mark = [int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, _ in rows]
    out = []
    for k, ((doc, _), s) in enumerate(zip(rows, sources, strict=True)):
        times = int(target[s] // total[s]) if total[s] else 0
        upto = sum(n for n, t, m in zip(size, sources, mark, strict=True) if t == s and m <= mark[k])
        before = sum(n for n, t, m in zip(size, sources, mark, strict=True) if t == s and m < mark[k])
        rest = target[s] - times * total[s]
        # a boundary document counts where the mix ends nearer to its target with it
        extra = bool(total[s]) and (upto <= rest or before <= rest and upto - rest < rest - before)
        out.append((doc, size[k], total[s], pytest.approx(target[s]), (times + extra) * size[k]))
    return sorted(out, key=lambda x: str(x[:3]) + str(x[4]))


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=lambda x: str(x[:3]) + str(x[4]))


def test_against_brute_force(documents):
    rows = [(i, "w " * (i * 7 % 23)) for i in range(120)] + MESSY
    sources = [None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 5}" for i in range(len(rows))]
    assert result(M.mix(documents(rows, sources))) == brute(rows, sources)
    assert result(M.mix(documents(rows, sources), weights=(1, 50))) == brute(rows, sources, weights=(1, 50))


def test_rows_come_as_often_as_taken(documents):
    rows = [(i, f"word{i} b c") for i in range(40)] + [(3, "word3 b c"), (50, None)]
    docs = documents(rows, ["x"] * 42)
    mixed = M.copies_of(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in M.mix(docs).collect()) and abs(words - 1.5 * 41 * 3) <= 6
    assert M.mix(documents([])).count() == 0 and M.copies_of(documents([])).count() == 0


def test_a_source_misses_its_target_by_half_a_document_at_most(documents):
    rows = [(i, "w " * (2000 if i % 10 == 0 else 3 + i % 5)) for i in range(400)]
    sources = [f"s{i % 7}" for i in range(400)]
    got = M.mix(documents(rows, sources)).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 and (part.taken <= 2 * part["size"]).all()
