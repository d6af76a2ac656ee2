import hashlib
import random
import re

import numpy as np
import pytest

from panelyard.llm import wu_manber as W

from .conftest import MESSY

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            b = split(body)
            m = min(window, len(b))
            grams = {tuple(b[i:i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(words) - m + 1 if m else 0):
                if tuple(words[i:i + m]) in grams:
                    found.add(str(item))
                    hit.update(range(i, i + m))
        ids = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def test_against_brute_force(spark, documents, monkeypatch):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["a", "b", "cc", "É", "7", "Word"]) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(60)] + MESSY
    items = [(i, text(r.choice([0, 1, 2, 4, 9, 14, 20]))) for i in range(6, 12)] + [(11, text(15)), (12, None), (13, "..."), (10, "x-y, z")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    # 10 words: many shards, items in pieces, rows written between passes; then blocks of three and four words
    for size, grows in ((W.SHARD_WORDS, W.BLOCK_GROWS), (10, W.BLOCK_GROWS), (W.SHARD_WORDS, (0, 3))):
        monkeypatch.setattr(W, "SHARD_WORDS", size)
        monkeypatch.setattr(W, "BLOCK_GROWS", grows)
        for window in (13, 5):
            got = W.contamination(documents(docs), benchmark, window=window).drop("items", "spans").collect()
            assert sorted((tuple(x) for x in got), key=str) == brute(docs, items, window)


def test_rows_that_stay_keep_their_columns(spark, documents):
    docs = documents([(1, "one two three four five six"), (1, "clean text"), (None, "one two three four five six"), (2, None)])
    benchmark = spark.createDataFrame([(1, "One, two three four five SIX")], "item_id bigint, text string")
    left = W.decontaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == ["", "clean text"]
    assert W.contamination(documents([]), benchmark).count() == 0
    assert W.decontaminated(docs, benchmark.where("false")).count() == 4


class Counted(bytes):
    """A shift table that counts how often it is looked at."""

    looked = 0

    def __getitem__(self, at):
        self.looked += 1
        return super().__getitem__(at)


@pytest.mark.parametrize("size", [2_000, 20_000, 100_000, 200_000])
def test_jumps_stay_long_with_many_patterns(size):
    """Words as frequent as in natural text: few positions of a text are looked at, and planted passages are found."""
    r = np.random.default_rng(size)
    drawn = lambda n: [b"w%d" % i for i in np.minimum(r.zipf(1.2, n), 60_000)]
    items = [(str(i), drawn(100)) for i in range(size // 100)]
    text = drawn(20_000) + items[3][1][10:30] + drawn(50)
    (table,) = W.build(items).ready()
    table.shift = Counted(table.shift)
    found = {(start, item) for start, of in table.search(text) for item in of}
    assert {(20_000 + i, "3") for i in range(8)} <= found
    assert table.shift.looked < 0.3 * len(text)


def test_equal_windows_are_one_pattern():
    (table,) = W.build([(str(i), [b"a", b"b", b"c"] * 5) for i in range(50)]).ready()
    assert len(table.starts) == 3 and all(len(o) == 50 for o in table.owners)
