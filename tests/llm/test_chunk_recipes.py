import hashlib
import random

from panelyard.llm import chunk_recipes as C

from .conftest import MESSY


def brute(rows):
    out = []
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    for (doc, _), text in zip(rows, low, strict=True):
        same = [d for (d, _), t in zip(rows, low, strict=True) if t == text]
        keep = max((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cuts_cover_the_text_and_follow_content():
    r = random.Random(5)
    data = bytes(r.randrange(256) for _ in range(60000))
    ends = C.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= C.LONGEST and min(sizes[:-1]) >= C.SHORTEST and len(ends) > 10
    assert b"".join(C.pieces(data)) == data and C.cuts(b"") == []
    shifted = set(C.pieces(b"new start" + data))
    assert len(shifted & set(C.pieces(data))) > 0.7 * len(ends)
    assert max(C.cuts(bytes(50000))) == 50000


def test_against_brute_force(documents):
    r = random.Random(6)
    long = " ".join(str(r.random()) for _ in range(3000))
    rows = MESSY + [(20, long), (21, long.upper()), (22, long + "x"), (23, "x" + long), (24, long), (25, "ÉA"), (26, "éa"), (27, "Éa")]
    got = C.exact_groups(documents(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)
    left = C.without_copies(documents(rows))
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(d) for d in {d for d, k, *_ in brute(rows) if d == k})
    assert C.exact_groups(documents([])).count() == 0


def test_chunks_are_sent_once(documents):
    assert C.chunk_ids(documents([(1, "aa"), (2, "bb"), (3, "AA"), (4, None)])).count() == 2
