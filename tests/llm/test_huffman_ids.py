import gc
import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelyard.llm import huffman_ids as H
from panelyard.llm.queries import tokenizer_path
from panelyard.session import scratch_path

from .conftest import MESSY


def cost_of_huffman(counts):
    heap = sorted(c for c in counts if c)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_lengths_are_optimal_and_limited():
    r = np.random.default_rng(1)
    for size in (2, 3, 10, 300):
        counts = (r.pareto(1.0, size) * 10).astype(np.int64)
        counts[0] = 5
        lengths = H.code_lengths(counts, 16)
        used = counts > 0
        assert (lengths[used] > 0).all() and (lengths[~used] == 0).all()
        if used.sum() > 1:
            assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
            if lengths.max() < 16:
                assert int((counts * lengths).sum()) == cost_of_huffman(counts.tolist())
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = H.code_lengths(np.array(fibonacci), 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(x) for x in lengths) == 1.0
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(300, np.int64), 8)


def test_codes_are_canonical_and_blocks_round_trip():
    r = np.random.default_rng(2)
    ids = r.zipf(1.3, 5000) % 400
    lengths = H.code_lengths(np.bincount(ids, minlength=400))
    codes = H.canonical(lengths)
    words = sorted(format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    for n in (1, 63, 64, 65, 5000):
        bits, data, offsets = H.pack(ids[:n].astype("<u2"), lengths, codes)
        assert len(data) == (bits + 7) // 8 and len(offsets) == 4 * -(-n // H.EVERY)
        assert (H.unpack(data, offsets, n, H.decoding_table(lengths)) == ids[:n]).all()
    one = H.code_lengths(np.array([0, 7]))
    bits, data, offsets = H.pack(np.ones(70, "<u2"), one, H.canonical(one))
    assert bits == 70 and (H.unpack(data, offsets, 70, H.decoding_table(one)) == 1).all()


@pytest.mark.parametrize("blocks", [H.BLOCK_TOKENS, 50])
def test_files_hold_every_text(spark, messy, monkeypatch, blocks):
    monkeypatch.setattr(H, "BLOCK_TOKENS", blocks)
    path = scratch_path(spark, "ids")
    H.write_ids(messy, path, tokenizer_path(), end_id=2)
    rows = sorted(H.read_ids(spark, path).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted(((i is not None, i or 0), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in MESSY)
    got = [((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in rows]
    assert sorted(got) == want and [g[0] for g in got] == [w[0] for w in want]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens


def test_empty_table_and_other_vocabulary(spark, documents):
    import public_tokenizers

    path = scratch_path(spark, "ids")
    H.write_ids(documents([]), path, tokenizer_path())
    assert H.read_ids(spark, path).count() == 0
    path, name = scratch_path(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json")
    H.write_ids(documents([(1, "Two  Words"), (2, "x")]), path, name, end_id=50256)
    tokenizer = Tokenizer.from_file(name)
    assert {r.doc_id: list(r.ids) for r in H.read_ids(spark, path).collect()} == {
        i: [*tokenizer.encode(t).ids, 50256] for i, t in ((1, "Two  Words"), (2, "x"))}


def test_a_worker_reads_a_vocabulary_once(monkeypatch):
    monkeypatch.setattr(H, "_ENCODERS", {})
    made = []
    monkeypatch.setattr(H, "Encoder", lambda *given: made.append(given) or object())
    assert H.encoder("a", 2) is H.encoder("a", 2) and H.encoder("a", 3) is not H.encoder("a", 2)
    assert made == [("a", 2), ("a", 3)]


def test_kept_places_grow_by_a_quarter():
    kept = H.Kept()
    for i in range(100):
        kept.add([b"%d" % i], np.array([3]), np.arange(3 * i, 3 * i + 3))
    assert len(kept.ids) <= 1.3 * 300 and kept.begin.dtype == kept.sizes.dtype == np.int32
    assert kept.begin[:100].tolist() == list(range(0, 300, 3)) and kept.ids[:300].tolist() == list(range(300))


def test_new_words_are_learnt_without_collections():
    """Collections walk through all words of a slice; they are on again afterwards."""
    encode, seen = H.Encoder(tokenizer_path(), 2), []
    texts = [" ".join(f"W{i}x{k}" for k in range(100)).encode() for i in range(200)]
    started = lambda phase, info: seen.append(phase)
    learn, encode.kept = encode.learn, H.Kept()

    def counted(new):
        gc.callbacks.append(started)
        try:
            learn(new)
        finally:
            gc.callbacks.remove(started)

    encode.learn = counted
    got = encode(texts)
    assert not seen and gc.isenabled()
    assert [x.tolist() for x in got[:20]] == [[*encode.tokenizer.encode(t.decode(), add_special_tokens=False).ids, 2] for t in texts[:20]]


def test_recurring_words_outlive_a_full_cache(monkeypatch):
    """Rare words make room; a word that came again is not learnt anew, and ids stay those of the tokenizer."""
    monkeypatch.setattr(H, "CACHED", 60)
    encode = H.Encoder(tokenizer_path(), 2)
    learn, encode.kept, learnt = encode.learn, H.Kept(), []
    monkeypatch.setattr(encode, "learn", lambda new: (learnt.extend(new), learn(new)))
    plain = Tokenizer.from_file(tokenizer_path())
    for n in range(20):
        text = "always here, word " + " ".join(f"rare{n}x{i}" for i in range(15))
        assert encode([text.encode()])[0].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert len(encode.kept.place) <= 60
    assert learnt.count(b"always") == learnt.count(b"word") == 1
    many = " ".join(f"many{i}" for i in range(200))
    assert encode([many.encode()])[0].tolist() == [*plain.encode(many, add_special_tokens=False).ids, 2]
