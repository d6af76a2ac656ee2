"""Quality, toxicity and URL models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.llm import fact_machine as Q
from panelyard.llm import gru_toxicity as G
from panelyard.llm import url_filter as U

from .conftest import MESSY

VOICE = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "den", "rit", "s", "vel", "pom")]


def prose(r, n):
    return " ".join(r.choice(VOICE) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def toxic_rows():
    r = random.Random(8)
    rows = []
    for i in range(240):
        words = prose(r, r.randrange(5, 160)).split()
        if i % 3 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), r.choice(["zork", "Blarghvel", "blarghna!"]))
        rows.append((" ".join(words).encode(), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(toxic_rows):
    steps, G.STEPS = G.STEPS, 150
    try:
        return G.train(toxic_rows[:180])
    finally:
        G.STEPS = steps


def test_gradients_of_the_network():
    r = np.random.default_rng(3)
    m = {k: v.astype(np.float64) for k, v in G.new_model().items() if k not in ("word", "gram")}
    table, windows = r.standard_normal((2, 9, 3 * G.HIDDEN)), r.integers(0, 9, (3, 6))
    mask = np.ones((3, 6))
    mask[1, 4:] = 0
    # float64 copies of the loops' buffers are not needed for a comparison at this tolerance
    f = lambda mm, t: G.forward({k: v.astype(np.float32) for k, v in mm.items()}, t.astype(np.float32), windows, mask.astype(np.float32), keep=True)
    logit, state = f(m, table)
    up = np.array([1.0, -2.0, 0.5], np.float32)
    grad, dx = G.backward({k: v.astype(np.float32) for k, v in m.items()}, mask.astype(np.float32), state, up)
    flat = np.zeros_like(table)
    for d in (0, 1):
        np.add.at(flat[d], windows.ravel(), dx[d].reshape(-1, 3 * G.HIDDEN))
    for name, slot, analytic in (("u", (0, 2, 5), grad["u"][0, 2, 5]), ("u", (1, 1, 20), grad["u"][1, 1, 20]), ("v", (3,), grad["v"][3]), ("c", (9,), grad["c"][9])):
        low, high = ({k: v.copy() for k, v in m.items()} for _ in range(2))
        low[name][slot] -= 1e-2
        high[name][slot] += 1e-2
        assert (float((f(high, table)[0] - f(low, table)[0]) @ up) / 2e-2) == pytest.approx(float(analytic), abs=5e-3)
    for slot in ((0, 4, 3), (1, 2, 17)):
        low, high = table.copy(), table.copy()
        low[slot] -= 1e-2
        high[slot] += 1e-2
        assert (float((f(m, high)[0] - f(m, low)[0]) @ up) / 2e-2) == pytest.approx(float(flat[slot]), abs=5e-3)


def test_toxicity_on_held_out_texts(toxic_rows, toxic_model):
    scores = G.Scorer(toxic_model)([t for t, _ in toxic_rows[180:]])
    right = sum((s >= 0.3) == bool(y) for s, (_, y) in zip(scores, toxic_rows[180:], strict=True))
    assert right >= 55
    alone = [G.Scorer(toxic_model)([t])[0] for t, _ in toxic_rows[180:190]]
    assert np.allclose(alone, scores[:10], atol=1e-4)


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        at = G.starts(n)
        assert {i for s in at for i in range(s, s + G.WINDOW)} >= set(range(n)) and all(b - a <= G.STRIDE for a, b in zip(at, at[1:], strict=False))


def test_toxicity_of_messy_rows(spark, messy, toxic_model):
    scored = G.score(messy, toxic_model).collect()
    assert len(scored) == len(MESSY) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    left = G.without_toxic(messy, toxic_model, 2.0)
    assert left.columns == messy.columns and left.count() == len(MESSY) and G.without_toxic(messy, toxic_model, 0.0).count() == 0
    assert G.score(messy.where("false"), toxic_model).count() == 0


def test_without_labels_all_get_the_share(spark, messy):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    one = spark.createDataFrame([(1, 1, 1), (4, 1, 1), (5, None, None), (6, 0, 0), (6, 1, 1)], "doc_id bigint, toxic int, quality int")
    assert {r.score for r in G.score(messy, G.train(G.sample(messy, none))).collect()} == {0.0}
    assert {r.score for r in G.score(messy, G.train(G.sample(messy, one))).collect()} == {1.0}
    assert {r.score for r in Q.score(messy, Q.train(Q.sample(messy, none))).collect()} == {0.0}
    assert {r.score for r in Q.score(messy, Q.train(Q.sample(messy, one))).collect()} == {1.0}


def test_quality_on_held_out_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(Q, "EPOCHS", 3)
    r = random.Random(9)
    junk = [lambda: " | ".join(prose(r, 1) for _ in range(30)), lambda: prose(r, 1) * 40, lambda: (prose(r, 30) + " ").upper().replace(" ", "!! ")]
    rows = [(i, prose(r, r.randrange(10, 80)) if i % 2 else r.choice(junk)()) for i in range(200)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    model = Q.train(Q.sample(docs, labels))
    held = [x for x in Q.score(docs, model).collect() if x.doc_id >= 120]
    assert sum((x.score >= 0.5) == (x.doc_id % 2 == 1) for x in held) >= 76
    wild = Q.score(documents(MESSY), model).collect()
    assert len(wild) == len(MESSY) and all(0 <= x.score <= 1 for x in wild)
    assert Q.score(documents([]), model).count() == 0
    assert Q.score(docs.drop("n_chars"), model).count() == 200


def test_pairwise_sum_identity():
    r = np.random.default_rng(1)
    m = {"bias": 0.3, "w": r.standard_normal(30), "v": r.standard_normal((30, 4))}
    rows, cols, x = np.repeat([0, 1], [5, 7]), r.permutation(30)[:12], r.standard_normal(12)
    got = Q.logits(m, rows, cols, x, 2)[0]
    for k in (0, 1):
        c, v = cols[rows == k], x[rows == k]
        want = 0.3 + m["w"][c] @ v + sum(m["v"][c[i]] @ m["v"][c[j]] * v[i] * v[j] for i in range(len(c)) for j in range(i))
        assert got[k] == pytest.approx(want)


URLS = [("http://a.com/x", "a.com", "/x", "com/", "allow"), ("HTTPS://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"), ("http://example.com/de", "example.com", "/de", "com/", "allow"),
        ("http://notexample.net/es/x", "notexample.net", "/es/x", "net/es/", "block"), ("http://x.net/essay", "x.net", "/essay", None, None),
        ("http://x.com", "x.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://h?x://y/z", "h", "", None, None), ("", "", "", None, None), ("http://ÄB.net/fr/é", "Äb.net", "/fr/é", "net/fr/", "block")]


def test_url_parts_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "host", 1.0) for i, u in enumerate(URLS)] + [(None, URLS[0][0], "h", "host", 1.0)],
                                  "page_id bigint, url string, html string, host string, probability double")
    out = U.judge(pages)
    rows = {r.page_id: r for r in out.collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or ("block" if rows[i].score >= 0.5 else "allow"))
    assert len(rows) == len(URLS) + 1 and U.judge(pages.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_model_learns_its_table(spark):
    model = U.fit(U.labelled_table(spark))
    rows = U.labelled_table(spark).select(U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"), "label")
    scored = model.transform(U.features(rows)).select("label", "prediction").collect()
    assert sum(r.label == r.prediction for r in scored) == len(scored) == len(U.LABELLED)
    unseen = [("http://other.example.org/casino/free-spins", 1), ("http://other.example.org/en/article-99.html", 0)]
    rows = U.labelled_table(spark, unseen).select(U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"), "label")
    assert all(r.label == r.prediction for r in model.transform(U.features(rows)).collect())


def test_rules_alone_agree_with_the_judge(spark):
    urls = ["https://a.example.com/en/x", "http://www.example.com/en/?q", "https://b.net/fr/a#b", "ftp://x.com", "no scheme", None, "https://EXAMPLE.com/EN/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in U.judge(pages).collect()}
    got = {r["page_id"]: r for r in U.ruled(pages).collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == want
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow" and got[5]["verdict"] is None
