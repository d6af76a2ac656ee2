"""Ranks, quantiles and AUC against brute force, in both forms and with one hot group."""

import random

import numpy as np
import pandas as pd
import pytest

from panelyard.operators import ordered
from panelyard.operators.ordered import Rank, add_ranks, exact_quantiles, ranked_metrics


def sample(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}"
        value = None if rng.random() < 0.1 else 7.0 if rng.random() < 0.33 else round(rng.gauss(0, 50), 1)
        rows.append((i, group, value, rng.choice([0, 1, None]) if rng.random() < 0.2 else int(rng.random() < 0.1), rng.randrange(2)))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = sample()
    return spark.createDataFrame(rows, "id long, g string, v double, y int, seen int"), pd.DataFrame(
        rows, columns=["id", "g", "v", "y", "seen"])


def test_ranks(data):
    df, pdf = data
    ranks = [Rank("v", "pct", fill=0.5), Rank("v", "flip", flip=True, scale=100.0, fill=0.5), Rank("v", "place", "competition"),
             Rank("v", "up", "ascending"), Rank("v", "most", "at_most"), Rank("absent", "none", fill=0.5)]
    got = add_ranks(df, ["g"], ranks, ["id"], slices=16).toPandas().set_index("id").sort_index()
    assert len(got) == len(pdf)
    by = pdf.groupby("g")["v"]
    pct = by.rank(pct=True)
    assert np.allclose(got["pct"], pct.fillna(0.5))
    assert np.allclose(got["flip"], 100 * (1 - pct).fillna(0.5))
    assert np.allclose(got["place"].astype(float), by.rank(ascending=False, method="min"), equal_nan=True)
    assert np.allclose(got["up"].astype(float), by.rank(method="min"), equal_nan=True)
    assert np.allclose(got["most"].astype(float), by.rank(method="max"), equal_nan=True)
    assert (got["none"] == 0.5).all()


def test_quantiles(data):
    df, pdf = data
    got = exact_quantiles(df, ["g"], ["v"], [0.05, 0.5, 0.9], slices=16).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.05, 0.5, 0.9]).unstack()
    for name, share in (("q0", 0.05), ("q1", 0.5), ("q2", 0.9)):
        assert np.allclose(got[name].sort_index(), want[share].sort_index())


def brute_auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]))


def test_metrics(data):
    df, pdf = data
    got = ranked_metrics(df, ["g"], "v", {"h": ("y", "seen")}, [5, 10, 20], slices=16).toPandas().set_index("g")
    for group, rows in pdf[(pdf.seen == 1) & pdf.y.notna() & pdf.v.notna()].groupby("g"):
        label, score = rows.y.to_numpy(), rows.v.to_numpy()
        assert got.loc[group, "AUC"] == pytest.approx(brute_auc(score, label))
        assert got.loc[group, "N_TOTAL"] == len(rows)
        for k in (5, 10, 20):
            flagged = score >= np.percentile(score, 100 - k)
            assert got.loc[group, f"PRECISION_AT_{k}PCT"] == pytest.approx(label[flagged].mean())
            assert got.loc[group, f"RECALL_AT_{k}PCT"] == pytest.approx(label[flagged].sum() / label.sum())


def test_small_metrics(frame):
    df = frame("g string, s double, y int, seen int", [("a", 90.0, 1, 1), ("a", 85.0, 1, 1), ("a", 20.0, 0, 1), ("a", 10.0, None, 0),
                                                     ("b", 1.0, 0, 1), ("b", 2.0, 0, 1)])
    got = {r["g"]: r for r in ranked_metrics(df, ["g"], "s", {"h": ("y", "seen")}, [20]).collect()}
    assert got["a"]["AUC"] == 1.0 and got["a"]["N_FAILURES"] == 2 and got["a"]["N_TOTAL"] == 3
    assert got["b"]["AUC"] is None and got["b"]["N_FAILURES"] == 0 and got["b"]["N_TOTAL"] == 2


def test_values_are_carried_over_slices(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), None if rng.random() < 0.9 or t < 40 else int(t)) for t in rng.permutation(500)]
    got = {r["t"]: r["v"] for r in ordered.carried_forward(spark.createDataFrame(rows, "t int, v int").repartition(6), ["t"], "v").collect()}
    last = None
    for t, v in sorted(rows):
        last = v if v is not None else last
        assert got[t] == last
    none = spark.createDataFrame([(1, None), (2, None)], "t int, v int")
    assert [r["v"] for r in ordered.carried_forward(none, ["t"], "v").collect()] == [None, None]
    assert ordered.carried_forward(none.limit(0), ["t"], "v").count() == 0


def test_lags_over_slices(spark):
    rows = [(3 * t, float(t)) for t in range(200)]
    got = {r["t"]: (r["x__lag1"], r["x__lag4"]) for r in ordered.lagged_rows(spark.createDataFrame(rows, "t int, x double").repartition(5), ["t"], ["x"], [1, 4]).collect()}
    assert got == {3 * t: (float(t - 1) if t else None, float(t - 4) if t >= 4 else None) for t in range(200)}


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_ranks_of_a_value_that_fills_many_slices(spark, slices):
    """One value in most rows, one group of equal values only, negative zero, infinite and null values and groups."""
    rows = [(i, "hot", 5.0 if i % 10 else float(i)) for i in range(600)] + [(600 + i, "flat", -1.0) for i in range(200)]
    rows += [(800, "zero", 0.0), (801, "zero", -0.0), (802, "zero", float("inf")), (803, "zero", None), (804, None, 1.0), (805, "one", 3.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    ranks = [Rank("v", "pct"), Rank("v", "place", "competition"), Rank("v", "most", "at_most")]
    got = add_ranks(df, ["g"], ranks, ["id"], slices=slices).toPandas().set_index("id").sort_index()
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"]).set_index("id")
    by = pdf.groupby("g")["v"]
    assert len(got) == len(pdf)
    assert np.allclose(got["pct"].astype(float), by.rank(pct=True), equal_nan=True)
    assert np.allclose(got["place"].astype(float), by.rank(ascending=False, method="min"), equal_nan=True)
    assert np.allclose(got["most"].astype(float), by.rank(method="max"), equal_nan=True)


def test_rank_slices_hold_a_hot_value_in_parts(spark, monkeypatch):
    """Equal values are dealt over the slices: none holds more than its share."""
    written = []
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: written.append(df.cache()) or df)
    df = spark.range(4000).selectExpr("id", "'g' AS g", "CAST(7 AS DOUBLE) AS v")
    got = add_ranks(df, ["g"], [Rank("v", "pct")], ["id"], slices=8)
    assert got.filter("abs(pct - 4001 / 8000.0) < 1e-12").count() == 4000
    sizes = [r["count"] for r in written[-1].groupBy("__slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert all("id" in w.columns and len(w.columns) <= 5 for w in written)


def test_ranks_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, g string, v double")
    assert add_ranks(df, ["g"], [Rank("v", "pct")], ["id"]).count() == 0


def test_ranks_by_entity_leave_a_frame_in_place(frame):
    """Ranks joined on the entity equal those joined on all keys, and the frame is not dealt out by the date as well."""
    days = [f"20{y:02d}-{m}" for y in range(4) for m in ("03-31", "06-30")]
    rows = [(str(i % 7), day, float((i * 5) % 4) if i % 6 else None) for i in range(21) for day in days]
    rows = list({(c, d): (c, d, v) for c, d, v in rows}.values())
    df = frame("CERT string, REPDTE date, v double", rows)
    ranks = [Rank("v", "pct", fill=0.5, scale=100.0), Rank("v", "place", "competition"), Rank("none", "gone", fill=0.25)]
    keys = ["CERT", "REPDTE"]
    plain = {(r["CERT"], r["REPDTE"]): r for r in add_ranks(df, ["REPDTE"], ranks, keys, slices=5).collect()}
    got = add_ranks(df.repartition("CERT"), ["REPDTE"], ranks, keys, slices=5, entity=True)
    assert {(r["CERT"], r["REPDTE"]): r for r in got.collect()} == plain
    assert "hashpartitioning(CERT" in (text := got._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(coalesce(CERT" not in text and "REPDTE" not in "".join(x for x in text.splitlines() if "hashpartitioning" in x)


def test_ranks_are_dealt_to_as_many_tasks_as_slices(frame):
    """Few bytes of many rows are not put into one task; NULL keys meet, and of a key that comes again the highest place counts."""
    df = frame("id int, g string, v double", [*[(i, "a", float(i % 5)) for i in range(40)], (None, "a", 9.0), (7, "a", 8.0)])
    got = add_ranks(df, ["g"], [Rank("v", "place", "ascending")], ["id"], slices=9)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(__row") == 2 and "hashpartitioning(__row#" in text and "coalesce(id" not in text
    rows = got.collect()
    assert len(rows) == 42 and {r["place"] for r in rows if r["id"] is None} == {42}
    assert [r["place"] for r in rows if r["id"] == 7] == [41, 41]
