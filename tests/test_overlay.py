"""Models on a seeded panel: invariants, and the logistic fit against its own optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.plans import overlay

FEATURES = ["UNINSURED_SHARE", "CORE_DEPOSIT_SHARE", "TD_WAM_PROXY"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    rows = []
    for q in range(8):
        day = f"{2022 + q // 4}-{('03-31', '06-30', '09-30', '12-31')[q % 4]}"
        for c in range(30):
            u, k, w = rng.random(), rng.random(), rng.random()
            label = None if q == 7 else int(rng.random() < 1 / (1 + np.exp(-(4 * u - 2 * k - w - 1.0))))
            rows.append((str(c), day, float(u) if c % 7 else None, float(k), float(w), label, 100.0 + 10 * float(rng.random())))
    return spark.createDataFrame(rows, "CERT string, REPDTE string, UNINSURED_SHARE double, CORE_DEPOSIT_SHARE double, "
                                 "TD_WAM_PROXY double, y int, DEPDOM double").withColumn("REPDTE", F.col("REPDTE").cast("date"))


def test_logistic_reaches_the_penalised_optimum(panel):
    scored, fitted = overlay.full_sample_fit(panel, FEATURES, "y", "logistic")
    pdf = panel.toPandas()
    known = pdf[pdf.y.notna()]
    X = known[FEATURES].fillna(known[FEATURES].median())
    Z = ((X - X.mean()) / X.std(ddof=0)).to_numpy()
    y = known.y.to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = fitted.model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(Z @ w + fitted.model.intercept)))
    gradient = w + Z.T @ (weight * (p - y))  # of 0.5 |w|^2 + weighted log loss
    assert np.abs(gradient).max() < 1e-2
    assert scored.count() == len(pdf)
    got = scored.toPandas()[overlay.SCORE]
    assert got.between(0, 1).all()


def test_signs_are_kept(panel):
    _, fitted = overlay.full_sample_fit(panel, FEATURES, "y", "signed")
    weights = dict(zip(FEATURES, fitted.model.coefficients.toArray(), strict=True))
    assert weights["UNINSURED_SHARE"] >= 0 and weights["TD_WAM_PROXY"] <= 0
    names = [n for n, _ in fitted.importances()]
    assert sorted(names) == sorted(FEATURES)


def test_trees(panel):
    scored, fitted = overlay.full_sample_fit(panel, FEATURES, "y", "trees", trees=3)
    assert fitted.importances()[0][1] > 0 and scored.filter(F.col(overlay.SCORE).isNull()).count() == 0


def test_walk_forward_gates(panel):
    scored, last = overlay.walk_forward(panel, FEATURES, "y", min_quarters=4, min_events=5)
    got = {str(r["REPDTE"]): (r["n"], r["q"]) for r in scored.groupBy("REPDTE").agg(
        F.count(overlay.SCORE).alias("n"), F.max("SUPERVISED_TRAIN_QUARTERS").alias("q")).collect()}
    assert got["2022-12-31"] == (0, None) and got["2023-03-31"] == (30, 4) and got["2023-12-31"] == (30, 7)
    assert scored.count() == 240 and last is not None
    assert 0.5 < scored.first()["SUPERVISED_OOT_AUC_MEAN"] <= 1.0


def test_too_small_or_one_class(panel):
    few = panel.filter(F.col("CERT") == "1")
    assert overlay.full_sample_fit(few, FEATURES, "y")[1] is None
    assert overlay.full_sample_fit(panel.withColumn("y", F.lit(0)), FEATURES, "y")[1] is None


def test_overlay_end_to_end(panel):
    out = overlay.supervised_overlay(panel.drop("y"), percentile=20.0, walk=False, kind="logistic")
    row = out.filter(F.col(overlay.SCORE).isNotNull()).first()
    assert 0 <= row["SUPERVISED_RISK_SCORE"] <= 100 and row["SUPERVISED_MODEL_TYPE"] == "logistic"
    assert out.count() == 240
    thin = overlay.supervised_overlay(panel.select("CERT", "REPDTE", "DEPDOM"), walk=False)
    assert thin.first()["SUPERVISED_RISK_SCORE"] is None


@pytest.mark.parametrize("kind", ["logistic", "signed"])
def test_constant_features_stay_out_of_the_fit(panel, kind):
    wide = panel.withColumn("HAS_IR_DERIVATIVES", F.lit(0.1)).withColumn("LOAN_WAM_PROXY", F.lit(None).cast("double"))
    scored, fitted = overlay.full_sample_fit(wide, [*FEATURES, "HAS_IR_DERIVATIVES", "LOAN_WAM_PROXY"], "y", kind)
    _, same = overlay.full_sample_fit(panel, FEATURES, "y", kind)
    assert fitted.features == FEATURES and np.allclose(fitted.model.coefficients.toArray(), same.model.coefficients.toArray(), atol=1e-6)
    assert scored.filter(F.col(overlay.SCORE).isNull()).count() == 0
    assert overlay.full_sample_fit(wide, ["HAS_IR_DERIVATIVES"], "y", kind)[1] is None


def test_walk_forward_with_a_feature_constant_in_early_windows(panel):
    late = panel.withColumn("HAS_IR_DERIVATIVES", F.when(F.col("REPDTE") > "2023-04-01", F.crc32("CERT") % 2).otherwise(0).cast("double"))
    scored, last = overlay.walk_forward(late, [*FEATURES, "HAS_IR_DERIVATIVES"], "y", "signed", min_quarters=4, min_events=5)
    got = {str(r["REPDTE"]): r["n"] for r in scored.groupBy("REPDTE").agg(F.count(overlay.SCORE).alias("n")).collect()}
    assert got["2023-03-31"] == 30 and got["2023-12-31"] == 30 and "HAS_IR_DERIVATIVES" in last.features


def test_window_statistics_equal_each_window_by_itself(panel):
    """Merged statistics against numpy on the rows of each window; dates without a fit are absent."""
    odd = panel.withColumn("EMPTY", F.lit(None).cast("double"))
    names = [*FEATURES, "EMPTY"]
    got = {(str(r["REPDTE"]), r["FEATURE"]): r for r in overlay.window_table(odd, names, "y", 3, 10).collect()}
    pdf = panel.toPandas().assign(EMPTY=np.nan)
    days = sorted(pdf.REPDTE.astype(str).unique())
    assert {d for d, _ in got} == set(days[3:])
    for (day, name), r in got.items():
        rows = pdf[(pdf.REPDTE.astype(str) < day) & pdf.y.notna()]
        middle = rows[name].median() if rows[name].notna().any() else 0.0
        filled = rows[name].fillna(middle)
        assert (r["N_ROWS"], r["N_EVENTS"], r["TRAIN_QUARTERS"]) == (len(rows), rows.y.sum(), days.index(day))
        assert np.allclose([r["MEDIAN"], r["CENTRE"], r["SPREAD"]], [middle, filled.mean(), filled.std(ddof=0)])
        assert r["VARIES"] == (name != "EMPTY")


def test_windows_of_no_rows_and_null_dates(panel):
    assert overlay.window_table(panel.limit(0), FEATURES, "y").count() == 0
    scored, last = overlay.walk_forward(panel.limit(0), FEATURES, "y")
    assert scored.count() == 0 and last is None
    undated = panel.unionByName(panel.limit(3).withColumn("REPDTE", F.lit(None).cast("date")))
    scored, _ = overlay.walk_forward(undated, FEATURES, "y", min_events=5)
    assert scored.count() == 243 and scored.filter("REPDTE IS NULL").select(F.max(overlay.SCORE)).first()[0] is None


def test_linear_scores_equal_the_models(panel):
    """The one plan over all quarters gives what the fitted model gives."""
    scored, last = overlay.walk_forward(panel, FEATURES, "y", kind="signed", min_quarters=7, min_events=5)
    final = scored.filter(F.col("REPDTE") == "2023-12-31")
    both = last.score(final.drop(overlay.SCORE)).select("CERT", F.col(overlay.SCORE).alias("again")).join(final, "CERT").toPandas()
    assert len(both) == 30 and np.allclose(both["again"], both[overlay.SCORE], atol=1e-12)


@pytest.mark.parametrize("kind", ["logistic", "signed"])
def test_certificate(panel, kind):
    # a label that rises with TD_WAM_PROXY, whose weight may not be positive: the bound holds it at zero
    turned = panel.withColumn("y", F.when(F.col("y").isNotNull(), (F.col("TD_WAM_PROXY") + F.crc32("CERT") % 7 / 20.0 > 0.6).cast("int")))
    rows = {r["FEATURE"]: r for r in overlay.fit_certificate(turned, FEATURES, "y", kind).collect()}
    assert set(rows) == {"(intercept)", *FEATURES}
    assert all(abs(r["RESIDUAL"]) < 1e-4 and r["SIGN_KEPT"] for r in rows.values())
    assert overlay.fit_certificate(turned.filter("CERT = '1'"), FEATURES, "y", kind).count() == 0


def test_certificate_tells_a_wrong_fit(panel, monkeypatch):
    monkeypatch.setattr(overlay, "MAX_ITERATIONS", 1)
    assert max(abs(r["RESIDUAL"]) for r in overlay.fit_certificate(panel, FEATURES, "y").collect()) > 1e-3
