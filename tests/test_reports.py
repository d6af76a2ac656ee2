"""Back-test labels, checks, reports and published records."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import by
from panelyard import config as cfg
from panelyard.plans import backtest, checks, publish, reports, stress


def test_failure_labels(frame):
    rows = [(c, d, 1.0) for c in ("1", "2") for d in ("2022-06-30", "2022-09-30")]
    failures = frame("CERT double, FAILDATE string", [(1.0, "3/10/2023"), (1.0, "2010-01-01")])
    got = by(backtest.failure_labels(frame("CERT string, REPDTE date, S double", rows), failures), "CERT", "REPDTE")
    near, far = got["1", "2022-09-30"], got["1", "2022-06-30"]
    assert (near["QUARTERS_TO_FAILURE"], near["FAIL_WITHIN_1Q"], near["FAIL_WITHIN_2Q"]) == (2, 0, 1)
    assert (far["FAIL_WITHIN_2Q"], far["FAIL_WITHIN_4Q"]) == (0, 1)
    assert got["2", "2022-09-30"]["FAIL_WITHIN_4Q"] == 0


def test_unobserved_future_has_no_label(frame):
    rows = frame("CERT string, REPDTE date, S double", [("1", "2024-09-30", 1.0), ("2", "2024-09-30", 1.0)])
    failures = frame("CERT double, FAILDATE string", [(1.0, "2025-01-20")])
    got = by(backtest.failure_labels(rows, failures), "CERT")["1"]
    assert (got["FORWARD_OBSERVED_2Q"], got["FAIL_WITHIN_2Q"], got["FORWARD_OBSERVED_1Q"], got["FAIL_WITHIN_1Q"]) == (0, None, 1, 0)


def test_metric_grid_is_whole(frame):
    rows = [(str(i), "2023-03-31", float(i)) for i in range(20)]
    df = frame("CERT string, REPDTE date, RUN_RISK_INDEX double", rows)
    failures = frame("CERT double, FAILDATE string", [(19.0, "2023-05-01"), (18.0, "2023-05-01")])
    got = backtest.metrics_table(backtest.failure_labels(df, failures)).collect()
    assert len(got) == 4 * 3
    cells = {(r["SLICE"], r["HORIZON_QUARTERS"]): r for r in got}
    assert cells["full_sample", 1]["AUC"] == 1.0 and cells["banking_2023", 4]["N_FAILURES"] == 2
    assert cells["gfc_2008", 1]["N_TOTAL"] == 0 and cells["gfc_2008", 1]["AUC"] is None
    assert cells["full_sample", 1]["RECALL_AT_10PCT"] == 1.0


@pytest.mark.parametrize("columns, row, codes", [
    ("COREDEP double, DEPDOM double", (5.0, 4.0), ["COREDEP_GT_DEPDOM"]),
    ("SCPLEDGE double, SC double", (5.0, 4.0), ["SCPLEDGE_GT_SC"]),
    ("DEPDOM double, DEP double", (-1.0, -2.0), ["NEGATIVE_DEPOSIT", "NEGATIVE_DEPOSIT"]),
    ("UNINSURED_SHARE double, BROKERED_SHARE double", (1.5, -0.1), ["SHARE_GT_1", "SHARE_NEGATIVE"]),
    ("TREASURY_TO_UNINSURED double", (-0.5,), ["NEGATIVE_COVERAGE"]),
    ("SCNM3LES double, SCNM1T3 double, SCRDEBT double", (80.0, 50.0, 100.0), ["SEC_BUCKET_SUM_EXCEEDS_TOTAL"]),
    ("OTBFH1L double, OTBFHOV5 double, OTHBFHLB double", (10.0, 20.0, 100.0), ["FHLB_BUCKET_SUM_MISMATCH"]),
    ("OTBFH1L double, OTBFHOV5 double, OTHBFHLB double", (50.0, 45.0, 100.0), []),
    ("SOD_TOTAL_DEPOSITS double, SOD_DEPOSIT_HHI_STATE double", (0.0, 1.2), ["SOD_HHI_OUT_OF_RANGE", "SOD_NONPOSITIVE_DEPOSITS"]),
    ("OTHER double", (1.0,), [])])
def test_checks(frame, columns, row, codes):
    df = frame(f"CERT string, REPDTE date, {columns}", [("1", "2024-03-31", *row)])
    found = checks.run_checks(df)
    assert found.columns == ["CERT", "REPDTE", "CHECK", "DETAIL"]
    assert sorted(r["CHECK"] for r in found.collect()) == codes


def test_holder_change_needs_both_ids(frame):
    df = frame("CERT string, REPDTE date, RSSDHCR long", [("1", "2023-12-31", 5), ("1", "2024-03-31", 6), ("1", "2024-06-30", None),
                                                        ("1", "2024-09-30", 7), ("2", "2024-03-31", 9)])
    assert [str(r["REPDTE"]) for r in checks.run_checks(df).collect()] == ["2024-03-31"]


def test_custom_checks(frame):
    df = frame("CERT string, REPDTE date, X double", [("1", "2024-03-31", 5.0)])
    found = checks.run_checks(df, [lambda d: [(F.col("X") > 1, "BIG", "X > 1")]]).collect()
    assert [(r["CHECK"], r["DETAIL"]) for r in found] == [("BIG", "X > 1")]


INDEX = ("CERT string, REPDTE date, NAMEFULL string, PEER_GROUP string, ASSET double, DEPDOM double, RUN_RISK_INDEX double, "
         "ALM_MISMATCH_INDEX double, TREASURY_BUFFER_INDEX double, FUNDING_FRAGILITY_INDEX double, RUN_RISK_SCORE double, "
         "UNINSURED_SHARE double, DEPOSIT_WAL_BASELINE double, YC_10Y_3M_SLOPE_BP double, TREASURY_YIELD_DATE date, "
         "RANK_UNINSURED_SHARE double, ALM_MISMATCH_INDEX_CONTRIB_LOANS_TO_CORE_DEPOSITS double, HAS_FFIEC_FEATURES int, "
         "DURATION_GAP_LITE double")


@pytest.fixture
def mart(frame):
    return frame(INDEX, [
        ("1", "2023-12-31", "One", "community", 1.0, 9.0, 10.0, 20.0, 30.0, 26.0, 5.0, 0.1, 3.0, None, None, 0.5, 1.0, 0, None),
        ("1", "2024-03-31", "One", "community", 1.0, 9.0, 50.0, 60.0, 40.0, 56.0, 6.0, 0.2, 3.0, -40.0, "2024-03-28", 1.0, 2.0, 1, 2.0),
        ("2", "2024-03-31", "Two", "regional", 2.0, 8.0, 70.0, None, 40.0, None, 9.0, 0.4, 2.0, -40.0, "2024-03-28", 0.5, None, 1, 1.0),
        ("3", "2024-03-31", "Tri", "regional", 2.0, 8.0, 70.0, 80.0, 10.0, 78.0, 9.0, 0.3, 2.0, -40.0, "2024-03-28", None, None, 0, None)])


def test_league_and_scenarios(mart):
    rows = reports.league_table(mart, "2024-03-31").collect()
    assert [(r["CERT"], r["FRAGILITY_RANK"]) for r in rows] == [("3", 1), ("1", 2), ("2", None)]
    assert [r["CERT"] for r in reports.scenario_comparison(mart, "2024-03-31").collect()] == ["2", "3", "1"]
    assert [str(r["REPDTE"]) for r in reports.drill_down(mart, " 1 ").collect()] == ["2023-12-31", "2024-03-31"]
    assert reports.drill_down(mart, "404").count() == 0


def test_peer_summary(mart):
    got = by(reports.peer_summary(mart), "REPDTE", "PEER_GROUP")
    cell = got["2024-03-31", "regional"]
    assert (cell["UNINSURED_SHARE_MEDIAN"], cell["UNINSURED_SHARE_COUNT"], cell["ALM_MISMATCH_INDEX_COUNT"]) == (pytest.approx(0.35), 2, 1)


def test_peer_summary_keeps_null_group(frame):
    df = frame("REPDTE date, PEER_GROUP string, RUN_RISK_SCORE double", [("2024-03-31", None, 1.0), ("2024-03-31", None, 3.0)])
    row = reports.peer_summary(df).first()
    assert row["PEER_GROUP"] is None and row["RUN_RISK_SCORE_MEDIAN"] == 2.0


def test_regime_and_coverage(mart):
    got = by(reports.regime_summary(mart), "REPDTE")
    assert got["2024-03-31"]["CURVE_REGIME"] == "inverted" and got["2023-12-31"]["CURVE_REGIME"] == "upward_sloping"
    cover = by(reports.layer_coverage(mart), "REPDTE")["2024-03-31"]
    assert (cover["BANKS"], cover["FFIEC"], cover["SOD"], cover["VERSION"]) == (3, 2, 0, "?")


def test_split(mart):
    core, enriched = reports.core_enriched_split(mart)
    assert core.count() == 4 and "DURATION_GAP_LITE" not in core.columns
    assert enriched.count() == 3 and "DURATION_GAP_LITE" in enriched.columns
    assert {str(r["ENRICHED_WINDOW_START"]) for r in core.collect()} == {"2024-03-31"}
    none, all_rows = reports.core_enriched_split(mart.drop("HAS_FFIEC_FEATURES"))
    assert all_rows.count() == 4 and none.first()["ENRICHED_WINDOW_START"] is None


def test_league_records(mart, frame):
    failures = frame("CERT double, FAILDATE string", [(1.0, "3/10/2023"), (9.0, "1/1/2020")])
    rows = by(publish.league_rows(mart, failures), "cert")
    assert len(rows) == 3 and rows["1"]["failed"] and rows["1"]["fail_date"] == "2023-03-10" and not rows["2"]["failed"]
    assert rows["2"]["peer_group_bank_count"] == 2 and rows["1"]["treasury_yield_date"] == "2024-03-28"
    parts = rows["1"]["run_risk_components"]
    assert [(p["key"], p["label"], p["percentile"]) for p in parts] == [("uninsured_share", "Uninsured deposits", 100.0)]
    assert rows["3"]["run_risk_components"] == [] and [p["key"] for p in rows["2"]["composite_components"]] == [
        "run_risk_index", "inverse_treasury_buffer_index"]
    assert sum(p["contribution"] for p in rows["3"]["composite_components"]) == pytest.approx(78.0)
    assert set(publish.bank_summary_rows(mart).columns) == set(publish.SUMMARY_FIELDS)


def test_json_rows(frame):
    df = frame("a double, d date, s string", [(float("nan"), "2024-03-31", None), (float("inf"), None, "x"), (1.5, None, "y")])
    got = [json.loads(r["JSON"]) for r in publish.rows_to_json(df).collect()]
    assert got == [{"a": None, "d": "2024-03-31", "s": None}, {"a": None, "d": None, "s": "x"}, {"a": 1.5, "d": None, "s": "y"}]


def test_manifest(mart, frame):
    metrics = frame("SLICE string, HORIZON_QUARTERS int, SCORE_COL string, AUC double, N_FAILURES long, RECALL_AT_20PCT double",
                    [("full_sample", 4, "RUN_RISK_INDEX", 0.8, 12, 0.5), ("full_sample", 1, "RUN_RISK_INDEX", 0.1, 1, 0.1)])
    core, enriched = reports.core_enriched_split(mart)
    row = publish.manifest(mart, "2024-07-15T00:00:00Z", core, enriched, metrics).first()
    assert row["failures_tested"] == 12 and row["pipeline"]["bank_quarters"] == 4 and row["freshness"]["stale"]
    assert row["published_panels"]["recent_history_enriched"]["bank_quarters"] == 3
    first = row["indices"][0]
    assert (first["id"], first["failure_auc"], first["validation_status"]) == ("run_risk", 0.8, "backtested")
    assert [b["cert"] for b in first["top_banks"]] == ["2", "3", "1"]
    assert row["indices"][3]["validation_status"] == "not_backtested_yet"
    assert [(g["id"], g["label"], g["count"]) for g in row["peer_groups"]] == [("regional", "Regional", 2), ("community", "Community", 1)]
    assert row["treasury_regime"]["yield_date"] == "2024-03-28"
    assert any("sod coverage is unavailable" in w for w in row["freshness"]["coverage_warnings"])


def test_search_page(frame):
    rows = frame("cert string, name string, state string, peer_group string, funding_fragility double",
                 [(str(i), f"Bank {i}", "CA" if i % 2 else "NY", "community", float(i)) for i in range(1, 41)])
    got = reports.search_page(rows, "ca", ["community"], page=2, size=5).collect()
    assert [(r["cert"], r["RANK"]) for r in got] == [("29", 6), ("27", 7), ("25", 8), ("23", 9), ("21", 10)]


def test_stress_report(frame):
    df = frame("CERT string, REPDTE date, UNINSURED_SHARE double, TREASURY_TO_UNINSURED double, VOLATILE_TO_LIQUID_LOWER double",
               [("1", "2022-12-31", 0.9, 0.1, 3.0), ("2", "2022-12-31", 0.2, 0.5, 1.0), ("3", "2022-12-31", 0.3, None, None),
                ("1", "2021-12-31", 0.8, 0.4, 1.0)])
    got = by(stress.stress_case_report(df, "2022-12-31"), "CERT")
    one = got["1"]
    assert (one["RANK_UNINSURED_SHARE"], one["RANK_TREASURY_TO_UNINSURED"], one["N_TREASURY_TO_UNINSURED"]) == (1, 1, 2)
    assert one["DELTA_TREASURY_TO_UNINSURED"] == pytest.approx(-0.3) and one["CHECKS_PASSED"] == 3
    assert one["VOLATILE_SHARE_AT_MOST"] == pytest.approx(2 / 3) and got["3"]["CHECKS_PASSED"] == 0
    assert stress.stress_case_report(df, "2022-12-31", "2").count() == 1


def test_config_weights_add_up():
    assert sum(w for _, w, _ in cfg.RUN_RISK_COMPONENTS) == pytest.approx(0.78)
    for parts in (cfg.PRESSURE_COMPONENTS, cfg.MISMATCH_COMPONENTS, cfg.BUFFER_COMPONENTS, cfg.COMPOSITE_COMPONENTS):
        assert sum(w for _, w, _ in parts) == pytest.approx(1.0)


def test_leaves_of_nested_records(spark):
    rows = [("r", 1, [("p", [0.5, None]), ("q", [])], (float("nan"), True)), ("e", None, [], None), ("z", 2, None, (2.0, None))]
    df = spark.createDataFrame(rows, "id string, n int, a array<struct<k:string,w:array<double>>>, s struct<x:double,b:boolean>")
    got = sorted((tuple(r) for r in publish.record_leaves(df, "id").collect()), key=str)
    assert got == sorted([
        ("r", "id", "r", None), ("r", "n", None, 1.0), ("r", "a[0].k", "p", None), ("r", "a[0].w[0]", None, 0.5), ("r", "a[0].w[1]", None, None),
        ("r", "a[1].k", "q", None), ("r", "s.x", None, None), ("r", "s.b", "true", None),
        ("e", "id", "e", None), ("e", "n", None, None), ("e", "s.x", None, None), ("e", "s.b", None, None),
        ("z", "id", "z", None), ("z", "n", None, 2.0), ("z", "s.x", None, 2.0), ("z", "s.b", None, None)], key=str)


def test_manifest_reads_named_columns_only(mart):
    """What the manifest writes of the index table is enough for it, and leaves the other columns out."""
    wide = mart.withColumn("NOT_READ", F.lit(1.0))
    narrow = publish.manifest_columns(wide)
    assert "NOT_READ" not in narrow.columns and set(narrow.columns) <= set(mart.columns)

    def text(df):
        core, enriched = reports.core_enriched_split(df)
        return publish.rows_to_json(publish.manifest(df, "2024-07-15T00:00:00Z", core, enriched)).first()["JSON"]

    assert text(narrow) == text(wide)
