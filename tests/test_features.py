"""Feature stages on small literal panels."""

import pytest
from pyspark.sql import functions as F

from conftest import by
from panelyard import config as cfg
from panelyard.functions.scalars import ensure_columns
from panelyard.plans import competition, deposits, indices, mismatch, outflow, repricing, treasury

MIX = "CERT string, REPDTE date, DEPDOM double, DEPUNA double, DDT double, TRN double, NTRSMMDA double, NTRSOTH double, NTRTIME double"


def test_less_uninsured_is_stickier(frame):
    df = frame(MIX, [("1", "2024-03-31", 100.0, 10.0, 20.0, 30.0, 20.0, 10.0, 20.0),
                     ("2", "2024-03-31", 100.0, 90.0, 20.0, 30.0, 20.0, 10.0, 20.0)])
    got = by(deposits.deposit_features(df), "CERT")
    assert got["1"]["RUN_RISK_SCORE"] < got["2"]["RUN_RISK_SCORE"]
    assert got["1"]["RUN_RISK_SCORE"] + got["1"]["STICKINESS_SCORE"] == pytest.approx(100.0)
    assert got["1"]["TRN_EX_DDT"] == 10.0 and got["1"]["NMD_TOTAL"] == 60.0
    for name in ("BASELINE", "ADVERSE", "SEVERE"):
        assert got["1"][f"DEPOSIT_WAL_{name}"] >= got["2"][f"DEPOSIT_WAL_{name}"]
    assert got["1"]["DEPOSIT_WAL_BASELINE"] > got["1"]["DEPOSIT_WAL_SEVERE"]


def test_life_follows_score(frame):
    df = frame("CERT string, RUN_RISK_SCORE double, DDT double, NMD_TOTAL double, TIME_DEPOSIT_STABLE_EQUIV double",
               [("1", 50.0, 10.0, 10.0, 0.0), ("2", 100.0, 10.0, 10.0, 0.0), ("3", None, 10.0, 10.0, 0.0)])
    df = ensure_columns(df, ["TRN_EX_DDT", "NTRSMMDA", "NTRSOTH", "TIME_DEPOSIT_WAL", "TIME_DEPOSITS_EFFECTIVE"])
    scenario = cfg.LifeScenario("BASELINE", 0.5, {c: (4.0, 1.0) for c in cfg.DEPOSIT_CATEGORIES})
    got = by(deposits.deposit_life_scenarios(df, [scenario]), "CERT")
    assert [got[c]["DDT_LIFE_BASELINE"] for c in "123"] == [3.0, 2.0, None]
    assert got["3"]["DEPOSIT_STABLE_EQUIV_BASELINE"] is None


def test_reported_zero_is_unknown(frame):
    df = frame(MIX, [("1", "2024-03-31", 100.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("2", "2024-03-31", 100.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0),
                     ("3", "2024-03-31", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])
    got = by(deposits.deposit_features(df), "CERT")
    assert [got[c]["UNINSURED_SHARE"] for c in "123"] == [None, 0.5, None]
    assert [got[c]["DEPUNA_MISSING"] for c in "123"] == [True, False, False]
    assert got["3"]["DEPOSIT_WAL_BASELINE"] is None


def test_growth_and_volatility(frame):
    rows = [("1", f"2024-{m}", v) for m, v in (("03-31", 100.0), ("06-30", 110.0), ("09-30", 99.0))]
    df = deposits.deposit_dynamics(frame("CERT string, REPDTE date, DEPDOM_EFFECTIVE double", rows)).orderBy("REPDTE").collect()
    assert [r["DEP_GROWTH_QOQ"] for r in df] == [None, pytest.approx(0.1), pytest.approx(-0.1)]
    assert [r["DEP_GROWTH_VOL_4Q"] for r in df] == [None, None, pytest.approx(0.02 ** 0.5)]
    assert df[2]["DEP_DRAWDOWN_4Q"] == pytest.approx(0.1)


@pytest.mark.parametrize("depuna", [None, 0.0])
def test_runnable_funding(frame, depuna):
    df = frame("DEPUNA double, IDDEPLAM double, BRO double, DEPLSNB double, VOLIAB double", [(depuna, 200.0, 10.0, 5.0, 80.0)])
    assert mismatch.runnable_funding(df).first()["RUNNABLE_FUNDING_PROXY"] == 115.0


def test_stable_funding_and_fallback(frame):
    schema = ("EQ double, DEPOSIT_STABLE_EQUIV_BASELINE double, COREDEP double, OTBFH1T3 double, OTBFH3T5 double, "
              "OTBFHOV5 double, ASSTLT double")
    row = mismatch.stable_funding(frame(schema, [(20.0, 60.0, 5.0, 10.0, 5.0, 5.0, 180.0)])).first()
    assert row["STABLE_FUNDING_BASELINE"] == 100.0
    assert row["LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE"] == pytest.approx(1.8)
    empty = mismatch.stable_funding(frame(schema, [(20.0, None, 5.0, 10.0, 5.0, 5.0, 180.0)])).first()
    assert empty["STABLE_FUNDING_BASELINE"] == 45.0


def test_rate_shock(frame):
    df = frame("SCUST double, SCAGE double, SCPLEDGE double, CHBAL double, FREPO double, DEPUNA double, RUNNABLE_FUNDING_PROXY double, "
               "SECURITY_DURATION_PROXY double, VOLIAB double", [(100.0, 40.0, 10.0, 50.0, 20.0, 200.0, 100.0, 4.0, 0.0)])
    row = treasury.treasury_features(df).first()
    assert row["HQLA_NARROW_LOWER"] == pytest.approx(194.0)
    assert row["TREASURY_LOSS_100BP"] == pytest.approx(4.0)
    assert row["TREASURY_TO_UNINSURED_AFTER_100BP"] == pytest.approx(0.48)
    assert row["HAS_TREASURY_YIELD_HISTORY"] == 0


def test_volatile_liabilities_stand_in(frame):
    df = frame("SCUST double, CHBAL double, VOLIAB double", [(20.0, 10.0, 50.0)])
    assert treasury.treasury_coverage(df).first()["HQLA_NARROW_LOWER_TO_RUNNABLE"] == pytest.approx(0.6)


def test_yield_regime(frame):
    panel = frame("CERT string, REPDTE date", [("1", "2023-12-31"), ("1", "2024-03-31")])
    hist = frame("DATE string, YC_3MO double, YC_2YR double, YC_10YR double, YC_30YR double",
                 [("2023-12-29", 5.4, 4.2, 3.9, 4.0), ("2024-03-28", 4.5, 4.6, 4.1, 4.3)])
    got = by(treasury.yield_regime(panel, hist.withColumn("DATE", F.col("DATE").cast("date"))), "REPDTE")["2024-03-31"]
    assert str(got["TREASURY_YIELD_DATE"]) == "2024-03-28"
    assert got["YC_10Y_3M_SLOPE_BP"] == pytest.approx(-40.0) and got["YC_10YR_QOQ_CHANGE_BP"] == pytest.approx(20.0)


def test_best_rate_and_premium(frame):
    panel = frame("CERT string, REPDTE date, DOMESTIC_DEPOSIT_COST double", [("1", "2024-03-31", 0.01)])
    rates = frame("DATE date, IORB double, RRPONTSYAWARD double", [("2024-03-28", 5.4, 5.3)])
    row = competition.competition_features(panel, rates).first()
    assert row["OUTSIDE_OPTION_RATE_BP"] == pytest.approx(540.0) and row["OUTSIDE_OPTION_SOURCE"] == "IORB_BP"
    assert row["OUTSIDE_OPTION_PREMIUM_BP"] == pytest.approx(440.0)


def test_three_month_yield_is_the_last_resort(frame):
    panel = frame("CERT string, REPDTE date, DOMESTIC_DEPOSIT_COST double, YC_3MO double", [("1", "2024-03-31", 0.01, 5.0)])
    row = competition.competition_features(panel).first()
    assert (row["OUTSIDE_OPTION_RATE_BP"], row["DOMESTIC_DEPOSIT_COST_BP"]) == (pytest.approx(500.0), pytest.approx(100.0))
    assert row["OUTSIDE_OPTION_PREMIUM_POS_BP"] == pytest.approx(400.0) and row["HAS_MARKET_RATE_HISTORY"] == 0


CODES = "IDRSSD long, REPDTE date, CODE string, VALUE double"


def facts(values, bank=1, day="2023-06-30"):
    return [(bank, day, code, value) for code, value in values.items()]


def test_loan_maturity(frame):
    row = repricing.repricing_features(frame(CODES, facts({"RCONA570": 100.0, "RCONA571": 0.0, "RCONA575": 100.0})),
                                       ["IDRSSD", "REPDTE"]).first()
    assert row["LOAN_WAM_PROXY"] == pytest.approx(10.0625) and row["LOAN_MATURITY_TOTAL"] == 200.0
    assert row["TD_MATURITY_TOTAL"] is None and row["DURATION_GAP_LITE"] is None


def test_repricing_gaps(frame):
    values = {f"RCONA57{i}": 100.0 for i in range(6)} | {f"RCONHK{c}": 0.0 for c in ("07", "08", "09", "10")}
    values |= {"RCONHK12": 0.0, "RCONHK13": 50.0, "RCONHK14": 0.0, "RCONHK15": 0.0}
    row = repricing.repricing_features(frame(CODES, facts(values)), ["IDRSSD", "REPDTE"]).first()
    assert row["REPRICING_GAP_0_3M"] == 100.0 and row["CUMULATIVE_GAP_0_3M"] == 100.0 and row["CUMULATIVE_GAP_3_12M"] == 150.0
    assert row["REPRICING_GAP_5Y_PLUS"] == 200.0 and row["DURATION_GAP_LITE"] > 0


def test_code_fallbacks(frame):
    rows = facts({"RCONA570": 100.0, "RCFDA570": 200.0, "RCFD2651": 7.0}) + facts({"RCFDA570": 500.0, "RCFD2651": 8.0}, bank=2)
    rows += facts({"RCON2651": 1.0, "RCFD2651": 9.0}, bank=1, day="2023-09-30") + facts({"RCFD2651": 9.0}, bank=2, day="2023-09-30")
    got = by(repricing.repricing_features(frame(CODES, rows), ["IDRSSD", "REPDTE"]), "IDRSSD", "REPDTE")
    assert (got["1", "2023-06-30"]["LOAN_0_3M"], got["2", "2023-06-30"]["LOAN_0_3M"]) == (100.0, 500.0)
    # the domestic borrowing code is absent from all of June, present in September
    assert [got[b, "2023-06-30"]["FHLB_LE_1Y"] for b in "12"] == [7.0, 8.0]
    assert [got[b, "2023-09-30"]["FHLB_LE_1Y"] for b in "12"] == [1.0, None]


def test_derivatives(frame):
    got = by(repricing.derivative_features(frame("IDRSSD long, RCFD3450 double, RCON3450 double, ASSET double",
                                                 [(1, 1000.0, 5.0, 4000.0), (2, 0.0, 5.0, 0.0), (3, None, None, None)])), "IDRSSD")
    assert [got[i]["HAS_IR_DERIVATIVES"] for i in "123"] == [1, 0, 0]
    assert got["1"]["IR_DERIV_NOTIONAL_TO_ASSETS"] == 0.25 and got["2"]["IR_DERIV_NOTIONAL_TO_ASSETS"] is None


INDEX = ["RUN_RISK_SCORE", *[c for c, _, _ in cfg.MISMATCH_COMPONENTS], *[c for c, _, _ in cfg.BUFFER_COMPONENTS]]


def test_worse_bank_scores_higher(frame):
    schema = "CERT string, REPDTE date, ASSET double, " + ", ".join(f"{c} double" for c in INDEX)
    good = [10.0, 0.5, 0.5, 0.1, 0.5, 0.1, 2.0, 2.0, 2.0]
    bad = [90.0, 2.0, 2.0, 3.0, 1.5, 0.9, 0.1, 0.1, 0.1]
    df = frame(schema, [("1", "2024-03-31", 5e5, *good), ("2", "2024-03-31", 6e5, *bad)])
    got = by(indices.indices_frame(df), "CERT")
    assert got["2"]["FUNDING_FRAGILITY_INDEX"] > got["1"]["FUNDING_FRAGILITY_INDEX"]
    assert got["1"]["PEER_GROUP"] == "community" and got["1"]["INDEX_VERSION"] == cfg.BASE_VERSION
    parts = sum(got["2"][f"ALM_MISMATCH_INDEX_CONTRIB_{c}"] for c, _, _ in cfg.MISMATCH_COMPONENTS)
    assert parts == pytest.approx(got["2"]["ALM_MISMATCH_INDEX"])
    assert got["1"]["DEPOSIT_COMPETITION_PRESSURE_INDEX"] is None


def test_versions(frame):
    df = frame("CERT string, HAS_FFIEC_FEATURES int", [("1", 0), ("2", 1)])
    assert [by(indices.version_tag(df), "CERT")[c]["INDEX_VERSION"] for c in "12"] == [cfg.BASE_VERSION, cfg.SCHEDULE_VERSION]
    assert indices.version_tag(df, "x").first()["INDEX_VERSION"] == "x"


def test_outflow_labels(frame):
    one = [("1", d, v) for d, v in (("2024-03-31", 100.0), ("2024-06-30", 110.0), ("2024-09-30", 80.0), ("2024-12-31", 85.0))]
    got = by(outflow.outflow_labels(frame("CERT string, REPDTE date, DEPDOM double", one)), "REPDTE")
    assert got["2024-06-30"]["SEVERE_ABSOLUTE_OUTFLOW"] == 1 and got["2024-12-31"]["SEVERE_ABSOLUTE_OUTFLOW"] is None
    two = [(c, d, v) for c, vs in (("1", (100.0, 110.0)), ("2", (100.0, 80.0))) for d, v in zip(("2024-03-31", "2024-06-30"), vs)]
    got = by(outflow.outflow_labels(frame("CERT string, REPDTE date, DEPDOM double", two), 50.0), "CERT", "REPDTE")
    assert [got[c, "2024-03-31"]["SEVERE_ABSOLUTE_OUTFLOW"] for c in "12"] == [0, 1]


def test_gap_in_quarters_is_unobserved(frame):
    df = frame("CERT string, REPDTE date, DEPDOM double", [("1", "2023-12-31", 9.0), ("1", "2024-03-31", 1.0), ("1", "2024-09-30", 2.0)])
    got = by(outflow.next_growth(df), "REPDTE")
    assert [got[d]["NEXT_Q_OBSERVED"] for d in ("2023-12-31", "2024-03-31", "2024-09-30")] == [True, False, False]
