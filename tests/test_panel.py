import pytest

from conftest import by
from panelyard.operators import joins
from panelyard.operators.aggregates import duplicate_keys, require_unique, sod_features
from panelyard.operators.windows import keep_first, keep_last, latest_snapshot
from panelyard.plans import panel


def test_survey_year_join(frame):
    fin = frame("CERT string, REPDTE string, DEPDOM double", [("1", "20240331", 100.0), ("1", "20240930", 110.0)])
    sod = frame("CERT string, YEAR int, DEPSUMBR double, UNINUMBR long, STALP string, CNTYNAME string",
                [("1", 2023, 80.0, 1, "CA", "A"), ("1", 2024, 95.0, 1, "CA", "A")])
    got = by(panel.bank_panel(fin, sod=sod), "REPDTE")
    assert (got["2024-03-31"]["SOD_TOTAL_DEPOSITS"], got["2024-03-31"]["SOD_JOIN_YEAR"]) == (80.0, 2023)
    assert (got["2024-09-30"]["SOD_TOTAL_DEPOSITS"], got["2024-09-30"]["SOD_JOIN_YEAR"]) == (95.0, 2024)
    assert got["2024-09-30"]["HAS_SOD_FEATURES"] == 1 and got["2024-09-30"]["HAS_FFIEC_FEATURES"] == 0


def test_numeric_date(frame):
    fin = frame("CERT long, REPDTE long, DEPDOM double", [(1, 19840331, 1.0)])
    row = panel.bank_panel(fin).first()
    assert str(row["REPDTE"]) == "1984-03-31" and row["CERT"] == "1"


def test_duplicate_key_raises(frame):
    fin = frame("CERT string, REPDTE string, DEPDOM double", [("1", "20240331", 1.0), ("1", "20240331", 2.0)])
    with pytest.raises(ValueError, match=r"Duplicate CERT\+REPDTE"):
        panel.bank_panel(fin, check_keys=True)
    assert duplicate_keys(fin, ["CERT", "REPDTE"]).first()["N_ROWS"] == 2
    assert require_unique(fin, ["DEPDOM"]) is fin


def test_institution_fields(frame):
    fin = frame("CERT string, REPDTE string, STALP string", [("1", "20240331", None), ("2", "20240331", "NY")])
    inst = frame("CERT long, FED_RSSD long, NAME string, RSSDHCR long, BKCLASS string, STALP string, CITY string, SEQ int",
                 [(1, 41, "Old", 9, "N", "TX", "X", 1), (1, 42, "New", 9, "N", "CA", "Y", 2)])
    got = by(panel.bank_panel(fin, inst, institution_order=("SEQ",)), "CERT")
    assert (got["1"]["RSSDID"], got["1"]["NAMEFULL"], got["1"]["STALP"]) == (42, "New", "CA")
    assert (got["2"]["RSSDID"], got["2"]["STALP"]) == (None, "NY")


def test_branch_geography(frame):
    sod = frame("CERT string, YEAR int, DEPSUMBR string, UNINUMBR long, STALPBR string, CNTYNAMB string, BRNUM int",
                [("1", 2024, "300", 1, "CA", "A", 1), ("1", 2024, "200", 2, "CA", "B", 2), ("1", 2024, "100", 3, "NV", "C", 3),
                 ("2", 2024, "50", 9, "TX", "Z", 1), ("3", 2024, "bad", 9, "TX", "Z", 1)])
    got = by(sod_features(sod), "CERT")
    one = got["1"]
    assert (one["SOD_TOTAL_DEPOSITS"], one["SOD_BRANCH_COUNT"], one["SOD_STATE_COUNT"], one["SOD_COUNTY_COUNT"]) == (600.0, 3, 2, 3)
    assert one["SOD_TOP_STATE_SHARE"] == pytest.approx(5 / 6)
    assert one["SOD_DEPOSIT_HHI_COUNTY"] == pytest.approx(0.25 + 1 / 9 + 1 / 36)
    assert got["2"]["SOD_DEPOSIT_HHI_STATE"] == 1.0 and got["2"]["SOD_DEPOSIT_HHI_COUNTY"] == 1.0
    assert got["3"]["SOD_TOP_STATE_SHARE"] is None and got["3"]["SOD_DEPOSIT_HHI_STATE"] == 0.0


def test_schedule_columns_join(frame):
    fin = frame("CERT string, REPDTE string", [("1", "20230630"), ("1", "20230930")])
    side = frame("CERT string, REPDTE date, DURATION_GAP_LITE double, LOAN_WAM_PROXY double, OTHER double",
                 [("1", "2023-06-30", 2.5, 3.0, 9.0)])
    got = by(panel.bank_panel(fin, repricing=side), "REPDTE")
    assert got["2023-06-30"]["DURATION_GAP_LITE"] == 2.5 and got["2023-09-30"]["DURATION_GAP_LITE"] is None
    assert (got["2023-06-30"]["HAS_FFIEC_FEATURES"], got["2023-09-30"]["HAS_FFIEC_FEATURES"]) == (1, 0)
    assert "OTHER" not in got["2023-06-30"].asDict()


def test_asof_takes_the_last_row_whole(frame):
    rows = frame("CERT string, REPDTE date", [("1", "2024-03-31"), ("2", "2024-03-31"), ("1", "2023-12-31")])
    hist = frame("DATE date, SEQ int, Y double, Z double", [("2024-03-28", 1, 4.0, 1.0), ("2024-03-28", 2, 5.0, None),
                                                          ("2024-04-01", 1, 9.0, 9.0)])
    got = joins.asof_join(rows, hist, ["Y", "Z"], order=["SEQ"])
    assert got.count() == 3
    got = by(got, "CERT", "REPDTE")
    assert (got["1", "2024-03-31"]["Y"], got["1", "2024-03-31"]["Z"]) == (5.0, None)
    assert str(got["2", "2024-03-31"]["MATCHED_DATE"]) == "2024-03-28"
    assert got["1", "2023-12-31"]["HAS_HISTORY"] == 0


def test_keep_first_last(frame):
    df = frame("k string, o int, v string", [("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)])
    assert {r["k"]: r["v"] for r in keep_last(df, ["k"], ["o"]).collect()} == {"a": "x", "b": None}
    assert {r["k"]: r["v"] for r in keep_first(df, ["k"], ["o"]).collect()} == {"a": "y", "b": None}


def test_latest_snapshot(spark):
    """The last date's row; ties by all other columns, entities without dates keep a row, rows without an entity go."""
    rows = [("1", "2020-01-01", 1, "a"), ("1", "2020-02-01", None, "b"), ("1", "2020-02-01", 2, "c"), ("1", "2020-02-01", 2, "c"),
            (None, "2020-02-01", 2, "c"), ("2", None, 5, "x"), ("2", None, 6, None), ("3", "2020-01-01", None, None), ("3", None, 7, "q")]
    df = spark.createDataFrame(rows, "CERT string, REPDTE string, a int, b string")
    got = latest_snapshot(df)
    assert sorted(map(tuple, got.collect())) == [("1", "2020-02-01", 2, "c"), ("2", None, 6, None), ("3", "2020-01-01", None, None)]
    assert sorted(got.collect()) == sorted(keep_last(df.filter("CERT IS NOT NULL"), ["CERT"], ["REPDTE"]).collect())
    assert "struct" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert latest_snapshot(df.select("CERT", "REPDTE")).count() == 3 and latest_snapshot(df.limit(0)).count() == 0
