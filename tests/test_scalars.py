import datetime

import pytest
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions import scalars as S
from panelyard.functions.text import normalize_name


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_null_rules(spark):
    null = F.lit(None).cast("double")
    row = one(spark, S.clip(null, lower=0), S.clip(F.lit(-1.0), lower=0), S.safe_div(F.lit(1.0), F.lit(0.0)),
              S.safe_div(F.lit(1.0), null), S.nz(null), S.number(F.lit("nan")), S.number(F.lit("x")), S.number(F.lit(" 5.5 ")))
    assert list(row) == [None, 0.0, None, None, 0.0, None, None, 5.5]


def test_number_by_name(spark):
    df = spark.createDataFrame([("nan",), ("1.5",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(S.number("t")).collect()] == [None, 1.5, None, None]


def test_report_dates(spark):
    row = one(spark, S.parse_report_date(F.lit(19840331)), S.parse_report_date(F.lit("2024-03-31")),
              S.parse_report_date(F.lit("3/10/2023")), S.parse_report_date(F.lit("later")))
    assert list(row) == [datetime.date(1984, 3, 31), datetime.date(2024, 3, 31), datetime.date(2023, 3, 10), None]


def test_quarter_maths(spark):
    d = lambda t: F.lit(t).cast("date")
    row = one(spark, S.quarter_distance(d("2008-12-31"), d("2009-01-25")), S.quarter_end_offset(d("2024-09-30"), 1),
              S.quarter_end_offset(d("2024-08-15"), 1), S.quarter_end_offset(d("2024-08-15"), 4),
              S.last_completed_quarter(d("2026-03-20")), S.last_completed_quarter(d("2026-03-31")),
              S.last_completed_quarter(d("2026-03-31"), today_counts=False), S.survey_year(d("2024-06-30")),
              S.survey_year(d("2024-09-30")), S.survey_snapshot_date(d("2024-06-30")))
    day = datetime.date
    assert list(row) == [1, day(2024, 12, 31), day(2024, 9, 30), day(2025, 6, 30), day(2025, 12, 31), day(2026, 3, 31),
                         day(2025, 12, 31), 2023, 2024, day(2024, 6, 30)]


def test_quarter_sequence(spark):
    d = lambda t: F.lit(t).cast("date")
    days = [str(r[0]) for r in spark.range(1).select(S.quarter_sequence(d("2020-03-31"), d("2020-12-31"))).collect()]
    assert days == ["2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31"]


def test_peer_bands(spark):
    df = spark.createDataFrame([(5e5,), (5e6,), (5e7,), (5e8,), (-1.0,), (None,)], "a double")
    got = [r[0] for r in df.select(S.banded("a", cfg.SIZE_BANDS, cfg.UNASSIGNED)).collect()]
    assert got == ["community", "regional", "large_regional", "very_large", "unassigned", "unassigned"]


def test_later_band_wins(spark):
    df = spark.createDataFrame([(5.0,)], "a double")
    assert df.select(S.banded("a", [("x", 0, 10), ("y", 4, 6)], "none")).first()[0] == "y"


@pytest.mark.parametrize("method, expected", [("max_available", (5.4, "A", 2)), ("first_available", (5.4, "A", 2))])
def test_best_rate(spark, method, expected):
    df = spark.createDataFrame([(5.4, None, 5.4)], "A double, B double, C double")
    assert tuple(df.select(*S.best_of(["A", "B", "C"], method)).first()) == expected


def test_exposure_skips_missing_shares(spark):
    df = spark.createDataFrame([(1.5, 0.0, None, None), (None, None, None, None)],
                               "UNINSURED_SHARE double, BROKERED_SHARE double, LIST_SERVICE_SHARE double, TIME_DEPOSIT_SHARE double")
    got = [r[0] for r in df.select(S.weighted_mean_available(cfg.EXPOSURE_WEIGHTS)).collect()]
    assert got[0] == pytest.approx(0.75) and got[1] is None


@pytest.mark.parametrize("raw, clean", [
    ("First Horizon Corp.", "first horizon"), ("SVB Financial Group", "svb"), ("Texaco", "texa"),
    ("Big  Bank, N.A.", "big bank"), ("A&B Holdings, Inc.", "ab"), (None, "")])
def test_names(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "n string").select(normalize_name("n")).first()[0] == clean


def test_entity_ids(spark):
    df = spark.createDataFrame([("5.0",), (" 12 ",), ("007",), ("AB",), (None,)], "c string")
    assert [r[0] for r in df.select(S.entity_id("c")).collect()] == ["5", "12", "7", "AB", None]
