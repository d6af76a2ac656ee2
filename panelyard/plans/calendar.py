"""Which periods each source should cover, and how far its files lag behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scalars import last_completed_quarter, quarter_distance, quarter_sequence
from panelyard.sources.schedules import status_date_from_name, year_from_name

# First quarter of quarterly sources; first and last year of yearly ones.
QUARTERLY_STARTS = {"financials": "2007-03-31", "ffiec": "2020-03-31"}
YEARLY_RANGES = {"sod": (2010, 2024), "treasury": (2022, None)}


def _last_year(today: str, cap: int | None):
    year = F.year(F.lit(today).cast("date")) - 1
    return year if cap is None else F.least(year, F.lit(cap))


def source_windows(spark: SparkSession, today: str) -> DataFrame:
    """(SOURCE, PERIOD): quarter ends as yyyyMMdd and years each source covers at ``today``."""
    one, day = spark.range(1), F.lit(today).cast("date")
    out = None
    for source, start in QUARTERLY_STARTS.items():
        part = one.select(F.lit(source).alias("SOURCE"), quarter_sequence(
            F.lit(start).cast("date"), last_completed_quarter(day)).alias("d"))
        part = part.select("SOURCE", F.date_format("d", "yyyyMMdd").alias("PERIOD"))
        out = part if out is None else out.unionByName(part)
    for source, (first, last) in YEARLY_RANGES.items():
        end = _last_year(today, last)
        years = F.when(end >= first, F.sequence(F.lit(first), F.greatest(end, F.lit(first)))).cast("array<string>")
        out = out.unionByName(one.select(F.lit(source).alias("SOURCE"), F.explode(years).alias("PERIOD")))
    return out


def source_status(files: DataFrame, today: str, source: str = "SOURCE", path: str = "PATH") -> DataFrame:
    """Per source: latest period among its file names, target, lag and unit; ``MISS`` without a readable name.

    One aggregate over the file list.
    """
    day = F.lit(today).cast("date")
    target = last_completed_quarter(day)
    latest = files.groupBy(source).agg(F.max(status_date_from_name(path)).alias("__d"), F.max(year_from_name(path)).alias("__y"))
    yearly = F.col(source).isin(list(YEARLY_RANGES))
    cap = F.lit(None).cast("int")
    for name, (_, last) in YEARLY_RANGES.items():
        cap = F.when(F.col(source) == name, _last_year(today, last)).otherwise(cap)
    lag = F.when(yearly, cap - F.col("__y")).otherwise(quarter_distance("__d", target))
    return latest.select(
        source,
        F.when(yearly, F.col("__y").cast("string")).otherwise(F.date_format("__d", "yyyy-MM-dd")).alias("LATEST"),
        F.when(yearly, cap.cast("string")).otherwise(F.date_format(target, "yyyy-MM-dd")).alias("TARGET"),
        lag.alias("LAG"), F.when(yearly, F.lit("Y")).otherwise(F.lit("Q")).alias("UNIT"),
    ).withColumn("STATUS", F.when(F.col("LATEST").isNull(), F.lit("MISS")).otherwise(F.lit("OK")))
