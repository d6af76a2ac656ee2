"""Report tables over the index table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import nz, present_columns
from panelyard.operators.aggregates import group_summary
from panelyard.operators.joins import add_new_columns
from panelyard.operators.ordered import Rank, add_ranks
from panelyard.operators.windows import latest_snapshot, top_k


def in_quarter(df: DataFrame, quarter: str) -> DataFrame:
    return df.filter(F.col("REPDTE") == F.lit(quarter).cast("date"))


def drill_down(df: DataFrame, cert: str) -> DataFrame:
    """One entity over all quarters."""
    names = ["CERT", "REPDTE", "NAMEFULL", "PEER_GROUP", "ASSET", *cfg.INDEX_COLUMNS, *cfg.FEATURE_COLUMNS,
             *cfg.SCENARIO_COLUMNS, *cfg.SCHEDULE_REPORT_COLUMNS, *cfg.BRANCH_REPORT_COLUMNS]
    # ids of the table are canonical, so the plain column is compared and the filter reaches the files
    rows = df.filter(F.col("CERT") == F.lit(re.sub(r"\.0+$", "", str(cert).strip())))
    return rows.select(*present_columns(df, names)).orderBy("REPDTE")


def league_table(df: DataFrame, quarter: str) -> DataFrame:
    """One quarter by composite, ranked from the most fragile (ties share a rank, unknown last)."""
    names = ["CERT", "NAMEFULL", "PEER_GROUP", "ASSET", *cfg.INDEX_COLUMNS, "RUN_RISK_SCORE",
             "DEPOSIT_COMPETITION_PRESSURE_SCORE", *cfg.LEAGUE_FEATURES]
    rows = in_quarter(df, quarter).select("REPDTE", *present_columns(df, names))
    ranked = add_ranks(rows, ["REPDTE"], [Rank("FUNDING_FRAGILITY_INDEX", "FRAGILITY_RANK", "competition")],
                       ["CERT"])
    return ranked.drop("REPDTE").orderBy(F.col("FUNDING_FRAGILITY_INDEX").desc_nulls_last(), "CERT")


def scenario_comparison(df: DataFrame, quarter: str) -> DataFrame:
    """Deposit lives side by side for one quarter."""
    names = ["CERT", "NAMEFULL", "PEER_GROUP", "RUN_RISK_SCORE", *cfg.SCENARIO_COLUMNS]
    rows = in_quarter(df, quarter).select(*present_columns(df, names))
    return rows.orderBy(F.col("RUN_RISK_SCORE").desc_nulls_last(), "CERT")


def peer_summary(df: DataFrame) -> DataFrame:
    """Median, mean and count of the published measures per quarter and peer group."""
    return group_summary(df, ["REPDTE", "PEER_GROUP"], [*cfg.INDEX_COLUMNS, *cfg.SUMMARY_FEATURES])


def regime_summary(df: DataFrame) -> DataFrame:
    """The rate backdrop of each quarter (the values are the same on all its rows)."""
    names = present_columns(df, cfg.REGIME_COLUMNS)
    out = df.groupBy("REPDTE").agg(*[F.max(n).alias(n) for n in names])
    if "YC_10Y_3M_SLOPE_BP" in names:
        out = out.withColumn("CURVE_REGIME", curve_regime("YC_10Y_3M_SLOPE_BP"))
    return out


def curve_regime(slope: str):
    return F.when(F.col(slope) < 0, F.lit("inverted")).otherwise(F.lit("upward_sloping"))


def layer_coverage(df: DataFrame) -> DataFrame:
    """Per quarter how many entities have branch, schedule and yield data."""
    def known(name: str):
        return F.count(name) if name in df.columns else F.lit(0).cast("long")

    treasury = "HAS_TREASURY_YIELD_HISTORY"
    return df.groupBy("REPDTE").agg(
        F.count(F.lit(1)).alias("BANKS"),
        known("SOD_TOTAL_DEPOSITS").alias("SOD"),
        known("DURATION_GAP_LITE").alias("FFIEC"),
        (F.sum(nz(treasury).cast("long")) if treasury in df.columns else F.lit(0).cast("long")).alias("TSY"),
        (F.min("INDEX_VERSION") if "INDEX_VERSION" in df.columns else F.lit("?")).alias("VERSION"))


def peer_sizes(latest: DataFrame) -> DataFrame:
    """Entities per peer group of a snapshot with one row per entity."""
    group = F.coalesce("PEER_GROUP", F.lit(cfg.UNASSIGNED)).alias("PEER_GROUP")
    return latest.groupBy(group).agg(F.count(F.lit(1)).alias("PEER_COUNT"))


def latest_with_flag(df: DataFrame, flag: str, date: str = "REPDTE"):
    """Aggregate: the last date on which a flag is set."""
    return F.max(F.when(nz(flag) > 0, F.col(date))) if flag in df.columns else F.lit(None).cast("date")


def enriched_start(df: DataFrame) -> DataFrame:
    """One row: the first quarter in which any enrichment flag is set."""
    flags = [nz(f) > 0 for f in present_columns(df, cfg.ENRICHED_FLAGS)]
    any_flag = F.lit(False)
    for flag in flags:
        any_flag = any_flag | flag
    return df.agg(F.min(F.when(any_flag, F.col("REPDTE"))).alias("ENRICHED_WINDOW_START"))


def publishable_mart(indices: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Indices with the overlay's new columns and the experimental flag."""
    mart = indices if overlay is None else add_new_columns(indices, overlay)
    if "HAS_HISTORICAL_ENTITY_MAP" not in mart.columns:
        mart = mart.withColumn("HAS_HISTORICAL_ENTITY_MAP", F.lit(0))
    scored = F.col("SUPERVISED_OUTFLOW_SCORE").isNotNull().cast("int") \
        if "SUPERVISED_OUTFLOW_SCORE" in mart.columns else F.lit(0)
    return mart.withColumn("SUPERVISED_EXPERIMENTAL", scored)


def core_enriched_split(mart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The full-history core panel, and all columns from the first enriched quarter on."""
    start = enriched_start(mart).scalar()
    core = mart.select(*present_columns(mart, cfg.CORE_COLUMNS)).withColumns({
        "PANEL_VARIANT": F.lit("full_history_core"), "ENRICHED_WINDOW_START": start})
    enriched = mart.withColumn("ENRICHED_WINDOW_START", start).filter(
        F.col("ENRICHED_WINDOW_START").isNull() | (F.col("REPDTE") >= F.col("ENRICHED_WINDOW_START")))
    return core, enriched.withColumn("PANEL_VARIANT", F.lit("recent_history_enriched"))


def top_k_per_index(latest: DataFrame, k: int = 3, indices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The ``k`` highest entities of each published index in a snapshot."""
    indices = indices or cfg.PUBLISHED_INDICES
    pairs = F.array(*[F.struct(F.lit(i).alias("INDEX_ID"), F.col(score).alias("SCORE"))
                      for i, (score, _) in indices.items() if score in latest.columns])
    long = latest.select("CERT", "NAMEFULL", "PEER_GROUP", F.inline(pairs))
    return top_k(long, ["INDEX_ID"], k, [F.col("SCORE").desc_nulls_last(), F.col("CERT").asc()])


def search_page(rows: DataFrame, text: str = "", groups: Sequence[str] = (), sort: str = "funding_fragility",
                descending: bool = True, page: int = 1, size: int = 25) -> DataFrame:
    """One page of a searched, filtered and sorted league table, with the position as RANK.

    Only the rows up to the end of the page are sorted together (a top-k); the page is a
    result the caller asks for, not a sample of a larger one.
    """
    if text:
        needle = F.lit(text.lower())
        hay = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle) for c in ("name", "cert", "state")]
        rows = rows.filter(hay[0] | hay[1] | hay[2])
    if groups:
        rows = rows.filter(F.col("peer_group").isin(list(groups)))
    key = F.coalesce(F.col(sort), F.col("funding_fragility"), F.lit(0.0)) \
        if dict(rows.dtypes)[sort] == "double" else F.col(sort)
    order = key.desc() if descending else key.asc()
    first = (page - 1) * size
    top = rows.withColumn("__key", key).orderBy(order, "cert").limit(first + size)
    from pyspark.sql import Window

    # at most first + size rows reach this window
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        F.col("__key").desc() if descending else F.col("__key").asc(), "cert"))
    return top.withColumn("RANK", position).filter(F.col("RANK") > first).drop("__key")


def snapshot(df: DataFrame) -> DataFrame:
    return latest_snapshot(df)
