"""Failure labels with censoring, and how well each index ranked the failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import entity_id, parse_date_columns, quarter_distance, quarter_end_offset
from panelyard.operators.ordered import ranked_metrics

FIRST_YEAR, LAST_YEAR = 2007, 2024


def last_failures(failures: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The last failure date per entity, inside a range of years if given."""
    df = parse_date_columns(failures, "FAILDATE").select(entity_id("CERT").alias("CERT"), "FAILDATE")
    df = df.filter(F.col("CERT").isNotNull() & F.col("FAILDATE").isNotNull())
    if first_year is not None:
        df = df.filter(F.year("FAILDATE").between(first_year, last_year))
    return df.groupBy("CERT").agg(F.max("FAILDATE").alias("FAILDATE"))


def event_join(panel: DataFrame, failures: DataFrame, first_year: int = FIRST_YEAR,
               last_year: int = LAST_YEAR) -> DataFrame:
    """Panel rows of the year range with the entity's last failure of that range."""
    df = parse_date_columns(panel, "REPDTE").filter(F.year("REPDTE").between(first_year, last_year))
    df = df.withColumn("CERT", entity_id("CERT"))
    return df.join(last_failures(failures, first_year, last_year), "CERT", "left")


def failure_labels(panel: DataFrame, failures: DataFrame, first_year: int = FIRST_YEAR,
                   last_year: int = LAST_YEAR, horizons: Sequence[int] = tuple(cfg.HORIZONS)) -> DataFrame:
    """Per horizon whether the future is observed and, only then, whether a failure falls in it.

    ``FAIL_DATE`` and ``FAILED_BANK`` tell whether and when the entity failed at all, whatever the horizon.
    """
    df = event_join(panel, failures, first_year, last_year)
    df = df.withColumns({"FAIL_DATE": F.col("FAILDATE"), "FAILED_BANK": F.col("FAILDATE").isNotNull().cast("int")})
    df = df.withColumn("QUARTERS_TO_FAILURE",
                       F.when(F.col("FAILDATE") > F.col("REPDTE"), quarter_distance("REPDTE", "FAILDATE")))
    end = F.lit(f"{last_year}-12-31").cast("date")
    out = {}
    for h in horizons:
        observed = quarter_end_offset("REPDTE", h) <= end
        hit = F.coalesce(F.col("QUARTERS_TO_FAILURE").between(1, h), F.lit(False))
        out[f"FORWARD_OBSERVED_{h}Q"] = observed.cast("int")
        out[f"FAIL_WITHIN_{h}Q"] = F.when(observed, hit.cast("int"))
    return df.withColumns(out)


def episode_rows(df: DataFrame, episodes: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """One row per episode window that holds the report date (windows may overlap)."""
    marks = []
    for name, (start, end) in episodes.items():
        inside = F.col("REPDTE").isNotNull()
        if start is not None:
            inside = inside & (F.col("REPDTE") >= F.lit(start).cast("date"))
        if end is not None:
            inside = inside & (F.col("REPDTE") <= F.lit(end).cast("date"))
        marks.append(F.when(inside, F.lit(name)))
    return df.withColumn("SLICE", F.explode(F.array_compact(F.array(*marks))))


def score_rows(df: DataFrame, scores: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per score column: ``SCORE_COL`` and ``__score``."""
    pairs = F.array(*[F.struct(F.lit(s).alias("SCORE_COL"), F.col(s).cast("double").alias("__score")) for s in scores])
    return df.select(*keep, F.inline(pairs))


def metrics_table(labelled: DataFrame, episodes=cfg.EPISODES, horizons: Sequence[int] = tuple(cfg.HORIZONS),
                  scores: dict[str, str] = cfg.BACKTEST_SCORES, top_shares: Sequence[int] = tuple(cfg.TOP_SHARES),
                  slices: int | None = None) -> DataFrame:
    """AUC, precision and recall per episode, horizon and score, from one histogram pass.

    Every cell of the grid is reported; a cell without rows has zero counts.
    """
    present = {s: label for s, label in scores.items() if s in labelled.columns}
    flags = [c for h in horizons for c in (f"FAIL_WITHIN_{h}Q", f"FORWARD_OBSERVED_{h}Q")]
    long = score_rows(labelled.select("REPDTE", *flags, *present), list(present), ["REPDTE", *flags])
    measured = ranked_metrics(
        episode_rows(long, episodes), ["SLICE", "SCORE_COL"], "__score",
        {str(h): (f"FAIL_WITHIN_{h}Q", f"FORWARD_OBSERVED_{h}Q") for h in horizons}, top_shares, slices)
    measured = measured.withColumn("HORIZON_QUARTERS", F.col("LABEL").cast("int")).drop("LABEL")
    grid = labelled.sparkSession.createDataFrame(
        [(e, h, s, label) for e in episodes for h in horizons for s, label in present.items()],
        "SLICE string, HORIZON_QUARTERS int, SCORE_COL string, SCORE_LABEL string")
    keys = ["SLICE", "HORIZON_QUARTERS", "SCORE_COL"]
    out = grid.join(measured, keys, "left").fillna(0, ["N_FAILURES", "N_TOTAL"])
    tops = [f"{m}_AT_{p}PCT" for p in top_shares for m in ("PRECISION", "RECALL")]
    return out.select("SLICE", "HORIZON_QUARTERS", "SCORE_COL", "SCORE_LABEL", "AUC", "N_FAILURES", "N_TOTAL", *tops)
