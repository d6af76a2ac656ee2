"""Next-quarter outflow labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import number, safe_div
from panelyard.operators.ordered import exact_quantiles
from panelyard.operators.windows import history, lagged, next_quarter_observed


def next_growth(df: DataFrame) -> DataFrame:
    """Growth of this and of the next row, and whether the next row is the next quarter."""
    over = history()
    df = df.withColumn("DEPDOM", number("DEPDOM"))
    before = lagged("DEPDOM", 1, over)
    df = df.withColumn("DEP_GROWTH_QOQ", safe_div(F.col("DEPDOM") - before, before))
    return df.withColumns({
        "NEXT_DEP_GROWTH_QOQ": F.lead("DEP_GROWTH_QOQ").over(over),
        "NEXT_Q_OBSERVED": next_quarter_observed(over=over),
    })


def group_quantile(df: DataFrame, by: str, value: str, share: float, out: str) -> DataFrame:
    """One row per group: the interpolated quantile of the non-null values."""
    return exact_quantiles(df, [by], [value], [share]).select(by, F.col("q0").alias(out))


def outflow_labels(df: DataFrame, percentile: float = 5.0) -> DataFrame:
    """Weakest next-quarter growth of each quarter, and the same restricted to real shrinkage.

    The threshold table has one row per report date, so it is broadcast.
    """
    df = next_growth(df)
    growth = F.col("NEXT_DEP_GROWTH_QOQ")
    observed = F.col("NEXT_Q_OBSERVED") & growth.isNotNull()
    cut = group_quantile(df.filter(observed), "REPDTE", "NEXT_DEP_GROWTH_QOQ", percentile / 100.0, "__cut")
    df = df.join(cut, "REPDTE", "left")
    weak = F.coalesce(growth <= F.col("__cut"), F.lit(False))
    return df.withColumns({
        "SEVERE_RELATIVE_OUTFLOW": F.when(observed, weak.cast("int")),
        "SEVERE_ABSOLUTE_OUTFLOW": F.when(observed, (weak & (growth < 0)).cast("int")),
    }).drop("__cut")
