"""Stress-case report: where an entity stood in one quarter and how it got there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import entity_id
from panelyard.operators.ordered import Rank, add_ranks, exact_quantiles

# Ratio -> rank direction (most uninsured first, least covered first).
RATIOS = {"UNINSURED_SHARE": "competition", "TREASURY_TO_UNINSURED": "ascending",
          "VOLATILE_TO_LIQUID_LOWER": "competition"}


def stress_case_report(panel: DataFrame, quarter: str, cert: str | None = None) -> DataFrame:
    """Ranks, first-to-last changes and three pass/fail rules per entity of a quarter.

    With ``cert`` the report is cut to that entity; ranks still run over the whole quarter.
    """
    rows = panel.select(entity_id("CERT").alias("CERT"), "REPDTE", *RATIOS)
    section = rows.filter(F.col("REPDTE") == F.lit(quarter).cast("date"))
    ranks = [Rank(name, f"RANK_{name}", kind) for name, kind in RATIOS.items()]
    ranks.append(Rank("VOLATILE_TO_LIQUID_LOWER", "__at_most", "at_most"))
    ranked = add_ranks(section, ["REPDTE"], ranks, ["CERT", "REPDTE"])
    whole = section.groupBy("REPDTE").agg(
        F.count(F.lit(1)).alias("N_ROWS"), F.max("UNINSURED_SHARE").alias("__max"),
        *[F.count(name).alias(f"N_{name}") for name in RATIOS])
    medians = exact_quantiles(section, ["REPDTE"], ["TREASURY_TO_UNINSURED"], [0.5]).select("REPDTE", F.col("q0").alias("__median"))
    first_last = rows.groupBy("CERT").agg(*[
        a for name in RATIOS
        for a in (F.min_by(F.struct(name), "REPDTE").alias(f"__first_{name}"),
                  F.max_by(F.struct(name), "REPDTE").alias(f"__last_{name}"))])
    # the two summaries are one row each: the section is one quarter
    df = ranked.join(whole, "REPDTE").join(medians, "REPDTE", "left")
    df = df if cert is None else df.filter(F.col("CERT") == F.lit(str(cert).strip()))
    df = df.join(first_last, "CERT", "left")
    df = df.withColumns({
        f"DELTA_{name}": F.col(f"__last_{name}")[name] - F.col(f"__first_{name}")[name] for name in RATIOS})
    share = F.coalesce(F.col("__at_most"), F.lit(0)) / F.col("N_ROWS")
    df = df.withColumns({
        "VOLATILE_SHARE_AT_MOST": share,
        "PASS_MAX_UNINSURED": F.coalesce(F.col("UNINSURED_SHARE") == F.col("__max"), F.lit(False)).cast("int"),
        "PASS_VOLATILE": (share >= 0.5).cast("int"),
        "PASS_COVERAGE": F.coalesce(F.col("TREASURY_TO_UNINSURED") < F.col("__median"), F.lit(False)).cast("int"),
    })
    df = df.withColumn("CHECKS_PASSED", F.col("PASS_MAX_UNINSURED") + F.col("PASS_VOLATILE") + F.col("PASS_COVERAGE"))
    return df.select(
        "CERT", "REPDTE", *RATIOS, *[f"RANK_{n}" for n in RATIOS], *[f"N_{n}" for n in RATIOS],
        *[f"DELTA_{n}" for n in RATIOS], "VOLATILE_SHARE_AT_MOST",
        "PASS_MAX_UNINSURED", "PASS_VOLATILE", "PASS_COVERAGE", "CHECKS_PASSED")
