"""Funding that can run, liquid assets, stable funding and duration proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import (
    double, ensure_columns, nz, nz_sum, nz_weighted, present_columns, safe_div,
)

AGENCY_HAIRCUT = 0.85


def with_fallback_column(df: DataFrame, preferred: str, other: str, out: str,
                         check: bool = True) -> DataFrame:
    """``preferred``, or ``other`` when ``preferred`` has no value in any row of the run.

    The test is a scalar subquery, so the plan stays lazy. An absent column needs no
    test, and a caller that knows the column is filled switches it off.
    """
    if preferred not in df.columns:
        return df.withColumn(out, F.col(other))
    if not check:
        return df.withColumn(out, F.col(preferred))
    filled = df.agg(F.count(preferred)).scalar()
    return df.withColumn(out, F.when(filled == 0, F.col(other)).otherwise(F.col(preferred)))


def runnable_funding(df: DataFrame) -> DataFrame:
    """Larger of volatile liabilities and uninsured + brokered + list-service deposits."""
    df = ensure_columns(df, ["DEPUNA", "IDDEPLAM", "BRO", "DEPLSNB", "VOLIAB"])
    df = df.withColumn("UNINSURED_PROXY", F.expr("coalesce(CASE WHEN DEPUNA > 0 THEN DEPUNA END, 0.5D * IDDEPLAM)"))
    # greatest() skips NULL, which is the rule here
    return df.withColumn("RUNNABLE_FUNDING_PROXY",
                         F.expr(f"greatest(VOLIAB, {nz_sum(['UNINSURED_PROXY', 'BRO', 'DEPLSNB'])})"))


def narrow_liquid() -> str:
    """SQL text: cash, fed funds, treasuries and agencies after a haircut."""
    return f"{nz_sum(['CHBAL', 'FREPO', 'SCUST'])} + {double(AGENCY_HAIRCUT)} * coalesce(SCAGE, 0D)"


def liquid_assets(df: DataFrame) -> DataFrame:
    """Narrow and broad liquid assets, net of pledged securities, and the run coverage."""
    df = ensure_columns(df, ["CHBAL", "FREPO", "SCUST", "SCAGE", "SCAF", "SCPLEDGE"])
    other = "greatest(coalesce(SCAF, 0D) - coalesce(SCUST, 0D) - coalesce(SCAGE, 0D), 0D)"
    df = df.withColumns({"LIQUID_ASSETS_NARROW": F.expr(narrow_liquid()),
                         "LIQUID_ASSETS_BROAD": F.expr(f"{narrow_liquid()} + 0.5D * {other}")})
    df = df.withColumns({
        f"UNPLEDGED_LIQUID_{kind}_LOWER": F.expr(f"greatest(LIQUID_ASSETS_{kind} - coalesce(SCPLEDGE, 0D), 0D)")
        for kind in ("NARROW", "BROAD")
    })
    return df.withColumns({
        "VOLATILE_TO_LIQUID_LOWER": safe_div("RUNNABLE_FUNDING_PROXY", "UNPLEDGED_LIQUID_NARROW_LOWER"),
        "VOLATILE_TO_LIQUID_BROAD_LOWER": safe_div("RUNNABLE_FUNDING_PROXY", "UNPLEDGED_LIQUID_BROAD_LOWER"),
    })


def stable_funding(df: DataFrame, check: bool = True) -> DataFrame:
    """Equity, deposits that stay and term advances against long-term assets."""
    df = ensure_columns(df, ["EQ", "COREDEP", "ASSTLT", *cfg.ADVANCE_BUCKETS])
    df = with_fallback_column(df, "DEPOSIT_STABLE_EQUIV_BASELINE", "COREDEP", "__stable", check)
    terms = f"{nz_sum(['EQ', '__stable'])} + ({nz_sum(cfg.ADVANCE_BUCKETS[1:])})"
    df = df.withColumn("STABLE_FUNDING_BASELINE", F.expr(terms))
    return df.withColumns({
        "LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE": safe_div("ASSTLT", "STABLE_FUNDING_BASELINE"),
        "STRUCTURAL_TERM_GAP_BASELINE": F.expr("ASSTLT - STABLE_FUNDING_BASELINE"),
    }).drop("__stable")


def security_duration(df: DataFrame) -> DataFrame:
    """Midpoint life of securities, and how far it exceeds the deposit life."""
    df = ensure_columns(df, ["SCRDEBT", "DEPOSIT_WAL_BASELINE", *cfg.SECURITY_BUCKETS])
    base = f"CASE WHEN SCRDEBT <> 0 THEN SCRDEBT ELSE {nz_sum(cfg.SECURITY_BUCKETS)} END"
    df = df.withColumn("SECURITY_DURATION_PROXY", F.expr(f"try_divide({nz_weighted(cfg.SECURITY_BUCKETS)}, {base})"))
    return df.withColumn("SECURITY_VS_DEPOSIT_GAP_BASELINE", F.expr("SECURITY_DURATION_PROXY - DEPOSIT_WAL_BASELINE"))


def loan_core_ratio(df: DataFrame) -> DataFrame:
    df = ensure_columns(df, ["LNLSNET", "COREDEP", "IDLNCORR"])
    return df.withColumn("LOANS_TO_CORE_DEPOSITS", F.expr("coalesce(try_divide(LNLSNET, COREDEP), IDLNCORR / 100D)"))


def short_advance_share(df: DataFrame) -> DataFrame:
    df = ensure_columns(df, ["OTBFH1L", "OTHBFHLB"])
    return df.withColumn("SHORT_FHLB_SHARE", safe_div("OTBFH1L", "OTHBFHLB"))


# Repricing buckets.
GAP_BUCKETS = ["0_3M", "3_12M", "1_3Y", "3_5Y", "5Y_PLUS"]


def bucket_gap(df: DataFrame) -> DataFrame:
    """Asset minus liability per bucket when all ten columns exist; one-year cumulative gap."""
    needed = [f"{side}_BKT_{b}" for b in GAP_BUCKETS for side in ("ASSET", "LIAB")]
    if len(present_columns(df, needed)) < len(needed):
        return df
    df = df.withColumns({f"REPRICING_GAP_{b}": F.col(f"ASSET_BKT_{b}") - F.col(f"LIAB_BKT_{b}")
                         for b in GAP_BUCKETS})
    return df.withColumn("CUMULATIVE_GAP_1Y", nz("REPRICING_GAP_0_3M") + nz("REPRICING_GAP_3_12M"))


def mismatch_features(df: DataFrame, check: bool = True) -> DataFrame:
    """The whole mismatch stage. ``check=False`` when the deposit stage filled its columns."""
    df = stable_funding(liquid_assets(runnable_funding(df)), check)
    for step in (security_duration, loan_core_ratio, short_advance_share, bucket_gap):
        df = step(df)
    return df
