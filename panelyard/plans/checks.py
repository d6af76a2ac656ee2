"""Data checks: one scan, one exploded array of findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import nz, present_columns, total
from panelyard.operators.windows import history

# A check looks at the columns a frame has and returns (condition, code, detail) rules.
Rule = tuple[Column, str, str]
Check = Callable[[DataFrame], list[Rule]]

# Columns of the range checks.
DEPOSIT_COLUMNS = ["DEPDOM", "COREDEP", "DEP"]
SHARE_COLUMNS = ["UNINSURED_SHARE", "BROKERED_SHARE", "LIST_SERVICE_SHARE", "LARGE_ACCOUNT_SHARE",
                 "CORE_DEPOSIT_SHARE", "NONINTEREST_SHARE", "TIME_DEPOSIT_SHARE", "SHORT_FHLB_SHARE"]
COVERAGE_COLUMNS = ["TREASURY_TO_UNINSURED", "TREASURY_AGENCY_TO_RUNNABLE", "HQLA_NARROW_LOWER_TO_RUNNABLE",
                    "VOLATILE_TO_LIQUID_LOWER"]
HHI_COLUMNS = ["SOD_DEPOSIT_HHI_STATE", "SOD_DEPOSIT_HHI_COUNTY"]
TOLERANCE = 0.20


def _exceeds(left: str, right: str) -> Check:
    def check(df: DataFrame) -> list[Rule]:
        if {left, right} <= set(df.columns):
            return [(F.col(left) > F.col(right), f"{left}_GT_{right}", f"{left} > {right}")]
        return []

    return check


core_over_domestic = _exceeds("COREDEP", "DEPDOM")
pledged_over_securities = _exceeds("SCPLEDGE", "SC")


def negative_deposits(df: DataFrame) -> list[Rule]:
    return [(F.col(c) < 0, "NEGATIVE_DEPOSIT", f"{c} < 0") for c in present_columns(df, DEPOSIT_COLUMNS)]


def shares_out_of_range(df: DataFrame) -> list[Rule]:
    rules = []
    for c in present_columns(df, SHARE_COLUMNS):
        rules += [(F.col(c) < 0, "SHARE_NEGATIVE", f"{c} < 0"), (F.col(c) > 1.0, "SHARE_GT_1", f"{c} > 1.0")]
    return rules


def negative_coverage(df: DataFrame) -> list[Rule]:
    return [(F.col(c) < 0, "NEGATIVE_COVERAGE", f"{c} < 0") for c in present_columns(df, COVERAGE_COLUMNS)]


def _bucket_ratio(df: DataFrame, buckets: Sequence[str], whole: str) -> Column | None:
    found = present_columns(df, list(buckets))
    if whole not in df.columns or not found:
        return None
    return F.when(F.col(whole) > 0, F.try_divide(total([nz(b) for b in found]), F.col(whole)))


def security_buckets(df: DataFrame) -> list[Rule]:
    whole = "SCRDEBT" if "SCRDEBT" in df.columns else "SC"
    ratio = _bucket_ratio(df, list(cfg.SECURITY_BUCKETS), whole)
    if ratio is None:
        return []
    return [(ratio > 1.0 + TOLERANCE, "SEC_BUCKET_SUM_EXCEEDS_TOTAL",
             f"sum(SCNM*) exceeds {whole} by >{TOLERANCE:.0%}")]


def advance_buckets(df: DataFrame) -> list[Rule]:
    ratio = _bucket_ratio(df, cfg.ADVANCE_BUCKETS, "OTHBFHLB")
    if ratio is None:
        return []
    return [((ratio < 1.0 - TOLERANCE) | (ratio > 1.0 + TOLERANCE), "FHLB_BUCKET_SUM_MISMATCH",
             f"sum(OTBFH*) deviates from OTHBFHLB by >{TOLERANCE:.0%}")]


def date_order(df: DataFrame) -> list[Rule]:
    if not {"CERT", "REPDTE"} <= set(df.columns):
        return []
    return [(F.col("REPDTE") <= F.lag("REPDTE").over(history()), "NON_MONOTONIC_REPDTE",
             "REPDTE <= previous REPDTE for same CERT")]


def holder_changes(df: DataFrame) -> list[Rule]:
    if not {"CERT", "RSSDHCR"} <= set(df.columns):
        return []
    return [(F.col("RSSDHCR") != F.lag("RSSDHCR").over(history()), "RSSDHCR_CHANGE",
             "RSSDHCR changed between consecutive quarters")]


def branch_deposits_positive(df: DataFrame) -> list[Rule]:
    return [(F.col(c) <= 0, "SOD_NONPOSITIVE_DEPOSITS", f"{c} <= 0")
            for c in present_columns(df, ["SOD_TOTAL_DEPOSITS"])]


def hhi_range(df: DataFrame) -> list[Rule]:
    return [((F.col(c) < 0) | (F.col(c) > 1.0), "SOD_HHI_OUT_OF_RANGE", f"{c} outside [0, 1]")
            for c in present_columns(df, HHI_COLUMNS)]


ALL_CHECKS: list[Check] = [
    core_over_domestic, pledged_over_securities, negative_deposits, shares_out_of_range, negative_coverage,
    security_buckets, advance_buckets, date_order, holder_changes, branch_deposits_positive, hhi_range,
]


def run_checks(df: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """All findings as (CERT, REPDTE, CHECK, DETAIL); the schema is the same without findings.

    Checks whose columns are absent are skipped. The row-pair checks share one exchange
    on the entity; everything else is evaluated in the same scan.
    """
    rules = [rule for check in (checks or ALL_CHECKS) for rule in check(df)]
    keys = [F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in ("CERT", "REPDTE")]
    if not rules:
        return df.select(*keys, F.lit("").alias("CHECK"), F.lit("").alias("DETAIL")).limit(0)
    # window results must be columns before they can enter an array expression
    flagged = df.select(*keys, *[F.coalesce(cond, F.lit(False)).alias(f"__c{i}") for i, (cond, _, _) in enumerate(rules)])
    found = F.array_compact(F.array(*[
        F.when(F.col(f"__c{i}"), F.struct(F.lit(code).alias("CHECK"), F.lit(detail).alias("DETAIL")))
        for i, (_, code, detail) in enumerate(rules)]))
    return flagged.select("CERT", "REPDTE", F.inline(found))
