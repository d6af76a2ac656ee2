"""Treasury coverage, rate shocks and the yield backdrop of each report date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import clip, double, ensure_columns, nz_sum, present_columns, safe_div
from panelyard.operators.joins import asof_dates, spread_dates
from panelyard.operators.ordered import lagged_rows
from panelyard.plans.mismatch import AGENCY_HAIRCUT, narrow_liquid, with_fallback_column

BOOK = ["SCUST", "SCAGE", "SCPLEDGE", "CHBAL", "FREPO", "DEPUNA", "VOLIAB"]
# Yield columns used, and slope name -> (long, short).
YIELDS = ["YC_3MO", "YC_2YR", "YC_10YR", "YC_30YR"]
SLOPES = {"YC_10Y_3M_SLOPE_BP": ("YC_10YR", "YC_3MO"), "YC_10Y_2Y_SLOPE_BP": ("YC_10YR", "YC_2YR")}
# Duration clip, default and extra agency years.
DURATION_LOW, DURATION_HIGH, DURATION_DEFAULT, AGENCY_EXTRA, AGENCY_HIGH = 2.0, 6.0, 4.5, 0.5, 7.0


def runnable_base(df: DataFrame, check: bool = True) -> DataFrame:
    """``__run``: the runnable-funding proxy, or volatile liabilities when it is empty."""
    return with_fallback_column(ensure_columns(df, BOOK), "RUNNABLE_FUNDING_PROXY", "VOLIAB", "__run", check)


def treasury_coverage(df: DataFrame, check: bool = True) -> DataFrame:
    """Treasuries against uninsured deposits and liquid assets against runnable funding."""
    df = runnable_base(df, check)
    agencies = f"{double(AGENCY_HAIRCUT)} * coalesce(SCAGE, 0D)"
    return df.withColumns({
        "TREASURY_TO_UNINSURED": F.expr("try_divide(coalesce(SCUST, 0D), DEPUNA)"),
        "TREASURY_AGENCY_TO_RUNNABLE": F.expr(f"try_divide(coalesce(SCUST, 0D) + {agencies}, __run)"),
        "HQLA_NARROW_UPPER": F.expr(narrow_liquid()),
        "HQLA_NARROW_LOWER": F.expr(f"greatest({narrow_liquid()} - coalesce(SCPLEDGE, 0D), 0D)"),
        "HQLA_NARROW_LOWER_TO_RUNNABLE": F.expr(
            f"try_divide(greatest({narrow_liquid()} - coalesce(SCPLEDGE, 0D), 0D), __run)"),
    }).drop("__run")


def rate_shock(df: DataFrame, shocks: Sequence[int] = tuple(cfg.SHOCKS_BP), check: bool = True) -> DataFrame:
    """Value lost at each parallel shock and the coverage that remains."""
    df = runnable_base(ensure_columns(df, ["SECURITY_DURATION_PROXY"]), check)
    duration = F.coalesce(clip("SECURITY_DURATION_PROXY", DURATION_LOW, DURATION_HIGH), F.lit(DURATION_DEFAULT))
    df = df.withColumn("TREASURY_DURATION_ASSUMPTION", duration)
    years = "TREASURY_DURATION_ASSUMPTION"
    agency_years = f"least({years} + {double(AGENCY_EXTRA)}, {double(AGENCY_HIGH)})"
    held, agencies = "coalesce(SCUST, 0D)", "coalesce(SCAGE, 0D)"
    after = {}
    for bp in shocks:
        loss = f"{held} * {years} * {double(bp / 10_000.0)}"
        after[f"TREASURY_LOSS_{bp}BP"] = F.expr(loss)
        after[f"TREASURY_AFTER_{bp}BP"] = F.expr(f"greatest({held} - {loss}, 0D)")
    df = df.withColumns(after)
    ratios = {}
    for bp in shocks:
        left = f"greatest({agencies} - {agencies} * {agency_years} * {double(bp / 10_000.0)}, 0D)"
        liquid = (f"{nz_sum(['CHBAL', 'FREPO'])} + TREASURY_AFTER_{bp}BP + {double(AGENCY_HAIRCUT)} * {left}"
                  " - coalesce(SCPLEDGE, 0D)")
        ratios[f"TREASURY_TO_UNINSURED_AFTER_{bp}BP"] = safe_div(f"TREASURY_AFTER_{bp}BP", "DEPUNA")
        ratios[f"HQLA_NARROW_LOWER_TO_RUNNABLE_AFTER_{bp}BP"] = F.expr(f"try_divide(greatest({liquid}, 0D), __run)")
    return df.withColumns(ratios).drop("__run")


def regime_by_date(panel: DataFrame, history: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per report date: as-of yields, slopes and their changes over the date series.

    Changes look back by report dates, whatever their number: rows are placed in slices and joined by place.
    """
    values = present_columns(history, YIELDS)
    dates = asof_dates(panel, history, values, matched="TREASURY_YIELD_DATE", order=order)
    dates = dates.withColumn("HAS_TREASURY_YIELD_HISTORY", F.col("TREASURY_YIELD_DATE").isNotNull().cast("int"))
    slopes = {name: (F.col(a) - F.col(b)) * 100.0 for name, (a, b) in SLOPES.items() if {a, b} <= set(values)}
    dates = dates.withColumns(slopes) if slopes else dates
    measured = [c for c in ("YC_2YR", "YC_10YR", *SLOPES) if c in dates.columns]
    if not measured:
        return dates
    back = {"QOQ": 1, "YOY": 4}
    changes = {f"{name}_{tag}_CHANGE_BP": (F.col(name) - F.col(f"{name}__lag{rows}")) * F.lit(1.0 if name in SLOPES else 100.0)
               for name in measured for tag, rows in back.items()}
    series = lagged_rows(dates, ["REPDTE"], measured, list(back.values()))
    return series.withColumns(changes).select(*dates.columns, *changes)


def yield_regime(panel: DataFrame, history: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    return spread_dates(panel, regime_by_date(panel, history, order))


def treasury_features(df: DataFrame, history: DataFrame | None = None, check: bool = True) -> DataFrame:
    """The whole treasury stage; without history the flag is 0."""
    df = rate_shock(treasury_coverage(df, check), check=check)
    if history is None:
        return df.withColumn("HAS_TREASURY_YIELD_HISTORY", F.lit(0))
    return yield_regime(df, history)
