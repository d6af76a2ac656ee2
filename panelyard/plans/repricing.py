"""Repricing buckets, maturities and gaps from schedule facts; derivative notionals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import ensure_columns, number, nz, safe_div, total
from panelyard.session import cut_lineage

REPRICING_CODES = [
    *[c for pair in cfg.LOAN_CODES.values() for c in pair], *cfg.RE_LOAN_CODES.values(),
    *cfg.TIME_DEPOSIT_CODES.values(), *[c for pair in cfg.BORROWING_CODES.values() for c in pair],
]
OVERLAY_CODES = [c for pair in cfg.DERIVATIVE_CODES.values() for c in pair]


def pivot_codes(facts: DataFrame, keys: Sequence[str], codes: Sequence[str], code: str = "CODE",
                value: str = "VALUE", order: Sequence[str] = ()) -> DataFrame:
    """Long facts to one column per code; the first known value in ``order`` wins.

    The code list is given, so there is no extra pass to find the codes, and the wide
    row is one aggregate instead of a chain of outer joins.
    """
    wanted = facts.filter(F.col(code).isin(list(codes)))
    known = number(value)
    if order:
        ranked = F.struct(*order, known.alias("__v"))
        aggs = [F.min(F.when((F.col(code) == c) & known.isNotNull(), ranked))["__v"].alias(c) for c in codes]
    else:
        aggs = [F.max(F.when(F.col(code) == c, known)).alias(c) for c in codes]
    return wanted.groupBy(*keys).agg(*aggs)


def present_by_batch(facts: DataFrame, codes: Sequence[str], batch: str = "REPDTE", code: str = "CODE") -> DataFrame:
    """One row per batch: 0/1 per code that has any fact in it (at most one row per report date)."""
    return facts.filter(F.col(code).isin(list(codes))).groupBy(batch).agg(
        *[F.max(F.when(F.col(code) == c, 1).otherwise(0)).alias(f"__has_{c}") for c in codes])


def repricing_buckets(wide: DataFrame, borrowing_present: DataFrame | None = None,
                      batch: str = "REPDTE") -> DataFrame:
    """Bucket columns from codes.

    Loans fall back per row. Borrowings use the consolidated code only in a batch where
    the domestic code never occurs: ``borrowing_present`` (see :func:`present_by_batch`)
    holds that; without it a code is taken to occur when its column exists.
    """
    existing = set(wide.columns)
    wide = ensure_columns(wide, REPRICING_CODES)
    if borrowing_present is not None:
        # one row per report date: a few hundred rows at any scale
        wide = wide.join(borrowing_present, batch, "left")
    out: dict[str, Column] = {name: F.coalesce(*codes) for name, codes in cfg.LOAN_CODES.items()}
    out |= {name: F.col(c) for name, c in {**cfg.RE_LOAN_CODES, **cfg.TIME_DEPOSIT_CODES}.items()}
    for name, (first, second) in cfg.BORROWING_CODES.items():
        if borrowing_present is not None:
            out[name] = F.when(F.col(f"__has_{first}") == 1, F.col(first)).otherwise(F.col(second))
        else:
            out[name] = F.col(first if first in existing else second)
    wide = wide.withColumns(out)
    return wide.drop(*[c for c in wide.columns if c.startswith("__has_")])


def sum_present(df: DataFrame, columns: Sequence[str], out: str, batch: str | None = "REPDTE",
                empty: float | None = None) -> DataFrame:
    """Row sum over columns that hold any value in the batch; ``empty`` if none does.

    With ``batch=None`` the whole frame is one batch. The per-batch test is a small
    aggregate joined back (one row per batch), not a window over the batch.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df.withColumn(out, F.lit(empty).cast("double"))
    known = F.coalesce(*columns).isNotNull()
    if batch is None:
        any_value = df.agg(F.max(known.cast("int"))).scalar()
        return df.withColumn(out, F.when(any_value == 1, total([nz(c) for c in columns])).otherwise(F.lit(empty)))
    seen = df.groupBy(batch).agg(F.max(known.cast("int")).alias("__any"))
    joined = df.join(seen, batch, "left")
    return joined.withColumn(
        out, F.when(F.col("__any") == 1, total([nz(c) for c in columns])).otherwise(F.lit(empty))).drop("__any")


def _weighted_years(buckets: Sequence[str], prefixes: Sequence[str]) -> Column:
    def years(name: str) -> float:
        bucket = next(name[len(p):] for p in prefixes if name.startswith(p))
        return cfg.MIDPOINTS[bucket]

    return total([nz(b) * F.lit(years(b)) for b in buckets])


def maturity_totals(df: DataFrame, batch: str | None = "REPDTE") -> DataFrame:
    """Totals per book and their weighted average maturity.

    The three per-batch tests are one aggregate and one broadcast join.
    """
    books = {
        "LOAN_MATURITY_TOTAL": (list(cfg.LOAN_CODES), "LOAN_WAM_PROXY", ["LOAN_"]),
        "RE_LOAN_MATURITY_TOTAL": (list(cfg.RE_LOAN_CODES), "RE_LOAN_WAM_PROXY", ["RE_LOAN_"]),
        "TD_MATURITY_TOTAL": (list(cfg.TIME_DEPOSIT_CODES), "TD_WAM_PROXY", ["TD_SMALL_", "TD_LARGE_"]),
    }
    if batch is None:
        for name, (buckets, _, _) in books.items():
            df = sum_present(df, buckets, name, None)
    else:
        seen = df.groupBy(batch).agg(*[F.max(F.coalesce(*buckets).isNotNull().cast("int")).alias(f"__any_{name}")
                                       for name, (buckets, _, _) in books.items()])
        df = df.join(seen, batch, "left")
        df = df.withColumns({
            name: F.when(F.col(f"__any_{name}") == 1, total([nz(b) for b in buckets]))
            for name, (buckets, _, _) in books.items()
        }).drop(*[f"__any_{name}" for name in books])
    df = df.withColumn("ALL_LOAN_MATURITY_TOTAL", nz("LOAN_MATURITY_TOTAL") + nz("RE_LOAN_MATURITY_TOTAL"))
    return df.withColumns({
        wam: F.when(F.col(name) > 0, _weighted_years(buckets, prefixes) / F.col(name))
        for name, (buckets, wam, prefixes) in books.items()
    })


# Horizon -> (asset bucket suffixes, time-deposit bucket suffixes).
GAP_HORIZONS = {
    "0_3M": (["0_3M"], ["0_3M"]),
    "3_12M": (["3_12M"], ["3_12M"]),
    "1_3Y": (["1_3Y"], ["1_3Y"]),
    "3_5Y": (["3_5Y"], ["3Y_PLUS"]),
    "5Y_PLUS": (["5_15Y", "15Y_PLUS"], []),
}


def repricing_gaps(df: DataFrame) -> DataFrame:
    """Assets minus time deposits per horizon, and the running sum."""
    gaps, running, cumulative = {}, None, {}
    for horizon, (assets, deposits) in GAP_HORIZONS.items():
        held = total([nz(f"{kind}_{b}") for b in assets for kind in ("LOAN", "RE_LOAN")])
        owed = total([nz(f"{kind}_{b}") for b in deposits for kind in ("TD_SMALL", "TD_LARGE")]) \
            if deposits else F.lit(0.0)
        gaps[f"REPRICING_GAP_{horizon}"] = held - owed
        gap = F.col(f"REPRICING_GAP_{horizon}")
        running = gap if running is None else running + gap
        cumulative[f"CUMULATIVE_GAP_{horizon}"] = running
    return df.withColumns(gaps).withColumns(cumulative)


def duration_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("DURATION_GAP_LITE", F.col("LOAN_WAM_PROXY") - F.col("TD_WAM_PROXY"))


def repricing_features(facts: DataFrame, keys: Sequence[str], batch: str = "REPDTE",
                       order: Sequence[str] = ()) -> DataFrame:
    """Long schedule facts to bucket, maturity and gap features per entity and report date.

    The wide table (one row per filer and date) is read again for the per-batch tests, so
    it is written once instead of pivoting the facts twice.
    """
    wide = cut_lineage(pivot_codes(facts, keys, REPRICING_CODES, order=order))
    firsts = [first for first, _ in cfg.BORROWING_CODES.values()]
    return duration_gap(repricing_gaps(maturity_totals(
        repricing_buckets(wide, present_by_batch(facts, firsts, batch), batch), batch)))


def derivative_features(wide: DataFrame) -> DataFrame:
    """Five notionals (consolidated code first), their total, a 0/1 flag and the ratio to assets."""
    wide = ensure_columns(wide, OVERLAY_CODES)
    wide = wide.withColumns({name: F.coalesce(*codes) for name, codes in cfg.DERIVATIVE_CODES.items()})
    wide = wide.withColumn("IR_DERIV_TOTAL_NOTIONAL",
                           total([nz(name) for name in cfg.DERIVATIVE_CODES]))
    wide = wide.withColumn("HAS_IR_DERIVATIVES", (F.col("IR_DERIV_TOTAL_NOTIONAL") > 0).cast("int"))
    if "ASSET" in wide.columns:
        wide = wide.withColumn("IR_DERIV_NOTIONAL_TO_ASSETS", F.when(
            F.col("ASSET") > 0, safe_div("IR_DERIV_TOTAL_NOTIONAL", "ASSET")))
    return wide
