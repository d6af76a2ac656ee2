"""Row windows of one entity's history, and one-row-per-key reductions.

Windows partition by entity and order by report date. (entity, date) is unique in
a panel, so a window partition holds at most one row per reporting date, however
large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import ColumnLike, as_col, quarter_end_offset, safe_div

ENTITY = ("CERT",)
TIME = "REPDTE"


def history(entity: Sequence[str] = ENTITY, time: str = TIME):
    return Window.partitionBy(*entity).orderBy(time)


def lagged(value: ColumnLike, rows: int = 1, over=None) -> Column:
    """Value some rows (not calendar quarters) back."""
    return F.lag(as_col(value), rows).over(over or history())


def growth(value: ColumnLike, rows: int = 1, over=None) -> Column:
    before = lagged(value, rows, over)
    return safe_div(as_col(value) - before, before)


def rolling_std(value: ColumnLike, rows: int = 4, at_least: int = 2, over=None) -> Column:
    """Sample deviation of the last ``rows`` rows with enough non-null values."""
    frame = (over or history()).rowsBetween(-(rows - 1), 0)
    value = as_col(value)
    return F.when(F.count(value).over(frame) >= at_least, F.stddev_samp(value).over(frame))


def rolling_peak(value: ColumnLike, rows: int = 4, over=None) -> Column:
    return F.max(as_col(value)).over((over or history()).rowsBetween(-(rows - 1), 0))


def drawdown(value: ColumnLike, rows: int = 4, over=None) -> Column:
    peak = rolling_peak(value, rows, over)
    return safe_div(peak - as_col(value), peak)


def next_quarter_observed(time: str = TIME, over=None) -> Column:
    """True when the entity's next row is exactly one quarter end on."""
    following = F.lead(time).over(over or history(time=time))
    return F.coalesce(following == quarter_end_offset(time, 1), F.lit(False))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``. An aggregate, so a hot key combines map side."""
    return _keep(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.min)


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = [c for c in order if c not in keys]
    if not lead + rest:
        return df.select(*keys).distinct()
    row = pick(F.struct(*lead, *rest)).alias("__row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def latest_snapshot(df: DataFrame, entity: Sequence[str] = ENTITY, time: str = TIME) -> DataFrame:
    """Last row per entity (rows with a NULL entity are dropped).

    The last date of each entity is an aggregate of two columns; it filters a second read of ``df``, so wide rows of
    earlier dates are neither sorted nor shuffled as aggregate state. Of several rows of that date the last in the
    order of all other columns stays.
    """
    entity = list(entity)
    known = df
    for name in entity:
        known = known.filter(F.col(name).isNotNull())
    last = known.groupBy(*[F.col(name).alias(f"__e{i}") for i, name in enumerate(entity)]).agg(F.max(time).alias("__last"))
    same = [F.col(name) == F.col(f"__e{i}") for i, name in enumerate(entity)]
    found = known.join(last, [*same, F.col(time).eqNullSafe(F.col("__last"))], "left_semi")
    rest = [F.col(f"`{c}`").desc() for c in df.columns if c not in [*entity, time]]
    if not rest:
        return found.distinct()
    over = Window.partitionBy(*entity, time).orderBy(*rest)
    return found.withColumn("__at", F.row_number().over(over)).filter(F.col("__at") == 1).drop("__at")


def top_k(df: DataFrame, by: Sequence[str], k: int, order: Sequence[Column], rank: str = "RANK") -> DataFrame:
    """First ``k`` rows per group; Spark cuts each map task to k rows per group before the shuffle."""
    over = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= k)
