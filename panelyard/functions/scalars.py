"""Null-keeping column expressions used by every stage.

Missing values are always NULL. ``greatest``/``least`` skip NULL and ANSI
division raises, so stages use the helpers here instead of the bare operators.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def total(columns: Iterable[Column]) -> Column:
    """Left-to-right sum of columns (NULL if any is NULL)."""
    return reduce(lambda a, b: a + b, columns)


def number(value: ColumnLike) -> Column:
    """Text or number as double; unreadable text and NaN become NULL."""
    if isinstance(value, str):
        return F.expr(f"nanvl(try_cast(`{value}` AS DOUBLE), NULL)")
    parsed = as_col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def nz(value: ColumnLike) -> Column:
    """NULL as zero. Names go to the JVM as one expression text, which keeps plan building quick."""
    if isinstance(value, str):
        return F.expr(f"coalesce(`{value}`, 0D)")
    return F.coalesce(as_col(value), F.lit(0.0))


def safe_div(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """NULL when either side is NULL or the denominator is zero."""
    if isinstance(numerator, str) and isinstance(denominator, str):
        return F.expr(f"try_divide(`{numerator}`, `{denominator}`)")
    return F.try_divide(as_col(numerator), as_col(denominator))


def clip(value: ColumnLike, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value, keeping NULL."""
    value = as_col(value)
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(float(lower)))
    if upper is not None:
        bounded = F.least(bounded, F.lit(float(upper)))
    return F.when(value.isNotNull(), bounded)


def clip01(value: ColumnLike) -> Column:
    return clip(value, 0.0, 1.0)


def row_max(*columns: ColumnLike) -> Column:
    """Largest non-null value of the row."""
    return F.greatest(*[as_col(c) for c in columns])


def nz_sum(names: Iterable[str]) -> str:
    """SQL text: left-to-right sum of columns with NULL as zero."""
    return " + ".join(f"coalesce(`{n}`, 0D)" for n in names)


def nz_weighted(weights: dict[str, float]) -> str:
    """SQL text: sum of columns (NULL as zero) times their weights."""
    return " + ".join(f"coalesce(`{n}`, 0D) * {double(w)}" for n, w in weights.items())


def double(x: float) -> str:
    """SQL text of a double literal."""
    return f"{float(x)!r}D"


def present_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next(iter(present_columns(df, names)), None)


def coalesce_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null of the candidate columns that exist, in order."""
    found = present_columns(df, names)
    return F.coalesce(*[F.col(n) for n in found]) if found else F.lit(None).cast("double")


def ensure_columns(df: DataFrame, names: Sequence[str], dtype: str = "double") -> DataFrame:
    """Add absent columns as typed NULL."""
    have = set(df.columns)
    missing = {n: F.lit(None).cast(dtype) for n in names if n not in have}
    return df.withColumns(missing) if missing else df


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().upper() for c in df.columns])


def entity_id(value: ColumnLike) -> Column:
    """Canonical text id: whole numbers lose a trailing ``.0``, text is trimmed."""
    text = F.trim(as_col(value).cast("string"))
    whole = text.rlike(r"^[0-9]+(\.0+)?$")
    return F.when(whole, text.try_cast("decimal(20,0)").cast("string")).otherwise(text)


def parse_report_date(value: ColumnLike) -> Column:
    """Eight digits are ``yyyyMMdd``; other text is ISO or month/day/year; bad text is NULL."""
    text = F.trim(as_col(value).cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).otherwise(
        F.coalesce(text.try_cast("date"), F.try_to_date(text, "M/d/yyyy"))
    )


def parse_date_columns(df: DataFrame, *names: str) -> DataFrame:
    """Apply :func:`parse_report_date` to the columns that are not dates already."""
    types = dict(df.dtypes)
    todo = {n: parse_report_date(n) for n in names if types[n] != "date"}
    return df.withColumns(todo) if todo else df


def quarter_end(day: ColumnLike) -> Column:
    """Last day of the quarter that holds ``day``."""
    return F.last_day(F.add_months(F.trunc(as_col(day), "quarter"), 2))


def quarter_end_offset(day: ColumnLike, quarters: int) -> Column:
    """``quarters`` (>= 1) quarter ends on; the current one counts unless ``day`` is it."""
    day = as_col(day)
    steps = F.when(day == quarter_end(day), F.lit(quarters)).otherwise(F.lit(quarters - 1))
    return F.last_day(F.add_months(F.trunc(day, "quarter"), F.lit(2) + steps * 3))


def quarter_distance(start: ColumnLike, end: ColumnLike) -> Column:
    start, end = as_col(start), as_col(end)
    return (F.year(end) - F.year(start)) * 4 + (F.quarter(end) - F.quarter(start))


def last_completed_quarter(today: ColumnLike, today_counts: bool = True) -> Column:
    """Latest finished quarter; a quarter ending on ``today`` counts if asked."""
    today = as_col(today)
    previous = F.date_sub(F.trunc(today, "quarter"), 1)
    if not today_counts:
        return previous
    return F.when(today == quarter_end(today), today).otherwise(previous)


def quarter_sequence(first: ColumnLike, last: ColumnLike) -> Column:
    """Quarter ends from the quarter of ``first`` up to ``last``, one row each."""
    ends = F.sequence(F.add_months(F.trunc(as_col(first), "quarter"), 2), as_col(last), F.expr("interval 3 months"))
    return F.explode(F.transform(ends, lambda d: F.last_day(d)))


def survey_year(day: ColumnLike) -> Column:
    """Branch survey known at ``day``: up to June it is last year's."""
    day = as_col(day)
    return F.year(day) - F.when(F.month(day) <= 6, 1).otherwise(0)


def survey_snapshot_date(day: ColumnLike) -> Column:
    """June 30 of the survey a published date claims (June itself counts as the same year)."""
    day = as_col(day)
    year = F.year(day) - F.when(F.month(day) >= 6, 0).otherwise(1)
    return F.make_date(year, F.lit(6), F.lit(30))


def banded(value: ColumnLike, bands: Sequence[tuple[str, float, float | None]],
           default: str) -> Column:
    """Half-open size bands ``[low, high)``; a later band wins where bands overlap."""
    value = as_col(value)
    out = F.lit(default)
    for name, low, high in bands:
        inside = value >= F.lit(float(low))
        if high is not None:
            inside = inside & (value < F.lit(float(high)))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def threshold_label(score: ColumnLike, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first cut (largest first) that ``score`` reaches."""
    score = as_col(score)
    out = F.lit(default)
    for limit, label in reversed(list(cuts)):
        out = F.when(score >= F.lit(float(limit)), F.lit(label)).otherwise(out)
    return out


def any_present(columns: Sequence[ColumnLike]) -> Column:
    """1 if any column holds a value, else 0 (also 0 for no columns)."""
    if not columns:
        return F.lit(0)
    return reduce(lambda a, b: a | b, [as_col(c).isNotNull() for c in columns]).cast("int")


def best_of(columns: Sequence[str], method: str = "max_available") -> tuple[Column, Column, Column]:
    """(value, name of its column, number of non-null columns) over ``columns``.

    ``max_available`` takes the largest, the first column in order winning ties;
    ``first_available`` takes the first non-null.
    """
    cols = [F.col(c) for c in columns]
    count = total([c.isNotNull().cast("int") for c in cols])
    if method == "first_available":
        value = F.coalesce(*cols)
        hits = [c.isNotNull() for c in cols]
    elif method == "max_available":
        value = F.greatest(*cols) if len(cols) > 1 else cols[0]
        hits = [c == value for c in cols]
    else:
        raise ValueError(f"unknown selection method: {method}")
    source = F.lit(None).cast("string")
    for name, hit in reversed(list(zip(columns, hits, strict=True))):
        source = F.when(hit, F.lit(name)).otherwise(source)
    return value, source, count


def weighted_mean_available(weights: dict[str, float]) -> Column:
    """Mean of shares clipped to [0,1], weights renormalised over the non-null ones."""
    parts, used = [], []
    for name, weight in weights.items():
        parts.append(nz(clip01(name) * F.lit(weight)))
        used.append(F.when(F.col(name).isNotNull(), F.lit(weight)).otherwise(F.lit(0.0)))
    return clip01(safe_div(total(parts), total(used)))


def finite(value: ColumnLike, dtype: T.DataType) -> Column:
    """NULL for NaN and infinities in floating columns; other types unchanged."""
    value = as_col(value)
    if not isinstance(dtype, T.DoubleType | T.FloatType):
        return value
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
