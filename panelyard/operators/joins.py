"""Left joins that add columns, and the as-of join on dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.ordered import carried_forward
from panelyard.operators.windows import keep_last

KEYS = ("CERT", "REPDTE")


def add_new_columns(base: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS,
                    prefixes: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Left join only the columns ``base`` lacks (and that start with a prefix, if given).

    ``order`` names the columns that decide which row of a repeated key wins (the last).
    """
    keys = list(keys)
    have = set(base.columns)
    new = [c for c in other.columns
           if c not in have and c not in order and (prefixes is None or c.startswith(tuple(prefixes)))]
    if not new:
        return base
    side = other.select(*keys, *[c for c in order if c not in keys], *new)
    if order:
        side = keep_last(side, keys, order).select(*keys, *new)
    return base.join(side, keys, "left")


def merge_stages(first: DataFrame, *others: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fold of :func:`add_new_columns` over stage outputs with unique keys."""
    for other in others:
        first = add_new_columns(first, other, keys)
    return first


def fill_from_dimension(fact: DataFrame, dimension: DataFrame, key: str,
                        columns: Sequence[str]) -> DataFrame:
    """Left join a dimension with one row per key; a fact value wins, the dimension fills nulls."""
    names = [c for c in columns if c in dimension.columns]
    side = dimension.select(key, *[F.col(c).alias(f"__dim_{c}") for c in names])
    joined = fact.join(side, key, "left")
    have = set(fact.columns)
    out = {c: F.coalesce(F.col(c), F.col(f"__dim_{c}")) if c in have else F.col(f"__dim_{c}") for c in names}
    return joined.withColumns(out).drop(*[f"__dim_{c}" for c in names]) if names else fact


def override_values(df: DataFrame, overrides: DataFrame, key: str, columns: dict[str, str],
                    tag: tuple[str, str] | None = None) -> DataFrame:
    """Replace values for listed keys: ``columns`` maps a column to its override column.

    ``tag`` = (column, text) marks rows that had an override. Unlisted keys of the
    override table are ignored.
    """
    side = overrides.select(F.col(key).alias("__ok"), *[F.col(o).alias(f"__o_{c}") for c, o in columns.items()],
                            F.lit(True).alias("__hit"))
    joined = df.join(side, df[key] == F.col("__ok"), "left")
    out: dict[str, Column] = {c: F.coalesce(F.col(f"__o_{c}"), F.col(c)) for c in columns}
    if tag:
        out[tag[0]] = F.when(F.col("__hit"), F.lit(tag[1])).otherwise(F.col(tag[0]))
    return joined.withColumns(out).drop("__ok", "__hit", *[f"__o_{c}" for c in columns])


def asof_dates(days: DataFrame, history: DataFrame, values: Sequence[str], day: str = "REPDTE",
               date: str = "DATE", matched: str = "MATCHED_DATE", order: Sequence[str] = ()) -> DataFrame:
    """For each distinct day or time the last history row on or before it (the whole row, nulls included).

    Both inputs are first reduced to one row per time; the ordered pass runs in slices of the time line, each of which
    takes over the last row of the slices before it, so timestamps work like dates.
    """
    seen = days.select(F.col(day).alias("__d")).filter(F.col("__d").isNotNull()).distinct()
    rows = history.filter(F.col(date).isNotNull()).select(date, *[c for c in order if c != date], *values)
    rows = keep_last(rows, [date], list(order))
    kept = rows.select(F.col(date).alias("__d"), F.struct(F.col(date).alias(matched), *values).alias("__h"),
                       F.lit(0).alias("__q"))
    asked = seen.select("__d", F.lit(None).cast(kept.schema["__h"].dataType).alias("__h"), F.lit(1).alias("__q"))
    filled = carried_forward(kept.unionByName(asked), ["__d", "__q"], "__h")
    return filled.filter(F.col("__q") == 1).select(
        F.col("__d").alias(day), *[F.col(f"__h.`{c}`").alias(c) for c in (matched, *values)])


def spread_dates(panel: DataFrame, per_day: DataFrame, day: str = "REPDTE") -> DataFrame:
    """Join a one-row-per-calendar-day table to the panel (a few thousand rows per decade)."""
    return panel.join(per_day, day, "left")


def asof_join(panel: DataFrame, history: DataFrame, values: Sequence[str], day: str = "REPDTE",
              date: str = "DATE", matched: str = "MATCHED_DATE", flag: str = "HAS_HISTORY",
              order: Sequence[str] = ()) -> DataFrame:
    """As-of join on dates with the matched date and a 0/1 flag."""
    per_day = asof_dates(panel, history, values, day, date, matched, order)
    joined = spread_dates(panel, per_day, day)
    return joined.withColumn(flag, F.col(matched).isNotNull().cast("int"))


def map_ids(df: DataFrame, mapping: DataFrame, source: str, target: str, on: str,
            order: Sequence[str] = ()) -> DataFrame:
    """Attach ``target`` by the first mapping row per ``source`` id."""
    from panelyard.operators.windows import keep_first

    side = mapping.filter(F.col(source).isNotNull()).select(
        source, *[c for c in order if c not in (source, target)], target)
    side = keep_first(side, [source], list(order) or [target]).select(F.col(source).alias("__id"), target)
    return df.join(side, df[on] == F.col("__id"), "left").drop("__id")
