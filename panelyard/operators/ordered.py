"""Exact order statistics that never put a whole group into one task.

A rank, quantile or AUC needs, for each value, how much weight lies below it in
its group. A window over the group would send the group (a quarter can hold a
large part of the table) to one task. Here instead

1. equal values are collapsed first (``groupBy(group, value)``, combined map
   side), so a value that a third of the rows share is one row;
2. the distinct values are range-partitioned by (group, value) into slices of about
   equal size and written once with their slice number: a large group spans many
   slices, and a lost task cannot change the cuts;
3. slice totals (one row per slice) give each slice its offset, and a window runs
   inside slices only.

Row ranks (``add_ranks``) need a result for each row, so there the rows themselves are cut into slices, by (group, value,
key): a value that a third of the rows share fills many slices, and nothing is joined on a value.

The cuts only steer balance. Results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.session import cut_lineage

SLICE_ROWS = 200_000
COUNT = "__n"


def stack_values(df: DataFrame, keep: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form (keep..., ``__metric``, ``__value``) of double columns, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(v).alias("__metric"), F.col(v).cast("double").alias("__value")) for v in values])
    return df.select(*keep, F.inline(pairs)).filter(F.col("__value").isNotNull())


def running_weights(hist: DataFrame, groups: Sequence[str], value: str, weights: Sequence[str],
                    slices: int | None = None) -> DataFrame:
    """Add ``<w>__below`` and ``<w>__total`` to a histogram.

    ``hist`` has one row per (groups, value); ``weights`` are non-negative columns of it.
    Groups must not be NULL. ``slices`` defaults to one for each SLICE_ROWS rows of the histogram.
    """
    groups = list(groups)
    hist = cut_lineage(hist)  # sampled and dealt out from one written copy
    n = slices or max(1, -(-hist.count() // SLICE_ROWS))
    sliced = cut_lineage(hist.repartitionByRange(n, *groups, value).withColumn("__slice", F.spark_partition_id()))
    # Slices are contiguous, so there are at most (slices + groups) of these rows.
    totals = sliced.groupBy(*groups, "__slice").agg(*[F.sum(w).alias(w) for w in weights])
    earlier = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*groups)
    offsets = totals.select(
        *groups,
        "__slice",
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}__before") for w in weights],
        *[F.sum(w).over(group).alias(f"{w}__total") for w in weights],
    )
    inside = Window.partitionBy(*groups, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.join(offsets, [*groups, "__slice"])
    return joined.select(
        *hist.columns,
        *[(F.coalesce(F.sum(w).over(inside), F.lit(0)) + F.col(f"{w}__before")).alias(f"{w}__below")
          for w in weights],
        *[f"{w}__total" for w in weights],
    )


def in_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` written in contiguous slices of ``order`` with their number in ``__slice``; equal keys share a slice."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()))


def carried_forward(df: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """``value`` with NULLs filled by the last known one before, in ``order`` over all rows.

    A window runs inside slices; each slice takes over the last value of the slices before it (one row per slice).
    """
    sliced = in_slices(df, order)
    ends = sliced.filter(F.col(value).isNotNull()).groupBy("__slice").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    every = sliced.select("__slice").distinct().join(ends, "__slice", "left")
    before = every.select("__slice", F.last("__last", ignorenulls=True).over(
        Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inside = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__carry"))
    return sliced.join(before, "__slice").select(*[filled.alias(value) if c == value else c for c in df.columns])


def positions(df: DataFrame, order: Sequence[str], name: str = "__at") -> DataFrame:
    """The place of each row (from 1) in ``order`` over all rows, whose keys must differ."""
    sliced = in_slices(df, order)
    sizes = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))  # one row per slice
    before = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    return sliced.join(before, "__slice").select(*df.columns, (F.col("__before") + inside).alias(name))


def lagged_rows(df: DataFrame, order: Sequence[str], values: Sequence[str], rows: Sequence[int]) -> DataFrame:
    """``<value>__lag<k>`` for each of ``rows``: values of the row ``k`` places before in ``order`` over all rows."""
    placed = cut_lineage(positions(df, order))
    out = placed
    for k in rows:
        side = placed.select((F.col("__at") + k).alias("__at"), *[F.col(v).alias(f"{v}__lag{k}") for v in values])
        out = out.join(side, "__at", "left")
    return out.drop("__at")


def histogram(long: DataFrame, groups: Sequence[str], value: str = "__value") -> DataFrame:
    return long.groupBy(*groups, value).agg(F.count(F.lit(1)).alias(COUNT))


@dataclass(frozen=True)
class Rank:
    """One ranked column.

    ``percentile``: average-tie rank / non-null count; ``flip`` takes 1 - rank.
    ``competition``: 1 + number of larger values; ``ascending``: 1 + number of smaller ones.
    ``at_most``: number of values <= this one.
    NULL stays unranked and becomes ``fill``.
    """

    value: str
    out: str
    kind: str = "percentile"
    flip: bool = False
    scale: float = 1.0
    fill: float | None = None

    def of(self, below: Column, ties: Column, total: Column) -> Column:
        if self.kind == "competition":
            return (total - below - ties + 1).cast("long")
        if self.kind == "ascending":
            return (below + 1).cast("long")
        if self.kind == "at_most":
            return (below + ties).cast("long")
        rank = (below + (ties + 1) / F.lit(2.0)) / total
        if self.flip:
            rank = F.lit(1.0) - rank
        if self.fill is not None:
            rank = F.coalesce(rank, F.lit(self.fill))
        return rank * F.lit(self.scale) if self.scale != 1.0 else rank


def add_ranks(df: DataFrame, by: Sequence[str], ranks: Sequence[Rank], keys: Sequence[str], slices: int | None = None,
              entity: bool = False) -> DataFrame:
    """Rank columns inside groups of any size; ``keys`` identify a row.

    Only keys, groups and values are written and ranked, as narrow rows; all ranks of a row come back in one row that is
    joined once. ``df`` is read for the narrow rows and for the result, so its keys must be the same each time (write it
    first if they are generated).

    ``entity``: the first key is an entity with a bounded history, never NULL. Its ranks come back as one map from the
    other keys, joined on the entity alone: a wide frame that lies by entity for its history windows stays where it is.
    """
    by, keys = list(by), list(keys)
    for name in {r.value for r in ranks} - set(df.columns):
        df = df.withColumn(name, F.lit(None).cast("double"))
    names = list(dict.fromkeys(r.value for r in ranks))
    back, n = _places(df, by, names, keys, slices, entity)
    absent = [F.lit(r.fill * r.scale if r.fill is not None else None) for r in ranks]
    found = []
    for i, r in enumerate(ranks):
        place = F.col(f"__r{names.index(r.value)}")
        rank = r.of(place["below"], place["ties"], place["total"])
        found.append(F.when(place.isNotNull(), rank).otherwise(absent[i]).alias(f"__r{i}"))
    if entity:
        first, *rest = keys
        held = F.struct(_row(rest).alias("key"), F.struct(*found).alias("value"))
        # written, as a wide frame is read again for the ranks of later stages
        back = cut_lineage(back.groupBy(F.col(first).alias("__k0")).agg(F.map_from_entries(F.collect_list(held)).alias("__held")))
        matched = df.join(back, df[first] == back["__k0"], "left").withColumn("__back", F.element_at("__held", _row(rest)))
    else:
        # a record of the keys is equal where they are, NULL or not; both sides lie by it in as many tasks as slices
        back = back.select("__row", F.struct(*found).alias("__back"))
        matched = df.withColumn("__row", _row(keys)).repartition(n, "__row").join(back, "__row", "left")
    out = {r.out: F.when(F.col("__back").isNotNull(), F.col("__back")[f"__r{i}"]).otherwise(absent[i]) for i, r in enumerate(ranks)}
    return matched.withColumns(out).drop("__k0", "__row", "__held", "__back")


def _row(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _places(df: DataFrame, by: list[str], names: list[str], keys: list[str], slices: int | None, entity: bool = False) -> tuple[DataFrame, int]:
    """One row per ``keys`` (without ``entity`` as one record ``__row``), and the number of slices: ``__r<i>`` tells how many
    values lie below the i-th name's value, equal it, and are in all.

    Rows are range-partitioned by group, value and key, so equal values may fill many slices and no value makes a slice
    larger. Windows run inside slices; only the first and last value of a slice can go on in another one, and their
    counts are put together over the ends of all slices (two rows per slice). Rows are dealt to as many tasks as there are
    slices: by bytes alone, compressed ones, a task would hold many times more of larger inputs.
    """
    groups = [*by, "__metric"]
    rows = stack_values(df, list(dict.fromkeys([*keys, *by])), names).withColumn("__value", F.col("__value") + F.lit(0.0))
    for name in by:
        rows = rows.filter(F.col(name).isNotNull())
    rows = cut_lineage(rows)  # sampled and dealt out from one written copy
    n = slices or max(1, -(-rows.count() // SLICE_ROWS))
    order = [*groups, "__value", *[k for k in keys if k not in by]]
    sliced = cut_lineage(rows.repartitionByRange(n, *order).withColumn("__slice", F.spark_partition_id()))
    part = [*groups, "__slice"]
    values = Window.partitionBy(*part).orderBy("__value")
    placed = sliced.repartition(n, *part).withColumns({
        "__low": (F.rank().over(values) - 1).cast("long"),
        "__ties": F.count(F.lit(1)).over(values.rangeBetween(Window.currentRow, Window.currentRow))})
    # both scans leave one row per slice and task; the bounds, one row per slice, are sent to every task
    bounds = sliced.groupBy(*part).agg(F.min("__value").alias("__first"), F.max("__value").alias("__last"))
    sizes = sliced.join(F.broadcast(bounds), part).groupBy(*part).agg(
        F.count(F.lit(1)).alias("__rows"), F.max("__first").alias("__first"), F.max("__last").alias("__last"),
        F.count(F.when(F.col("__value") == F.col("__first"), 1)).alias("__firsts"),
        F.count(F.when(F.col("__value") == F.col("__last"), 1)).alias("__lasts"))
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({"__before": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)),
                                 "__total": F.sum("__rows").over(group)})
    first = F.struct(F.lit(0).alias("end"), F.col("__first").alias("value"), F.col("__firsts").alias("ties"),
                     F.col("__before").alias("below"))
    last = F.struct(F.lit(1).alias("end"), F.col("__last").alias("value"), F.col("__lasts").alias("ties"),
                    (F.col("__before") + F.col("__rows") - F.col("__lasts")).alias("below"))
    one = F.col("__first") == F.col("__last")
    ends = offsets.select(*part, "__before", "__total", F.inline(F.when(one, F.array(first)).otherwise(F.array(first, last))))
    shared = Window.partitionBy(*groups, "value")
    ends = ends.withColumns({"ties": F.sum("ties").over(shared), "below": F.min("below").over(shared)})
    of = lambda end: F.max(F.when(F.col("end") == end, F.struct("value", "ties", "below")))
    ends = ends.groupBy(*part).agg(F.max("__before").alias("__before"), F.max("__total").alias("total"),
                                   of(0).alias("__a"), of(1).alias("__b"))
    whole = lambda field, inside: F.when(F.col("__value") == F.col("__a.value"), F.col(f"__a.{field}")).when(
        F.col("__value") == F.col("__b.value"), F.col(f"__b.{field}")).otherwise(inside)
    ranked = placed.join(ends, part).select(
        *dict.fromkeys([*keys, "__metric"]), whole("below", F.col("__before") + F.col("__low")).alias("below"),
        whole("ties", F.col("__ties")).alias("ties"), "total")
    # the rows of an entity meet in one task, where they are joined; others are dealt to as many tasks as slices
    if entity:
        ranked, row = ranked.repartition(keys[0]), keys
    else:
        ranked, row = ranked.withColumn("__row", _row(keys)).drop(*keys).repartition(n, "__row"), ["__row"]
    return ranked.groupBy(*row).agg(*[
        F.max(F.when(F.col("__metric") == name, F.struct("below", "ties", "total"))).alias(f"__r{i}")
        for i, name in enumerate(names)]), n


def _at(position: Column, below: str, count: str, value: Column) -> Column:
    """Aggregate that picks ``value`` of the row covering a 0-based position."""
    hit = (F.col(below) <= position) & (position < F.col(below) + F.col(count))
    return F.max(F.when(hit, value))


def exact_quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str], shares: Sequence[float],
                    slices: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles: one row per (by, ``__metric``) with ``q0``, ``q1``.. and ``n``."""
    groups = [*by, "__metric"]
    rows = stack_values(df, by, values)
    for name in by:
        rows = rows.filter(F.col(name).isNotNull())
    placed = running_weights(histogram(rows, groups), groups, "__value", [COUNT], slices)
    n, below = F.col(f"{COUNT}__total"), f"{COUNT}__below"
    picks = []
    for i, share in enumerate(shares):
        position = F.lit(float(share)) * (n - 1)
        picks += [
            _at(F.floor(position), below, COUNT, F.col("__value")).alias(f"lo{i}"),
            _at(F.ceil(position), below, COUNT, F.col("__value")).alias(f"hi{i}"),
        ]
    picked = placed.groupBy(*groups).agg(F.max(n).alias("n"), *picks)
    out = []
    for i, share in enumerate(shares):
        position = F.lit(float(share)) * (F.col("n") - 1)
        step = position - F.floor(position)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append((lo + (hi - lo) * step).alias(f"q{i}"))
    return picked.select(*groups, "n", *out)


def windowed_quantiles(df: DataFrame, values: Sequence[str], within: dict[str, Column], share: float,
                       slices: int | None = None) -> DataFrame:
    """One row per ``__metric``: its interpolated quantile over the rows of each condition of ``within``, as ``<name>``.

    All conditions are answered from one histogram whose distinct values carry a weight for each of them, so windows
    that overlap (all rows before a date, for every date) do not multiply the rows. A window without values gives NULL.
    """
    names = list(within)
    rows = stack_values(df.withColumns({f"__in_{n}": c for n, c in within.items()}), [f"__in_{n}" for n in names], values)
    hist = rows.groupBy("__metric", "__value").agg(*[F.sum(F.col(f"__in_{n}").cast("long")).alias(n) for n in names])
    placed = running_weights(hist, ["__metric"], "__value", names, slices)
    at = {n: F.lit(float(share)) * (F.col(f"{n}__total") - 1) for n in names}
    picked = placed.groupBy("__metric").agg(*[a for n in names for a in (
        _at(F.floor(at[n]), f"{n}__below", n, F.col("__value")).alias(f"{n}__lo"),
        _at(F.ceil(at[n]), f"{n}__below", n, F.col("__value")).alias(f"{n}__hi"),
        F.max(at[n] - F.floor(at[n])).alias(f"{n}__step"))])
    return picked.select("__metric", *[
        (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__step")).alias(n) for n in names])


def ranked_metrics(df: DataFrame, cell: Sequence[str], score: str, labels: dict[str, tuple[str, str]],
                   top_shares: Sequence[int], slices: int | None = None) -> DataFrame:
    """AUC and precision/recall at the top of a score, for several labels in one pass.

    ``labels`` maps a name to (label column 0/1/NULL, observed column 0/1). Rows whose
    label is NULL or unobserved do not count for that name. The histogram of distinct
    scores carries all labels as weights, so horizons do not multiply the rows.
    Output: one row per (cell, ``LABEL``).
    """
    cell = list(cell)
    weights, aggs = [], []
    for name, (label, observed) in labels.items():
        valid = (F.col(observed) > 0) & F.col(label).isNotNull()
        aggs.append(F.sum(F.when(valid & (F.col(label) == 1), 1).otherwise(0)).alias(f"{name}_pos"))
        aggs.append(F.sum(F.when(valid, 1).otherwise(0)).alias(f"{name}_all"))
        weights += [f"{name}_pos", f"{name}_all"]
    hist = df.filter(F.col(score).isNotNull()).groupBy(*cell, score).agg(
        F.count(F.lit(1)).alias(COUNT), *aggs)
    placed = running_weights(hist, cell, score, weights, slices)
    measures = []
    for name in labels:
        pos, every = F.col(f"{name}_pos"), F.col(f"{name}_all")
        neg_below = F.col(f"{name}_all__below") - F.col(f"{name}_pos__below")
        measures.append(F.max(f"{name}_pos__total").alias(f"{name}_p"))
        measures.append(F.max(f"{name}_all__total").alias(f"{name}_t"))
        measures.append(F.sum(pos * (neg_below + (every - pos) / F.lit(2.0))).alias(f"{name}_wins"))
        for share in top_shares:
            # score >= interpolated percentile <=> not below the value at the upper position
            position = F.ceil(F.lit((100 - share) / 100.0) * (F.col(f"{name}_all__total") - 1))
            at = lambda v: _at(position, f"{name}_all__below", f"{name}_all", v)
            measures.append(at(F.col(f"{name}_pos__below")).alias(f"{name}_missed{share}"))
            measures.append(at(F.col(f"{name}_all__below")).alias(f"{name}_under{share}"))
    wide = placed.groupBy(*cell).agg(*measures)
    records = []
    for name in labels:
        p, t = F.col(f"{name}_p"), F.col(f"{name}_t")
        both = (p > 0) & (p < t)
        fields = [
            F.lit(name).alias("LABEL"),
            F.when(both, F.col(f"{name}_wins") / (p * (t - p))).alias("AUC"),
            F.when(both, p).otherwise(F.lit(0)).cast("long").alias("N_FAILURES"),
            t.cast("long").alias("N_TOTAL"),
        ]
        for share in top_shares:
            caught = p - F.col(f"{name}_missed{share}")
            flagged = t - F.col(f"{name}_under{share}")
            fields.append(F.when(both, caught / flagged).alias(f"PRECISION_AT_{share}PCT"))
            fields.append(F.when(both, caught / p).alias(f"RECALL_AT_{share}PCT"))
        records.append(F.struct(*fields))
    return wide.select(*cell, F.explode(F.array(*records)).alias("__m")).select(*cell, "__m.*")
