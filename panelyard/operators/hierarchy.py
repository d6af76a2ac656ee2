"""Ownership chains: the top holder of every entity, cycles included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.windows import keep_last
from panelyard.session import cut_lineage


def current_edges(relationships: DataFrame, active_from: int = 20240101) -> DataFrame:
    """Controlling relationships still active at ``active_from`` (yyyymmdd), distinct.

    Names may carry a leading ``#``; numbers may be text.
    """
    df = relationships.toDF(*[c.lstrip("#").strip() for c in relationships.columns])
    df = df.filter((F.col("DT_END").try_cast("double") >= active_from) & (F.col("CTRL_IND").try_cast("double") == 1))
    extra = [c for c in ("PCT_EQUITY",) if c in df.columns]
    return df.select(
        F.col("ID_RSSD_PARENT").try_cast("double").cast("bigint").alias("ID_RSSD_PARENT"),
        F.col("ID_RSSD_OFFSPRING").try_cast("double").cast("bigint").alias("ID_RSSD_OFFSPRING"),
        F.col("RELN_LVL").try_cast("double").alias("RELN_LVL"), *extra).distinct()


def entity_attributes(attributes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Id, trimmed names and types; the last row per id in ``order``."""
    df = attributes.toDF(*[c.lstrip("#").strip() for c in attributes.columns])
    have = [c for c in ("NM_LGL", "NM_SHORT", "ENTITY_TYPE", "BHC_IND") if c in df.columns]
    df = df.select(F.col("ID_RSSD").try_cast("bigint").alias("ID_RSSD"), *order, *[
        F.trim(c).alias(c) if c.startswith("NM_") else F.col(c) for c in have])
    return keep_last(df, ["ID_RSSD"], list(order)).select("ID_RSSD", *have)


def _jump(table: DataFrame, lookup: DataFrame) -> DataFrame:
    """Follow every pointer of ``table`` once through ``lookup`` (one row per node).

    Many nodes may point to the same one; the adaptive skew join splits such a key,
    the looked-up side being one row for it.
    """
    side = lookup.select(F.col("node").alias("__n"), F.col("jump").alias("__j"), F.col("done").alias("__d"))
    joined = table.join(side, table["jump"] == side["__n"])
    return joined.select("node", F.col("__j").alias("jump"), F.col("__d").alias("done"))


def _resolve(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Double pointers until each node knows its root; also the nodes that only reach cycles.

    While some chain is longer than the distance covered, a round resolves at least one
    node, so a round that resolves none proves that the rest leads into cycles.
    """
    table = cut_lineage(table)
    left = table.filter(~F.col("done")).count()
    while left:
        still = _jump(table.filter(~F.col("done")), table)
        table = cut_lineage(table.filter("done").unionByName(still))
        now = table.filter(~F.col("done")).count()
        if now == left:
            break
        left = now
    return table.filter("done").select("node", "jump"), table.filter(~F.col("done"))


def _cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle among edges whose every node leads into one.

    The images of the doubled pointers shrink to exactly the cycles and then stay.
    """
    table = cut_lineage(edges.select("node", "jump", F.lit(False).alias("done")))
    size = -1
    while True:
        image = table.select("jump").distinct()
        now = image.count()
        if now == size:
            return image.withColumnRenamed("jump", "node")
        size, table = now, cut_lineage(_jump(table, table))


def top_holder(edges: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(ID_RSSD, TOP_HOLDER_RSSD) for every entity of the edge list.

    With several parents the last in ``order`` counts. An entity without a parent is its
    own top. A walk that meets a cycle ends at the first node it sees twice: a
    cycle's node is its own top, a tail ends where it enters the cycle.
    """
    known = edges.filter(F.col("ID_RSSD_OFFSPRING").isNotNull() & F.col("ID_RSSD_PARENT").isNotNull())
    one = keep_last(known.select("ID_RSSD_OFFSPRING", *order, "ID_RSSD_PARENT"), ["ID_RSSD_OFFSPRING"], list(order))
    parents = cut_lineage(one.select(F.col("ID_RSSD_OFFSPRING").cast("bigint").alias("node"),
                                     F.col("ID_RSSD_PARENT").cast("bigint").alias("jump")))
    roots = parents.select(F.col("jump").alias("node")).distinct().join(parents, "node", "left_anti")
    start = parents.select("node", "jump", F.lit(False).alias("done")).unionByName(
        roots.select("node", F.col("node").alias("jump"), F.lit(True).alias("done")))
    tops, cyclic = _resolve(start)
    if not cyclic.isEmpty():
        edges_left = cut_lineage(parents.join(cyclic.select("node"), "node", "left_semi"))
        ring = _cycle_nodes(edges_left)
        tails = edges_left.join(ring, "node", "left_anti").select("node", "jump", F.lit(False).alias("done"))
        ends = ring.select("node", F.col("node").alias("jump"), F.lit(True).alias("done"))
        resolved, _ = _resolve(tails.unionByName(ends))
        tops = tops.unionByName(resolved)
    return tops.select(F.col("node").alias("ID_RSSD"), F.col("jump").alias("TOP_HOLDER_RSSD"))


def holder_names(tops: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attach the legal name of each top holder (attributes: one row per id)."""
    side = attributes.select(F.col("ID_RSSD").alias("TOP_HOLDER_RSSD"), F.col("NM_LGL").alias("TOP_HOLDER_NAME"))
    return tops.join(side, "TOP_HOLDER_RSSD", "left")
