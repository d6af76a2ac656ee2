"""Mixing sources to target weights with nested hash thresholds.

Every document has a fixed 60-bit hash of its id. A source whose target is ``b`` whole copies and a rest takes each
document ``b`` times and, once more, those whose hash lies below the source's threshold. The threshold is found from
histograms: tokens are summed by source and hash bucket, the bucket in which the running sum passes the rest is the
boundary, and only the rows of boundary buckets are summed again by their next ten bits, until a bucket is one hash
value. The documents of that boundary hash, mostly one, are taken too where this ends nearer to the target, so a source
misses its target by half of its boundary document at most. Nothing is sorted but the at most 1,024 sums of a source, and
no document is moved.

Defined results. A null text has size 0. A null source is a source of its own, last in the order. A null doc_id hashes
like the text "null". Repeated rows share one hash, so they are taken together or not at all. An empty table gives an
empty table. Other columns are neither read nor returned by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import word_count
from panelyard.session import cut_lineage

BITS, LEVELS = 10, 6


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """source, source_size and target: ``share`` of all words dealt by weight, never above ``most`` times a source.

    With targets ``min(most * size, level * weight)`` the level follows from the sources in order of size by weight:
    those before the first one that the level doesn't fill are at their bound. The frame has one row per source.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").isNull(), "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    per = per.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("fill", F.col("bound") / F.col("weight"))
    rising = Window.orderBy("fill", F.col("src").isNull(), "src")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    found = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(whole)
    per = per.withColumn("level", F.coalesce(found["level"], F.lit(0.0)))
    return per.select("src", "source_size", F.least("bound", F.col("level") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source the whole copies and the hash below which documents count once more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = targets.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = cut_lineage(state.withColumn("threshold", F.lit(0).cast("bigint")))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        now = state.select(F.col("src").alias("of"), "threshold", "left")
        inside = sizes.join(now, F.col("src").eqNullSafe(F.col("of")))
        if level:
            inside = inside.where(F.shiftright("hash", shift + BITS) == F.shiftright("threshold", shift + BITS))
        bucket = F.shiftright("hash", shift).bitwiseAND((1 << BITS) - 1)
        sums = inside.groupBy("of", "left", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("of").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        edge = sums.groupBy("of").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("used"), "tokens")).alias("edge"))
        # without a boundary everything below this level's end fits; only possible for sources of size 0
        left = F.col("left") - F.coalesce(F.col("edge.used"), F.lit(0))
        threshold = F.col("threshold") + F.shiftleft(F.coalesce(F.col("edge.bucket"), F.lit((1 << BITS) - 1)), shift)
        if level == LEVELS - 1:  # the boundary is one hash value: the threshold may stand behind it
            threshold = threshold + F.coalesce((F.col("edge.tokens") - left < left).cast("bigint"), F.lit(0))
        after = state.join(edge, F.col("src").eqNullSafe(F.col("of")), "left").select(
            "src", "source_size", "target", "copies", left.alias("left"), threshold.alias("threshold"))
        state = cut_lineage(after)
    return state


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and the source and hash that decide."""
    sizes = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("src"),
                                    word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")))
    state = thresholds(sizes, source_targets(sizes, list(weights), share, most)).withColumnRenamed("src", "of")
    times = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("bigint")
    return sizes.join(state, F.col("src").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("copies"),
        F.col("src").alias("source"), "hash")


def copies_of(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    chosen = mix(docs, **options).select(F.col("doc_id").alias("__of"), F.col("source").alias("__source"), F.col("size").alias("__size"),
                                         F.col("copies").alias("__copies")).where("__copies > 0").dropDuplicates()
    keyed = docs.withColumn("__row", word_count(F.col("text")))
    out = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("__of")) & F.col("source").eqNullSafe(F.col("__source"))
                     & (F.col("__row") == F.col("__size")))
    # array_repeat and explode give a row its copies in place
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*[docs[c] for c in docs.columns])
