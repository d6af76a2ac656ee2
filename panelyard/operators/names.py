"""Matching entity names to a registry: exact, then token overlap, then overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import present_columns
from panelyard.functions.text import normalize_name
from panelyard.operators.joins import override_values
from panelyard.session import cut_lineage

# Words that tell nothing about a bank.
STOP_WORDS = ["bank", "of", "the", "and", "national", "first", "trust", "savings", "federal"]
# Least shared words and least score of an overlap match.
MIN_OVERLAP, MIN_SCORE = 2, 0.6
# Scores that are searched one after another, for names without one of the scores before.
SCORES = (0.8, MIN_SCORE)
# Registry sets of one key beyond which the key's rows are split by their next word.
SPLIT_ROWS = 64
MATCH_COLUMNS = ["SEC_CIK", "SEC_TICKER", "SEC_TITLE", "SEC_MATCH_TYPE"]


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks: normalising costs much a row, and a file of some million names is one or two splits."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def registry_lookup(registry: DataFrame, seq: str = "SEQ") -> DataFrame:
    """Registry rows with their normalised name; ``seq`` is the row order that breaks ties."""
    registry = dealt(registry)
    cik = "CIK_STR" if "CIK_STR" in registry.columns else "CIK"
    return registry.select(
        F.col(seq).alias("__seq"), F.col(cik).alias("SEC_CIK"), F.col("TICKER").alias("SEC_TICKER"),
        F.col("TITLE").alias("SEC_TITLE"), normalize_name("TITLE").alias("__norm"))


def exact_name_match(names: DataFrame, lookup: DataFrame, norm: str = "INST_NAME_NORM") -> DataFrame:
    """First registry row with the same non-empty normalised name."""
    first = lookup.filter(F.length("__norm") > 0).groupBy("__norm").agg(
        F.min(F.struct("__seq", "SEC_CIK", "SEC_TICKER", "SEC_TITLE")).alias("__hit"))
    joined = names.join(first, names[norm] == first["__norm"], "left")
    return joined.withColumns({
        "SEC_CIK": F.col("__hit.SEC_CIK"), "SEC_TICKER": F.col("__hit.SEC_TICKER"),
        "SEC_TITLE": F.col("__hit.SEC_TITLE"),
        "SEC_MATCH_TYPE": F.when(F.col("__hit").isNotNull(), F.lit("exact")),
    }).drop("__norm", "__hit")


def _words(norm: str) -> Column:
    return F.sort_array(F.array_except(F.array_distinct(F.split(F.col(norm), " ")),
                                       F.array(*[F.lit(w) for w in ["", *STOP_WORDS]])))


def _least_shared(size: Column, score: float) -> Column:
    """Fewest shared words a set of this size needs for a match of this score."""
    return F.greatest(F.lit(MIN_OVERLAP), F.ceil(size * F.lit(score) - F.lit(1e-9)).cast("int"))


def _numbered(df: DataFrame, name: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows with a number of their own, written; with ``order`` numbers rise in it."""
    return cut_lineage((df.orderBy(*order) if order else df).withColumn(name, F.monotonically_increasing_id()))


def _by_rarity(sets: DataFrame, places: DataFrame, number: str) -> DataFrame:
    """Word sets as the places of their words by registry frequency, then text; words the registry lacks only count in ``size``."""
    placed = sets.select(number, F.size("words").alias("size"), F.explode("words").alias("word")).join(places, "word")
    ordered = placed.groupBy(number).agg(F.sort_array(F.collect_list("place")).alias("words"), F.first("size").alias("size"))
    return cut_lineage(ordered.filter(F.size("words") >= MIN_OVERLAP))


def _but_one(rows: DataFrame) -> DataFrame:
    """What is left of a set without one of its words or without none; a word the registry lacks is always left out."""
    known, size = F.size("words"), F.col("size")
    less = F.transform(F.sequence(F.lit(1), known), lambda i: F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, known)))
    parts = (F.when((known == size) & (known > MIN_OVERLAP), F.concat(F.array("words"), less)).when(known >= size - 1, F.array("words")))
    return rows.select(*[c for c in rows.columns if c != "words"], F.explode(parts).alias("part"))


def _near_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches of sets of which neither has more than one word that the other lacks.

    Such sets leave an equal part. Of registry sets with the same part the first one of each size stands for all, so rows
    grow with the words of the sets only, however many sets are near each other."""
    first = _but_one(b).groupBy("part", F.col("size").alias("n")).agg(F.min("hit").alias("hit"))
    score = F.size("part") / F.greatest("size", "n")
    return _best(_but_one(a).join(first.hint("merge"), "part").select("asked", score.alias("score"), "hit").filter(F.col("score") >= MIN_SCORE))


def _extended(rows: DataFrame, k: int) -> DataFrame:
    """Keys of ``k`` words: each key with every word behind its last one that can be the ``k``-th shared word of a match."""
    end = F.size("words") - F.greatest("need", F.lit(k)) + k - 1
    others = [c for c in rows.columns if c not in ("key", "last")]
    longer = rows.filter(F.col("last") < end).select("*", F.explode(F.sequence(F.col("last") + 1, end)).alias("at"))
    return longer.select(*others, F.concat("key", F.array(F.get("words", "at"))).alias("key"), F.col("at").alias("last"))


def _best(found: DataFrame) -> DataFrame:
    """Highest score per set, ties to the earliest registry row."""
    return found.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("s"), "hit")).alias("b")).select(
        "asked", (-F.col("b.s")).alias("score"), F.col("b.hit").alias("hit"))


def _scoring(a: DataFrame, b: DataFrame, score: float) -> DataFrame:
    """Best matches of at least ``score``, by keys of rare words that are split where many registry sets have one."""
    none = {"key": F.array().cast("array<bigint>"), "last": F.lit(-1)}
    a, b = (side.withColumns({"need": _least_shared(F.col("size"), score), **none}) for side in (a, b))
    a, b = cut_lineage(_extended(_extended(a, 1), 2)), _extended(_extended(b, 1), 2)
    found, k = None, 2
    while True:
        # joins by merging: written sets are compressed many times over, so by their size the planner would send them
        # through the driver, those of all rounds at once
        b = cut_lineage(b.join(a.select("key").distinct().hint("merge"), "key", "left_semi"))
        hot = cut_lineage(b.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT_ROWS).select("key"))
        other = b.join(hot.hint("merge"), "key", "left_anti").select(
            "key", "hit", F.col("words").alias("other"), F.col("size").alias("n"), F.col("need").alias("need_n"), F.col("last").alias("last_n"))
        behind = F.least(F.size("words") - F.col("last"), F.size("other") - F.col("last_n")) - 1
        near = (F.least("size", "n") >= F.greatest("size", "n") * score) & (behind + k >= F.greatest("need", "need_n"))
        overlap = F.size(F.array_intersect("words", "other"))
        verified = a.join(other.hint("merge"), "key").filter(near).select(
            "asked", overlap.alias("o"), (overlap / F.greatest("size", "n")).alias("score"), "hit")
        verified = _best(verified.filter((F.col("o") >= MIN_OVERLAP) & (F.col("score") >= score)).select("asked", "score", "hit"))
        verified = cut_lineage(verified)  # a round is run by itself: the plan of the result does not hold all of them
        found = verified if found is None else found.unionByName(verified)
        if hot.isEmpty():
            return _best(found)
        a, b = (cut_lineage(side.join(hot.hint("merge"), "key", "left_semi")) for side in (a, b))
        first = b.filter(F.col("need") <= k).groupBy("key", F.col("size").alias("n")).agg(F.min("hit").alias("hit"))
        whole = a.filter(F.col("need") <= k).join(first.hint("merge"), "key").select(
            "asked", (F.lit(k) / F.greatest("size", "n")).alias("score"), "hit").filter(F.col("score") >= score)
        found, k = found.unionByName(whole), k + 1
        a, b = cut_lineage(_extended(a, k)), _extended(b, k)


def token_overlap(asked: DataFrame, registered: DataFrame) -> DataFrame:
    """Best registry row per distinct word set.

    ``asked`` has distinct ``words``; ``registered`` has distinct ``words`` and ``hit`` (first registry row of that set).
    Equal sets are one row on both sides, so copies of a name cost nothing. Sets travel as the numbers of their words,
    registry rows as their place in the order of ``hit``.

    Only the best match is asked for, so sets with a near one leave first. Where a match lacks one word at most on either
    side, one that lacks more needs a set of twice the size to score as well, which is below ``MIN_SCORE``. The others go
    through ``SCORES``: what has a match of a score has its best one among all of that score.

    Each score is a positional prefix filter for sets of every size: words are ordered by rarity, and sets that match share
    their first two common words, which lie so far in front that enough others can follow in both. Pairs with a common key
    of two words, of near sizes and with enough words left are verified. A key that more than ``SPLIT_ROWS`` registry sets
    have is not joined: its rows are split by their next word into keys of three words, and so on. Rows that need no more
    words than such a key has match every registry row that needs no more; of these the first one of each size stands for
    all. So a key never pairs more than ``SPLIT_ROWS`` rows with an asked one, whatever words most names share. The driver
    goes on for as many rounds as the longest key that many sets share has words.
    """
    enough = F.size("words") >= MIN_OVERLAP
    registered = _numbered(registered.filter(enough), "no", ["hit"])
    asked = _numbered(asked.filter(enough).select("words"), "asked")
    frequency = registered.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    places = _numbered(frequency, "place", ["n", "word"]).drop("n")
    b = _by_rarity(registered, places, "no").withColumnRenamed("no", "hit")
    a = _by_rarity(asked, places, "asked").filter(F.size("words") >= _least_shared(F.col("size"), MIN_SCORE))
    best = found = cut_lineage(_near_equal(a, b))
    for score in SCORES:
        a = cut_lineage(a.join(found.select("asked").hint("merge"), "asked", "left_anti"))
        if a.isEmpty():
            break
        found = cut_lineage(_scoring(a, b, score))
        best = best.unionByName(found)
    named = best.join(asked.hint("merge"), "asked").withColumnRenamed("hit", "no").join(registered.select("no", "hit").hint("merge"), "no")
    return named.select("words", "score", "hit")


def token_overlap_match(names: DataFrame, lookup: DataFrame, norm: str = "INST_NAME_NORM") -> DataFrame:
    """Fill rows that have no match yet by word overlap."""
    words = cut_lineage(names.withColumn("words", _words(norm)))  # names are normalised once, for the search and the result
    open_names = words.filter(F.col("SEC_MATCH_TYPE").isNull()).select("words").distinct()
    # written, as a filter on words would be moved before the rows are dealt, and names be normalised in the tasks of the file
    titles = cut_lineage(lookup.select(_words("__norm").alias("words"), F.struct("__seq", "SEC_CIK", "SEC_TICKER", "SEC_TITLE").alias("hit")))
    registered = titles.groupBy("words").agg(F.min("hit").alias("hit"))
    best = token_overlap(open_names, registered).withColumnRenamed("words", "__w")
    joined = words.join(best.hint("merge"), (words["words"] == best["__w"]) & words["SEC_MATCH_TYPE"].isNull(), "left")
    kind = F.concat(F.lit("fuzzy_"), F.format_string("%.2f", F.bround("score", 2)))
    return joined.withColumns({
        "SEC_CIK": F.coalesce("SEC_CIK", "hit.SEC_CIK"), "SEC_TICKER": F.coalesce("SEC_TICKER", "hit.SEC_TICKER"),
        "SEC_TITLE": F.coalesce("SEC_TITLE", "hit.SEC_TITLE"),
        "SEC_MATCH_TYPE": F.coalesce("SEC_MATCH_TYPE", F.when(F.col("score").isNotNull(), kind)),
    }).drop("words", "__w", "score", "hit")


def holder_name_preference(institutions: DataFrame, holders: DataFrame, on: str,
                           norm: str = "INST_NAME_NORM") -> DataFrame:
    """Use the top holder's normalised name where there is one (first row per entity)."""
    side = holders.filter(F.col("ID_RSSD").isNotNull() & F.col("TOP_HOLDER_NAME").isNotNull()).groupBy(
        F.col("ID_RSSD").cast("bigint").alias("__id")).agg(F.min("TOP_HOLDER_NAME").alias("TOP_HOLDER_NAME"))
    joined = institutions.join(side, institutions[on].try_cast("bigint") == side["__id"], "left").drop("__id")
    joined = joined.withColumn("HC_NAME_NORM", normalize_name("TOP_HOLDER_NAME"))
    return joined.withColumn(norm, F.when(F.length("HC_NAME_NORM") > 0, F.col("HC_NAME_NORM")).otherwise(F.col(norm)))


def manual_override(mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace id and ticker of listed entities; the title stays, unknown entities are ignored."""
    keyed = mapping.withColumn("CERT", F.trim(F.col("CERT").cast("string")))
    return override_values(keyed, overrides, "CERT", {"SEC_CIK": "CIK", "SEC_TICKER": "TICKER"},
                           ("SEC_MATCH_TYPE", "override"))


def sec_mapping(institutions: DataFrame, registry: DataFrame, overrides: DataFrame | None = None,
                holders: DataFrame | None = None, seq: str = "SEQ",
                keep: Sequence[str] = ("FED_RSSD", "RSSDID", "RSSDHCR", "NAME", "NAMEFULL")) -> DataFrame:
    """Entity to registrant: holder name, exact match, word overlap, overrides."""
    name = "NAME" if "NAME" in institutions.columns else "NAMEFULL"
    lookup = cut_lineage(registry_lookup(registry, seq))  # read for equal names and for word sets
    inst = dealt(institutions).withColumn("INST_NAME_NORM", normalize_name(name))
    on = present_columns(inst, ["FED_RSSD", "RSSDID"])
    if holders is not None and on:
        inst = holder_name_preference(inst, holders, on[0])
    matched = token_overlap_match(exact_name_match(inst, lookup), lookup)
    if overrides is not None:
        matched = manual_override(matched, overrides)
    return matched.select("CERT", *present_columns(matched, keep), *MATCH_COLUMNS)
