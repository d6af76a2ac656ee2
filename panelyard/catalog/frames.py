"""Star-schema tables seen as filings: the inputs of the registered queries.

A supplier is an entity, its shipped lines of a quarter are its balance sheet, order
prices are daily rates. All tables are read whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scalars import quarter_end
from panelyard.session import cut_lineage, scratch_path
from panelyard.sources.archives import csv_line, write_archives

# Size bands that split the surrogate entities into four groups.
BANDS = [("community", 0.0, 0.9e6), ("regional", 0.9e6, 1.2e6), ("large_regional", 1.2e6, 1.5e6),
         ("very_large", 1.5e6, None)]
# Back-test years and episodes of the shipped dates.
FIRST_YEAR, LAST_YEAR = 1995, 2001
EPISODES = {"full_sample": (None, None), "early": ("1996-01-01", "1997-12-31"),
            "middle": ("1998-01-01", "1999-12-31"), "late": ("2000-01-01", "2001-12-31")}
QUARTER = "2000-12-31"


def when(condition: str, otherwise: str = "") -> str:
    return f"sum(CASE WHEN {condition} THEN l_extendedprice {otherwise} END)"


# Balance-sheet items as portable aggregates over the lines of an entity and quarter.
MEASURES = {
    "ASSET": "sum(l_extendedprice * (1 + l_tax))",
    "DEPDOM": "sum(l_extendedprice)",
    "DEPUNA": when("l_returnflag = 'R'", "ELSE 0"),
    "BRO": when("l_returnflag = 'A' AND l_linestatus = 'F'"),
    "DEPLSNB": when("l_discount >= 0.09"),
    "IDDEPLAM": when("l_extendedprice > 50000"),
    "IDDEPSAM": when("l_extendedprice <= 50000"),
    "COREDEP": when("l_linestatus = 'F'", "ELSE 0"),
    "DEPNIDOM": when("l_returnflag = 'N'"),
    "DDT": when("l_linenumber = 1"),
    "TRN": when("l_linenumber <= 2"),
    "NTRSMMDA": when("l_linenumber = 3"),
    "NTRSOTH": when("l_linenumber = 4"),
    "NTRTIME": when("l_linenumber >= 5"),
    "IDCD3LES": when("l_linenumber >= 5 AND l_quantity <= 6"),
    "IDCD3T12": when("l_linenumber >= 5 AND l_quantity > 6 AND l_quantity <= 12"),
    "IDCD1T3": when("l_linenumber >= 5 AND l_quantity > 12 AND l_quantity <= 18"),
    "IDCDOV3": when("l_linenumber >= 5 AND l_quantity > 18 AND l_quantity <= 25"),
    "IDCD3LESS": when("l_linenumber >= 5 AND l_quantity > 25 AND l_quantity <= 31"),
    "IDCD3T12S": when("l_linenumber >= 5 AND l_quantity > 31 AND l_quantity <= 37"),
    "IDCD1T3S": when("l_linenumber >= 5 AND l_quantity > 37 AND l_quantity <= 44"),
    "IDCDOV3S": when("l_linenumber >= 5 AND l_quantity > 44"),
    "CD3LES": when("l_linenumber = 6"),
    "CD1T3S": when("l_linenumber = 7"),
    "EDEPDOMQ": "sum(l_extendedprice * l_discount) / 4",
    "ASSTLT": when("l_quantity > 40"),
    "VOLIAB": when("l_quantity < 10", "ELSE 0"),
    "LNLSNET": when("l_quantity >= 20"),
    "IDLNCORR": "sum(l_quantity)",
    "CHBAL": when("l_tax < 0.015"),
    "FREPO": when("l_tax >= 0.015 AND l_tax < 0.025"),
    "SCUST": when("l_tax >= 0.025 AND l_tax < 0.045"),
    "SCAGE": when("l_tax >= 0.045 AND l_tax < 0.055"),
    "SCAF": when("l_tax >= 0.025 AND l_tax < 0.075"),
    "SC": when("l_tax >= 0.025"),
    "SCPLEDGE": when("l_discount >= 0.065"),
    "SCRDEBT": when("l_tax >= 0.035"),
    "SCNM3LES": when("l_tax >= 0.025 AND l_quantity <= 8"),
    "SCNM3T12": when("l_tax >= 0.025 AND l_quantity > 8 AND l_quantity <= 16"),
    "SCNM1T3": when("l_tax >= 0.025 AND l_quantity > 16 AND l_quantity <= 24"),
    "SCNM3T5": when("l_tax >= 0.025 AND l_quantity > 24 AND l_quantity <= 32"),
    "SCNM5T15": when("l_tax >= 0.025 AND l_quantity > 32 AND l_quantity <= 40"),
    "SCNMOV15": when("l_tax >= 0.025 AND l_quantity > 40"),
    "OTBFH1L": when("l_discount < 0.015"),
    "OTBFH1T3": when("l_discount >= 0.015 AND l_discount < 0.035"),
    "OTBFH3T5": when("l_discount >= 0.035 AND l_discount < 0.055"),
    "OTBFHOV5": when("l_discount >= 0.055 AND l_discount < 0.075"),
    "OTHBFHLB": when("l_discount < 0.065"),
}
# What the measures and the holder id read of a line.
LINE_COLUMNS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
# Holder id of a quarter: changes between quarters, unknown in some.
HOLDER = "max(CASE WHEN l_returnflag = 'A' THEN l_linenumber END)"

# Daily rates as the mean order price of one priority.
RATE_PRIORITIES = {"YC_3MO": "1-URGENT", "YC_2YR": "2-HIGH", "YC_10YR": "3-MEDIUM", "IORB": "4-NOT SPECIFIED",
                   "RRPONTSYAWARD": "5-LOW"}
YIELD_COLUMNS = ["YC_3MO", "YC_2YR", "YC_10YR"]
RATE_COLUMNS = ["IORB", "RRPONTSYAWARD"]


class Frames:
    """Inputs of one run, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def financials(self) -> DataFrame:
        """One row per entity and quarter; lines are summed before anything is joined.

        A group has a few dozen lines, dealt over all of the input, so sums before the shuffle are nearly one row of all
        measures per line; the narrow lines are sent instead, once, and summed where they arrive.
        """
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("__s"), quarter_end(F.col("l_shipdate").cast("date")).alias("REPDTE"), *LINE_COLUMNS)
        return lines.repartition("__s", "REPDTE").groupBy("__s", "REPDTE").agg(
            F.expr(HOLDER).cast("bigint").alias("RSSDHCR"),
            *[F.round(F.expr(e), 6).alias(n) for n, e in MEASURES.items()])

    @cached_property
    def institutions(self) -> DataFrame:
        """One row per entity: id, filer id, name, state, charter class."""
        nation = self.table("nation")  # bounded: one row per nation
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").cast("string").alias("CERT"), F.col("s_suppkey").alias("FED_RSSD"),
            F.col("s_name").alias("NAMEFULL"), F.col("n_name").alias("STALP"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("BKCLASS"),
            F.col("s_acctbal").alias("EQ"))

    @cached_property
    def panel(self) -> DataFrame:
        names = self.institutions.select(F.col("FED_RSSD").alias("__s"), "CERT", "NAMEFULL", "STALP", "BKCLASS", "EQ")
        return self.financials.join(names, "__s").drop("__s")

    @cached_property
    def written_panel(self) -> DataFrame:
        """The panel written once, for pipelines that read it several times: it is far
        smaller than the lines it sums, which are then scanned once."""
        return cut_lineage(self.panel)

    @cached_property
    def branch(self) -> DataFrame:
        """One row per line: entity, year, deposit, branch, state and county."""
        nation = self.table("nation")
        place = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("STALPBR"),
            F.concat("n_name", F.lit("/"), "c_mktsegment").alias("CNTYNAMB"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(place, "o_custkey")
        return self.table("lineitem").join(orders, "l_orderkey").select(
            F.col("l_suppkey").cast("string").alias("CERT"), F.year("l_shipdate").alias("YEAR"),
            F.col("l_extendedprice").alias("DEPSUMBR"), F.col("l_partkey").alias("UNINUMBR"), "STALPBR", "CNTYNAMB")

    def _daily(self, names: list[str]) -> DataFrame:
        """Mean price per business day and priority; a weekend's orders count to the Friday before."""
        day = F.col("o_orderdate").cast("date")
        day = F.date_sub(day, F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0))
        return self.table("orders").groupBy(day.alias("DATE")).agg(*[
            F.round(F.avg(F.when(F.col("o_orderpriority") == RATE_PRIORITIES[n], F.col("o_totalprice"))) / 50000.0, 10)
            .alias(n) for n in names])

    @cached_property
    def yields(self) -> DataFrame:
        return self._daily(YIELD_COLUMNS)

    @cached_property
    def rates(self) -> DataFrame:
        return self._daily(RATE_COLUMNS)

    @cached_property
    def failures(self) -> DataFrame:
        """Entities with a low balance fail on the day of their largest shipment."""
        largest = self.table("lineitem").groupBy("l_suppkey").agg(
            F.max(F.struct("l_extendedprice", F.col("l_shipdate").cast("date").alias("d")))["d"].alias("FAILDATE"))
        low = self.table("supplier").filter(F.col("s_acctbal") < 2000)
        return low.join(largest, F.col("s_suppkey") == F.col("l_suppkey")).select(
            F.col("s_suppkey").cast("double").alias("CERT"), "FAILDATE")

    @cached_property
    def edges(self) -> DataFrame:
        """Ownership tree over all entities; the first one owns itself."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("ID_RSSD_OFFSPRING"),
            F.floor(F.col("s_suppkey") / 3).cast("bigint").alias("ID_RSSD_PARENT"))

    def codes(self, names: list[str]) -> DataFrame:
        """Schedule facts: each line counts for one code, summed per filer, date and code."""
        spot = (F.col("l_quantity").cast("int") + F.col("l_linenumber") * 7) % len(names)
        code = F.element_at(F.array(*[F.lit(n) for n in names]), spot + 1)
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("IDRSSD"), quarter_end(F.col("l_shipdate").cast("date")).alias("REPDTE"),
            code.alias("CODE"), "l_extendedprice")
        # few lines of a filer and date share a code: they are sent once, to where filers are put together
        return lines.repartition("IDRSSD", "REPDTE").groupBy("IDRSSD", "REPDTE", "CODE").agg(F.round(F.sum("l_extendedprice"), 6).alias("VALUE"))

    def schedule_archives(self, names: list[str], dealt: int = 4) -> str:
        """Folder of schedule archives with the facts of ``codes``: per quarter ``dealt`` archives of some filers each, in
        two parts. The middle code stands in both; the second part holds twice its value, which must not count."""
        half = len(names) // 2
        parts = {"Schedule RCCI (1 of 2).txt": names[:half + 1], "Schedule RCCI (2 of 2).txt": names[half:]}
        facts = F.map_from_entries(F.collect_list(F.struct("CODE", "VALUE"))).alias("facts")  # a row per code at most
        wide = cut_lineage(self.codes(names).groupBy("IDRSSD", "REPDTE").agg(facts).withColumn("archive", F.concat(
            F.lit("Call Bulk "), F.date_format("REPDTE", "MMddyyyy"), F.lit(" "), F.pmod(F.xxhash64("IDRSSD"), F.lit(dealt)).cast("string"), F.lit(".zip"))))
        labels = self.table("part").filter(F.col("p_partkey") <= len(names)).agg(F.map_from_entries(F.collect_list(F.struct("p_partkey", "p_name"))).alias("m"))
        out = None
        for second, (part, have) in enumerate(parts.items()):
            values = F.transform(F.array(*[F.lit(c) for c in have]), lambda c: F.coalesce(
                (F.col("facts")[c] * F.when(c == F.lit(names[half] if second else ""), 2).otherwise(1)).cast("string"), F.lit("")))
            data = wide.filter(F.arrays_overlap(F.map_keys("facts"), F.array(*[F.lit(c) for c in have]))).select("archive", F.lit(part).alias("part"), (F.col("IDRSSD") + 2).alias("line_number"),
                                                                      F.concat_ws("\t", F.col("IDRSSD").cast("string"), F.array_join(values, "\t")).alias("line"))
            texts = F.concat_ws("\t", F.lit(""), *[F.concat(F.lit('" '), F.coalesce(F.col("m")[F.lit(names.index(c) + 1).cast("bigint")], F.lit("")), F.lit(f' {second + 1} "')) for c in have])
            archives = data.select("archive", "part").distinct()
            heads = archives.select("archive", "part", F.lit(0).cast("bigint").alias("line_number"), F.lit("\t".join(['"IDRSSD"', *have])).alias("line")).unionByName(
                archives.withColumn("m", labels.scalar()).select("archive", "part", F.lit(1).cast("bigint").alias("line_number"), texts.alias("line")))
            both = data.unionByName(heads)
            out = both if out is None else out.unionByName(both)
        folder = scratch_path(self.spark, "schedules")
        write_archives(out, folder)
        return folder

    def csv_archives(self, df: DataFrame, key: str, dealt: int = 8) -> str:
        """Folder of Latin-1 CSV archives of a table, dealt out by ``key``; the first name carries a ``#``."""
        named = df.select(F.concat(F.lit("rows "), F.pmod(F.xxhash64(key), F.lit(dealt)).cast("string"), F.lit(".zip")).alias("archive"),
                          F.lit("TABLE.CSV").alias("part"), F.monotonically_increasing_id().alias("n"), csv_line(*[F.col(c) for c in df.columns]).alias("line"))
        data = named.select("archive", "part", (F.col("n") + 1).alias("line_number"), "line")
        head = data.select("archive", "part").distinct().withColumns({"line_number": F.lit(0).cast("bigint"), "line": F.lit("#" + ",".join(df.columns))})
        folder = scratch_path(self.spark, "csv")
        write_archives(data.unionByName(head), folder, "latin-1")
        return folder

    @cached_property
    def named_institutions(self) -> DataFrame:
        """Entities whose names resemble, equal or miss registry titles."""
        small, large = F.col("p_size") <= 15, F.col("p_size") > 35
        name = (F.when(small, F.concat_ws(" ", "p_brand", "p_name", F.lit("Bank, N.A.")))
                .when(large, F.concat_ws(" ", F.lit("First"), "p_type", "p_name", F.lit("Bancorp Inc.")))
                .otherwise(F.concat_ws(" ", F.lit("National Bank of"), "p_name", "p_type", "p_brand", F.lit("Co"))))
        return self.table("part").select(F.col("p_partkey").cast("string").alias("CERT"),
                                         F.col("p_partkey").alias("FED_RSSD"), name.alias("NAME"))

    @cached_property
    def registry(self) -> DataFrame:
        """Registrants in file order."""
        title = F.concat_ws(" ", "p_brand", "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("Bank"))
                            .otherwise(F.lit("Financial Group, Inc.")))
        return self.table("part").select(
            F.col("p_partkey").alias("SEQ"), (F.col("p_partkey") + 1000000).alias("CIK_STR"),
            F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("TICKER"), title.alias("TITLE"))
