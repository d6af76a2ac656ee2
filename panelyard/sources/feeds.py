"""Rate feeds, registries and filing indexes as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.scalars import ColumnLike, as_col, number, parse_report_date
from panelyard.operators.windows import keep_last

# Tenors of the yield history.
TENORS = ["1MO", "2MO", "3MO", "4MO", "6MO", "1YR", "2YR", "3YR", "5YR", "7YR", "10YR", "20YR", "30YR"]
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def yield_feed_name(name: str) -> str:
    """``NEW_DATE`` is the date, ``BC_10YEAR`` becomes ``YC_10YR``, other names go to upper case."""
    upper = re.sub(r"^(\{.*\}|.*:)", "", name).upper()
    if upper == "NEW_DATE":
        return "DATE"
    if upper.startswith("BC_"):
        return "YC_" + upper[3:].replace("MONTH", "MO").replace("YEAR", "YR")
    return upper


def yield_feed(df: DataFrame) -> DataFrame:
    """Rename feed columns by rule; yields become numbers and the date a date."""
    df = df.toDF(*[yield_feed_name(c) for c in df.columns])
    out = {c: number(c) for c in df.columns if c.startswith("YC_")}
    if "DATE" in df.columns:
        out["DATE"] = parse_report_date(F.substring(F.col("DATE").cast("string"), 1, 10))
    return df.withColumns(out) if out else df


def _feed_fields() -> str:
    tenors = [t.replace("MO", "MONTH").replace("YR", "YEAR") for t in TENORS]
    return ", ".join(f"{n} string" for n in ["NEW_DATE", *[f"BC_{t}" for t in tenors]])


def read_yield_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of Atom feed files. The schema is declared (all tenors as text), so nothing is inferred."""
    reader = spark.read.format("xml").option("rowTag", "properties").option("ignoreNamespace", "true")
    return yield_feed(reader.schema(_feed_fields()).load(path))


def yield_xml_rows(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of Atom feed documents held in a column."""
    schema = f"entry array<struct<content: struct<properties: struct<{_feed_fields().replace(' string', ': string')}>>>>"
    parsed = documents.select(F.from_xml(xml, schema, {"ignoreNamespace": "true"}).alias("x"))
    return yield_feed(parsed.select(F.explode("x.entry").alias("e")).select("e.content.properties.*"))


def yield_columns(df: DataFrame) -> DataFrame:
    """``"10 Yr"`` becomes ``YC_10YR``; the date column becomes ``DATE``."""
    def rename(name: str) -> str:
        clean = name.strip()
        return "DATE" if clean.lower() == "date" else "YC_" + clean.upper().replace(" ", "")

    return df.toDF(*[rename(c) for c in df.columns])


OBSERVATIONS = "struct<observations:array<struct<date:string,value:string>>>"


def series_observations(payloads: DataFrame, payload: str = "payload", series: str = "series") -> DataFrame:
    """JSON observations to (series, DATE, VALUE); ``.`` is missing, bad dates go, the last per date stays."""
    rows = payloads.select(series, F.posexplode(F.from_json(payload, OBSERVATIONS)["observations"]).alias("__p", "o"))
    rows = rows.select(series, F.col("o.date").try_cast("date").alias("DATE"), "__p", number(F.col("o.value")).alias("VALUE"))
    rows = rows.filter(F.col("DATE").isNotNull())
    return keep_last(rows, [series, "DATE"], ["__p"]).drop("__p")


def series_pivot(long: DataFrame, ids: Sequence[str], series: str = "series", value: str = "VALUE") -> DataFrame:
    """Series side by side on the date; a date any series has is kept."""
    listed = long.filter(F.col(series).isin(list(ids)))
    return listed.groupBy("DATE").agg(*[F.max(F.when(F.col(series) == i, F.col(value))).alias(i) for i in ids])


def pad_id(value: ColumnLike, width: int = 10) -> Column:
    """Zero-pad on the left; longer ids stay whole."""
    text = as_col(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


RECORDS = "map<string,struct<cik_str:string,cik:string,ticker:string,title:string>>"
FIELDS = "struct<fields:array<string>,data:array<array<string>>>"


def registry_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Registry documents in either layout to (TICKER, CIK): records by key, or fields and data rows."""
    table = F.from_json(payload, FIELDS)
    by_rows = payloads.select(table.alias("t")).filter(F.col("t.fields").isNotNull()).select(
        F.col("t.fields").alias("f"), F.explode("t.data").alias("d"))

    def cell(name: str) -> Column:
        # get() is 0-based and gives NULL past the end of a short row
        return F.get("d", (F.array_position("f", F.lit(name)) - 1).cast("int"))

    listed = by_rows.filter(F.array_contains("f", "ticker") & F.array_contains("f", "cik")).select(
        F.upper(cell("ticker")).alias("TICKER"), pad_id(cell("cik")).alias("CIK"))
    listed = listed.filter(F.col("TICKER").isNotNull() & F.col("CIK").isNotNull())
    records = payloads.filter(table["fields"].isNull()).select(
        F.explode(F.map_values(F.from_json(payload, RECORDS))).alias("r"))
    keyed = records.select(
        F.trim(F.upper("r.ticker")).alias("TICKER"),
        pad_id(F.trim(F.coalesce("r.cik_str", "r.cik"))).alias("CIK"))
    keyed = keyed.filter((F.length("TICKER") > 0) & F.coalesce(F.length("CIK") > 0, F.lit(False)))
    return listed.unionByName(keyed)


def parallel_arrays_to_rows(df: DataFrame, arrays: str, keep: Sequence[str] = ()) -> DataFrame:
    """A struct of arrays to one row per position; short arrays are padded with NULL."""
    names = [f.name for f in df.schema[arrays].dataType.fields]
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(f"{arrays}.{n}").alias(n) for n in names])))


def filing_url(cik: ColumnLike, accession: ColumnLike, document: ColumnLike) -> Column:
    return F.concat(F.lit(ARCHIVE), as_col(cik).cast("bigint").cast("string"), F.lit("/"),
                    F.replace(as_col(accession), F.lit("-"), F.lit("")), F.lit("/"), as_col(document))


def filing_filter_limit(filings: DataFrame, forms: Sequence[str], first: int, order: Sequence[Column],
                        issuer: str = "CIK") -> DataFrame:
    """The first filings of the wanted forms per issuer, with their address.

    The per-issuer limit is the operator; Spark cuts each task to it before the shuffle.
    """
    from panelyard.operators.windows import top_k

    wanted = filings.filter(
        F.upper("FORM").isin([f.upper() for f in forms]) & (F.length("ACCESSION") > 0) & (F.length("DOCUMENT") > 0))
    kept = top_k(wanted, [issuer], first, order, "POSITION")
    return kept.withColumn("FILING_URL", filing_url(issuer, "ACCESSION", "DOCUMENT"))


def filing_facts(filings: DataFrame, html: str = "HTML", mapping: DataFrame | None = None, issuer: str = "CIK") -> DataFrame:
    """Disclosed amount and mentions per filing row; other columns of ``filings`` (form, dates, address) stay.

    ``mapping`` (CERT, SEC_CIK, SEC_TICKER) names the entities of each issuer: a filing has a row for each of them, and
    filings of unmapped issuers are left out. Documents are read before, once each.
    """
    from panelyard.functions.text import disclosed_amount, html_text, mention_flags

    read = filings.withColumn("__text", html_text(html))
    facts = read.withColumns({**disclosed_amount(html, "__text"), **mention_flags("__text")}).drop("__text")
    if mapping is None:
        return facts
    entities = mapping.filter(F.col("SEC_CIK").isNotNull()).select("CERT", F.col("SEC_CIK").cast("bigint").alias("SEC_CIK"), "SEC_TICKER")
    return facts.join(entities, F.col(issuer).cast("bigint") == F.col("SEC_CIK"))
