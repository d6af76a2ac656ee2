"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.fragments import FRAGMENTS, codes
from panelyard.catalog.registry import query
from panelyard.operators.hierarchy import current_edges, entity_attributes
from panelyard.plans.publish import rows_to_json
from panelyard.plans.repricing import REPRICING_CODES
from panelyard.session import scratch_path
from panelyard.sources import archives, feeds, schedules, tables
from panelyard.sources.text_files import keyword_line_scan

FRAGMENTS["v_codes"] = codes(REPRICING_CODES)


@query("scan_table", "O_ORDERKEY O_CUSTKEY O_ORDERSTATUS O_TOTALPRICE O_ORDERDATE:d O_ORDERPRIORITY", "orders")
def scan_table(f):
    return tables.scan_table(f.spark, f.path("orders"))


@query("union_by_name", "ID NAME SEGMENT ACCTBAL",
       "SELECT c_custkey AS ID, c_name AS NAME, c_mktsegment AS SEGMENT, NULL::DOUBLE AS ACCTBAL FROM customer "
       "UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_by_name(f):
    customers = f.table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = f.table("supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS acctbal")
    return tables.union_by_name([customers, suppliers])


@query("scan_csv", "C_CUSTKEY C_NAME C_MKTSEGMENT C_ACCTBAL:r",
       "SELECT c_custkey::BIGINT AS C_CUSTKEY, c_name AS C_NAME, c_mktsegment AS C_MKTSEGMENT, c_acctbal AS C_ACCTBAL FROM customer")
def scan_csv(f):
    """Written as CSV and read back as text, with the numeric columns found again."""
    path = scratch_path(f.spark, "sink") + ".csv"
    tables.sink_table(f.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    df = tables.promote_numeric_columns(tables.scan_table(f.spark, path))
    return df.withColumn("C_CUSTKEY", F.col("C_CUSTKEY").cast("bigint"))


@query("scan_tables", "KEY TOTAL:r NAME",
       "SELECT o_orderkey AS KEY, o_totalprice AS TOTAL, NULL AS NAME FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def scan_tables(f):
    """One file for each order status and market segment, of two shapes: two scans."""
    folder, paths = scratch_path(f.spark, "many"), []
    for table, by, columns in (("orders", "o_orderstatus", ["o_orderkey AS key", "o_totalprice AS total"]),
                               ("customer", "c_mktsegment", ["c_custkey AS key", "c_name AS name"])):
        df = f.table(table)
        for (value,) in df.select(by).distinct().collect():  # a handful of codes
            paths.append(f"{folder}/{table} {value}.parquet")
            tables.sink_table(df.filter(F.col(by) == value).selectExpr(*columns), paths[-1])
    return tables.scan_tables(f.spark, paths)


@query("sink_table", "CERT REPDTE:d ASSET:r DEPDOM:r DDT:r", "v_panel")
def sink_table(f):
    path = scratch_path(f.spark, "sink") + ".parquet"
    tables.sink_table(f.panel.select("CERT", "REPDTE", "ASSET", "DEPDOM", "DDT"), path, ["REPDTE"])
    return f.spark.read.parquet(path)


@query("schedule_ingest", "IDRSSD REPDTE:d " + " ".join(f"{c}:r" for c in REPRICING_CODES),
       "SELECT IDRSSD, REPDTE, " + ", ".join(f"max(CASE WHEN CODE = '{c}' THEN VALUE END) AS {c}" for c in REPRICING_CODES)
       + " FROM v_codes GROUP BY 1, 2")
def schedule_ingest(f):
    """Written as archives of two parts with a code in both, and read back."""
    return schedules.read_schedules(f.spark, f.schedule_archives(REPRICING_CODES), ["Schedule RCCI"], REPRICING_CODES)


_HALF = len(REPRICING_CODES) // 2
_SECOND = ", ".join(f"('{c}', {i + 1}, {1 if i < _HALF else 2})" for i, c in enumerate(REPRICING_CODES))


@query("schedule_labels", "CODE LABEL",
       f"SELECT CODE, p_name || ' ' || n AS LABEL FROM (VALUES {_SECOND}) AS c(CODE, i, n) JOIN part ON p_partkey = i")
def schedule_labels(f):
    """The label lines of the same archives; the last part's label counts."""
    lines = archives.archive_lines(f.spark, f.schedule_archives(REPRICING_CODES), ["Schedule RCCI"])
    return schedules.schedule_labels(schedules.schedule_cells(lines))


@query("edges_ingest", "ID_RSSD_PARENT ID_RSSD_OFFSPRING RELN_LVL PCT_EQUITY",
       "SELECT DISTINCT o_custkey AS ID_RSSD_PARENT, CAST(floor(o_totalprice / 1000) AS BIGINT) AS ID_RSSD_OFFSPRING, "
       "1.0e0 AS RELN_LVL, 'é, \"' || o_orderpriority AS PCT_EQUITY FROM orders "
       "WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'O'")
def edges_ingest(f):
    """Written as Latin-1 CSV archives with accents, commas and quotes in cells, and read back."""
    raw = f.table("orders").select(
        F.col("o_custkey").cast("string").alias("ID_RSSD_PARENT"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("ID_RSSD_OFFSPRING"),
        F.lit("1").alias("RELN_LVL"), F.concat(F.lit('é, "'), "o_orderpriority").alias("PCT_EQUITY"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("DT_END"),
        F.when(F.col("o_orderstatus") == "O", "1").when(F.col("o_orderstatus") == "F", "x").otherwise("0").alias("CTRL_IND"))
    return current_edges(archives.latin1_table(f.spark, f.csv_archives(raw, "ID_RSSD_PARENT"), []), 19980101)


@query("entity_attributes", "ID_RSSD NM_LGL ENTITY_TYPE",
       "SELECT c_nationkey::BIGINT AS ID_RSSD, arg_max('Société ' || c_name, c_custkey) AS NM_LGL, "
       "arg_max(c_mktsegment, c_custkey) AS ENTITY_TYPE FROM customer GROUP BY 1")
def attributes(f):
    raw = f.table("customer").select(
        F.col("c_nationkey").cast("string").alias("ID_RSSD"), F.concat(F.lit("  Société "), "c_name", F.lit(" ")).alias("NM_LGL"),
        F.col("c_mktsegment").alias("ENTITY_TYPE"), F.col("c_custkey").alias("SEQ"))
    read = archives.latin1_table(f.spark, f.csv_archives(raw, "SEQ"), [])
    return entity_attributes(read.withColumn("SEQ", F.col("SEQ").try_cast("bigint")), ["SEQ"])


@query("yield_xml", "DATE:d YC_3MO YC_2YR YC_10YR", "v_yields")
def yield_xml(f):
    value = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<d:{t}>"), F.col(c).cast("string"), F.lit(f"</d:{t}>")))
             for c, t in (("YC_3MO", "BC_3MONTH"), ("YC_2YR", "BC_2YEAR"), ("YC_10YR", "BC_10YEAR"))]
    return feeds.yield_xml_rows(f.yields.select(F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:d="d" xmlns:m="m"><entry><content><m:properties><d:NEW_DATE>'),
        F.date_format("DATE", "yyyy-MM-dd"), F.lit("T00:00:00</d:NEW_DATE>"), F.concat_ws("", *value),
        F.lit("</m:properties></content></entry></feed>")).alias("xml")))


@query("yield_columns", "DATE:d YC_3MO YC_2YR YC_10YR", "v_yields")
def yield_columns(f):
    return feeds.yield_columns(f.yields.toDF("Date ", "3 Mo", "2 Yr", "10 yr"))


@query("series_observations", "SERIES DATE:d VALUE",
       """SELECT SERIES, DATE, r.v AS VALUE FROM (SELECT SERIES, DATE, max({'p': p, 'v': v}) AS r FROM (
 SELECT o_orderpriority AS SERIES, CAST(o_orderdate AS DATE) AS DATE, 0 AS p, o_totalprice AS v FROM orders
 UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS DATE) + 30, 1, NULL FROM orders) GROUP BY 1, 2)""")
def series_observations(f):
    day = F.col("o_orderdate").cast("date")

    def seen(date, value):
        return F.struct(date.cast("string").alias("date"), value.alias("value"))

    payloads = f.table("orders").select(F.col("o_orderpriority").alias("SERIES"), F.to_json(F.struct(F.array(
        seen(day, F.col("o_totalprice").cast("string")), seen(F.date_add(day, 30), F.lit(".")),
        seen(F.lit("n/a"), F.lit("1"))).alias("observations"))).alias("payload"))
    return feeds.series_observations(payloads, series="SERIES")


@query("series_pivot", "DATE:d YC_3MO YC_2YR YC_10YR", "SELECT * FROM v_yields WHERE "
       "YC_3MO IS NOT NULL OR YC_2YR IS NOT NULL OR YC_10YR IS NOT NULL")
def series_pivot(f):
    long = f.yields.unpivot("DATE", ["YC_3MO", "YC_2YR", "YC_10YR"], "series", "VALUE").filter("VALUE IS NOT NULL")
    return feeds.series_pivot(long, ["YC_3MO", "YC_2YR", "YC_10YR"])


@query("registry_json", "TICKER CIK",
       "SELECT 'T' || c_custkey AS TICKER, CASE WHEN length(c_custkey::VARCHAR) < 10 THEN lpad(c_custkey::VARCHAR, 10, '0') "
       "ELSE c_custkey::VARCHAR END AS CIK FROM customer")
def registry_json(f):
    key = F.col("c_custkey").cast("string")
    by_fields = F.to_json(F.struct(
        F.array(F.lit("cik"), F.lit("name"), F.lit("ticker")).alias("fields"),
        F.array(F.array(key, F.col("c_name"), F.concat(F.lit("t"), key))).alias("data")))
    by_record = F.to_json(F.create_map(F.lit("0"), F.struct(
        F.col("c_custkey").alias("cik_str"), F.concat(F.lit("t"), key).alias("ticker"), F.col("c_name").alias("title"))))
    return feeds.registry_json(f.table("customer").select(
        F.when(F.col("c_acctbal") > 0, by_fields).otherwise(by_record).alias("payload")))


@query("parallel_arrays_to_rows", "o_orderkey word status",
       "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word, unnest([o_orderstatus]) AS status FROM orders")
def parallel_arrays(f):
    df = f.table("orders").select("o_orderkey", F.struct(
        F.split("o_orderpriority", "-").alias("word"), F.array("o_orderstatus").alias("status")).alias("recent"))
    return feeds.parallel_arrays_to_rows(df, "recent", ["o_orderkey"])


FRAGMENTS["v_filings"] = """SELECT o_custkey AS CIK, o_orderkey AS SEQ, CAST(o_orderdate AS DATE) AS FILING_DATE,
 CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '10-q' ELSE '8-K' END AS FORM,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE '0000-' || o_orderkey END AS ACCESSION, 'd' || o_orderkey || '.htm' AS DOCUMENT
 FROM orders"""
FRAGMENTS["v_kept_filings"] = """SELECT *, 'https://www.sec.gov/Archives/edgar/data/' || CIK || '/' || replace(ACCESSION, '-', '')
 || '/' || DOCUMENT AS FILING_URL, row_number() OVER (PARTITION BY CIK ORDER BY FILING_DATE DESC, SEQ) AS POSITION FROM v_filings
 WHERE upper(FORM) IN ('10-K', '10-Q') AND length(ACCESSION) > 0 QUALIFY POSITION <= 4"""


def filings(f):
    priority, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    form = (F.when(priority == "1-URGENT", "10-K").when(priority == "2-HIGH", "10-Q")
            .when(priority == "3-MEDIUM", "10-q").otherwise("8-K"))
    return f.table("orders").select(
        F.col("o_custkey").alias("CIK"), F.col("o_orderkey").alias("SEQ"), F.col("o_orderdate").cast("date").alias("FILING_DATE"),
        form.alias("FORM"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("0000-"), key)).alias("ACCESSION"),
        F.concat(F.lit("d"), key, F.lit(".htm")).alias("DOCUMENT"), F.col("o_totalprice"), F.col("o_orderstatus"))


def kept_filings(f):
    return feeds.filing_filter_limit(filings(f), ["10-Q", "10-K"], 4, [F.col("FILING_DATE").desc(), F.col("SEQ")])


@query("filing_filter_limit", "CIK SEQ FORM FILING_DATE:d FILING_URL POSITION:i", "v_kept_filings")
def filing_filter_limit(f):
    return kept_filings(f)


@query("date_from_filename", "o_orderkey MONTH_FIRST:d YEAR_FIRST:d STATUS_DATE:d STATUS_YEAR:i",
       """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS MONTH_FIRST, CAST(o_orderdate AS DATE) AS YEAR_FIRST,
 CASE WHEN year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) END AS STATUS_DATE,
 CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) END AS STATUS_YEAR FROM orders""")
def date_from_filename(f):
    month_first = F.concat(F.lit("/raw/Call Bulk All Schedules "), F.date_format("o_orderdate", "MMddyyyy"), F.lit(".zip"))
    year_first = F.concat(F.lit("/raw/financials_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".parquet"))
    yearly = F.concat(F.lit("/raw/yields_"), F.year("o_orderdate").cast("string"), F.lit(".parquet"))
    status = F.coalesce(schedules.status_date_from_name(month_first), schedules.status_date_from_name(year_first))
    return f.table("orders").select(
        "o_orderkey", schedules.report_date_from_name(month_first).alias("MONTH_FIRST"),
        schedules.report_date_from_name(year_first).alias("YEAR_FIRST"), status.alias("STATUS_DATE"),
        schedules.year_from_name(yearly).alias("STATUS_YEAR"))


@query("field_audit", "FIELD STATUS ROW_COUNT:i NON_NULL:i",
       "SELECT 'CERT' AS FIELD, 'returned' AS STATUS, count(*) AS ROW_COUNT, count(CERT) AS NON_NULL FROM v_panel "
       "UNION ALL SELECT 'BRO', 'returned', count(*), count(BRO) FROM v_panel "
       "UNION ALL SELECT 'DDT', 'unknown', count(*), count(DDT) FROM v_panel "
       "UNION ALL SELECT 'NOSUCH', 'missing', count(*), 0 FROM v_panel")
def field_audit(f):
    return tables.field_audit(f.panel, ["CERT", "BRO", "DDT", "NOSUCH"], ["CERT", "BRO", "NOSUCH", "ASSET"])


@query("exact_dedupe", None, "SELECT DISTINCT * FROM lineitem")
def exact_dedupe(f):
    """Whole rows, each of them twice in the input."""
    return tables.exact_dedupe(f.table("lineitem").unionAll(f.table("lineitem")))


@query("rows_to_json", "JSON",
       "SELECT to_json({'CERT': CERT, 'REPDTE': strftime(REPDTE, '%Y-%m-%d'), 'RSSDHCR': RSSDHCR, 'STALP': STALP})::VARCHAR "
       "AS JSON FROM v_panel")
def to_json(f):
    return rows_to_json(f.panel.select("CERT", "REPDTE", "RSSDHCR", "STALP"))


@query("keyword_line_scan", "doc_id line_number:i snippet",
       """SELECT doc_id, line_number, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet FROM (
 SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_number FROM (
 SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS lines FROM documents))
 WHERE regexp_matches(line, '(?i)maturity|repric|lement|a\\.b')""")
def keyword_scan(f):
    return keyword_line_scan(f.table("documents"), ["maturity", "Repric", "lement", "a.b"], key="doc_id")


