"""Queries over whole pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.fragments import FRAGMENTS
from panelyard.catalog.registry import query
from panelyard.catalog.source_queries import kept_filings
from panelyard.functions import text as X
from panelyard.sources.feeds import filing_facts


def html_text_sql(c: str) -> str:
    text = c
    for pattern in (r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>", r"<!--.*?-->", r"<[^>]*>"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'gis')"
    for entity, character in X.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{character.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({text}, '[\\s ]+', ' ', 'g'))"


@query("html_text", "page_id TEXT", f"SELECT page_id, {html_text_sql('html')} AS TEXT FROM pages")
def html_text(f):
    return f.table("pages").select("page_id", X.html_text("html").alias("TEXT"))


# Sentences around order prices, in the three disclosure forms, with and without a scale word.
FRAGMENTS["v_amounts"] = """SELECT o_orderkey, o_totalprice, o_orderpriority,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'As of year end, uninsured deposits totaled $' || CAST(o_totalprice AS VARCHAR) || ' million, up.'
 WHEN '2-HIGH' THEN 'The estimated uninsured deposits $' || CAST(o_totalprice AS VARCHAR) || ' thousand'
 WHEN '3-MEDIUM' THEN 'Deposits that exceed the FDIC insurance limit were $' || CAST(o_totalprice AS VARCHAR) || ' billion'
 WHEN '4-NOT SPECIFIED' THEN 'Uninsured deposits were $,, and deposits exceeding FDIC coverage were ' || CAST(o_totalprice AS VARCHAR)
 ELSE 'Deposits grew to ' || CAST(o_totalprice AS VARCHAR) || ' million' END AS t FROM orders"""


def sentence():
    price = F.col("o_totalprice").cast("string")
    p = F.col("o_orderpriority")
    return (F.when(p == "1-URGENT", F.concat(F.lit("As of year end, uninsured deposits totaled $"), price, F.lit(" million, up.")))
            .when(p == "2-HIGH", F.concat(F.lit("The estimated uninsured deposits $"), price, F.lit(" thousand")))
            .when(p == "3-MEDIUM", F.concat(F.lit("Deposits that exceed the FDIC insurance limit were $"), price, F.lit(" billion")))
            .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Uninsured deposits were $,, and deposits exceeding FDIC coverage were "), price))
            .otherwise(F.concat(F.lit("Deposits grew to "), price, F.lit(" million"))))


def amounts(f):
    return f.table("orders").withColumn("t", sentence())


_AMOUNT = ("CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice * 1000 WHEN '2-HIGH' THEN o_totalprice "
           "WHEN '3-MEDIUM' THEN o_totalprice * 1000000 WHEN '4-NOT SPECIFIED' THEN o_totalprice END")


@query("amount_extract", "o_orderkey AMOUNT:r CONTEXT",
       f"SELECT o_orderkey, {_AMOUNT} AS AMOUNT, CASE WHEN o_orderpriority <> '5-LOW' THEN trim(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' "
       "THEN substring(t, greatest(strpos(t, 'deposits exceeding') - 50, 1)) ELSE t END) END AS CONTEXT FROM v_amounts")
def amount_extract(f):
    df = amounts(f).withColumn("x", X.amount_extract("t"))
    return df.select("o_orderkey", F.col("x.amount").alias("AMOUNT"), F.col("x.context").alias("CONTEXT"))


def tagged(scale):
    price = F.regexp_replace(F.format_string("%.2f", F.col("o_totalprice")), r"^(\d+)(\d{3})\.", "$1,$2.")
    return F.concat(F.lit('<p><ix:nonFraction name="us-gaap:DepositLiabilityUninsured" '), scale, F.lit(' id="x">'), price,
                    F.lit("</ix:nonFraction></p>"))


@query("inline_tag_amount", "o_orderkey SCALED:r PLAIN:r NONE:r",
       "SELECT o_orderkey, o_totalprice * 1000000 / 1000 AS SCALED, o_totalprice AS PLAIN, NULL::DOUBLE AS NONE FROM orders")
def inline_tag_amount(f):
    return f.table("orders").select(
        "o_orderkey", X.inline_tag_amount(tagged(F.lit('scale="6"'))).alias("SCALED"),
        X.inline_tag_amount(tagged(F.lit('unit="usd"'))).alias("PLAIN"),
        X.inline_tag_amount(F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>"))).alias("NONE"))


FRAGMENTS["v_mentions"] = """SELECT doc_id, text || CASE WHEN n_chars % 3 = 0 THEN ' Securities Available-for-sale' WHEN n_chars % 3 = 1
 THEN ' held to MATURITY' ELSE '' END AS t FROM documents"""


@query("mention_flags", "doc_id SEC_AFS_FOUND:b SEC_HTM_FOUND:b",
       "SELECT doc_id, regexp_matches(t, 'available[-\\s]for[-\\s]sale', 'i') AS SEC_AFS_FOUND, "
       "regexp_matches(t, 'held[-\\s]to[-\\s]maturity', 'i') AS SEC_HTM_FOUND FROM v_mentions")
def mention_flags(f):
    rest = F.col("n_chars") % 3
    text = F.concat("text", F.when(rest == 0, " Securities Available-for-sale").when(rest == 1, " held to MATURITY").otherwise(""))
    return f.table("documents").select("doc_id", text.alias("t")).select("doc_id", *[c.alias(n) for n, c in X.mention_flags("t").items()])


FRAGMENTS["v_links"] = r"""SELECT page_id, POSITION, URL, LABEL FROM (SELECT page_id, POSITION,
 regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') AS URL,
 trim(replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&amp;', '&')) AS LABEL FROM (
 SELECT page_id, url, unnest(l) AS a, unnest(range(0, len(l))) AS POSITION FROM (
 SELECT page_id, url, regexp_extract_all(html, '<a [^>]*>.*?</a>') AS l FROM pages)))
 QUALIFY row_number() OVER (PARTITION BY page_id, URL ORDER BY POSITION) = 1"""


@query("link_extract", "page_id POSITION:i URL LABEL", "v_links")
def link_extract(f):
    return X.link_extract(f.table("pages"))


@query("link_extract_filtered", "page_id POSITION:i URL LABEL",
       "SELECT * FROM v_links WHERE (lower(URL) LIKE '%en' OR lower(URL) LIKE '%.') AND lower(LABEL || ' ' || URL) LIKE '%e%'")
def link_extract_filtered(f):
    return X.link_extract(f.table("pages"), ["en", "."], ["e"])


FRAGMENTS["v_facts"] = f"""SELECT k.*, {_AMOUNT.replace('o_', 'a.o_')} AS SEC_UNINSURED_AMOUNT, a.o_orderpriority <> '5-LOW' AS SEC_UNINSURED_FOUND,
 (k.SEQ % 2 = 0) AS SEC_AFS_FOUND, (date_trunc('quarter', k.FILING_DATE) - INTERVAL 1 DAY)::DATE AS REPORT_DATE, m.CERT, m.SEC_TICKER
 FROM v_kept_filings k JOIN v_amounts a ON k.SEQ = a.o_orderkey JOIN v_mapped m ON k.CIK = m.SEC_CIK"""
# every customer files for itself; suppliers share the filings of the customer of their number
FRAGMENTS["v_mapped"] = """SELECT 'C' || c_custkey AS CERT, c_custkey AS SEC_CIK, 'T' || c_nationkey AS SEC_TICKER FROM customer
 UNION ALL SELECT 'S' || s_suppkey, s_suppkey, NULL FROM supplier"""


@query("filing_facts", "CERT SEC_TICKER CIK SEQ FORM FILING_DATE:d REPORT_DATE:d FILING_URL SEC_UNINSURED_FOUND:b SEC_UNINSURED_AMOUNT:r SEC_AFS_FOUND:b", "v_facts")
def facts(f):
    """Filing index to facts: the kept filings joined to their documents and read."""
    html = F.concat(F.lit("<html><style>p{color:red}</style><p>"), F.replace(sentence(), F.lit(" "), F.lit("&nbsp;")), F.lit("</p><p>"),
                    F.when(F.col("o_orderkey") % 2 == 0, "Available for <b>sale</b>").otherwise("none"), F.lit("</p></html>"))
    documents = f.table("orders").select(F.col("o_orderkey").alias("SEQ"), html.alias("HTML"))
    filings = kept_filings(f).drop("o_totalprice", "o_orderstatus").withColumn("REPORT_DATE", F.date_sub(F.trunc("FILING_DATE", "quarter"), 1))
    mapping = f.table("customer").select(F.concat(F.lit("C"), "c_custkey").alias("CERT"), F.col("c_custkey").alias("SEC_CIK"),
                                         F.concat(F.lit("T"), "c_nationkey").alias("SEC_TICKER")).unionByName(
        f.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("CERT"), F.col("s_suppkey").alias("SEC_CIK"), F.lit(None).cast("string").alias("SEC_TICKER")))
    return filing_facts(filings.join(documents, "SEQ"), mapping=mapping)
