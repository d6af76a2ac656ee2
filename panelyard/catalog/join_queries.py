"""Queries over joins, entity resolution and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.fragments import FRAGMENTS, LAST_YEAR, sd
from panelyard.catalog.frames import FIRST_YEAR, YIELD_COLUMNS
from panelyard.catalog.registry import query
from panelyard.catalog.scalar_queries import normalized_sql, wide_sql
from panelyard.functions.text import normalize_name
from panelyard.operators import hierarchy, joins, names
from panelyard.operators.aggregates import sod_features
from panelyard.plans import backtest, panel, publish
from panelyard.plans.repricing import OVERLAY_CODES, REPRICING_CODES, pivot_codes
from panelyard.session import cut_lineage
from panelyard.sources.schedules import crosswalk


@query("dim_join_coalesce", "CERT REPDTE:d RSSDID NAMEFULL STALP BKCLASS",
       "SELECT i.CERT, f.REPDTE, i.FED_RSSD AS RSSDID, coalesce(CASE WHEN f.RSSDHCR > 5 THEN 'own name' END, i.NAMEFULL) "
       "AS NAMEFULL, i.STALP, i.BKCLASS FROM v_fin f JOIN v_inst i ON f.s = i.FED_RSSD")
def dim_join_coalesce(f):
    fact = f.financials.select(F.col("__s").cast("string").alias("CERT"), "REPDTE",
                               F.when(F.col("RSSDHCR") > 5, "own name").alias("NAMEFULL"))
    dim = f.institutions.withColumn("SEQ", F.lit(1))
    twice = dim.unionByName(dim.withColumns({"SEQ": F.lit(0), "NAMEFULL": F.lit("older row")}))
    return joins.fill_from_dimension(fact, panel.normalise_institutions(twice, ["SEQ"]), "CERT", panel.DIMENSION_COLUMNS)


FRAGMENTS["v_geo"] = """SELECT CERT, YEAR, STALPBR, CNTYNAMB, sum(DEPSUMBR) AS a FROM v_branch GROUP BY 1, 2, 3, 4"""
FRAGMENTS["v_state"] = f"""SELECT CERT, YEAR, count(STALPBR) AS SOD_STATE_COUNT, max(share) AS SOD_TOP_STATE_SHARE,
 sum(coalesce(share, 0) * coalesce(share, 0)) AS SOD_DEPOSIT_HHI_STATE FROM (
 SELECT CERT, YEAR, STALPBR, CASE WHEN sum(a) OVER (PARTITION BY CERT, YEAR) > 0 THEN {sd('a', 'sum(a) OVER (PARTITION BY CERT, YEAR)')} END
 AS share FROM (SELECT CERT, YEAR, STALPBR, round(sum(a), 6) AS a FROM v_geo GROUP BY 1, 2, 3)) GROUP BY 1, 2"""
FRAGMENTS["v_county"] = f"""SELECT CERT, YEAR, count(CNTYNAMB) AS SOD_COUNTY_COUNT,
 sum(coalesce(share, 0) * coalesce(share, 0)) AS SOD_DEPOSIT_HHI_COUNTY FROM (
 SELECT CERT, YEAR, CNTYNAMB, CASE WHEN sum(a) OVER (PARTITION BY CERT, YEAR) > 0 THEN {sd('a', 'sum(a) OVER (PARTITION BY CERT, YEAR)')} END
 AS share FROM (SELECT CERT, YEAR, CNTYNAMB, round(sum(a), 6) AS a FROM v_geo GROUP BY 1, 2, 3)) GROUP BY 1, 2"""
FRAGMENTS["v_sod"] = """SELECT b.*, s.* EXCLUDE (CERT, YEAR), c.* EXCLUDE (CERT, YEAR) FROM (SELECT CERT, YEAR AS SOD_YEAR,
 round(sum(DEPSUMBR), 6) AS SOD_TOTAL_DEPOSITS, count(DISTINCT UNINUMBR) AS SOD_BRANCH_COUNT FROM v_branch GROUP BY 1, 2) b
 JOIN v_state s ON b.CERT = s.CERT AND b.SOD_YEAR = s.YEAR JOIN v_county c ON b.CERT = c.CERT AND b.SOD_YEAR = c.YEAR"""
SOD_SPEC = ("SOD_TOTAL_DEPOSITS:r SOD_BRANCH_COUNT:i SOD_STATE_COUNT:i SOD_TOP_STATE_SHARE:r SOD_DEPOSIT_HHI_STATE:r "
            "SOD_COUNTY_COUNT:i SOD_DEPOSIT_HHI_COUNTY:r")
FRAGMENTS["v_panel_sod"] = """SELECT p.*, s.* EXCLUDE (CERT) FROM (SELECT *, year(REPDTE) - CASE WHEN month(REPDTE) <= 6 THEN 1 ELSE 0 END
 AS SOD_JOIN_YEAR FROM v_panel) p LEFT JOIN v_sod s ON p.CERT = s.CERT AND p.SOD_JOIN_YEAR = s.SOD_YEAR"""


@query("lagged_year_join", "CERT REPDTE:d SOD_JOIN_YEAR:i " + SOD_SPEC, "v_panel_sod")
def lagged_year_join(f):
    return panel.join_branch_features(f.panel, sod_features(f.branch))


FRAGMENTS["v_jcodes"] = FRAGMENTS["v_ucodes"]
FRAGMENTS["v_jwide"] = wide_sql("v_jcodes", REPRICING_CODES)


@query("feature_join_new_columns", "CERT REPDTE:d LOAN_A:r TD_SMALL_A:r DEPDOM:r",
       "SELECT p.CERT, p.REPDTE, w.RCONA570 AS LOAN_A, w.RCONHK07 AS TD_SMALL_A, p.DEPDOM FROM v_panel p "
       "LEFT JOIN v_jwide w ON p.CERT = CAST(w.IDRSSD AS VARCHAR) AND p.REPDTE = w.REPDTE")
def feature_join(f):
    wide = pivot_codes(f.codes(REPRICING_CODES), ["IDRSSD", "REPDTE"], ["RCONA570", "RCONHK07"])
    side = wide.select(F.col("IDRSSD").cast("string").alias("CERT"), "REPDTE", F.col("RCONA570").alias("LOAN_A"),
                       F.col("RCONHK07").alias("TD_SMALL_A"), F.lit(0.0).alias("DEPDOM"), F.lit(1).alias("OTHER"))
    return joins.add_new_columns(f.panel, side, prefixes=("LOAN_", "TD_SMALL_"))


@query("merge_extra_columns", "CERT REPDTE:d ASSET:r BRO2:r DDT2:r",
       "SELECT CERT, REPDTE, ASSET, BRO * 2 AS BRO2, DDT * 2 AS DDT2 FROM v_panel")
def merge_extra_columns(f):
    base = f.panel.select("CERT", "REPDTE", "ASSET")
    one = f.panel.select("CERT", "REPDTE", (F.col("BRO") * 2).alias("BRO2"), F.lit(0.0).alias("ASSET"))
    two = f.panel.select("CERT", "REPDTE", (F.col("DDT") * 2).alias("DDT2"), F.lit(0.0).alias("BRO2"))
    return joins.merge_stages(base, one, two)


@query("asof_join", "CERT REPDTE:d TREASURY_YIELD_DATE:d YC_3MO YC_2YR YC_10YR HAS_HISTORY:i",
       "SELECT p.CERT, p.REPDTE, y.DATE AS TREASURY_YIELD_DATE, YC_3MO, YC_2YR, YC_10YR, (y.DATE IS NOT NULL)::INT AS HAS_HISTORY "
       "FROM v_panel p ASOF LEFT JOIN v_yields y ON y.DATE <= p.REPDTE")
def asof(f):
    return joins.asof_join(f.panel, f.yields, YIELD_COLUMNS, matched="TREASURY_YIELD_DATE")


@query("asof_join_times", "l_orderkey l_linenumber:i MATCHED:d YC_2YR",
       "SELECT l_orderkey, l_linenumber, y.DATE AS MATCHED, YC_2YR FROM (SELECT *, l_shipdate::DATE + to_seconds(l_orderkey) AS t FROM lineitem) l "
       "ASOF LEFT JOIN v_yields y ON y.DATE::TIMESTAMP <= l.t")
def asof_times(f):
    """As-of join of single lines on timestamps, of which nearly every line has its own."""
    at = F.timestamp_add("SECOND", F.col("l_orderkey").cast("int"), F.col("l_shipdate").cast("date").cast("timestamp"))
    lines = f.table("lineitem").select("l_orderkey", "l_linenumber", at.alias("AT"))
    history = f.yields.withColumn("DATE", F.col("DATE").cast("timestamp"))
    return joins.asof_join(lines, history, ["YC_2YR"], day="AT", matched="MATCHED")


@query("outer_merge_schedules", "IDRSSD REPDTE:d RCONA570:r RCFD3450:r",
       "SELECT coalesce(w.IDRSSD, d.IDRSSD) AS IDRSSD, coalesce(w.REPDTE, d.REPDTE) AS REPDTE, RCONA570, RCFD3450 "
       "FROM (SELECT * FROM v_jwide WHERE RCONA570 IS NOT NULL) w FULL JOIN (SELECT * FROM v_jdwide WHERE RCFD3450 IS NOT NULL) d "
       "ON w.IDRSSD = d.IDRSSD AND w.REPDTE = d.REPDTE")
def outer_merge_schedules(f):
    """Two schedules side by side: union of the facts and one pivot."""
    facts = f.codes(REPRICING_CODES).unionByName(f.codes(OVERLAY_CODES))
    return pivot_codes(facts, ["IDRSSD", "REPDTE"], ["RCONA570", "RCFD3450"])


FRAGMENTS["v_jdcodes"] = FRAGMENTS["v_uderiv"]
FRAGMENTS["v_jdwide"] = wide_sql("v_jdcodes", OVERLAY_CODES)


@query("id_crosswalk", "o_orderkey o_custkey CERT",
       "SELECT o_orderkey, o_custkey, m.CERT FROM orders LEFT JOIN (SELECT s_nationkey AS k, arg_min(s_name, s_suppkey) AS CERT "
       "FROM supplier GROUP BY 1) m ON o_custkey = m.k")
def id_crosswalk(f):
    institutions = f.table("supplier").selectExpr("s_nationkey AS FED_RSSD", "s_name AS CERT", "s_suppkey AS SEQ")
    return crosswalk(f.table("orders").select("o_orderkey", "o_custkey"), institutions, on="o_custkey", order=["SEQ"])


@query("event_join", "CERT REPDTE:d FAILDATE:d",
       "SELECT p.CERT, p.REPDTE, f.FAILDATE FROM v_panel p LEFT JOIN v_lastfail f ON p.CERT = f.CERT "
       f"WHERE year(p.REPDTE) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}")
def event_join(f):
    return backtest.event_join(f.panel, f.failures, FIRST_YEAR, LAST_YEAR)


_NAME = ("CASE WHEN p_size <= 15 THEN concat_ws(' ', p_brand, p_name, 'Bank, N.A.') WHEN p_size > 35 THEN "
         "concat_ws(' ', 'First', p_type, p_name, 'Bancorp Inc.') ELSE "
         "concat_ws(' ', 'National Bank of', p_name, p_type, p_brand, 'Co') END")
FRAGMENTS["v_names"] = (f"SELECT CAST(p_partkey AS VARCHAR) AS CERT, p_partkey AS FED_RSSD, NAME, {normalized_sql('NAME')} AS n "
                        f"FROM (SELECT *, {_NAME} AS NAME FROM part)")
_TITLE = ("concat_ws(' ', p_brand, p_name, CASE WHEN p_size % 2 = 0 THEN 'Bank' ELSE 'Financial Group, Inc.' END)")
FRAGMENTS["v_reg"] = (f"SELECT p_partkey AS SEQ, p_partkey + 1000000 AS CIK, 'T' || p_partkey AS TICKER, TITLE, "
                      f"{normalized_sql('TITLE')} AS n FROM (SELECT *, {_TITLE} AS TITLE FROM part)")
FRAGMENTS["v_exact"] = """SELECT i.CERT, i.FED_RSSD, i.NAME, i.n, h.r.CIK AS SEC_CIK, h.r.TICKER AS SEC_TICKER, h.r.TITLE AS SEC_TITLE,
 CASE WHEN h.r IS NOT NULL THEN 'exact' END AS SEC_MATCH_TYPE FROM v_names i LEFT JOIN (
 SELECT n, arg_min({'CIK': CIK, 'TICKER': TICKER, 'TITLE': TITLE}, SEQ) AS r FROM v_reg WHERE n <> '' GROUP BY 1) h ON i.n = h.n"""
_STOP = "['', " + ", ".join(f"'{w}'" for w in names.STOP_WORDS) + "]"
_SET = "list_sort(list_filter(list_distinct(string_split(n, ' ')), lambda x: NOT list_contains(" + _STOP + ", x)))"


def fuzzy_sql(source: str, registry: str = "v_reg") -> str:
    """Every open name against every registry set: the plain all-pairs definition."""
    return f"""SELECT e.* EXCLUDE (SEC_CIK, SEC_TICKER, SEC_TITLE, SEC_MATCH_TYPE, w), coalesce(e.SEC_CIK, b.r.CIK) AS SEC_CIK,
 coalesce(e.SEC_TICKER, b.r.TICKER) AS SEC_TICKER, coalesce(e.SEC_TITLE, b.r.TITLE) AS SEC_TITLE,
 coalesce(e.SEC_MATCH_TYPE, 'fuzzy_' || printf('%.2f', b.score)) AS SEC_MATCH_TYPE FROM (SELECT *, {_SET} AS w FROM {source}) e
 LEFT JOIN (SELECT w, first(score ORDER BY score DESC, SEQ) AS score, first({{'CIK': CIK, 'TICKER': TICKER, 'TITLE': TITLE}} ORDER BY score DESC, SEQ) AS r FROM (
 SELECT a.w, g.*, len(list_intersect(a.w, g.w)) / greatest(len(a.w), len(g.w)) AS score FROM
 (SELECT DISTINCT {_SET} AS w FROM {source} WHERE SEC_MATCH_TYPE IS NULL) a, (SELECT *, {_SET} AS w FROM {registry}) g
 WHERE len(list_intersect(a.w, g.w)) >= 2) WHERE score >= 0.6e0 GROUP BY 1) b ON e.SEC_MATCH_TYPE IS NULL AND e.w = b.w"""


FRAGMENTS["v_fuzzy"] = fuzzy_sql("v_exact")
MATCH_SPEC = "CERT SEC_CIK SEC_TICKER SEC_TITLE SEC_MATCH_TYPE"


def _named(f):
    return names.dealt(f.named_institutions).withColumn("INST_NAME_NORM", normalize_name("NAME"))


@query("exact_name_match", MATCH_SPEC, "v_exact")
def exact_name_match(f):
    return names.exact_name_match(_named(f), names.registry_lookup(f.registry))


@query("token_overlap_match", MATCH_SPEC, "v_fuzzy")
def token_overlap_match(f):
    lookup = cut_lineage(names.registry_lookup(f.registry))
    return names.token_overlap_match(names.exact_name_match(_named(f), lookup), lookup)


# Names of nine and more words, three of which all names share.
_LONG_TAIL = "Farmers Merchants Community"
_LONG_CODES = "concat('size', p_size, ' lot', p_size % 10, ' row', p_partkey % 9)"
FRAGMENTS["v_long_names"] = (
    f"SELECT CERT, n, NULL::BIGINT AS SEC_CIK, NULL AS SEC_TICKER, NULL AS SEC_TITLE, NULL AS SEC_MATCH_TYPE FROM (SELECT *, {normalized_sql('NAME')} AS n FROM "
    f"(SELECT CAST(p_partkey AS VARCHAR) AS CERT, concat_ws(' ', p_brand, p_name, p_type, {_LONG_CODES}, '{_LONG_TAIL}') AS NAME FROM part))")
FRAGMENTS["v_long_reg"] = (
    f"SELECT *, {normalized_sql('TITLE')} AS n FROM (SELECT p_partkey AS SEQ, p_partkey + 1000000 AS CIK, 'T' || p_partkey AS TICKER, "
    f"concat_ws(' ', '{_LONG_TAIL}', p_type, p_brand, {_LONG_CODES}, p_name, CASE WHEN p_size % 2 = 0 THEN 'Partners' ELSE 'Financial Group, Inc.' END) AS TITLE FROM part)")
FRAGMENTS["v_long_fuzzy"] = fuzzy_sql("v_long_names", "v_long_reg")


@query("token_overlap_long", MATCH_SPEC, "v_long_fuzzy")
def token_overlap_long(f):
    part = f.table("part")
    end = F.when(F.col("p_size") % 2 == 0, F.lit("Partners")).otherwise(F.lit("Financial Group, Inc."))
    registry = part.select(F.col("p_partkey").alias("SEQ"), (F.col("p_partkey") + 1000000).alias("CIK_STR"),
                           F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("TICKER"),
                           F.concat_ws(" ", F.lit(_LONG_TAIL), "p_type", "p_brand", F.expr(_LONG_CODES), "p_name", end).alias("TITLE"))
    asked = names.dealt(part).select(F.col("p_partkey").cast("string").alias("CERT"),
                        normalize_name(F.concat_ws(" ", "p_brand", "p_name", "p_type", F.expr(_LONG_CODES), F.lit(_LONG_TAIL))).alias("INST_NAME_NORM"),
                        *[F.lit(None).cast("long" if c == "SEC_CIK" else "string").alias(c) for c in names.MATCH_COLUMNS])
    return names.token_overlap_match(asked, names.registry_lookup(registry))


FRAGMENTS["v_overrides"] = ("SELECT CAST(s_suppkey AS VARCHAR) AS CERT, s_suppkey + 5000000 AS CIK, CASE WHEN s_acctbal > 0 THEN 'OV' END "
                            "AS TICKER FROM supplier UNION ALL SELECT 'unknown', 1, 'X'")


def overrides(f):
    listed = f.table("supplier").select(F.col("s_suppkey").cast("string").alias("CERT"), (F.col("s_suppkey") + 5000000).alias("CIK"),
                                        F.when(F.col("s_acctbal") > 0, "OV").alias("TICKER"))
    return listed.unionByName(f.spark.createDataFrame([("unknown", 1, "X")], "CERT string, CIK long, TICKER string"))


def overridden_sql(source: str) -> str:
    return (f"SELECT m.* EXCLUDE (SEC_CIK, SEC_TICKER, SEC_MATCH_TYPE), coalesce(o.CIK, m.SEC_CIK) AS SEC_CIK, "
            f"coalesce(o.TICKER, m.SEC_TICKER) AS SEC_TICKER, CASE WHEN o.CERT IS NOT NULL THEN 'override' ELSE m.SEC_MATCH_TYPE END "
            f"AS SEC_MATCH_TYPE FROM {source} m LEFT JOIN v_overrides o ON m.CERT = o.CERT")


@query("manual_override", MATCH_SPEC, overridden_sql("v_exact"))
def manual_override(f):
    matched = names.exact_name_match(_named(f), names.registry_lookup(f.registry))
    return names.manual_override(matched, overrides(f))


FRAGMENTS["v_holders"] = "SELECT p_partkey AS ID_RSSD, p_brand || ' ' || p_name || ' Bank' AS TOP_HOLDER_NAME FROM part WHERE p_size > 45"


def holders(f):
    """Names of the holders of the largest entities; the rest have none."""
    return f.table("part").select(F.col("p_partkey").alias("ID_RSSD"), F.when(
        F.col("p_size") > 45, F.concat_ws(" ", "p_brand", "p_name", F.lit("Bank"))).alias("TOP_HOLDER_NAME"))


@query("holder_name_preference", "CERT NAME INST_NAME_NORM",
       f"SELECT i.CERT, i.NAME, coalesce(nullif({normalized_sql('h.TOP_HOLDER_NAME')}, ''), i.n) AS INST_NAME_NORM "
       "FROM v_names i LEFT JOIN v_holders h ON i.FED_RSSD = h.ID_RSSD")
def holder_name_preference(f):
    return names.holder_name_preference(_named(f), holders(f), "FED_RSSD")


FRAGMENTS["v_walk"] = """SELECT * FROM (WITH RECURSIVE w AS (
 SELECT ID_RSSD_OFFSPRING AS node, ID_RSSD_PARENT AS top, 1 AS depth FROM v_edges WHERE ID_RSSD_OFFSPRING <> ID_RSSD_PARENT
 UNION ALL SELECT w.node, e.ID_RSSD_PARENT, depth + 1 FROM w JOIN v_edges e ON w.top = e.ID_RSSD_OFFSPRING
 WHERE e.ID_RSSD_PARENT <> e.ID_RSSD_OFFSPRING) SELECT node AS ID_RSSD, arg_max(top, depth) AS TOP_HOLDER_RSSD FROM w GROUP BY 1
 UNION ALL SELECT ID_RSSD_OFFSPRING, ID_RSSD_OFFSPRING FROM v_edges WHERE ID_RSSD_OFFSPRING = ID_RSSD_PARENT)"""


@query("top_holder", "ID_RSSD TOP_HOLDER_RSSD", "v_walk")
def top_holder(f):
    return hierarchy.top_holder(f.edges)


@query("holder_names", "ID_RSSD TOP_HOLDER_RSSD TOP_HOLDER_NAME",
       "SELECT w.*, s.s_name AS TOP_HOLDER_NAME FROM v_walk w LEFT JOIN supplier s ON w.TOP_HOLDER_RSSD = s.s_suppkey")
def holder_names(f):
    attributes = hierarchy.entity_attributes(f.table("supplier").selectExpr(
        "CAST(s_suppkey AS string) AS `#ID_RSSD`", "concat(s_name, ' ') AS NM_LGL", "s_acctbal AS SEQ"), ["SEQ"])
    return hierarchy.holder_names(hierarchy.top_holder(f.edges), attributes)


@query("failure_flag_lookup", "CERT NAMEFULL failed:b fail_date",
       "SELECT i.CERT, i.NAMEFULL, f.FAILDATE IS NOT NULL AS failed, strftime(f.FAILDATE, '%Y-%m-%d') AS fail_date "
       "FROM v_inst i LEFT JOIN (SELECT CERT, max(FAILDATE) AS FAILDATE FROM v_failures GROUP BY 1) f ON i.CERT = f.CERT")
def failure_flag_lookup(f):
    return publish.failure_flags(f.institutions, f.failures)


FRAGMENTS["v_preferred"] = (f"SELECT i.* EXCLUDE (n), coalesce(nullif({normalized_sql('h.TOP_HOLDER_NAME')}, ''), i.n) AS n "
                            "FROM v_names i LEFT JOIN v_holders h ON i.FED_RSSD = h.ID_RSSD")
FRAGMENTS["v_exact2"] = FRAGMENTS["v_exact"].replace("v_names", "v_preferred")
FRAGMENTS["v_fuzzy2"] = fuzzy_sql("v_exact2")


@query("sec_mapping", MATCH_SPEC + " NAME FED_RSSD", overridden_sql("v_fuzzy2"))
def sec_mapping(f):
    return names.sec_mapping(f.named_institutions, f.registry, overrides(f), holders(f))
