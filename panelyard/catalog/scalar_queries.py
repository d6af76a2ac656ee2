"""Queries over projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.catalog.fragments import (
    FRAGMENTS, PEERS, clip01, codes, nz, num, quarter_distance, quarter_end, quarter_end_offset, sd,
)
from panelyard.catalog.frames import BANDS
from panelyard.catalog.registry import query
from panelyard.functions import scalars as S
from panelyard.functions.text import SUFFIX_PATTERN, normalize_name
from panelyard.plans import indices, mismatch, panel, repricing
from panelyard.plans.calendar import source_status, source_windows
from panelyard.plans.competition import rates_to_bp
from panelyard.plans.reports import curve_regime
from panelyard.plans.treasury import regime_by_date
from panelyard.sources.tables import promote_numeric_columns


@query("parse_report_date", "o_orderkey A:d B:d C:d D:d",
       """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS A, CAST(o_orderdate AS DATE) AS B, CAST(o_orderdate AS DATE) AS C,
 NULL::DATE AS D FROM orders""")
def parse_report_date(f):
    day = F.col("o_orderdate")
    return f.table("orders").select(
        "o_orderkey", S.parse_report_date(F.date_format(day, "yyyyMMdd").cast("bigint")).alias("A"),
        S.parse_report_date(F.date_format(day, "M/d/yyyy")).alias("B"),
        S.parse_report_date(F.date_format(day, "yyyy-MM-dd")).alias("C"),
        S.parse_report_date(F.concat(F.lit("day "), F.col("o_orderkey").cast("string"))).alias("D"))


FRAGMENTS["v_texts"] = """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' WHEN '2-HIGH' THEN 'nan'
 WHEN '1-URGENT' THEN NULL ELSE ' ' || CAST(o_totalprice AS VARCHAR) END AS t, o_totalprice FROM orders"""


def texts(f):
    p = F.col("o_orderpriority")
    return f.table("orders").select("o_orderkey", "o_totalprice", F.when(p == "5-LOW", "n/a").when(p == "2-HIGH", "nan").when(
        p == "1-URGENT", F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).alias("t"))


@query("numeric_or_null", "o_orderkey PARSED ABSENT",
       "SELECT o_orderkey, CASE WHEN t IN ('n/a', 'nan') OR t IS NULL THEN NULL ELSE o_totalprice END AS PARSED, "
       "NULL::DOUBLE AS ABSENT FROM v_texts")
def numeric_or_null(f):
    df = S.ensure_columns(texts(f), ["ABSENT"])
    return df.select("o_orderkey", S.number("t").alias("PARSED"), S.number("ABSENT").alias("ABSENT"))


@query("promote_numeric_columns", "o_orderkey WHOLE MIXED", "SELECT o_orderkey, o_totalprice AS WHOLE, t AS MIXED FROM "
       "(SELECT o_orderkey, o_totalprice, o_orderpriority AS t FROM orders)")
def promote(f):
    return promote_numeric_columns(f.table("orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("WHOLE"), F.col("o_orderpriority").alias("MIXED")))


@query("safe_div", "CERT REPDTE:d RATIO:r BY_ZERO:r",
       f"SELECT CERT, REPDTE, {sd('BRO', 'DEPUNA')} AS RATIO, {sd('DEPDOM', 'DEPDOM - DEPDOM')} AS BY_ZERO FROM v_panel")
def safe_div(f):
    return f.panel.select("CERT", "REPDTE", S.safe_div("BRO", "DEPUNA").alias("RATIO"),
                          S.safe_div("DEPDOM", F.col("DEPDOM") - F.col("DEPDOM")).alias("BY_ZERO"))


@query("coalesce_columns", "CERT REPDTE:d DEPOSITS:r BUCKET:r",
       "SELECT CERT, REPDTE, DEPDOM AS DEPOSITS, coalesce(IDCD3LES, CD3LES) AS BUCKET FROM v_panel")
def coalesce_columns(f):
    p = f.panel
    return p.select("CERT", "REPDTE", S.coalesce_columns(p, ["DEPDOM", "DEP"]).alias("DEPOSITS"),
                    S.coalesce_columns(p, ["NOSUCH", "IDCD3LES", "CD3LES"]).alias("BUCKET"))


FRAGMENTS["v_ucodes"] = codes(repricing.REPRICING_CODES)
FRAGMENTS["v_uderiv"] = codes(repricing.OVERLAY_CODES)


def wide_sql(source: str, names) -> str:
    return ("SELECT IDRSSD, REPDTE, " + ", ".join(f"max(CASE WHEN CODE = '{c}' THEN VALUE END) AS {c}" for c in names)
            + f" FROM {source} GROUP BY 1, 2")


FRAGMENTS["v_wide"] = wide_sql("v_ucodes", repricing.REPRICING_CODES)
FRAGMENTS["v_dwide"] = wide_sql("v_uderiv", repricing.OVERLAY_CODES)


@query("code_fallback_row", "IDRSSD REPDTE:d LOAN:r SWAP:r",
       "SELECT w.IDRSSD, w.REPDTE, coalesce(RCONA570, RCFDA570) AS LOAN, coalesce(RCFD3450, RCON3450) AS SWAP "
       "FROM v_wide w JOIN v_dwide d ON w.IDRSSD = d.IDRSSD AND w.REPDTE = d.REPDTE")
def code_fallback_row(f):
    keys = ["IDRSSD", "REPDTE"]
    loans = repricing.pivot_codes(f.codes(repricing.REPRICING_CODES), keys, repricing.REPRICING_CODES)
    swaps = repricing.pivot_codes(f.codes(repricing.OVERLAY_CODES), keys, repricing.OVERLAY_CODES)
    return loans.join(swaps, keys).select(*keys, F.coalesce(*cfg.LOAN_CODES["LOAN_0_3M"]).alias("LOAN"),
                                          F.coalesce(*cfg.DERIVATIVE_CODES["IR_SWAPS"]).alias("SWAP"))


@query("clip", "CERT REPDTE:d FLOORED:r SHARE:r BRO_KEPT:r",
       f"SELECT CERT, REPDTE, CASE WHEN EQ IS NOT NULL THEN greatest(EQ - 5000, 0) END AS FLOORED, "
       f"{clip01('EQ / 5000.0e0')} AS SHARE, CASE WHEN BRO IS NOT NULL THEN greatest(BRO, 50000) END AS BRO_KEPT FROM v_panel")
def clip(f):
    return f.panel.select("CERT", "REPDTE", S.clip(F.col("EQ") - 5000, lower=0).alias("FLOORED"),
                          S.clip01(F.col("EQ") / 5000.0).alias("SHARE"), S.clip("BRO", lower=50000).alias("BRO_KEPT"))


@query("rowwise_max", "CERT REPDTE:d LARGEST:r", "SELECT CERT, REPDTE, greatest(BRO, DEPLSNB, DDT) AS LARGEST FROM v_panel")
def rowwise_max(f):
    return f.panel.select("CERT", "REPDTE", S.row_max("BRO", "DEPLSNB", "DDT").alias("LARGEST"))


@query("rowwise_sum_present", "IDRSSD REPDTE:d TOTAL:r NONE:r",
       f"""SELECT IDRSSD, REPDTE, CASE WHEN max((coalesce(RCONA564, RCONA565) IS NOT NULL)::INT) OVER (PARTITION BY REPDTE) = 1
 THEN {nz('RCONA564')} + {nz('RCONA565')} END AS TOTAL, NULL::DOUBLE AS NONE FROM v_wide""")
def rowwise_sum_present(f):
    wide = repricing.pivot_codes(f.codes(repricing.REPRICING_CODES), ["IDRSSD", "REPDTE"], repricing.REPRICING_CODES)
    df = repricing.sum_present(wide, ["RCONA564", "RCONA565"], "TOTAL")
    return repricing.sum_present(df, ["NOSUCH"], "NONE")


@query("zero_as_unknown", "CERT REPDTE:d DEPUNA_MISSING:b UNINSURED_SHARE:r UNINSURED_PROXY:r",
       "SELECT CERT, REPDTE, DEPUNA_MISSING, UNINSURED_SHARE, coalesce(CASE WHEN DEPUNA > 0 THEN DEPUNA END, 0.5e0 * IDDEPLAM) "
       "AS UNINSURED_PROXY FROM v_mix")
def zero_as_unknown(f):
    from panelyard.plans.deposits import deposit_mix

    return mismatch.runnable_funding(deposit_mix(f.panel))


@query("whole_column_fallback", "CERT REPDTE:d EMPTY_USES:r FILLED_KEEPS:r",
       "SELECT CERT, REPDTE, COREDEP AS EMPTY_USES, BRO AS FILLED_KEEPS FROM v_panel")
def whole_column_fallback(f):
    df = f.panel.withColumn("EMPTY", F.lit(None).cast("double"))
    df = mismatch.with_fallback_column(df, "EMPTY", "COREDEP", "EMPTY_USES")
    return mismatch.with_fallback_column(df, "BRO", "COREDEP", "FILLED_KEEPS")


@query("peer_group", "CERT REPDTE:d ASSET:r PEER_GROUP", f"SELECT CERT, REPDTE, ASSET, {PEERS} AS PEER_GROUP FROM v_panel")
def peer_group(f):
    return indices.with_peer_group(f.panel, BANDS)


@query("pct_to_bp", "DATE:d IORB_BP:r RRPONTSYAWARD_BP:r YC_3MO_BP",
       "SELECT DATE, IORB * 100.0e0 AS IORB_BP, RRPONTSYAWARD * 100.0e0 AS RRPONTSYAWARD_BP, IORB AS YC_3MO_BP FROM v_rates")
def pct_to_bp(f):
    # a target that exists already is left alone
    return rates_to_bp(f.rates.withColumns({"YC_3MO": F.col("IORB"), "YC_3MO_BP": F.col("IORB")}))


@query("best_available_rate", "DATE:d VALUE:r SOURCE N:i FIRST_VALUE:r",
       """SELECT DATE, greatest(YC_3MO, YC_2YR, YC_10YR) AS VALUE, CASE greatest(YC_3MO, YC_2YR, YC_10YR)
 WHEN YC_3MO THEN 'YC_3MO' WHEN YC_2YR THEN 'YC_2YR' WHEN YC_10YR THEN 'YC_10YR' END AS SOURCE,
 (YC_3MO IS NOT NULL)::INT + (YC_2YR IS NOT NULL)::INT + (YC_10YR IS NOT NULL)::INT AS N,
 coalesce(YC_3MO, YC_2YR, YC_10YR) AS FIRST_VALUE FROM (SELECT DATE, YC_3MO * 10 AS YC_3MO, YC_2YR * 10 AS YC_2YR,
 YC_10YR * 10 AS YC_10YR FROM v_yields)""")
def best_available_rate(f):
    names = ["YC_3MO", "YC_2YR", "YC_10YR"]
    df = f.yields.withColumns({n: F.col(n) * 10 for n in names})
    value, source, n = S.best_of(names)
    return df.select("DATE", value.alias("VALUE"), source.alias("SOURCE"), n.alias("N"),
                     S.best_of(names, "first_available")[0].alias("FIRST_VALUE"))


_W = {"BROKERED_SHARE": 0.15, "LIST_SERVICE_SHARE": 0.10, "UNINSURED_SHARE": 0.45}


@query("weighted_mean_available", "CERT REPDTE:d MEAN:r",
       "SELECT CERT, REPDTE, " + clip01(sd(
           " + ".join(f"coalesce({clip01(c)} * {num(w)}, 0)" for c, w in _W.items()),
           " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {num(w)} ELSE 0.0e0 END" for c, w in _W.items())))
       + " AS MEAN FROM v_mix")
def weighted_mean_available(f):
    from panelyard.plans.deposits import deposit_mix

    return deposit_mix(f.panel).withColumn("MEAN", S.weighted_mean_available(_W))


@query("quarter_distance", "l_orderkey l_linenumber:i Q:i",
       f"SELECT l_orderkey, l_linenumber, {quarter_distance('o_orderdate', 'l_shipdate')} AS Q "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def quarter_distance_query(f):
    orders = f.table("orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return f.table("lineitem").join(orders, "l_orderkey").withColumn("Q", S.quarter_distance("o_orderdate", "l_shipdate"))


@query("quarter_end_offset", "o_orderkey Q1:d Q2:d Q4:d E1:d",
       "SELECT o_orderkey, " + ", ".join(f"{quarter_end_offset('d', n)} AS Q{n}" for n in (1, 2, 4))
       + f", {quarter_end_offset('e', 1)} AS E1 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, "
         f"{quarter_end('o_orderdate')} AS e FROM orders)")
def quarter_end_offset_query(f):
    day = F.col("o_orderdate").cast("date")
    return f.table("orders").select("o_orderkey", *[S.quarter_end_offset(day, n).alias(f"Q{n}") for n in (1, 2, 4)],
                                    S.quarter_end_offset(S.quarter_end(day), 1).alias("E1"))


@query("quarter_calendar", "QUARTER:d FILINGS:i",
       f"""SELECT q.QUARTER, count(o.o_orderkey) AS FILINGS FROM (
 SELECT CAST(last_day(d) AS DATE) AS QUARTER FROM (SELECT unnest(generate_series(date_trunc('quarter', a) + INTERVAL 2 MONTH,
 b, INTERVAL 3 MONTH)) AS d FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)) WHERE last_day(d) <= (SELECT max(o_orderdate) FROM orders)
 ) q LEFT JOIN orders o ON {quarter_end('o.o_orderdate')} = q.QUARTER GROUP BY 1""")
def quarter_calendar(f):
    """All completed quarters of the covered years with the number of orders in each."""
    orders = f.table("orders").select(F.col("o_orderdate").cast("date").alias("d"))
    calendar = orders.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(
        S.quarter_sequence("a", S.last_completed_quarter("b")).alias("QUARTER"))
    # a handful of quarters against per-quarter counts
    counts = orders.groupBy(S.quarter_end("d").alias("QUARTER")).agg(F.count(F.lit(1)).alias("FILINGS"))
    return calendar.join(counts, "QUARTER", "left").fillna(0, ["FILINGS"])


TODAY = "2021-05-10"
FRAGMENTS["v_files"] = """SELECT ['financials', 'ffiec', 'sod', 'treasury'][o_orderkey % 4 + 1] AS SOURCE,
 CAST(CAST(o_orderdate AS DATE) + INTERVAL 20 YEAR AS DATE) AS d FROM orders"""


def files(f):
    """One file name per order, dated twenty years later, as a source's folder would hold it."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    source = F.element_at(F.array(*map(F.lit, ("financials", "ffiec", "sod", "treasury"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return f.table("orders").select(source.alias("SOURCE"), day.alias("d"), F.concat(F.lit("/raw/all_"), F.date_format(day, "yyyyMMdd"), F.lit(".zip")).alias("PATH"))


@query("source_status", "SOURCE LATEST TARGET LAG:i UNIT STATUS",
       """SELECT SOURCE, CASE WHEN SOURCE IN ('sod', 'treasury') THEN CAST(max(year(d)) AS VARCHAR) ELSE strftime(max(d), '%Y-%m-%d') END AS LATEST,
 CASE WHEN SOURCE IN ('sod', 'treasury') THEN '2020' ELSE '2021-03-31' END AS TARGET,
 CASE WHEN SOURCE IN ('sod', 'treasury') THEN 2020 - max(year(d)) ELSE (2021 - year(max(d))) * 4 - (quarter(max(d)) - 1) END AS LAG,
 CASE WHEN SOURCE IN ('sod', 'treasury') THEN 'Y' ELSE 'Q' END AS UNIT, 'OK' AS STATUS FROM v_files GROUP BY SOURCE""")
def status(f):
    return source_status(files(f), TODAY)


@query("source_windows", "SOURCE PERIOD FILES:i",
       """SELECT w.SOURCE, w.PERIOD, count(v.d) AS FILES FROM (
 SELECT 'financials' AS SOURCE, strftime(last_day(m), '%Y%m%d') AS PERIOD FROM (SELECT unnest(generate_series(DATE '2007-03-01', DATE '2021-03-01', INTERVAL 3 MONTH)) AS m)
 UNION ALL SELECT 'ffiec', strftime(last_day(m), '%Y%m%d') FROM (SELECT unnest(generate_series(DATE '2020-03-01', DATE '2021-03-01', INTERVAL 3 MONTH)) AS m)
 UNION ALL SELECT 'sod', CAST(unnest(range(2010, 2021)) AS VARCHAR) UNION ALL SELECT 'treasury', '20' || CAST(unnest(range(22, 21)) AS VARCHAR)) w
 LEFT JOIN v_files v ON v.SOURCE = w.SOURCE AND w.PERIOD = CASE WHEN length(w.PERIOD) = 4 THEN CAST(year(v.d) AS VARCHAR)
  ELSE strftime(last_day(date_trunc('quarter', v.d) + INTERVAL 2 MONTH), '%Y%m%d') END GROUP BY 1, 2""")
def windows(f):
    """Files that each source has for the periods it should cover."""
    yearly = F.col("SOURCE").isin("sod", "treasury")
    have = files(f).select("SOURCE", F.when(yearly, F.year("d").cast("string")).otherwise(F.date_format(S.quarter_end("d"), "yyyyMMdd")).alias("PERIOD"))
    have = have.groupBy("SOURCE", "PERIOD").agg(F.count(F.lit(1)).alias("FILES"))
    return source_windows(f.spark, TODAY).join(have, ["SOURCE", "PERIOD"], "left").fillna(0, ["FILES"])


@query("annual_survey_year", "o_orderkey SURVEY:i SNAPSHOT:d",
       """SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 0 END AS SURVEY,
 make_date(CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 6 THEN 0 ELSE 1 END AS INT), 6, 30) AS SNAPSHOT FROM orders""")
def annual_survey_year(f):
    return f.table("orders").select("o_orderkey", S.survey_year("o_orderdate").alias("SURVEY"),
                                    S.survey_snapshot_date("o_orderdate").alias("SNAPSHOT"))


@query("coverage_flags", "CERT REPDTE:d HAS_SOD_FEATURES:i HAS_FFIEC_FEATURES:i HAS_DERIVATIVE_FEATURES:i "
       "HAS_HISTORICAL_ENTITY_MAP:i",
       "SELECT CERT, REPDTE, (coalesce(BRO, DDT) IS NOT NULL)::INT AS HAS_SOD_FEATURES, (DDT IS NOT NULL)::INT "
       "AS HAS_FFIEC_FEATURES, 0 AS HAS_DERIVATIVE_FEATURES, 0 AS HAS_HISTORICAL_ENTITY_MAP FROM v_panel")
def coverage_flags(f):
    return panel.coverage_flags(f.panel.withColumns({
        "SOD_TOTAL_DEPOSITS": F.col("BRO"), "SOD_STATE_COUNT": F.col("DDT"), "LOAN_WAM_PROXY": F.col("DDT")}))


@query("row_version_tag", "CERT REPDTE:d INDEX_VERSION CUSTOM",
       "SELECT CERT, REPDTE, CASE WHEN DDT IS NOT NULL THEN 'v1_ffiec_hybrid' ELSE 'v0_fdic_only' END AS INDEX_VERSION, "
       "'trial' AS CUSTOM FROM v_panel")
def row_version_tag(f):
    df = f.panel.withColumn("HAS_FFIEC_FEATURES", F.col("DDT").isNotNull().cast("int"))
    custom = indices.version_tag(df, "trial").withColumnRenamed("INDEX_VERSION", "CUSTOM")
    return indices.version_tag(custom)


@query("unhedged_flag", "CERT REPDTE:d UNHEDGED_DURATION_FLAG:i",
       f"SELECT CERT, REPDTE, ({nz('h')} = 0 AND {nz('g')} > 0)::INT AS UNHEDGED_DURATION_FLAG FROM (SELECT CERT, REPDTE, "
       "CASE WHEN BRO > 100000 THEN 1 WHEN BRO > 50000 THEN 0 END AS h, DDT - DEPLSNB AS g FROM v_panel)")
def unhedged_flag(f):
    return indices.unhedged_flag(f.panel.withColumns({
        "HAS_IR_DERIVATIVES": F.when(F.col("BRO") > 100000, 1).when(F.col("BRO") > 50000, 0),
        "DURATION_GAP_LITE": F.col("DDT") - F.col("DEPLSNB")}))


_RE = SUFFIX_PATTERN.replace("(?i)", "").replace("'", "''")


def normalized_sql(c: str) -> str:
    text = f"trim(lower(coalesce({c}, '')))"
    for _ in range(3):
        text = f"trim(regexp_replace({text}, '{_RE}', '', 'i'))"
    return f"trim(regexp_replace(regexp_replace({text}, '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_name", "p_partkey NAME_NORM",
       f"SELECT p_partkey, {normalized_sql('n')} AS NAME_NORM FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand || "
       "' ' || p_name || ' Holdings, Inc.' WHEN p_size < 25 THEN 'The ' || p_name || ' Bancorp  Co' ELSE p_type || ' ' || p_name "
       "|| ' N.A.' END AS n FROM part)")
def normalize(f):
    name = (F.when(F.col("p_size") < 10, F.concat_ws(" ", "p_brand", "p_name", F.lit("Holdings, Inc.")))
            .when(F.col("p_size") < 25, F.concat(F.lit("The "), "p_name", F.lit(" Bancorp  Co")))
            .otherwise(F.concat_ws(" ", "p_type", "p_name", F.lit("N.A."))))
    return f.table("part").select("p_partkey", normalize_name(name).alias("NAME_NORM"))


@query("risk_band", "CERT REPDTE:d BAND TIER",
       "SELECT CERT, REPDTE, CASE WHEN RUN_RISK_SCORE >= 80 THEN 'critical' WHEN RUN_RISK_SCORE >= 60 THEN 'high' "
       "WHEN RUN_RISK_SCORE >= 40 THEN 'elevated' WHEN RUN_RISK_SCORE >= 20 THEN 'moderate' ELSE 'low' END AS BAND, "
       "CASE WHEN RUN_RISK_SCORE >= 80 THEN 'very high' WHEN RUN_RISK_SCORE >= 60 THEN 'elevated' WHEN RUN_RISK_SCORE >= 40 "
       "THEN 'moderate' ELSE 'low' END AS TIER FROM v_run")
def risk_band(f):
    from panelyard.plans.deposits import deposit_features

    df = deposit_features(f.panel)
    return df.withColumns({"BAND": S.threshold_label("RUN_RISK_SCORE", cfg.RISK_BANDS, "low"),
                           "TIER": S.threshold_label("RUN_RISK_SCORE", cfg.COMPOSITE_TIERS, "low")})


@query("curve_regime", "REPDTE:d YC_10Y_3M_SLOPE_BP:r CURVE_REGIME",
       "SELECT REPDTE, YC_10Y_3M_SLOPE_BP, CASE WHEN YC_10Y_3M_SLOPE_BP < 0 THEN 'inverted' ELSE 'upward_sloping' END "
       "AS CURVE_REGIME FROM v_regime")
def curve(f):
    return regime_by_date(f.panel, f.yields).withColumn("CURVE_REGIME", curve_regime("YC_10Y_3M_SLOPE_BP"))
