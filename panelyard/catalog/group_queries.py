"""Queries over aggregates, top-k, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.catalog.fragments import FRAGMENTS
from panelyard.catalog.frames import BANDS, Frames
from panelyard.catalog.registry import query
from panelyard.operators import aggregates as A
from panelyard.plans import checks, competition, deposits, indices, mismatch, outflow, overlay, reports, treasury
from panelyard.plans.publish import component_breakdown, top_drivers
from panelyard.session import cut_lineage


def stage_deposits(f: Frames, panel=None):
    return deposits.deposit_features(f.panel if panel is None else panel)


def stage_mismatch(f: Frames, panel=None):
    return mismatch.mismatch_features(stage_deposits(f, panel), check=False)


def stage_treasury(f: Frames):
    # rates are looked up for the panel's dates, so the panel is read twice from here on
    return treasury.treasury_features(stage_mismatch(f, f.written_panel), f.yields, check=False)


def stage_competition(f: Frames):
    return competition.competition_features(stage_treasury(f), f.rates)


def stage_indices(f: Frames):
    """The whole pipeline on one lineage."""
    return indices.indices_frame(stage_competition(f), bands=BANDS)


@query("branch_totals", "CERT SOD_YEAR:i SOD_TOTAL_DEPOSITS:r",
       "SELECT CERT, YEAR AS SOD_YEAR, sum(DEPSUMBR) AS SOD_TOTAL_DEPOSITS FROM v_branch GROUP BY 1, 2")
def branch_totals(f):
    return A.branch_totals(f.branch)


@query("branch_distinct", "CERT SOD_YEAR:i SOD_BRANCH_COUNT:i",
       "SELECT CERT, YEAR AS SOD_YEAR, count(DISTINCT UNINUMBR) AS SOD_BRANCH_COUNT FROM v_branch GROUP BY 1, 2")
def branch_distinct(f):
    return A.branch_distinct(f.branch)


@query("geo_concentration", "CERT SOD_YEAR:i SOD_STATE_COUNT:i SOD_TOP_STATE_SHARE:r SOD_DEPOSIT_HHI_STATE:r "
       "SOD_COUNTY_COUNT:i SOD_DEPOSIT_HHI_COUNTY:r",
       "SELECT s.*, s.YEAR AS SOD_YEAR, c.* EXCLUDE (CERT, YEAR) FROM v_state s JOIN v_county c ON s.CERT = c.CERT AND s.YEAR = c.YEAR")
def geo_concentration(f):
    return A.geo_concentration(f.branch)


@query("sod_features", "CERT SOD_YEAR:i SOD_TOTAL_DEPOSITS:r SOD_BRANCH_COUNT:i SOD_STATE_COUNT:i SOD_TOP_STATE_SHARE:r "
       "SOD_DEPOSIT_HHI_STATE:r SOD_COUNTY_COUNT:i SOD_DEPOSIT_HHI_COUNTY:r", "v_sod")
def sod_features(f):
    return A.sod_features(f.branch)


_SUMMARY = [*cfg.INDEX_COLUMNS, *cfg.SUMMARY_FEATURES]


@query("peer_summary", "REPDTE:d PEER_GROUP " + " ".join(f"{c}_MEDIAN:r {c}_MEAN:r {c}_COUNT:i" for c in _SUMMARY),
       "SELECT REPDTE, PEER_GROUP, " + ", ".join(
           f"median({c}) AS {c}_MEDIAN, avg({c}) AS {c}_MEAN, count({c}) AS {c}_COUNT" for c in _SUMMARY)
       + " FROM v_idx GROUP BY 1, 2")
def peer_summary(f):
    # read twice (moments and medians), so the index table is written once
    return reports.peer_summary(cut_lineage(stage_indices(f).select("REPDTE", "PEER_GROUP", *_SUMMARY)))


_REGIME = ["HAS_TREASURY_YIELD_HISTORY", "YC_3MO", "YC_2YR", "YC_10YR"]
_MOVES = ["YC_10Y_3M_SLOPE_BP", "YC_10Y_2Y_SLOPE_BP", "YC_2YR_QOQ_CHANGE_BP", "YC_10YR_QOQ_CHANGE_BP",
          "YC_10Y_3M_SLOPE_BP_QOQ_CHANGE_BP", "YC_10Y_2Y_SLOPE_BP_QOQ_CHANGE_BP"]


@query("regime_summary", "REPDTE:d TREASURY_YIELD_DATE:d " + " ".join(_REGIME[1:]) + " HAS_TREASURY_YIELD_HISTORY:i "
       + " ".join(f"{c}:r" for c in _MOVES) + " CURVE_REGIME",
       "SELECT *, CASE WHEN YC_10Y_3M_SLOPE_BP < 0 THEN 'inverted' ELSE 'upward_sloping' END AS CURVE_REGIME FROM v_regime")
def regime_summary(f):
    return reports.regime_summary(treasury.yield_regime(f.panel.select("CERT", "REPDTE"), f.yields))


FRAGMENTS["v_layers"] = """SELECT p.*, (t.TREASURY_YIELD_DATE IS NOT NULL)::INT AS HAS_TREASURY_YIELD_HISTORY,
 p.BRO AS SOD_TOTAL_DEPOSITS, p.DDT AS DURATION_GAP_LITE, (p.DDT IS NOT NULL AND p.REPDTE >= DATE '1997-01-01')::INT AS HAS_FFIEC_FEATURES,
 (p.BRO IS NOT NULL AND p.REPDTE < DATE '2001-01-01')::INT AS HAS_SOD_FEATURES,
 CASE WHEN p.DDT IS NOT NULL AND p.REPDTE >= DATE '1997-01-01' THEN 'v1_ffiec_hybrid' ELSE 'v0_fdic_only' END AS INDEX_VERSION
 FROM v_panel p JOIN v_regime t ON p.REPDTE = t.REPDTE"""


def layers(f: Frames):
    """The panel with coverage that starts and ends at different dates."""
    day = F.col("REPDTE")
    df = treasury.yield_regime(f.panel, f.yields).withColumns({
        "SOD_TOTAL_DEPOSITS": F.col("BRO"), "DURATION_GAP_LITE": F.col("DDT"),
        "HAS_FFIEC_FEATURES": (F.col("DDT").isNotNull() & (day >= F.lit("1997-01-01").cast("date"))).cast("int"),
        "HAS_SOD_FEATURES": (F.col("BRO").isNotNull() & (day < F.lit("2001-01-01").cast("date"))).cast("int")})
    return indices.version_tag(df)


@query("layer_coverage", "REPDTE:d BANKS:i SOD:i FFIEC:i TSY:i VERSION",
       "SELECT REPDTE, count(*) AS BANKS, count(BRO) AS SOD, count(DDT) AS FFIEC, sum(HAS_TREASURY_YIELD_HISTORY) AS TSY, "
       "min(INDEX_VERSION) AS VERSION FROM v_layers GROUP BY 1")
def layer_coverage(f):
    return reports.layer_coverage(layers(f))


@query("peer_sizes", "PEER_GROUP PEER_COUNT:i", "SELECT PEER_GROUP, count(*) AS PEER_COUNT FROM v_latest GROUP BY 1")
def peer_sizes(f):
    return reports.peer_sizes(reports.snapshot(indices.with_peer_group(f.panel, BANDS)))


@query("panel_profile", "PANEL BANK_QUARTERS:i UNIQUE_BANKS:i QUARTERS:i DATE_RANGE",
       "SELECT 'all' AS PANEL, count(*) AS BANK_QUARTERS, count(DISTINCT CERT) AS UNIQUE_BANKS, count(DISTINCT REPDTE) AS QUARTERS, "
       "strftime(min(REPDTE), '%Y-%m-%d') || ' – ' || strftime(max(REPDTE), '%Y-%m-%d') AS DATE_RANGE FROM v_panel")
def panel_profile(f):
    return A.profile(f.panel, "all")


@query("max_date_where_flag", "FFIEC:d SOD:d NONE:d",
       "SELECT max(CASE WHEN HAS_FFIEC_FEATURES > 0 THEN REPDTE END) AS FFIEC, max(CASE WHEN HAS_SOD_FEATURES > 0 THEN REPDTE END) "
       "AS SOD, NULL::DATE AS NONE FROM v_layers")
def max_date_where_flag(f):
    df = layers(f)
    return df.agg(reports.latest_with_flag(df, "HAS_FFIEC_FEATURES").alias("FFIEC"),
                  reports.latest_with_flag(df, "HAS_SOD_FEATURES").alias("SOD"),
                  F.max(reports.latest_with_flag(df, "NOSUCH")).alias("NONE"))


@query("enriched_start", "ENRICHED_WINDOW_START:d",
       "SELECT min(REPDTE) AS ENRICHED_WINDOW_START FROM v_layers WHERE HAS_FFIEC_FEATURES > 0")
def enriched_start(f):
    return reports.enriched_start(layers(f).drop("HAS_TREASURY_YIELD_HISTORY"))


@query("duplicate_keys", "l_suppkey l_partkey N_ROWS:i",
       "SELECT l_suppkey, l_partkey, count(*) AS N_ROWS FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(f):
    return A.duplicate_keys(f.table("lineitem"), ["l_suppkey", "l_partkey"])


@query("group_quantile", "REPDTE:d P5:r",
       "SELECT REPDTE, quantile_cont(BRO, 0.05) AS P5 FROM v_panel WHERE BRO IS NOT NULL GROUP BY 1")
def group_quantile(f):
    return outflow.group_quantile(f.panel, "REPDTE", "BRO", 0.05, "P5")


@query("group_quantile_sliced", "l_returnflag P5:r P50:r P90:r",
       "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS P5, quantile_cont(l_extendedprice, 0.5) AS P50, "
       "quantile_cont(l_extendedprice, 0.9) AS P90 FROM lineitem GROUP BY 1")
def group_quantile_sliced(f):
    """Three groups that each hold a third of all lines: the form for groups of any size."""
    from panelyard.operators.ordered import exact_quantiles

    out = exact_quantiles(f.table("lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.05, 0.5, 0.9])
    return out.toDF("l_returnflag", "__metric", "n", "P5", "P50", "P90")


@query("median_impute", "CERT REPDTE:d BRO:r DDT:r IDCD1T3:r",
       "SELECT CERT, REPDTE, coalesce(BRO, (SELECT median(BRO) FROM v_panel WHERE REPDTE < DATE '1999-01-01')) AS BRO, "
       "coalesce(DDT, (SELECT median(DDT) FROM v_panel WHERE REPDTE < DATE '1999-01-01')) AS DDT, "
       "coalesce(IDCD1T3, (SELECT median(IDCD1T3) FROM v_panel WHERE REPDTE < DATE '1999-01-01')) AS IDCD1T3 FROM v_panel")
def median_impute(f):
    df = f.panel
    train = df.filter(F.col("REPDTE") < F.lit("1999-01-01").cast("date"))
    return overlay.median_impute(train, df, ["BRO", "DDT", "IDCD1T3"])


@query("usable_features", "FEATURE N_VALUES:i STD:r",
       " UNION ALL ".join(f"SELECT '{c}' AS FEATURE, count({c}) AS N_VALUES, stddev_samp({c}) / 1000 AS STD FROM v_panel"
                          for c in ("BRO", "DDT", "DEPLSNB")))
def usable_features(f):
    df = f.panel.withColumn("FLAT", F.lit(1.0))
    names = A.usable_features(cut_lineage(df.select("BRO", "DDT", "DEPLSNB", "FLAT")), ["BRO", "DDT", "DEPLSNB", "FLAT", "NOSUCH"])
    return A.feature_stats(df, names).withColumn("STD", F.col("STD") / 1000)


@query("ordered_panel", "CERT REPDTE:d ASSET:r", "SELECT CERT, REPDTE, ASSET FROM v_panel WHERE CERT IS NOT NULL AND REPDTE IS NOT NULL")
def ordered_panel(f):
    known = f.panel.filter(F.col("CERT").isNotNull() & F.col("REPDTE").isNotNull())
    return known.orderBy("CERT", "REPDTE")


FRAGMENTS["v_scores"] = " UNION ALL ".join(
    f"SELECT '{i}' AS INDEX_ID, CERT, NAMEFULL, PEER_GROUP, {score} AS SCORE FROM v_latest"
    for i, (score, _) in cfg.PUBLISHED_INDICES.items())


@query("top_k_per_index", "INDEX_ID CERT NAMEFULL PEER_GROUP SCORE:r RANK:i",
       "SELECT *, row_number() OVER (PARTITION BY INDEX_ID ORDER BY SCORE DESC NULLS LAST, CERT) AS RANK FROM v_scores QUALIFY RANK <= 3")
def top_k_per_index(f):
    return reports.top_k_per_index(reports.snapshot(stage_indices(f)))


_PARTS = " UNION ALL ".join(
    f"SELECT CERT, REPDTE, '{c.lower()}' AS KEY, 100.0e0 * RANK_{c} * {w}e0 / {sum(x for _, x, _ in cfg.RUN_RISK_COMPONENTS)!r}e0 AS CONTRIBUTION "
    f"FROM v_run" for c, w, _ in cfg.RUN_RISK_COMPONENTS)
FRAGMENTS["v_parts"] = _PARTS


@query("top_drivers", "CERT REPDTE:d PLACE:i KEY CONTRIBUTION:r",
       "SELECT *, row_number() OVER (PARTITION BY CERT, REPDTE ORDER BY round(CONTRIBUTION, 9) DESC, KEY) AS PLACE FROM v_parts QUALIFY PLACE <= 3")
def top_three(f):
    df = component_breakdown(stage_deposits(f)).withColumn("run_risk_components", F.transform(
        "run_risk_components", lambda c: c.withField("contribution", F.round(c["contribution"], 9))))
    return df.select("CERT", "REPDTE", F.posexplode(top_drivers("run_risk_components")).alias("p", "d")).select(
        "CERT", "REPDTE", (F.col("p") + 1).alias("PLACE"), F.col("d.key").alias("KEY"),
        F.col("d.contribution").alias("CONTRIBUTION"))


@query("search_filter_page", "cert name state peer_group funding_fragility:r RANK:i",
       """SELECT * FROM (SELECT CERT AS cert, NAMEFULL AS name, STALP AS state, PEER_GROUP AS peer_group, FUNDING_FRAGILITY_INDEX
 AS funding_fragility, row_number() OVER (ORDER BY coalesce(FUNDING_FRAGILITY_INDEX, 0) DESC, CERT) AS RANK FROM v_latest
 WHERE (lower(NAMEFULL) LIKE '%1%' OR lower(CERT) LIKE '%1%' OR lower(STALP) LIKE '%1%') AND PEER_GROUP <> 'unassigned')
 WHERE RANK > 5 AND RANK <= 10""")
def search_filter_page(f):
    latest = reports.snapshot(stage_indices(f))
    rows = latest.select(F.col("CERT").alias("cert"), F.col("NAMEFULL").alias("name"), F.col("STALP").alias("state"),
                         F.col("PEER_GROUP").alias("peer_group"), F.col("FUNDING_FRAGILITY_INDEX").alias("funding_fragility"))
    return reports.search_page(rows, "1", [n for n, _, _ in BANDS], page=2, size=5)


@query("union_all_flags", "CERT REPDTE:d CHECK DETAIL",
       "SELECT CERT, REPDTE, 'COREDEP_GT_DEPDOM' AS \"CHECK\", 'COREDEP > DEPDOM' AS DETAIL FROM v_panel WHERE COREDEP > DEPDOM "
       "UNION ALL SELECT CERT, REPDTE, 'SCPLEDGE_GT_SC', 'SCPLEDGE > SC' FROM v_panel WHERE SCPLEDGE > SC "
       "UNION ALL SELECT CERT, REPDTE, 'NEGATIVE_DEPOSIT', 'DEPDOM < 0' FROM v_panel WHERE DEPDOM < 0 "
       "UNION ALL SELECT CERT, REPDTE, 'NEGATIVE_DEPOSIT', 'COREDEP < 0' FROM v_panel WHERE COREDEP < 0")
def union_all_flags(f):
    return checks.run_checks(f.panel, [checks.core_over_domestic, checks.pledged_over_securities, checks.negative_deposits])
