"""Queries over reports and published records."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.catalog.evaluation_queries import labelled
from panelyard.catalog.fragments import FRAGMENTS, num
from panelyard.catalog.feature_queries import staged_panel
from panelyard.catalog.frames import BANDS, EPISODES, QUARTER
from panelyard.catalog.group_queries import layers, stage_competition, stage_deposits, stage_indices, stage_mismatch
from panelyard.catalog.registry import query
from panelyard.functions.scalars import last_completed_quarter, quarter_distance
from panelyard.operators.windows import lagged
from panelyard.plans import backtest, competition, indices, publish, reports, treasury
from panelyard.session import cut_lineage

BUILT_AT = "2001-12-05T00:00:00Z"
_DRILL = ["ASSET", *cfg.INDEX_COLUMNS, "UNINSURED_SHARE", "VOLATILE_TO_LIQUID_LOWER", "RUN_RISK_SCORE", "PASS_THROUGH_GAP_BP"]


def record_table(f):
    """What published records read of the index table, written once."""
    return cut_lineage(publish.record_columns(stage_indices(f)))


def manifest_table(f):
    """What the manifest reads of the index table, written once."""
    return cut_lineage(publish.manifest_columns(stage_indices(f)))


def cols(names, kind: str = "r") -> str:
    return " ".join(f"{n}:{kind}" for n in names)


@query("drill_down", "CERT REPDTE:d NAMEFULL PEER_GROUP " + cols(_DRILL), "SELECT * FROM v_idx WHERE CERT = '7'")
def drill_down(f):
    return reports.drill_down(stage_indices(f), "7")


_LEAGUE = ["ASSET", *cfg.INDEX_COLUMNS, "RUN_RISK_SCORE", "DEPOSIT_COMPETITION_PRESSURE_SCORE", *cfg.LEAGUE_FEATURES]


@query("league_table", "CERT NAMEFULL PEER_GROUP " + cols(_LEAGUE) + " FRAGILITY_RANK:i",
       "SELECT *, CASE WHEN FUNDING_FRAGILITY_INDEX IS NOT NULL THEN rank() OVER (ORDER BY FUNDING_FRAGILITY_INDEX DESC NULLS LAST) END "
       f"AS FRAGILITY_RANK FROM v_idx WHERE REPDTE = DATE '{QUARTER}'")
def league_table(f):
    return reports.league_table(stage_indices(f), QUARTER)


@query("scenario_comparison", "CERT NAMEFULL RUN_RISK_SCORE:r " + cols(cfg.SCENARIO_COLUMNS), f"SELECT * FROM v_dep WHERE REPDTE = DATE '{QUARTER}'")
def scenario_comparison(f):
    return reports.scenario_comparison(stage_deposits(f), QUARTER)


FRAGMENTS["v_overlay"] = ("SELECT CERT, REPDTE, CASE WHEN DDT > BRO THEN 1.0e0 WHEN DDT IS NOT NULL THEN 0.5e0 END "
                          "AS SUPERVISED_OUTFLOW_SCORE FROM v_panel")


def overlay_scores(f):
    return f.panel.select("CERT", "REPDTE", F.when(F.col("DDT") > F.col("BRO"), 1.0).when(F.col("DDT").isNotNull(), 0.5)
                          .alias("SUPERVISED_OUTFLOW_SCORE"), F.lit(0.0).alias("ASSET"))


@query("publishable_mart", "CERT REPDTE:d ASSET:r FUNDING_FRAGILITY_INDEX:r SUPERVISED_OUTFLOW_SCORE SUPERVISED_EXPERIMENTAL:i",
       "SELECT i.*, o.SUPERVISED_OUTFLOW_SCORE, (o.SUPERVISED_OUTFLOW_SCORE IS NOT NULL)::INT AS SUPERVISED_EXPERIMENTAL FROM v_idx i "
       "LEFT JOIN v_overlay o ON i.CERT = o.CERT AND i.REPDTE = o.REPDTE")
def publishable_mart(f):
    return reports.publishable_mart(stage_indices(f), overlay_scores(f))


@query("core_enriched_split", "CERT REPDTE:d DEPDOM:r INDEX_VERSION PANEL_VARIANT ENRICHED_WINDOW_START:d",
       """SELECT l.*, 'full_history_core' AS PANEL_VARIANT, w AS ENRICHED_WINDOW_START FROM v_layers l,
 (SELECT min(REPDTE) AS w FROM v_layers WHERE HAS_FFIEC_FEATURES > 0) UNION ALL
 SELECT l.*, 'recent_history_enriched', w FROM v_layers l, (SELECT min(REPDTE) AS w FROM v_layers WHERE HAS_FFIEC_FEATURES > 0) WHERE REPDTE >= w""")
def core_enriched_split(f):
    core, enriched = reports.core_enriched_split(cut_lineage(layers(f).drop("HAS_TREASURY_YIELD_HISTORY")))
    return core.unionByName(enriched, allowMissingColumns=True)


def _parts(kind: str, values: list[tuple[str, str, float, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT CERT, REPDTE, '{kind}' AS KIND, '{key}' AS KEY, '{label}' AS LABEL, {num(w)} AS WEIGHT, {pct} AS PERCENTILE, "
        f"{score} AS SCORE, {contribution} AS CONTRIBUTION FROM v_idx WHERE {contribution} IS NOT NULL"
        for key, label, w, pct, score, contribution in values)


def _ranked(components):
    whole = sum(w for _, w, _ in components)
    return [(c.lower(), label, w, f"100.0e0 * RANK_{c}", "NULL", f"100.0e0 * RANK_{c} * {num(w)} / {num(whole)}") for c, w, label in components]


def _contributed(index, components):
    return [(c.lower(), label, w, "NULL", "NULL", f"{index}_CONTRIB_{c}") for c, w, label in components]


_COMPOSITE = {"run_risk_index": "RUN_RISK_INDEX", "alm_mismatch_index": "ALM_MISMATCH_INDEX",
              "inverse_treasury_buffer_index": "(100.0e0 - TREASURY_BUFFER_INDEX)"}
FRAGMENTS["v_breakdown"] = " UNION ALL ".join([
    _parts("run_risk_components", _ranked(cfg.RUN_RISK_COMPONENTS)),
    _parts("deposit_competition_components", _ranked(cfg.PRESSURE_COMPONENTS)),
    _parts("alm_components", _contributed("ALM_MISMATCH_INDEX", cfg.MISMATCH_COMPONENTS)),
    _parts("treasury_buffer_components", _contributed("TREASURY_BUFFER_INDEX", cfg.BUFFER_COMPONENTS)),
    _parts("composite_components", [(k, label, w, "NULL", _COMPOSITE[k], f"{num(w)} * {_COMPOSITE[k]}")
                                    for k, w, label in cfg.COMPOSITE_COMPONENTS])])


@query("component_breakdown", "CERT REPDTE:d KIND KEY LABEL WEIGHT PERCENTILE:r SCORE:r CONTRIBUTION:r", "v_breakdown")
def component_breakdown(f):
    return _entries(publish.component_breakdown(stage_indices(f)), ["CERT", "REPDTE"])


def _entries(df, keep):
    """One row per entry of the component arrays."""
    def flat(name):
        def record(c):
            none = F.lit(None).cast("double")
            if name == "composite_components":
                percentile, score = none, c["score"]
            elif name in ("run_risk_components", "deposit_competition_components"):
                percentile, score = c["percentile"], none
            else:
                percentile, score = none, none
            return F.struct(F.lit(name).alias("KIND"), c["key"].alias("KEY"), c["label"].alias("LABEL"), c["weight"].alias("WEIGHT"),
                            percentile.alias("PERCENTILE"), score.alias("SCORE"), c["contribution"].alias("CONTRIBUTION"))

        return F.transform(name, record)

    return df.select(*keep, F.inline(F.concat(*[flat(n) for n in publish.COMPONENT_ARRAYS])))


_PLAIN = ("SELECT i.CERT AS cert, i.NAMEFULL AS name, i.PEER_GROUP AS peer_group, g.n AS peer_group_bank_count, ASSET AS assets, "
          "DEPDOM_EFFECTIVE AS deposits, UNINSURED_SHARE AS uninsured_pct, STALP AS state, strftime(i.REPDTE, '%Y-%m-%d') AS repdte, "
          "RUN_RISK_INDEX AS run_risk, ALM_MISMATCH_INDEX AS alm_mismatch, TREASURY_BUFFER_INDEX AS treasury_buffer, "
          "DEPOSIT_COMPETITION_PRESSURE_INDEX AS deposit_competition, FUNDING_FRAGILITY_INDEX AS funding_fragility, BKCLASS AS charter, "
          "strftime(TREASURY_YIELD_DATE, '%Y-%m-%d') AS treasury_yield_date, YC_10Y_3M_SLOPE_BP AS yc_10y_3m_slope_bp, INDEX_VERSION AS index_version, "
          "f.FAILDATE IS NOT NULL AS failed, strftime(f.FAILDATE, '%Y-%m-%d') AS fail_date, b.n AS n_components, b.c AS contributions "
          "FROM v_latest i JOIN (SELECT PEER_GROUP, count(*) AS n FROM v_latest GROUP BY 1) g ON i.PEER_GROUP = g.PEER_GROUP "
          "LEFT JOIN (SELECT CERT, max(FAILDATE) AS FAILDATE FROM v_failures GROUP BY 1) f ON i.CERT = f.CERT "
          "LEFT JOIN (SELECT CERT, REPDTE, count(*) AS n, sum(CONTRIBUTION) AS c FROM v_breakdown GROUP BY 1, 2) b "
          "ON i.CERT = b.CERT AND i.REPDTE = b.REPDTE")
_SUMMARY = ("cert name peer_group peer_group_bank_count:i assets:r deposits:r uninsured_pct:r state repdte run_risk:r alm_mismatch:r "
            "treasury_buffer:r deposit_competition:r funding_fragility:r")


@query("league_rows", _SUMMARY + " charter treasury_yield_date yc_10y_3m_slope_bp:r index_version failed:b fail_date n_components:i contributions:r",
       _PLAIN)
def league_rows(f):
    """The published records; their arrays are checked by size and by the sum of all contributions."""
    rows = publish.league_rows(record_table(f), f.failures)
    sizes, sums = F.lit(0), F.lit(0.0)
    for name in publish.COMPONENT_ARRAYS:
        sizes = sizes + F.size(name)
        sums = sums + F.aggregate(name, F.lit(0.0), lambda acc, c: acc + c["contribution"])
    return rows.withColumns({"n_components": sizes, "contributions": sums})


@query("bank_summary_rows", _SUMMARY, _PLAIN)
def bank_summary_rows(f):
    return publish.bank_summary_rows(record_table(f), f.failures)


@query("league_records", "JSON")
def league_records(f):
    """One JSON record per entity."""
    return publish.rows_to_json(publish.league_rows(record_table(f), f.failures))


def _leaf(path: str, text: str = "NULL", number: str = "NULL") -> str:
    return f"{{'PATH': {path}, 'TEXT': CAST({text} AS VARCHAR), 'NUMBER': CAST({number} AS DOUBLE)}}"


def _unnested(keep: str, leaves: list[str], source: str) -> str:
    """A row per leaf of each row of the source."""
    held = f"{keep}, " if keep else ""
    return f"SELECT {held}x.PATH, x.TEXT, x.NUMBER FROM (SELECT {held}unnest([{', '.join(leaves)}]) AS x FROM {source})"


# Published fields as texts and as numbers, apart from those that are lists.
_LEAF_TEXTS = {
    "cert": "i.CERT", "name": "NAMEFULL", "peer_group": "i.PEER_GROUP", "state": "STALP", "charter": "BKCLASS",
    "repdte": "strftime(i.REPDTE, '%Y-%m-%d')", "treasury_yield_date": "strftime(TREASURY_YIELD_DATE, '%Y-%m-%d')",
    "index_version": "INDEX_VERSION", "failed": "(f.FAILDATE IS NOT NULL)", "fail_date": "strftime(f.FAILDATE, '%Y-%m-%d')"}
_LEAF_NUMBERS = {
    "peer_group_bank_count": "g.n", "assets": "ASSET", "deposits": "DEPDOM_EFFECTIVE", "uninsured_pct": "UNINSURED_SHARE",
    "run_risk_score": "RUN_RISK_SCORE", "stickiness_score": "STICKINESS_SCORE", "run_risk": "RUN_RISK_INDEX",
    "alm_mismatch": "ALM_MISMATCH_INDEX", "treasury_buffer": "TREASURY_BUFFER_INDEX",
    "deposit_competition": "DEPOSIT_COMPETITION_PRESSURE_INDEX", "deposit_competition_resilience": "DEPOSIT_COMPETITION_RESILIENCE_INDEX",
    "deposit_competition_score": "DEPOSIT_COMPETITION_PRESSURE_SCORE", "funding_fragility": "FUNDING_FRAGILITY_INDEX",
    "supervised_outflow_score": "NULL", "has_treasury_yield_history": "HAS_TREASURY_YIELD_HISTORY", "yc_2yr": "YC_2YR",
    "yc_10yr": "YC_10YR", "yc_10y_3m_slope_bp": "YC_10Y_3M_SLOPE_BP", "yc_10y_2y_slope_bp": "YC_10Y_2Y_SLOPE_BP",
    "yc_10yr_qoq_change_bp": "YC_10YR_QOQ_CHANGE_BP", "has_ffiec_features": "HAS_FFIEC_FEATURES", "has_sod_features": "HAS_SOD_FEATURES"}
_KIND_PLACES = ", ".join(
    f"('{kind}', '{key}', {at})" for kind, keys in (
        ("run_risk_components", [c.lower() for c, _, _ in cfg.RUN_RISK_COMPONENTS]),
        ("deposit_competition_components", [c.lower() for c, _, _ in cfg.PRESSURE_COMPONENTS]),
        ("alm_components", [c.lower() for c, _, _ in cfg.MISMATCH_COMPONENTS]),
        ("treasury_buffer_components", [c.lower() for c, _, _ in cfg.BUFFER_COMPONENTS]),
        ("composite_components", [k for k, _, _ in cfg.COMPOSITE_COMPONENTS])) for at, key in enumerate(keys))


def _entry(field: str, text: str = "NULL", number: str = "NULL") -> str:
    return _leaf(f"b.KIND || '[' || b.at || '].{field}'", text, number)


FRAGMENTS["v_league_leaves"] = (
    _unnested("cert", [_leaf(f"'{n}'", c) for n, c in _LEAF_TEXTS.items()] + [_leaf(f"'{n}'", "NULL", c) for n, c in _LEAF_NUMBERS.items()],
              "(SELECT i.*, g, f FROM v_latest i JOIN (SELECT PEER_GROUP, count(*) AS n FROM v_latest GROUP BY 1) g ON i.PEER_GROUP = g.PEER_GROUP "
              "LEFT JOIN (SELECT CERT, max(FAILDATE) AS FAILDATE FROM v_failures GROUP BY 1) f ON i.CERT = f.CERT) i")
    + " UNION ALL " + _unnested(
        "cert", [_entry("key", "b.KEY"), _entry("label", "b.LABEL"), _entry("weight", "NULL", "b.WEIGHT"), _entry("contribution", "NULL", "b.CONTRIBUTION")],
        "v_entries b")
    + " UNION ALL " + _unnested("cert", [_entry("percentile", "NULL", "b.PERCENTILE")],
                                "v_entries b WHERE b.KIND IN ('run_risk_components', 'deposit_competition_components')")
    + " UNION ALL " + _unnested("cert", [_entry("score", "NULL", "b.SCORE")], "v_entries b WHERE b.KIND = 'composite_components'"))
FRAGMENTS["v_entries"] = (
    "SELECT b.*, row_number() OVER (PARTITION BY b.CERT, b.KIND ORDER BY p.place) - 1 AS at FROM v_breakdown b "
    "JOIN (SELECT CERT, REPDTE FROM v_latest) l ON b.CERT = l.CERT AND b.REPDTE = l.REPDTE "
    f"JOIN (VALUES {_KIND_PLACES}) p(kind, key, place) ON b.KIND = p.kind AND b.KEY = p.key")


@query("league_leaves", "cert PATH TEXT NUMBER:r", "v_league_leaves")
def league_leaves(f):
    """Every leaf of every published record, read back from its JSON text."""
    return publish.record_leaves(publish.league_rows(record_table(f), f.failures), "cert")


@query("headline_metric", "SLICE HORIZON_QUARTERS:i SCORE_COL AUC:r RECALL_AT_20PCT:r",
       "SELECT * FROM v_metrics WHERE SLICE = 'full_sample' AND HORIZON_QUARTERS = 4 AND SCORE_COL = 'FUNDING_FRAGILITY_INDEX'")
def headline_metric(f):
    metrics = backtest.metrics_table(labelled(f), {"full_sample": EPISODES["full_sample"]}, [4])
    return publish.headline_metric(metrics, "FUNDING_FRAGILITY_INDEX")


def _warning(source: str, c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN '{source} coverage is unavailable for the published site snapshot.' WHEN {c} < day THEN "
            f"'{source} coverage trails the published site snapshot (' || strftime({c}, '%Y-%m-%d') || ' vs ' || strftime(day, '%Y-%m-%d') || ').' END")


@query("freshness", "site_snapshot_as_of ffiec sod treasury warnings stale:b",
       "SELECT strftime(day, '%Y-%m-%d') AS site_snapshot_as_of, strftime(ffiec, '%Y-%m-%d') AS ffiec, strftime(sod, '%Y-%m-%d') AS sod, "
       "strftime(treasury, '%Y-%m-%d') AS treasury, concat_ws(' | ', " + ", ".join(
           _warning(s, c) for s, c in (("fdic_financials", "day"), ("ffiec", "ffiec"), ("sod", "sod"), ("treasury", "treasury")))
       + ") AS warnings, day < DATE '2001-09-30' AS stale FROM (SELECT max(REPDTE) AS day, max(CASE WHEN HAS_FFIEC_FEATURES > 0 THEN REPDTE END) "
       "AS ffiec, max(TREASURY_YIELD_DATE) AS treasury, make_date(CAST(year(max(CASE WHEN HAS_SOD_FEATURES > 0 THEN REPDTE END)) AS INT), 6, 30) AS sod "
       "FROM (SELECT l.*, r.TREASURY_YIELD_DATE FROM v_layers l JOIN v_regime r ON l.REPDTE = r.REPDTE))")
def freshness(f):
    one = publish.freshness(layers(f), BUILT_AT)
    return one.select("site_snapshot_as_of", "source_max_dates.ffiec", "source_max_dates.sod", "source_max_dates.treasury",
                      F.concat_ws(" | ", "coverage_warnings").alias("warnings"), "stale")


@query("source_lag", "CERT REPDTE:d LAG_QUARTERS:i LAG_YEARS:i GAP:i",
       "SELECT CERT, REPDTE, (2001 - year(REPDTE)) * 4 + 3 - quarter(REPDTE) AS LAG_QUARTERS, 2000 - year(REPDTE) AS LAG_YEARS, "
       "(year(REPDTE) - year(p)) * 4 + quarter(REPDTE) - quarter(p) AS GAP FROM (SELECT *, lag(REPDTE) OVER (PARTITION BY CERT ORDER BY REPDTE) AS p FROM v_panel)")
def source_lag(f):
    """How far each filing is behind the last completed quarter and year, and the gap to the one before."""
    target = last_completed_quarter(F.lit(BUILT_AT[:10]).cast("date"))
    return f.panel.select(
        "CERT", "REPDTE", quarter_distance("REPDTE", target).alias("LAG_QUARTERS"),
        (F.year(F.lit(BUILT_AT[:10]).cast("date")) - 1 - F.year("REPDTE")).alias("LAG_YEARS"),
        quarter_distance(lagged("REPDTE"), "REPDTE").alias("GAP"))


@query("manifest", "JSON")
def manifest(f):
    mart = manifest_table(f)
    core, enriched = reports.core_enriched_split(mart)
    metrics = backtest.metrics_table(labelled(f, mart), {"full_sample": EPISODES["full_sample"]}, [4])
    return publish.rows_to_json(publish.manifest(mart, BUILT_AT, core, enriched, metrics))


FRAGMENTS["v_headline"] = "SELECT * FROM v_metrics WHERE SLICE = 'full_sample' AND HORIZON_QUARTERS = 4"


@query("manifest_indices", "INDEX_ID title failure_auc:r failure_recall_20:r validation_status tops",
       "SELECT n.*, AUC AS failure_auc, RECALL_AT_20PCT AS failure_recall_20, 'backtested' AS validation_status, t.tops FROM ("
       + " UNION ALL ".join(f"SELECT '{i}' AS INDEX_ID, '{t}' AS title, '{s}' AS SCORE_COL" for i, (s, t) in cfg.PUBLISHED_INDICES.items())
       + ") n JOIN v_headline h ON n.SCORE_COL = h.SCORE_COL JOIN (SELECT INDEX_ID, string_agg(CERT, ',' ORDER BY RANK) AS tops FROM "
         "(SELECT *, row_number() OVER (PARTITION BY INDEX_ID ORDER BY SCORE DESC NULLS LAST, CERT) AS RANK FROM v_scores QUALIFY RANK <= 3) "
         "GROUP BY 1) t ON n.INDEX_ID = t.INDEX_ID")
def manifest_indices(f):
    mart = manifest_table(f)
    metrics = backtest.metrics_table(labelled(f, mart), {"full_sample": EPISODES["full_sample"]}, [4])
    out = publish.index_records(reports.snapshot(mart), metrics)
    return out.withColumn("tops", F.array_join(F.transform("top_banks", lambda b: b["cert"]), ","))


def _panel_leaves(path: str, where: str = "") -> str:
    day = lambda c: f"strftime({c}, '%Y-%m-%d')"
    return _unnested("", [_leaf(f"'{path}.bank_quarters'", "NULL", "rows"), _leaf(f"'{path}.unique_banks'", "NULL", "banks"),
                          _leaf(f"'{path}.quarters'", "NULL", "quarters"), _leaf(f"'{path}.date_range'", f"{day('first')} || ' – ' || {day('last')}")],
                     "(SELECT count(*) AS rows, count(DISTINCT CERT) AS banks, count(DISTINCT REPDTE) AS quarters, min(REPDTE) AS first, "
                     f"max(REPDTE) AS last FROM v_idx {where})")


_ENRICHED_FROM = "(SELECT min(REPDTE) FROM v_idx WHERE HAS_FFIEC_FEATURES > 0 OR HAS_TREASURY_YIELD_HISTORY > 0)"
FRAGMENTS["v_dates"] = (
    "SELECT max(REPDTE) AS day, max(CASE WHEN HAS_FFIEC_FEATURES > 0 THEN REPDTE END) AS ffiec, max(TREASURY_YIELD_DATE) AS treasury, "
    "make_date(CAST(year(max(CASE WHEN HAS_SOD_FEATURES > 0 THEN REPDTE END)) AS INT), 6, 30) AS sod FROM v_idx")
FRAGMENTS["v_warnings"] = (
    "SELECT text, row_number() OVER (ORDER BY nth) - 1 AS nth FROM (" + " UNION ALL ".join(
        f"SELECT {at} AS nth, {_warning(s, c)} AS text FROM v_dates"
        for at, (s, c) in enumerate((("fdic_financials", "day"), ("ffiec", "ffiec"), ("sod", "sod"), ("treasury", "treasury"))))
    + ") WHERE text IS NOT NULL")
FRAGMENTS["v_published"] = (
    "SELECT n.nth, n.id, n.title, AUC, RECALL_AT_20PCT, N_FAILURES FROM (VALUES " + ", ".join(
        f"({at}, '{i}', '{t}', '{s}')" for at, (i, (s, t)) in enumerate(cfg.PUBLISHED_INDICES.items()))
    + ") n(nth, id, title, score) JOIN v_headline h ON n.score = h.SCORE_COL")
FRAGMENTS["v_groups"] = (
    "SELECT PEER_GROUP, n, row_number() OVER (ORDER BY n DESC, PEER_GROUP) - 1 AS nth FROM (SELECT PEER_GROUP, count(*) AS n FROM v_latest GROUP BY 1)")


def _dated(name: str, column: str) -> str:
    return _leaf(f"'{name}'", f"strftime({column}, '%Y-%m-%d')")


def _placed(prefix: str, field: str, text: str = "NULL", number: str = "NULL") -> str:
    return _leaf(f"'{prefix}[' || nth || '].{field}'", text, number)


FRAGMENTS["v_manifest_leaves"] = " UNION ALL ".join([
    _unnested("", [_leaf("'schema_version'", "NULL", "3"), _leaf("'generated_at'", f"'{BUILT_AT}'"), _leaf("'freshness.generated_at'", f"'{BUILT_AT}'"),
                   _leaf("'headline_horizon_quarters'", "NULL", "4"), _leaf("'site_panel'", "'recent_history_enriched'"), _leaf("'published_panels.none'"),
                   _dated("freshness.site_snapshot_as_of", "day"), _dated("freshness.source_max_dates.fdic_financials", "day"),
                   _dated("freshness.source_max_dates.ffiec", "ffiec"), _dated("freshness.source_max_dates.sod", "sod"),
                   _dated("freshness.source_max_dates.treasury", "treasury"), _leaf("'freshness.stale'", "(day < DATE '2001-09-30')")], "v_dates"),
    _unnested("", [_leaf("'freshness.coverage_warnings[' || nth || ']'", "text")], "v_warnings"),
    _panel_leaves("pipeline"), _panel_leaves("published_panels.full_history_core"),
    _panel_leaves("published_panels.recent_history_enriched", f"WHERE REPDTE >= {_ENRICHED_FROM}"),
    _unnested("", [_leaf("'failures_tested'", "NULL", "N_FAILURES")], "v_published WHERE id = 'run_risk'"),
    _unnested("", [_dated("treasury_regime.yield_date", "day"), _leaf("'treasury_regime.y2'", "NULL", "y2"), _leaf("'treasury_regime.y10'", "NULL", "y10"),
                   _leaf("'treasury_regime.slope_10y_3m_bp'", "NULL", "slope")],
              "(SELECT max(TREASURY_YIELD_DATE) AS day, arg_max(YC_2YR, CERT) AS y2, arg_max(YC_10YR, CERT) AS y10, arg_max(YC_10Y_3M_SLOPE_BP, CERT) "
              "AS slope FROM v_latest WHERE TREASURY_YIELD_DATE IS NOT NULL)"),
    _unnested("", [_placed("indices", "position", "NULL", "nth"), _placed("indices", "id", "id"), _placed("indices", "title", "title"),
                   _placed("indices", "failure_auc", "NULL", "AUC"), _placed("indices", "failure_recall_20", "NULL", "RECALL_AT_20PCT"),
                   _placed("indices", "headline_horizon_quarters", "NULL", "4"), _placed("indices", "validation_status", "'backtested'")], "v_published"),
    _unnested("", [_placed("indices", f"top_banks[' || (RANK - 1) || '].{n}", t, v) for n, t, v in (
        ("rank", "NULL", "RANK"), ("name", "NAMEFULL", "NULL"), ("cert", "CERT", "NULL"), ("score", "NULL", "SCORE"), ("peer_group", "PEER_GROUP", "NULL"))],
        "(SELECT s.*, p.nth, row_number() OVER (PARTITION BY INDEX_ID ORDER BY SCORE DESC NULLS LAST, CERT) AS RANK FROM v_scores s "
        "JOIN v_published p ON s.INDEX_ID = p.id QUALIFY RANK <= 3)"),
    _unnested("", [_placed("peer_groups", "order", "NULL", "-n"), _placed("peer_groups", "id", "PEER_GROUP"), _placed("peer_groups", "count", "NULL", "n"),
                   _placed("peer_groups", "label", "array_to_string(list_transform(string_split(PEER_GROUP, '_'), lambda w: upper(w[1]) || w[2:]), ' ')")],
              "v_groups")])


@query("manifest_leaves", "PATH TEXT NUMBER:r", "v_manifest_leaves")
def manifest_leaves(f):
    """Every leaf of the manifest, read back from its JSON text."""
    mart = manifest_table(f)
    core, enriched = reports.core_enriched_split(mart)
    metrics = backtest.metrics_table(labelled(f, mart), {"full_sample": EPISODES["full_sample"]}, [4])
    return publish.record_leaves(publish.manifest(mart, BUILT_AT, core, enriched, metrics))


@query("competition_features", "CERT REPDTE:d OUTSIDE_OPTION_PREMIUM_BP:r DEPOSIT_COMPETITION_PRESSURE_SCORE:r", "v_comp")
def competition_features(f):
    return stage_competition(f)


# First report dates of the schedules and of the hedges in the full run; rows before them have neither.
SCHEDULES_FROM, HEDGES_FROM = "1997-01-01", "1999-01-01"
# Index rows of the full run: the indices of the plain panel with the staged flags.
FRAGMENTS["v_run_full"] = (
    "SELECT *, CASE WHEN HAS_FFIEC_FEATURES = 1 THEN 'v1_ffiec_hybrid' ELSE 'v0_fdic_only' END AS INDEX_VERSION, "
    "(coalesce(HEDGED, 0) = 0 AND coalesce(GAP, 0) > 0)::INT AS UNHEDGED_DURATION_FLAG FROM ("
    "SELECT i.* EXCLUDE (HAS_SOD_FEATURES, HAS_FFIEC_FEATURES, INDEX_VERSION), b.HAS_SOD_FEATURES, b.SOD_BRANCH_COUNT, "
    f"(b.HAS_FFIEC_FEATURES = 1 AND i.REPDTE >= DATE '{SCHEDULES_FROM}')::INT AS HAS_FFIEC_FEATURES, "
    f"CASE WHEN i.REPDTE >= DATE '{SCHEDULES_FROM}' THEN b.DURATION_GAP_LITE END AS GAP, "
    f"CASE WHEN i.REPDTE >= DATE '{HEDGES_FROM}' THEN b.HAS_IR_DERIVATIVES END AS HEDGED "
    "FROM v_idx i JOIN v_bank_panel b ON i.CERT = b.CERT AND i.REPDTE = b.REPDTE)")


def full_run(f):
    """From the staged tables to the index table."""
    staged = cut_lineage(staged_panel(f, SCHEDULES_FROM, HEDGES_FROM, equity=True))  # ranks and rates read it several times
    df = treasury.treasury_features(stage_mismatch(f, staged), f.yields, check=False)
    return indices.indices_frame(competition.competition_features(df, f.rates), bands=BANDS)


@query("full_run_indices", "CERT REPDTE:d NAMEFULL STALP PEER_GROUP INDEX_VERSION UNHEDGED_DURATION_FLAG:i HAS_SOD_FEATURES:i HAS_FFIEC_FEATURES:i "
       "SOD_BRANCH_COUNT:i " + " ".join(f"{c}:r" for c in cfg.INDEX_COLUMNS), "v_run_full")
def full_run_indices(f):
    """One run over financials, institutions, branches, schedules, hedges, yields and rates: base and schedule rows mixed."""
    return full_run(f)


@query("full_run_records", "cert repdte name peer_group peer_group_bank_count:i funding_fragility:r index_version failed:b fail_date KIND KEY LABEL "
       "WEIGHT PERCENTILE:r SCORE:r CONTRIBUTION:r",
       "SELECT i.CERT AS cert, strftime(i.REPDTE, '%Y-%m-%d') AS repdte, i.NAMEFULL AS name, i.PEER_GROUP AS peer_group, g.n AS peer_group_bank_count, "
       "i.FUNDING_FRAGILITY_INDEX AS funding_fragility, i.INDEX_VERSION AS index_version, x.FAILDATE IS NOT NULL AS failed, "
       "strftime(x.FAILDATE, '%Y-%m-%d') AS fail_date, b.* EXCLUDE (CERT, REPDTE) "
       "FROM (SELECT * FROM v_run_full QUALIFY row_number() OVER (PARTITION BY CERT ORDER BY REPDTE DESC) = 1) i "
       "JOIN (SELECT PEER_GROUP, count(*) AS n FROM v_latest GROUP BY 1) g ON i.PEER_GROUP = g.PEER_GROUP "
       "LEFT JOIN (SELECT CERT, max(FAILDATE) AS FAILDATE FROM v_failures GROUP BY 1) x ON i.CERT = x.CERT "
       "JOIN v_breakdown b ON i.CERT = b.CERT AND i.REPDTE = b.REPDTE")
def full_run_records(f):
    """The published records of that run, their nested arrays compared entry by entry."""
    # read for the records and their peers, so what they show is written once
    rows = publish.league_rows(cut_lineage(publish.record_columns(full_run(f))), f.failures)
    return _entries(rows, ["cert", "repdte", "name", "peer_group", "peer_group_bank_count", "funding_fragility", "index_version",
                           "failed", "fail_date"])
