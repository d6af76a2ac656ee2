"""Queries over labels, back-tests, checks and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.catalog.fragments import FRAGMENTS
from panelyard.catalog.frames import EPISODES, FIRST_YEAR, LAST_YEAR, QUARTER, Frames
from panelyard.catalog.feature_queries import staged_panel
from panelyard.catalog.group_queries import stage_indices, stage_mismatch, stage_treasury
from panelyard.catalog.registry import query
from panelyard.plans import backtest, checks, outflow, overlay, stress, treasury
from panelyard.session import cut_lineage

K = "CERT REPDTE:d "
_FLAGS = " ".join(f"FORWARD_OBSERVED_{h}Q:i FAIL_WITHIN_{h}Q:i" for h in cfg.HORIZONS)


def labelled(f: Frames, table=None):
    """Index table with failure labels, written once: the scores and the columns a back-test reads."""
    narrow = (stage_indices(f) if table is None else table).select("CERT", "REPDTE", *cfg.BACKTEST_SCORES)
    return cut_lineage(backtest.failure_labels(narrow, f.failures, FIRST_YEAR, LAST_YEAR))


@query("failure_labels", K + "FAILDATE:d FAIL_DATE:d FAILED_BANK:i QUARTERS_TO_FAILURE:i " + _FLAGS,
       "SELECT *, FAILDATE AS FAIL_DATE, (FAILDATE IS NOT NULL)::INT AS FAILED_BANK FROM v_labels")
def failure_labels(f):
    return backtest.failure_labels(f.panel, f.failures, FIRST_YEAR, LAST_YEAR)


_TOPS = [f"{m}_AT_{k}PCT" for k in cfg.TOP_SHARES for m in ("PRECISION", "RECALL")]


@query("auc", "SLICE HORIZON_QUARTERS:i SCORE_COL AUC:r N_FAILURES:i N_TOTAL:i",
       "SELECT * FROM v_metrics WHERE SLICE = 'full_sample'")
def auc(f):
    return backtest.metrics_table(labelled(f), {"full_sample": (None, None)})


@query("precision_recall_at", "SLICE HORIZON_QUARTERS:i SCORE_COL " + " ".join(f"{t}:r" for t in _TOPS),
       "SELECT * FROM v_metrics WHERE SLICE = 'full_sample'")
def precision_recall_at(f):
    return backtest.metrics_table(labelled(f), {"full_sample": (None, None)})


@query("metrics_table", "SLICE HORIZON_QUARTERS:i SCORE_COL SCORE_LABEL AUC:r N_FAILURES:i N_TOTAL:i " + " ".join(f"{t}:r" for t in _TOPS),
       "v_metrics")
def metrics_table(f):
    return backtest.metrics_table(labelled(f), EPISODES)


@query("outflow_labels", K + "NEXT_DEP_GROWTH_QOQ:r NEXT_Q_OBSERVED:b SEVERE_RELATIVE_OUTFLOW:i SEVERE_ABSOLUTE_OUTFLOW:i", "v_outflow")
def outflow_labels(f):
    return outflow.outflow_labels(f.written_panel)


def _found(source: str, condition: str, code: str, detail: str) -> str:
    return f"SELECT CERT, REPDTE, '{code}' AS \"CHECK\", '{detail}' AS DETAIL FROM {source} WHERE {condition}"


_SHARES = ["UNINSURED_SHARE", "BROKERED_SHARE", "LIST_SERVICE_SHARE", "LARGE_ACCOUNT_SHARE", "CORE_DEPOSIT_SHARE", "NONINTEREST_SHARE",
           "TIME_DEPOSIT_SHARE", "SHORT_FHLB_SHARE"]
_COVER = ["TREASURY_TO_UNINSURED", "TREASURY_AGENCY_TO_RUNNABLE", "HQLA_NARROW_LOWER_TO_RUNNABLE", "VOLATILE_TO_LIQUID_LOWER"]
_SEC = " + ".join(f"coalesce({c}, 0)" for c in cfg.SECURITY_BUCKETS)
_ADV = " + ".join(f"coalesce({c}, 0)" for c in cfg.ADVANCE_BUCKETS)
FRAGMENTS["v_checked"] = """SELECT t.*, lag(t.RSSDHCR) OVER (PARTITION BY t.CERT ORDER BY t.REPDTE) AS h, s.SOD_TOTAL_DEPOSITS,
 s.SOD_DEPOSIT_HHI_STATE, s.SOD_DEPOSIT_HHI_COUNTY FROM v_tsy t LEFT JOIN v_panel_sod s ON t.CERT = s.CERT AND t.REPDTE = s.REPDTE"""
_CHECKS = " UNION ALL ".join(
    [_found("v_checked", "COREDEP > DEPDOM", "COREDEP_GT_DEPDOM", "COREDEP > DEPDOM"),
     _found("v_checked", "SCPLEDGE > SC", "SCPLEDGE_GT_SC", "SCPLEDGE > SC")]
    + [_found("v_checked", f"{c} < 0", "NEGATIVE_DEPOSIT", f"{c} < 0") for c in ("DEPDOM", "COREDEP")]
    + [_found("v_checked", f"{c} < 0", "SHARE_NEGATIVE", f"{c} < 0") for c in _SHARES]
    + [_found("v_checked", f"{c} > 1.0e0", "SHARE_GT_1", f"{c} > 1.0") for c in _SHARES]
    + [_found("v_checked", f"{c} < 0", "NEGATIVE_COVERAGE", f"{c} < 0") for c in _COVER]
    + [_found("v_checked", f"SCRDEBT > 0 AND ({_SEC}) / SCRDEBT > 1.2e0", "SEC_BUCKET_SUM_EXCEEDS_TOTAL", "sum(SCNM*) exceeds SCRDEBT by >20%"),
       _found("v_checked", f"OTHBFHLB > 0 AND (({_ADV}) / OTHBFHLB < 0.8e0 OR ({_ADV}) / OTHBFHLB > 1.2e0)", "FHLB_BUCKET_SUM_MISMATCH",
              "sum(OTBFH*) deviates from OTHBFHLB by >20%"),
       _found("v_checked", "RSSDHCR <> h", "RSSDHCR_CHANGE", "RSSDHCR changed between consecutive quarters"),
       _found("v_checked", "SOD_TOTAL_DEPOSITS <= 0", "SOD_NONPOSITIVE_DEPOSITS", "SOD_TOTAL_DEPOSITS <= 0")]
    + [_found("v_checked", f"{c} < 0 OR {c} > 1.0e0", "SOD_HHI_OUT_OF_RANGE", f"{c} outside [0, 1]")
       for c in ("SOD_DEPOSIT_HHI_STATE", "SOD_DEPOSIT_HHI_COUNTY")])


@query("consistency_checks", K + "CHECK DETAIL", _CHECKS)
def consistency_checks(f):
    from panelyard.operators.aggregates import sod_features
    from panelyard.plans.panel import join_branch_features

    return checks.run_checks(join_branch_features(stage_treasury(f), sod_features(f.branch)))


_R = {"UNINSURED_SHARE": "DESC", "TREASURY_TO_UNINSURED": "ASC", "VOLATILE_TO_LIQUID_LOWER": "DESC"}
FRAGMENTS["v_section"] = f"SELECT CERT, REPDTE, {', '.join(_R)} FROM v_tsy WHERE REPDTE = DATE '{QUARTER}'"
FRAGMENTS["v_first_last"] = "SELECT CERT, " + ", ".join(
    f"arg_max({{'v': {c}}}, REPDTE).v - arg_min({{'v': {c}}}, REPDTE).v AS DELTA_{c}" for c in _R) + " FROM v_tsy GROUP BY 1"
_RANKED = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} {d} NULLS LAST) END AS RANK_{c}, count({c}) OVER () AS N_{c}"
                    for c, d in _R.items())
_PASSES = {"PASS_MAX_UNINSURED": "coalesce(UNINSURED_SHARE = m, false)", "PASS_VOLATILE": "VOLATILE_SHARE_AT_MOST >= 0.5e0",
           "PASS_COVERAGE": "coalesce(TREASURY_TO_UNINSURED < med, false)"}


@query("stress_case_report", K + " ".join(f"{c}:r RANK_{c}:i N_{c}:i DELTA_{c}:r" for c in _R) + " VOLATILE_SHARE_AT_MOST:r "
       + " ".join(f"{p}:i" for p in _PASSES) + " CHECKS_PASSED:i",
       "SELECT *, PASS_MAX_UNINSURED + PASS_VOLATILE + PASS_COVERAGE AS CHECKS_PASSED FROM (SELECT *, "
       + ", ".join(f"({e})::INT AS {n}" for n, e in _PASSES.items()) + f" FROM (SELECT s.*, {_RANKED}, max(UNINSURED_SHARE) OVER () AS m, "
       "median(TREASURY_TO_UNINSURED) OVER () AS med, CASE WHEN VOLATILE_TO_LIQUID_LOWER IS NULL THEN 0 ELSE "
       "count(VOLATILE_TO_LIQUID_LOWER) OVER (ORDER BY VOLATILE_TO_LIQUID_LOWER NULLS LAST) END / count(*) OVER () "
       "AS VOLATILE_SHARE_AT_MOST FROM v_section s)) x JOIN v_first_last d ON x.CERT = d.CERT".replace("SELECT *, PASS_MAX", "SELECT x.*, d.* EXCLUDE (CERT), PASS_MAX"))
def stress_case_report(f):
    """Every entity of the last full quarter as the stress case."""
    return stress.stress_case_report(stage_treasury(f), QUARTER)


def model_panel(f: Frames):
    """The staged panel written once, with what its stages read for the overlay: the balance sheet and staged features."""
    staged = staged_panel(f)
    read = ["CERT", *f.financials.columns, *overlay.FEATURE_SIGNS]
    return cut_lineage(staged.select(*[c for c in staged.columns if c in read]))


def model_table(f: Frames):
    """Labels next to the features of the overlay, written once: every fit reads it."""
    have = [c for c in overlay.FEATURE_SIGNS]
    staged = stage_mismatch(f, model_panel(f))
    df = outflow.outflow_labels(treasury.treasury_features(staged, f.yields, check=False))
    return cut_lineage(df.select("CERT", "REPDTE", "DEPDOM", overlay.LABEL, *[c for c in have if c in df.columns]))


def _features(df):
    return [c for c in overlay.FEATURE_SIGNS if c in df.columns]


@query("logistic_overlay", K + "SUPERVISED_OUTFLOW_SCORE")
def logistic_overlay(f):
    df = model_table(f)
    return overlay.full_sample_fit(df, _features(df), kind="logistic")[0]


@query("monotone_overlay", K + "SUPERVISED_OUTFLOW_SCORE")
def monotone_overlay(f):
    df = model_table(f)
    return overlay.full_sample_fit(df, _features(df), kind="signed")[0]


@query("tree_overlay", K + "SUPERVISED_OUTFLOW_SCORE")
def tree_overlay(f):
    """Boosted trees, without sign constraints."""
    df = model_table(f)
    return overlay.full_sample_fit(df, _features(df), kind="trees")[0]


@query("walk_forward", K + "SUPERVISED_OUTFLOW_SCORE SUPERVISED_TRAIN_QUARTERS SUPERVISED_OOT_AUC_MEAN")
def walk_forward(f):
    df = model_table(f)
    return overlay.walk_forward(df, _features(df))[0]


@query("full_sample_fit", K + "SUPERVISED_OUTFLOW_SCORE")
def full_sample_fit(f):
    df = model_table(f)
    return overlay.full_sample_fit(df, _features(df))[0]


@query("importances", "RANK FEATURE IMPORTANCE")
def importances(f):
    df = model_table(f)
    return overlay.importance_table(f.spark, overlay.full_sample_fit(df, _features(df))[1])


@query("supervised_overlay", K + "SUPERVISED_OUTFLOW_SCORE SUPERVISED_RISK_SCORE SUPERVISED_MODEL_TYPE SUPERVISED_LABEL_KIND "
       "SUPERVISED_IMPORTANCE_1 SUPERVISED_COEF_1 SEVERE_RELATIVE_OUTFLOW")
def supervised_overlay(f):
    staged = stage_mismatch(f, model_panel(f))
    return overlay.supervised_overlay(cut_lineage(treasury.treasury_features(staged, f.yields, check=False)))


# Where the labelled rows of the overlay have their features in SQL.
_STAGED = ["LOAN_WAM_PROXY", "TD_WAM_PROXY", "DURATION_GAP_LITE", "HAS_IR_DERIVATIVES", "SOD_DEPOSIT_HHI_STATE",
           "SOD_DEPOSIT_HHI_COUNTY", "SOD_TOP_STATE_SHARE"]
FRAGMENTS["v_model"] = (
    "SELECT a.CERT, a.REPDTE, o.SEVERE_RELATIVE_OUTFLOW AS y, " + ", ".join(
        f"CAST({'b' if c in _STAGED else 'a'}.{c} AS DOUBLE) AS {c}" for c in overlay.FEATURE_SIGNS)
    + " FROM v_alm a JOIN v_outflow o ON a.CERT = o.CERT AND a.REPDTE = o.REPDTE "
      "JOIN v_bank_panel b ON a.CERT = b.CERT AND a.REPDTE = b.REPDTE WHERE o.SEVERE_RELATIVE_OUTFLOW IS NOT NULL")
FRAGMENTS["v_model_long"] = " UNION ALL ".join(
    f"SELECT REPDTE, y, '{c}' AS FEATURE, {c} AS x FROM v_model" for c in overlay.FEATURE_SIGNS)
# Every date of the panel with the dates, labels and events before it.
FRAGMENTS["v_model_dates"] = (
    "SELECT REPDTE, row_number() OVER (ORDER BY REPDTE) - 1 AS seen, coalesce(sum(e) OVER (ORDER BY REPDTE ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS events FROM (SELECT REPDTE, sum(SEVERE_RELATIVE_OUTFLOW) AS e FROM v_outflow GROUP BY 1)")


def _statistics(source: str, by: str) -> str:
    """Counts, medians, and the moments of values whose gaps are filled with the median, of each group."""
    return (f"SELECT {by}, count(*) AS N_ROWS, sum(y) AS N_EVENTS, max(m) AS MEDIAN, avg(coalesce(x, m)) AS CENTRE, "
            f"stddev_pop(coalesce(x, m)) AS SPREAD FROM (SELECT *, coalesce(median(x) OVER (PARTITION BY {by}), 0) AS m FROM ({source})) GROUP BY ALL")


_VARIES = "SPREAD > 1e-12 * greatest(1, abs(CENTRE))"


@query("walk_forward_windows", "REPDTE:d TRAIN_QUARTERS:i N_ROWS:i N_EVENTS:i FEATURE MEDIAN:r CENTRE:r SPREAD:r VARIES:b",
       f"SELECT *, {_VARIES} AS VARIES FROM (" + _statistics(
           "SELECT d.REPDTE AS REPDTE, d.seen AS TRAIN_QUARTERS, l.y, l.FEATURE, l.x FROM v_model_dates d JOIN v_model_long l ON l.REPDTE < d.REPDTE "
           f"WHERE d.seen >= {overlay.MIN_QUARTERS} AND d.events >= {overlay.MIN_EVENTS}", "REPDTE, TRAIN_QUARTERS, FEATURE") + ")")
def walk_forward_windows(f):
    """What each walk-forward fit knows of its training rows."""
    df = model_table(f)
    return overlay.window_table(df, _features(df))


_EXPECTED = ("SELECT * FROM (SELECT FEATURE, N_ROWS, N_EVENTS, MEDIAN, CENTRE, SPREAD, 0 AS RESIDUAL, true AS SIGN_KEPT FROM ("
             + _statistics("SELECT * FROM v_model_long", "FEATURE") + f") WHERE {_VARIES} UNION ALL "
             "SELECT '(intercept)', count(*), sum(y), NULL, NULL, NULL, 0, true FROM v_model)")


def _certified(f, kind: str):
    df = model_table(f)
    table = overlay.fit_certificate(df, _features(df), kind=kind)
    return table.withColumn("RESIDUAL", F.round("RESIDUAL", 3))  # an optimum up to the fit's tolerance


_CERTIFICATE = "FEATURE N_ROWS:i N_EVENTS:i MEDIAN:r CENTRE:r SPREAD:r RESIDUAL:r SIGN_KEPT:b"


@query("logistic_certificate", _CERTIFICATE, _EXPECTED)
def logistic_certificate(f):
    """The plain fit solves its problem: every gradient is zero."""
    return _certified(f, "logistic")


@query("monotone_certificate", _CERTIFICATE, _EXPECTED)
def monotone_certificate(f):
    """The fit held to signs solves its problem: every weight has its sign and no allowed step lowers the loss."""
    return _certified(f, "signed")
