"""Queries over the feature stages and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.catalog.fragments import FRAGMENTS, PEERS, nz, num, pct_rank, sd, weighted_index
from panelyard.catalog.frames import BANDS
from panelyard.catalog.group_queries import (
    stage_competition, stage_deposits, stage_indices, stage_mismatch, stage_treasury,
)
from panelyard.catalog.registry import query
from panelyard.plans import competition, deposits, indices, mismatch, panel, repricing, treasury
from panelyard.plans.repricing import GAP_HORIZONS, OVERLAY_CODES, REPRICING_CODES

K = "CERT REPDTE:d "


def cols(names, kind: str = "r") -> str:
    return " ".join(f"{n}:{kind}" for n in names)


@query("deposit_mix", K + cols(["DEPDOM_EFFECTIVE", "UNINSURED_SHARE", "BROKERED_SHARE", "LIST_SERVICE_SHARE",
                                "LARGE_ACCOUNT_SHARE", "CORE_DEPOSIT_SHARE", "NONINTEREST_SHARE", "TRN_EX_DDT", "NMD_TOTAL"])
       + " DEPUNA_MISSING:b", "v_mix")
def deposit_mix(f):
    return deposits.deposit_mix(f.panel)


@query("time_deposit_buckets", K + cols([*cfg.TIME_BUCKETS, "TD_BUCKET_SUM", "TIME_DEPOSITS_EFFECTIVE", "TIME_DEPOSIT_SHARE"]), "v_time")
def time_deposit_buckets(f):
    return deposits.time_deposit_buckets(deposits.deposit_mix(f.panel))


@query("deposit_cost", K + "AVG_DEPDOM_QTR:r DOMESTIC_DEPOSIT_COST:r", "v_dyn")
def deposit_cost(f):
    return deposits.deposit_cost(deposits.deposit_mix(f.panel))


@query("deposit_dynamics", K + "DEP_GROWTH_QOQ:r DEP_GROWTH_YOY:r DEP_GROWTH_VOL_4Q:r DEP_DRAWDOWN_4Q:r", "v_dyn")
def deposit_dynamics(f):
    return deposits.deposit_dynamics(deposits.deposit_mix(f.panel))


_RANKS = [f"RANK_{n}" for n, _, _ in cfg.RUN_RISK_COMPONENTS]


@query("run_risk_score", K + cols([*_RANKS, "RUN_RISK_SCORE", "STICKINESS_SCORE"]), "v_run")
def run_risk_score(f):
    df = deposits.deposit_dynamics(deposits.deposit_cost(deposits.time_deposit_buckets(deposits.deposit_mix(f.panel))))
    return deposits.run_risk_score(df)


@query("time_deposit_wal", K + "TIME_DEPOSIT_WAL:r TIME_DEPOSIT_STABLE_EQUIV:r", "v_wal")
def time_deposit_wal(f):
    return deposits.time_deposit_wal(deposits.time_deposit_buckets(deposits.deposit_mix(f.panel)))


_LIFE = [f"{c.upper()}_LIFE_{s.name}" for s in cfg.LIFE_SCENARIOS for c in cfg.DEPOSIT_CATEGORIES]


@query("deposit_life_scenarios", K + cols([*_LIFE, *cfg.SCENARIO_COLUMNS, *[f"NMD_WAL_{s.name}" for s in cfg.LIFE_SCENARIOS]]), "v_dep")
def deposit_life_scenarios(f):
    return stage_deposits(f)


@query("runnable_funding", K + "UNINSURED_PROXY:r RUNNABLE_FUNDING_PROXY:r", "v_runnable")
def runnable_funding(f):
    return mismatch.runnable_funding(f.panel)


@query("liquid_assets", K + cols(["LIQUID_ASSETS_NARROW", "LIQUID_ASSETS_BROAD", "UNPLEDGED_LIQUID_NARROW_LOWER",
                                  "UNPLEDGED_LIQUID_BROAD_LOWER", "VOLATILE_TO_LIQUID_LOWER", "VOLATILE_TO_LIQUID_BROAD_LOWER"]), "v_liquid")
def liquid_assets(f):
    return mismatch.liquid_assets(mismatch.runnable_funding(f.panel))


@query("stable_funding", K + "STABLE_FUNDING_BASELINE:r LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE:r GAP_TO_ASSETS:r",
       "SELECT *, STRUCTURAL_TERM_GAP_BASELINE / ASSET AS GAP_TO_ASSETS FROM v_stable")
def stable_funding(f):
    df = mismatch.stable_funding(stage_deposits(f), check=False)
    return df.withColumn("GAP_TO_ASSETS", F.col("STRUCTURAL_TERM_GAP_BASELINE") / F.col("ASSET"))


@query("stable_funding_fallback", K + "STABLE_FUNDING_BASELINE:r",
       f"SELECT CERT, REPDTE, {nz('EQ')} + {nz('COREDEP')} + ({nz('OTBFH1T3')} + {nz('OTBFH3T5')} + {nz('OTBFHOV5')}) "
       "AS STABLE_FUNDING_BASELINE FROM v_panel")
def stable_funding_fallback(f):
    """No deposit-life column has a value, so core deposits stand in."""
    return mismatch.stable_funding(f.panel.withColumn("DEPOSIT_STABLE_EQUIV_BASELINE", F.lit(None).cast("double")))


@query("security_duration", K + "SECURITY_DURATION_PROXY:r SECURITY_VS_DEPOSIT_GAP_BASELINE:r", "v_alm")
def security_duration(f):
    return mismatch.security_duration(stage_deposits(f))


@query("loan_core_ratio", K + "LOANS_TO_CORE_DEPOSITS:r", "v_alm")
def loan_core_ratio(f):
    return mismatch.loan_core_ratio(f.panel)


@query("short_advance_share", K + "SHORT_FHLB_SHARE:r", "v_alm")
def short_advance_share(f):
    return mismatch.short_advance_share(f.panel)


_BUCKET_SOURCES = {"0_3M": ("SCNM3LES", "IDCD3LES"), "3_12M": ("SCNM3T12", "IDCD3T12"), "1_3Y": ("SCNM1T3", "IDCD1T3"),
                   "3_5Y": ("SCNM3T5", "IDCDOV3"), "5Y_PLUS": ("SCNM5T15", "IDCDOV3S")}


@query("bucket_gap", K + cols([f"REPRICING_GAP_{b}" for b in _BUCKET_SOURCES]) + " CUMULATIVE_GAP_1Y:r",
       "SELECT CERT, REPDTE, " + ", ".join(f"{a} - {b} AS REPRICING_GAP_{n}" for n, (a, b) in _BUCKET_SOURCES.items())
       + f", {nz('SCNM3LES - IDCD3LES')} + {nz('SCNM3T12 - IDCD3T12')} AS CUMULATIVE_GAP_1Y FROM v_panel")
def bucket_gap(f):
    df = f.panel.withColumns({f"{side}_BKT_{n}": F.col(pair[i]) for n, pair in _BUCKET_SOURCES.items()
                              for i, side in enumerate(("ASSET", "LIAB"))})
    return mismatch.bucket_gap(df)


@query("mismatch_features", K + cols(["RUNNABLE_FUNDING_PROXY", "VOLATILE_TO_LIQUID_LOWER", "LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE",
                                      "SECURITY_VS_DEPOSIT_GAP_BASELINE", "LOANS_TO_CORE_DEPOSITS", "SHORT_FHLB_SHARE"]), "v_alm")
def mismatch_features(f):
    return stage_mismatch(f)


@query("treasury_coverage", K + cols(["TREASURY_TO_UNINSURED", "TREASURY_AGENCY_TO_RUNNABLE", "HQLA_NARROW_UPPER", "HQLA_NARROW_LOWER",
                                      "HQLA_NARROW_LOWER_TO_RUNNABLE"]), "v_cover")
def treasury_coverage(f):
    return treasury.treasury_coverage(mismatch.runnable_funding(f.panel), check=False)


_SHOCKED = [f"{n}_{bp}BP" for bp in cfg.SHOCKS_BP for n in
            ("TREASURY_LOSS", "TREASURY_AFTER", "TREASURY_TO_UNINSURED_AFTER", "HQLA_NARROW_LOWER_TO_RUNNABLE_AFTER")]


@query("rate_shock", K + cols(["TREASURY_DURATION_ASSUMPTION", *_SHOCKED]), "v_shock")
def rate_shock(f):
    return treasury.rate_shock(mismatch.security_duration(mismatch.runnable_funding(f.panel)), check=False)


@query("yield_regime", K + "TREASURY_YIELD_DATE:d HAS_TREASURY_YIELD_HISTORY:i YC_2YR YC_10YR YC_10Y_3M_SLOPE_BP:r YC_10Y_2Y_SLOPE_BP:r "
       "YC_2YR_QOQ_CHANGE_BP:r YC_10YR_YOY_CHANGE_BP:r",
       "SELECT p.CERT, r.* FROM v_panel p JOIN v_regime r ON p.REPDTE = r.REPDTE")
def yield_regime(f):
    return treasury.yield_regime(f.panel, f.yields)


_RATE = ["OUTSIDE_OPTION_RATE_BP", "IORB_BP", "RRPONTSYAWARD_BP", "YC_3MO_BP"]


@query("outside_option", K + cols(_RATE) + " OUTSIDE_OPTION_SOURCE OUTSIDE_OPTION_RATE_AVAILABLE_COUNT:i HAS_MARKET_RATE_HISTORY:i "
       "MARKET_RATE_DATE:d", "v_option")
def outside_option(f):
    df = treasury.yield_regime(f.written_panel, f.yields)
    return competition.best_rate(competition.market_rates(df, f.rates, list(cfg.RATE_COLUMNS_TO_BP)))


_PREMIUM = ["DOMESTIC_DEPOSIT_COST_BP", "OUTSIDE_OPTION_PREMIUM_BP", "OUTSIDE_OPTION_PREMIUM_POS_BP", "OUTSIDE_OPTION_RATE_QOQ_CHANGE_BP",
            "DOMESTIC_DEPOSIT_COST_QOQ_CHANGE_BP", "PASS_THROUGH_GAP_BP"]


@query("premium_pass_through", K + cols(_PREMIUM), "v_premium")
def premium_pass_through(f):
    return stage_competition(f)


@query("premium_interactions", K + cols(["RATE_SENSITIVE_DEPOSIT_EXPOSURE", "PREMIUM_X_RATE_SENSITIVE_EXPOSURE",
                                         *[f"PREMIUM_X_{c}" for c in competition.PREMIUM_SHARES]]), "v_interact")
def premium_interactions(f):
    return stage_competition(f)


@query("pressure_score", K + cols([f"RANK_{c}" for c, _, _ in cfg.PRESSURE_COMPONENTS])
       + " DEPOSIT_COMPETITION_PRESSURE_SCORE:r DEPOSIT_COMPETITION_RESILIENCE_SCORE:r", "v_comp")
def pressure_score(f):
    return stage_competition(f)


FRAGMENTS["v_buckets"] = ("SELECT *, " + ", ".join(
    [f"coalesce({', '.join(c)}) AS {n}" for n, c in cfg.LOAN_CODES.items()]
    + [f"{c} AS {n}" for n, c in {**cfg.RE_LOAN_CODES, **cfg.TIME_DEPOSIT_CODES}.items()]
    + [f"CASE WHEN count({a}) OVER (PARTITION BY REPDTE) > 0 THEN {a} ELSE {b} END AS {n}" for n, (a, b) in cfg.BORROWING_CODES.items()])
    + " FROM v_wide")
_FACTS = list(REPRICING_CODES)
F_KEYS = ["IDRSSD", "REPDTE"]
FK = "IDRSSD REPDTE:d "


def _buckets(f):
    facts = f.codes(_FACTS)
    seen = repricing.present_by_batch(facts, [a for a, _ in cfg.BORROWING_CODES.values()])
    return repricing.repricing_buckets(repricing.pivot_codes(facts, F_KEYS, _FACTS), seen)


@query("repricing_buckets", FK + cols([*cfg.LOAN_CODES, *cfg.RE_LOAN_CODES, *cfg.TIME_DEPOSIT_CODES, *cfg.BORROWING_CODES]), "v_buckets")
def repricing_buckets(f):
    return _buckets(f)


def _sum(names) -> str:
    return " + ".join(nz(n) for n in names)


def _present_sum(names) -> str:
    return f"CASE WHEN max((coalesce({', '.join(names)}) IS NOT NULL)::INT) OVER (PARTITION BY REPDTE) = 1 THEN {_sum(names)} END"


def _years(names, prefixes) -> str:
    def mid(n):
        return cfg.MIDPOINTS[next(n[len(p):] for p in prefixes if n.startswith(p))]

    return " + ".join(f"{nz(n)} * {num(mid(n))}" for n in names)


FRAGMENTS["v_totals"] = f"""SELECT *, {nz('LOAN_MATURITY_TOTAL')} + {nz('RE_LOAN_MATURITY_TOTAL')} AS ALL_LOAN_MATURITY_TOTAL,
 CASE WHEN LOAN_MATURITY_TOTAL > 0 THEN ({_years(cfg.LOAN_CODES, ['LOAN_'])}) / LOAN_MATURITY_TOTAL END AS LOAN_WAM_PROXY,
 CASE WHEN RE_LOAN_MATURITY_TOTAL > 0 THEN ({_years(cfg.RE_LOAN_CODES, ['RE_LOAN_'])}) / RE_LOAN_MATURITY_TOTAL END AS RE_LOAN_WAM_PROXY,
 CASE WHEN TD_MATURITY_TOTAL > 0 THEN ({_years(cfg.TIME_DEPOSIT_CODES, ['TD_SMALL_', 'TD_LARGE_'])}) / TD_MATURITY_TOTAL END AS TD_WAM_PROXY
 FROM (SELECT *, {_present_sum(list(cfg.LOAN_CODES))} AS LOAN_MATURITY_TOTAL, {_present_sum(list(cfg.RE_LOAN_CODES))} AS RE_LOAN_MATURITY_TOTAL,
 {_present_sum(list(cfg.TIME_DEPOSIT_CODES))} AS TD_MATURITY_TOTAL FROM v_buckets)"""
_TOTALS = ["LOAN_MATURITY_TOTAL", "RE_LOAN_MATURITY_TOTAL", "TD_MATURITY_TOTAL", "ALL_LOAN_MATURITY_TOTAL", "LOAN_WAM_PROXY",
           "RE_LOAN_WAM_PROXY", "TD_WAM_PROXY"]


@query("maturity_totals_wam", FK + cols(_TOTALS), "v_totals")
def maturity_totals(f):
    return repricing.maturity_totals(_buckets(f))


_GAPS = {h: f"({_sum([f'{k}_{b}' for b in a for k in ('LOAN', 'RE_LOAN')])}) - "
            + (f"({_sum([f'{k}_{b}' for b in d for k in ('TD_SMALL', 'TD_LARGE')])})" if d else "0") for h, (a, d) in GAP_HORIZONS.items()}
_RUN = {h: " + ".join(f"({_GAPS[x]})" for x in list(GAP_HORIZONS)[:i + 1]) for i, h in enumerate(GAP_HORIZONS)}
FRAGMENTS["v_gaps"] = ("SELECT *, LOAN_WAM_PROXY - TD_WAM_PROXY AS DURATION_GAP_LITE, " + ", ".join(
    [f"{e} AS REPRICING_GAP_{h}" for h, e in _GAPS.items()] + [f"{e} AS CUMULATIVE_GAP_{h}" for h, e in _RUN.items()]) + " FROM v_totals")


@query("repricing_gaps", FK + cols([f"{k}_GAP_{h}" for k in ("REPRICING", "CUMULATIVE") for h in GAP_HORIZONS]), "v_gaps")
def repricing_gaps(f):
    return repricing.repricing_gaps(_buckets(f))


@query("duration_gap", FK + "DURATION_GAP_LITE:r", "v_gaps")
def duration_gap(f):
    return repricing.repricing_features(f.codes(_FACTS), F_KEYS)


_NOTIONALS = list(cfg.DERIVATIVE_CODES)
FRAGMENTS["v_hedge"] = (f"SELECT *, ({_sum(_NOTIONALS)}) AS IR_DERIV_TOTAL_NOTIONAL, (({_sum(_NOTIONALS)}) > 0)::INT AS HAS_IR_DERIVATIVES FROM ("
                        "SELECT *, " + ", ".join(f"coalesce({', '.join(c)}) AS {n}" for n, c in cfg.DERIVATIVE_CODES.items()) + " FROM v_dwide)")


@query("derivative_features", FK + cols([*_NOTIONALS, "IR_DERIV_TOTAL_NOTIONAL", "IR_DERIV_NOTIONAL_TO_ASSETS"]) + " HAS_IR_DERIVATIVES:i",
       f"SELECT h.*, CASE WHEN f.ASSET > 0 THEN {sd('h.IR_DERIV_TOTAL_NOTIONAL', 'f.ASSET')} END AS IR_DERIV_NOTIONAL_TO_ASSETS "
       "FROM v_hedge h JOIN v_fin f ON h.IDRSSD = f.s AND h.REPDTE = f.REPDTE")
def derivative_features(f):
    wide = repricing.pivot_codes(f.codes(OVERLAY_CODES), F_KEYS, OVERLAY_CODES)
    assets = f.financials.select(F.col("__s").alias("IDRSSD"), "REPDTE", "ASSET")
    return repricing.derivative_features(wide.join(assets, F_KEYS))


FRAGMENTS["v_bank_panel"] = """SELECT p.*, g.LOAN_WAM_PROXY, g.TD_WAM_PROXY, g.DURATION_GAP_LITE, g.CUMULATIVE_GAP_3_5Y, h.IR_DERIV_TOTAL_NOTIONAL,
 h.HAS_IR_DERIVATIVES, (coalesce(SOD_TOTAL_DEPOSITS, SOD_BRANCH_COUNT) IS NOT NULL)::INT AS HAS_SOD_FEATURES,
 (coalesce(DURATION_GAP_LITE, LOAN_WAM_PROXY, TD_WAM_PROXY, REPRICING_GAP_0_3M, CUMULATIVE_GAP_3_5Y) IS NOT NULL)::INT AS HAS_FFIEC_FEATURES,
 (HAS_IR_DERIVATIVES IS NOT NULL)::INT AS HAS_DERIVATIVE_FEATURES, 0 AS HAS_HISTORICAL_ENTITY_MAP
 FROM v_panel_sod p LEFT JOIN v_gaps g ON p.CERT = CAST(g.IDRSSD AS VARCHAR) AND p.REPDTE = g.REPDTE
 LEFT JOIN v_hedge h ON p.CERT = CAST(h.IDRSSD AS VARCHAR) AND p.REPDTE = h.REPDTE"""


@query("bank_panel", K + "NAMEFULL STALP BKCLASS ASSET:r SOD_JOIN_YEAR:i SOD_TOTAL_DEPOSITS:r SOD_BRANCH_COUNT:i SOD_DEPOSIT_HHI_STATE:r "
       "LOAN_WAM_PROXY:r DURATION_GAP_LITE:r CUMULATIVE_GAP_3_5Y:r IR_DERIV_TOTAL_NOTIONAL:r HAS_IR_DERIVATIVES:i HAS_SOD_FEATURES:i "
       "HAS_FFIEC_FEATURES:i HAS_DERIVATIVE_FEATURES:i HAS_HISTORICAL_ENTITY_MAP:i", "v_bank_panel")
def bank_panel(f):
    return staged_panel(f)


def staged_panel(f, schedules_from=None, hedges_from=None, equity=False):
    """Everything staged: financials, institutions, branches, schedules, hedges (these two from their first report date).

    ``equity`` adds the entities' equity to the balance sheet, which the surrogate lines lack.
    """
    def filed(codes, first):
        return codes if first is None else codes.filter(F.col("REPDTE") >= F.lit(first).cast("date"))

    fin = f.financials.withColumn("CERT", F.col("__s").cast("string")).drop("__s")
    if equity:
        fin = fin.join(f.institutions.select("CERT", "EQ"), "CERT", "left")
    gaps = repricing.repricing_features(filed(f.codes(_FACTS), schedules_from), F_KEYS)
    hedge = repricing.derivative_features(repricing.pivot_codes(filed(f.codes(OVERLAY_CODES), hedges_from), F_KEYS, OVERLAY_CODES))
    return panel.bank_panel(
        fin, f.institutions, f.branch,
        gaps.withColumn("CERT", F.col("IDRSSD").cast("string")).drop("IDRSSD"),
        hedge.withColumn("CERT", F.col("IDRSSD").cast("string")).drop("IDRSSD"))


FRAGMENTS["v_windex"] = (lambda m: f"SELECT *, {m[2]} FROM (SELECT *, {m[1]} FROM (SELECT *, {m[0]} FROM (SELECT *, {PEERS} AS PEER_GROUP FROM v_alm)))")(
    weighted_index("ALM_MISMATCH_INDEX", cfg.MISMATCH_COMPONENTS))
_CONTRIB = [f"ALM_MISMATCH_INDEX_CONTRIB_{c}" for c, _, _ in cfg.MISMATCH_COMPONENTS]


@query("weighted_index", K + "PEER_GROUP ALM_MISMATCH_INDEX:r " + cols(_CONTRIB), "v_windex")
def weighted(f):
    return indices.weighted_index(indices.with_peer_group(stage_mismatch(f), BANDS), cfg.MISMATCH_COMPONENTS, "ALM_MISMATCH_INDEX")


@query("fragility_indices", K + "PEER_GROUP " + cols(cfg.INDEX_COLUMNS), "v_idx")
def fragility_indices(f):
    return indices.fragility_indices(stage_competition(f), BANDS)


@query("indices_frame", K + "PEER_GROUP INDEX_VERSION " + cols(cfg.INDEX_COLUMNS)
       + " HAS_SOD_FEATURES:i HAS_FFIEC_FEATURES:i HAS_HISTORICAL_ENTITY_MAP:i "
       + cols([f"TREASURY_BUFFER_INDEX_CONTRIB_{c}" for c, _, _ in cfg.BUFFER_COMPONENTS]), "v_idx")
def indices_frame(f):
    return stage_indices(f)


@query("run_risk_index", K + "PEER_GROUP RUN_RISK_SCORE:r RUN_RISK_INDEX:r",
       f"SELECT *, 100.0e0 * {pct_rank('RUN_RISK_SCORE', 'REPDTE, PEER_GROUP', '0.5e0')} AS RUN_RISK_INDEX FROM (SELECT *, {PEERS} AS PEER_GROUP FROM v_run)")
def run_risk_index(f):
    return indices.fragility_indices(stage_deposits(f), BANDS, {"ALM_MISMATCH_INDEX": [], "TREASURY_BUFFER_INDEX": []})


@query("treasury_features", K + "TREASURY_TO_UNINSURED_AFTER_100BP:r HQLA_NARROW_LOWER_TO_RUNNABLE:r YC_10Y_3M_SLOPE_BP:r "
       "HAS_TREASURY_YIELD_HISTORY:i", "v_tsy")
def treasury_features(f):
    return stage_treasury(f)
