"""SQL fragments of the checks, written for DuckDB and composed as common table expressions."""

from __future__ import annotations

import re

from panelyard import config as cfg
from panelyard.catalog.frames import (
    BANDS, EPISODES, FIRST_YEAR, HOLDER, LAST_YEAR, MEASURES, RATE_COLUMNS, RATE_PRIORITIES, YIELD_COLUMNS,
)

FRAGMENTS: dict[str, str] = {}


def with_fragments(body: str) -> str:
    """Prefix ``body`` with every fragment it uses, directly or through others."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_[a-z0-9_]+\b", text)):
            if name in FRAGMENTS and name not in order:
                visit(FRAGMENTS[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in order) + "\n" + body


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def nz(c: str) -> str:
    return f"coalesce({c}, 0)"


def sd(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def low(c: str, bound: float = 0) -> str:
    return f"(CASE WHEN ({c}) IS NOT NULL THEN greatest(({c}), {num(bound)}) END)"


def high(c: str, bound: float) -> str:
    return f"(CASE WHEN ({c}) IS NOT NULL THEN least(({c}), {num(bound)}) END)"


def clip01(c: str) -> str:
    return high(low(c), 1)


def pct_rank(c: str, by: str, fill: str = "NULL") -> str:
    return (f"coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST)"
            f" + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0e0) / count({c}) OVER (PARTITION BY {by}) END, {fill})")


QEND = "CAST(last_day(date_trunc('quarter', {d}) + INTERVAL 2 MONTH) AS DATE)"


def quarter_end(d: str) -> str:
    return QEND.format(d=d)


def quarter_end_offset(d: str, n: int) -> str:
    on = quarter_end(d)
    return (f"CAST(last_day(date_trunc('quarter', {d}) + to_months(2 + 3 * (CASE WHEN {d} = {on} THEN {n} "
            f"ELSE {n - 1} END))) AS DATE)")


def quarter_distance(a: str, b: str) -> str:
    return f"((year({b}) - year({a})) * 4 + quarter({b}) - quarter({a}))"


HISTORY = "OVER (PARTITION BY CERT ORDER BY REPDTE)"
LAST4 = "OVER (PARTITION BY CERT ORDER BY REPDTE ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) {HISTORY}"


# ---- inputs -------------------------------------------------------------------------------
FRAGMENTS["v_fin"] = (
    f"SELECT l_suppkey AS s, {quarter_end('l_shipdate')} AS REPDTE, CAST({HOLDER} AS BIGINT) AS RSSDHCR, "
    + ", ".join(f"round({e}, 6) AS {n}" for n, e in MEASURES.items()) + " FROM lineitem GROUP BY 1, 2")
FRAGMENTS["v_inst"] = (
    "SELECT CAST(s_suppkey AS VARCHAR) AS CERT, s_suppkey AS FED_RSSD, s_name AS NAMEFULL, n_name AS STALP, "
    "'R' || CAST(n_regionkey AS VARCHAR) AS BKCLASS, s_acctbal AS EQ "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey")
FRAGMENTS["v_panel"] = (
    "SELECT f.* EXCLUDE (s), i.CERT, i.NAMEFULL, i.STALP, i.BKCLASS, i.EQ "
    "FROM v_fin f JOIN v_inst i ON f.s = i.FED_RSSD")
FRAGMENTS["v_branch"] = (
    "SELECT CAST(l_suppkey AS VARCHAR) AS CERT, CAST(year(l_shipdate) AS INT) AS YEAR, l_extendedprice AS DEPSUMBR, "
    "l_partkey AS UNINUMBR, n_name AS STALPBR, concat(n_name, '/', c_mktsegment) AS CNTYNAMB "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey")


def _daily(names: list[str]) -> str:
    return ("SELECT CAST(o_orderdate AS DATE) - CAST(greatest(isodow(o_orderdate) - 5, 0) AS INTEGER) AS DATE, " + ", ".join(
        f"round(avg(CASE WHEN o_orderpriority = '{RATE_PRIORITIES[n]}' THEN o_totalprice END) / 50000.0e0, 10) AS {n}"
        for n in names) + " FROM orders GROUP BY 1")


FRAGMENTS["v_yields"] = _daily(YIELD_COLUMNS)
FRAGMENTS["v_rates"] = _daily(RATE_COLUMNS)
FRAGMENTS["v_failures"] = (
    "SELECT CAST(s_suppkey AS VARCHAR) AS CERT, CAST(d AS DATE) AS FAILDATE FROM supplier JOIN (SELECT l_suppkey, "
    "max({'p': l_extendedprice, 'd': l_shipdate}).d AS d FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey "
    "WHERE s_acctbal < 2000")
FRAGMENTS["v_edges"] = (
    "SELECT s_suppkey AS ID_RSSD_OFFSPRING, CAST(floor(s_suppkey / 3.0) AS BIGINT) AS ID_RSSD_PARENT FROM supplier")


def codes(names: list[str]) -> str:
    listed = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return (f"SELECT l_suppkey AS IDRSSD, {quarter_end('l_shipdate')} AS REPDTE, "
            f"{listed}[CAST((CAST(l_quantity AS INT) + l_linenumber * 7) % {len(names)} + 1 AS INT)] AS CODE, "
            "round(sum(l_extendedprice), 6) AS VALUE FROM lineitem GROUP BY 1, 2, 3")


# ---- deposits -----------------------------------------------------------------------------
FRAGMENTS["v_mix"] = f"""SELECT *, {sd('IDDEPLAM', 'IDDEPLAM + IDDEPSAM')} AS LARGE_ACCOUNT_SHARE,
 {nz('DDT')} + {nz('TRN_EX_DDT')} + {nz('NTRSMMDA')} + {nz('NTRSOTH')} AS NMD_TOTAL FROM (
 SELECT *, DEPDOM AS DEPDOM_EFFECTIVE, coalesce(DEPUNA = 0 AND DEPDOM > 0, false) AS DEPUNA_MISSING,
 {sd('CASE WHEN DEPUNA > 0 OR DEPDOM <= 0 THEN DEPUNA END', 'DEPDOM')} AS UNINSURED_SHARE,
 {sd('BRO', 'DEPDOM')} AS BROKERED_SHARE, {sd('DEPLSNB', 'DEPDOM')} AS LIST_SERVICE_SHARE,
 {sd('COREDEP', 'DEPDOM')} AS CORE_DEPOSIT_SHARE, {sd('DEPNIDOM', 'DEPDOM')} AS NONINTEREST_SHARE,
 {low('TRN - DDT')} AS TRN_EX_DDT FROM v_panel)"""

_HAVE = set(MEASURES)
_BUCKETS = {n: "coalesce(" + ", ".join([c for c in (new, old) if c in _HAVE] + ["NULL"]) + ")"
            for n, (new, old, _) in cfg.TIME_BUCKETS.items()}
FRAGMENTS["v_time"] = f"""SELECT *, {sd('TIME_DEPOSITS_EFFECTIVE', 'DEPDOM')} AS TIME_DEPOSIT_SHARE FROM (
 SELECT *, CASE WHEN TD_BUCKET_SUM > 0 THEN TD_BUCKET_SUM ELSE NTRTIME END AS TIME_DEPOSITS_EFFECTIVE FROM (
 SELECT *, {' + '.join(nz(b) for b in _BUCKETS)} AS TD_BUCKET_SUM FROM (
 SELECT *, {', '.join(f'{e} AS {n}' for n, e in _BUCKETS.items())} FROM v_mix)))"""
FRAGMENTS["v_dyn"] = f"""SELECT *,
 CASE WHEN count(DEP_GROWTH_QOQ) {LAST4} >= 2 THEN stddev_samp(DEP_GROWTH_QOQ) {LAST4} END AS DEP_GROWTH_VOL_4Q,
 {sd('DEP_PEAK - DEPDOM', 'DEP_PEAK')} AS DEP_DRAWDOWN_4Q, {sd('EDEPDOMQ * 4', 'AVG_DEPDOM_QTR')} AS DOMESTIC_DEPOSIT_COST
 FROM (SELECT *, (DEPDOM + {lag('DEPDOM')}) / 2.0e0 AS AVG_DEPDOM_QTR,
 {sd(f"DEPDOM - {lag('DEPDOM')}", lag('DEPDOM'))} AS DEP_GROWTH_QOQ,
 {sd(f"DEPDOM - {lag('DEPDOM', 4)}", lag('DEPDOM', 4))} AS DEP_GROWTH_YOY, max(DEPDOM) {LAST4} AS DEP_PEAK FROM v_time)"""


def rank_score(source: str, components, score: str, complement: str) -> str:
    weight_sum = sum(w for _, w, _ in components)
    ranks = ", ".join(f"{pct_rank(n, 'REPDTE', '0.5e0')} AS RANK_{n}" for n, _, _ in components)
    mixed = " + ".join(f"RANK_{n} * {num(w)}" for n, w, _ in components)
    return (f"SELECT *, 100.0e0 - {score} AS {complement} FROM (SELECT *, ({mixed}) / {num(weight_sum)} * 100.0e0 "
            f"AS {score} FROM (SELECT *, {ranks} FROM {source}))")


FRAGMENTS["v_run"] = rank_score("v_dyn", cfg.RUN_RISK_COMPONENTS, "RUN_RISK_SCORE", "STICKINESS_SCORE")


def _life(scenario: cfg.LifeScenario) -> str:
    risk = clip01("RUN_RISK_SCORE / 100.0e0")
    life = {c: low(f"{num(base)} * (1.0e0 - {num(scenario.risk_adjustment)} * {risk})", floor)
            for c, (base, floor) in scenario.lives.items()}
    years = " + ".join(f"{nz(col)} * {life[c]}" for c, col in cfg.DEPOSIT_CATEGORIES.items())
    stable = " + ".join(f"{nz(col)} * least({life[c]} / {num(cfg.STABILITY_HORIZON_YEARS)}, 1.0e0)"
                        for c, col in cfg.DEPOSIT_CATEGORIES.items())
    s = scenario.name
    lives = ", ".join(f"{e} AS {c.upper()}_LIFE_{s}" for c, e in life.items())
    timed = f"{nz('TIME_DEPOSIT_WAL')} * {nz('TIME_DEPOSITS_EFFECTIVE')}"
    return (f"{lives}, {sd(years, 'NMD_TOTAL')} AS NMD_WAL_{s}, "
            f"{sd(f'{years} + {timed}', f'NMD_TOTAL + ' + nz('TIME_DEPOSITS_EFFECTIVE'))} AS DEPOSIT_WAL_{s}, "
            f"({stable}) + TIME_DEPOSIT_STABLE_EQUIV AS DEPOSIT_STABLE_EQUIV_{s}")


_MIDS = {n: mid for n, (_, _, mid) in cfg.TIME_BUCKETS.items()}
FRAGMENTS["v_wal"] = (
    f"SELECT *, {sd(' + '.join(f'{nz(n)} * {num(m)}' for n, m in _MIDS.items()), 'TIME_DEPOSITS_EFFECTIVE')} "
    "AS TIME_DEPOSIT_WAL, " + " + ".join(f"{nz(n)} * {num(min(m / cfg.STABILITY_HORIZON_YEARS, 1.0))}"
                                         for n, m in _MIDS.items()) + " AS TIME_DEPOSIT_STABLE_EQUIV FROM v_run")
FRAGMENTS["v_dep"] = "SELECT *, " + ", ".join(_life(s) for s in cfg.LIFE_SCENARIOS) + " FROM v_wal"

# ---- mismatch -----------------------------------------------------------------------------
FRAGMENTS["v_runnable"] = f"""SELECT *, greatest(VOLIAB, {nz('UNINSURED_PROXY')} + {nz('BRO')} + {nz('DEPLSNB')})
 AS RUNNABLE_FUNDING_PROXY FROM (SELECT *, coalesce(CASE WHEN DEPUNA > 0 THEN DEPUNA END, 0.5e0 * IDDEPLAM)
 AS UNINSURED_PROXY FROM v_dep)"""
_NARROW = f"{nz('CHBAL')} + {nz('FREPO')} + {nz('SCUST')} + 0.85e0 * {nz('SCAGE')}"
FRAGMENTS["v_liquid"] = f"""SELECT *, {sd('RUNNABLE_FUNDING_PROXY', 'UNPLEDGED_LIQUID_NARROW_LOWER')} AS VOLATILE_TO_LIQUID_LOWER,
 {sd('RUNNABLE_FUNDING_PROXY', 'UNPLEDGED_LIQUID_BROAD_LOWER')} AS VOLATILE_TO_LIQUID_BROAD_LOWER FROM (
 SELECT *, greatest(LIQUID_ASSETS_NARROW - {nz('SCPLEDGE')}, 0) AS UNPLEDGED_LIQUID_NARROW_LOWER,
 greatest(LIQUID_ASSETS_BROAD - {nz('SCPLEDGE')}, 0) AS UNPLEDGED_LIQUID_BROAD_LOWER FROM (
 SELECT *, LIQUID_ASSETS_NARROW + 0.5e0 * greatest({nz('SCAF')} - {nz('SCUST')} - {nz('SCAGE')}, 0) AS LIQUID_ASSETS_BROAD
 FROM (SELECT *, {_NARROW} AS LIQUID_ASSETS_NARROW FROM v_runnable)))"""
FRAGMENTS["v_stable"] = f"""SELECT *, {sd('ASSTLT', 'STABLE_FUNDING_BASELINE')} AS LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE,
 ASSTLT - STABLE_FUNDING_BASELINE AS STRUCTURAL_TERM_GAP_BASELINE FROM (
 SELECT *, {nz('EQ')} + {nz('DEPOSIT_STABLE_EQUIV_BASELINE')} + ({nz('OTBFH1T3')} + {nz('OTBFH3T5')} + {nz('OTBFHOV5')})
 AS STABLE_FUNDING_BASELINE FROM v_liquid)"""
_SEC_YEARS = " + ".join(f"{nz(n)} * {num(m)}" for n, m in cfg.SECURITY_BUCKETS.items())
_SEC_SUM = " + ".join(nz(n) for n in cfg.SECURITY_BUCKETS)
FRAGMENTS["v_alm"] = f"""SELECT *, SECURITY_DURATION_PROXY - DEPOSIT_WAL_BASELINE AS SECURITY_VS_DEPOSIT_GAP_BASELINE FROM (
 SELECT *, {sd(_SEC_YEARS, f'CASE WHEN SCRDEBT <> 0 THEN SCRDEBT ELSE {_SEC_SUM} END')} AS SECURITY_DURATION_PROXY,
 coalesce({sd('LNLSNET', 'COREDEP')}, IDLNCORR / 100.0e0) AS LOANS_TO_CORE_DEPOSITS,
 {sd('OTBFH1L', 'OTHBFHLB')} AS SHORT_FHLB_SHARE FROM v_stable)"""

# ---- treasury -----------------------------------------------------------------------------
FRAGMENTS["v_cover"] = f"""SELECT *, {sd('HQLA_NARROW_LOWER', 'RUNNABLE_FUNDING_PROXY')} AS HQLA_NARROW_LOWER_TO_RUNNABLE FROM (
 SELECT *, greatest(HQLA_NARROW_UPPER - {nz('SCPLEDGE')}, 0) AS HQLA_NARROW_LOWER FROM (
 SELECT *, {sd(nz('SCUST'), 'DEPUNA')} AS TREASURY_TO_UNINSURED,
 {sd(f"{nz('SCUST')} + 0.85e0 * {nz('SCAGE')}", 'RUNNABLE_FUNDING_PROXY')} AS TREASURY_AGENCY_TO_RUNNABLE,
 {_NARROW} AS HQLA_NARROW_UPPER FROM v_alm))"""


def _shock(bp: int) -> tuple[str, str]:
    k = num(bp / 10_000.0)
    years, agency_years = "TREASURY_DURATION_ASSUMPTION", "least(TREASURY_DURATION_ASSUMPTION + 0.5e0, 7.0e0)"
    loss = f"{nz('SCUST')} * {years} * {k}"
    after = f"greatest({nz('SCUST')} - {loss}, 0)"
    agency = f"greatest({nz('SCAGE')} - {nz('SCAGE')} * {agency_years} * {k}, 0)"
    liquid = f"{nz('CHBAL')} + {nz('FREPO')} + {after} + 0.85e0 * {agency} - {nz('SCPLEDGE')}"
    return (f"{loss} AS TREASURY_LOSS_{bp}BP, {after} AS TREASURY_AFTER_{bp}BP, {sd(after, 'DEPUNA')} "
            f"AS TREASURY_TO_UNINSURED_AFTER_{bp}BP, {sd(f'greatest({liquid}, 0)', 'RUNNABLE_FUNDING_PROXY')} "
            f"AS HQLA_NARROW_LOWER_TO_RUNNABLE_AFTER_{bp}BP", "")


FRAGMENTS["v_shock"] = ("SELECT *, " + ", ".join(_shock(bp)[0] for bp in cfg.SHOCKS_BP) + " FROM (SELECT *, "
                        f"coalesce({high(low('SECURITY_DURATION_PROXY', 2), 6)}, 4.5e0) AS TREASURY_DURATION_ASSUMPTION "
                        "FROM v_cover)")
FRAGMENTS["v_days"] = "SELECT DISTINCT REPDTE FROM v_panel"
_CHANGES = ", ".join(
    f"({c} - lag({c}, {n}) OVER (ORDER BY REPDTE)) * {scale} AS {c}_{tag}_CHANGE_BP"
    for c, scale in (("YC_2YR", "100.0e0"), ("YC_10YR", "100.0e0"), ("YC_10Y_3M_SLOPE_BP", "1.0e0"),
                     ("YC_10Y_2Y_SLOPE_BP", "1.0e0"))
    for tag, n in (("QOQ", 1), ("YOY", 4)))
FRAGMENTS["v_regime"] = f"""SELECT *, {_CHANGES} FROM (
 SELECT d.REPDTE, y.DATE AS TREASURY_YIELD_DATE, y.YC_3MO, y.YC_2YR, y.YC_10YR,
 CASE WHEN y.DATE IS NOT NULL THEN 1 ELSE 0 END AS HAS_TREASURY_YIELD_HISTORY,
 (y.YC_10YR - y.YC_3MO) * 100.0e0 AS YC_10Y_3M_SLOPE_BP, (y.YC_10YR - y.YC_2YR) * 100.0e0 AS YC_10Y_2Y_SLOPE_BP
 FROM v_days d ASOF LEFT JOIN v_yields y ON y.DATE <= d.REPDTE)"""
FRAGMENTS["v_tsy"] = "SELECT s.*, r.* EXCLUDE (REPDTE) FROM v_shock s LEFT JOIN v_regime r ON s.REPDTE = r.REPDTE"

# ---- competition --------------------------------------------------------------------------
FRAGMENTS["v_market"] = """SELECT d.REPDTE, r.DATE AS MARKET_RATE_DATE, r.IORB, r.RRPONTSYAWARD,
 CASE WHEN r.DATE IS NOT NULL THEN 1 ELSE 0 END AS HAS_MARKET_RATE_HISTORY
 FROM v_days d ASOF LEFT JOIN v_rates r ON r.DATE <= d.REPDTE"""
FRAGMENTS["v_option"] = """SELECT *, greatest(IORB_BP, RRPONTSYAWARD_BP, YC_3MO_BP) AS OUTSIDE_OPTION_RATE_BP,
 CASE greatest(IORB_BP, RRPONTSYAWARD_BP, YC_3MO_BP) WHEN IORB_BP THEN 'IORB_BP' WHEN RRPONTSYAWARD_BP
 THEN 'RRPONTSYAWARD_BP' WHEN YC_3MO_BP THEN 'YC_3MO_BP' END AS OUTSIDE_OPTION_SOURCE,
 (IORB_BP IS NOT NULL)::INT + (RRPONTSYAWARD_BP IS NOT NULL)::INT + (YC_3MO_BP IS NOT NULL)::INT
 AS OUTSIDE_OPTION_RATE_AVAILABLE_COUNT FROM (
 SELECT t.*, m.* EXCLUDE (REPDTE), m.IORB * 100.0e0 AS IORB_BP, m.RRPONTSYAWARD * 100.0e0 AS RRPONTSYAWARD_BP,
 t.YC_3MO * 100.0e0 AS YC_3MO_BP FROM v_tsy t LEFT JOIN v_market m ON t.REPDTE = m.REPDTE)"""
FRAGMENTS["v_premium"] = f"""SELECT *, {low('OUTSIDE_OPTION_RATE_QOQ_CHANGE_BP - DOMESTIC_DEPOSIT_COST_QOQ_CHANGE_BP')}
 AS PASS_THROUGH_GAP_BP FROM (
 SELECT *, OUTSIDE_OPTION_RATE_BP - OUTSIDE_OPTION_RATE_BP_LAG1 AS OUTSIDE_OPTION_RATE_QOQ_CHANGE_BP,
 DOMESTIC_DEPOSIT_COST_BP - DOMESTIC_DEPOSIT_COST_BP_LAG1 AS DOMESTIC_DEPOSIT_COST_QOQ_CHANGE_BP FROM (
 SELECT *, OUTSIDE_OPTION_RATE_BP - DOMESTIC_DEPOSIT_COST_BP AS OUTSIDE_OPTION_PREMIUM_BP,
 {low('OUTSIDE_OPTION_RATE_BP - DOMESTIC_DEPOSIT_COST_BP')} AS OUTSIDE_OPTION_PREMIUM_POS_BP,
 {lag('OUTSIDE_OPTION_RATE_BP')} AS OUTSIDE_OPTION_RATE_BP_LAG1,
 {lag('DOMESTIC_DEPOSIT_COST_BP')} AS DOMESTIC_DEPOSIT_COST_BP_LAG1 FROM (
 SELECT *, DOMESTIC_DEPOSIT_COST * 10000.0e0 AS DOMESTIC_DEPOSIT_COST_BP FROM v_option)))"""
_EXPOSED = " + ".join(f"coalesce({clip01(c)} * {num(w)}, 0)" for c, w in cfg.EXPOSURE_WEIGHTS.items())
_USED = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {num(w)} ELSE 0.0e0 END" for c, w in cfg.EXPOSURE_WEIGHTS.items())
_SHARES = ["UNINSURED_SHARE", "BROKERED_SHARE", "LIST_SERVICE_SHARE", "LARGE_ACCOUNT_SHARE", "TIME_DEPOSIT_SHARE",
           "DEP_DRAWDOWN_4Q", "SHORT_FHLB_SHARE"]
FRAGMENTS["v_interact"] = f"""SELECT *, OUTSIDE_OPTION_PREMIUM_POS_BP * RATE_SENSITIVE_DEPOSIT_EXPOSURE
 AS PREMIUM_X_RATE_SENSITIVE_EXPOSURE, {', '.join(f'OUTSIDE_OPTION_PREMIUM_POS_BP * {clip01(c)} AS PREMIUM_X_{c}' for c in _SHARES)}
 FROM (SELECT *, {clip01(sd(_EXPOSED, _USED))} AS RATE_SENSITIVE_DEPOSIT_EXPOSURE FROM v_premium)"""
FRAGMENTS["v_comp"] = rank_score("v_interact", cfg.PRESSURE_COMPONENTS, "DEPOSIT_COMPETITION_PRESSURE_SCORE",
                                 "DEPOSIT_COMPETITION_RESILIENCE_SCORE")

# ---- indices ------------------------------------------------------------------------------
PEERS = "CASE " + " ".join(
    f"WHEN ASSET >= {num(lo)}" + (f" AND ASSET < {num(hi)}" if hi is not None else "") + f" THEN '{n}'"
    for n, lo, hi in reversed(BANDS)) + " ELSE 'unassigned' END"
GROUP = "REPDTE, PEER_GROUP"


def weighted_index(name: str, components, present=None) -> tuple[str, str, str]:
    """Percentile columns, contribution columns and the index of their sum."""
    weight_sum = sum(w for _, w, _ in components)
    pcts = ", ".join(f"100.0e0 * {pct_rank(c, GROUP, '0.5e0')} AS p_{name}_{c}" for c, _, _ in components)
    contribs = ", ".join(f"p_{name}_{c} * {num(w)} / {num(weight_sum)} AS {name}_CONTRIB_{c}" for c, w, _ in components)
    mixed = " + ".join(f"{name}_CONTRIB_{c}" for c, _, _ in components)
    return pcts, contribs, f"{high(low(mixed), 100)} AS {name}"


_M = weighted_index("ALM_MISMATCH_INDEX", cfg.MISMATCH_COMPONENTS)
_B = weighted_index("TREASURY_BUFFER_INDEX", cfg.BUFFER_COMPONENTS)
FRAGMENTS["v_peers"] = f"SELECT *, {PEERS} AS PEER_GROUP FROM v_comp"
FRAGMENTS["v_idx"] = f"""SELECT * EXCLUDE (composite), {high(low('composite'), 100)} AS FUNDING_FRAGILITY_INDEX,
 0 AS HAS_SOD_FEATURES, 0 AS HAS_FFIEC_FEATURES, 0 AS HAS_HISTORICAL_ENTITY_MAP, 'v0_fdic_only' AS INDEX_VERSION FROM (
 SELECT *, 0.4e0 * RUN_RISK_INDEX + 0.4e0 * ALM_MISMATCH_INDEX + 0.2e0 * (100.0e0 - TREASURY_BUFFER_INDEX) AS composite FROM (
 SELECT *, 100.0e0 - RUN_RISK_INDEX AS DEPOSIT_STICKINESS_INDEX,
 100.0e0 - DEPOSIT_COMPETITION_PRESSURE_INDEX AS DEPOSIT_COMPETITION_RESILIENCE_INDEX, {_M[2]}, {_B[2]} FROM (
 SELECT *, {_M[1]}, {_B[1]} FROM (
 SELECT *, 100.0e0 * {pct_rank('RUN_RISK_SCORE', GROUP, '0.5e0')} AS RUN_RISK_INDEX,
 100.0e0 * {pct_rank('DEPOSIT_COMPETITION_PRESSURE_SCORE', GROUP, '0.5e0')} AS DEPOSIT_COMPETITION_PRESSURE_INDEX,
 {_M[0]}, {_B[0]} FROM v_peers))))"""
FRAGMENTS["v_latest"] = "SELECT * FROM v_idx QUALIFY row_number() OVER (PARTITION BY CERT ORDER BY REPDTE DESC) = 1"

# ---- back-test ----------------------------------------------------------------------------
_OBS = {h: f"({quarter_end_offset('REPDTE', h)} <= DATE '{LAST_YEAR}-12-31')" for h in cfg.HORIZONS}
FRAGMENTS["v_lastfail"] = (f"SELECT CERT, max(FAILDATE) AS FAILDATE FROM v_failures WHERE year(FAILDATE) BETWEEN "
                           f"{FIRST_YEAR} AND {LAST_YEAR} GROUP BY 1")
FRAGMENTS["v_event"] = ("SELECT p.*, f.FAILDATE FROM v_idx p LEFT JOIN v_lastfail f ON p.CERT = f.CERT "
                        f"WHERE year(p.REPDTE) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}")
FRAGMENTS["v_labels"] = "SELECT *, " + ", ".join(
    f"CASE WHEN {_OBS[h]} THEN 1 ELSE 0 END AS FORWARD_OBSERVED_{h}Q, CASE WHEN {_OBS[h]} THEN "
    f"CASE WHEN coalesce(QUARTERS_TO_FAILURE BETWEEN 1 AND {h}, false) THEN 1 ELSE 0 END END AS FAIL_WITHIN_{h}Q"
    for h in cfg.HORIZONS) + (f" FROM (SELECT *, CASE WHEN FAILDATE > REPDTE THEN {quarter_distance('REPDTE', 'FAILDATE')} "
                              "END AS QUARTERS_TO_FAILURE FROM v_event)")
_SLICES = " UNION ALL ".join(
    f"SELECT '{n}' AS SLICE, DATE '{a or '0001-01-01'}' AS first_day, DATE '{b or '9999-12-31'}' AS last_day"
    for n, (a, b) in EPISODES.items())
FRAGMENTS["v_slices"] = _SLICES
FRAGMENTS["v_scored"] = " UNION ALL ".join(
    f"SELECT s.SLICE, {h} AS HORIZON_QUARTERS, '{c}' AS SCORE_COL, '{label}' AS SCORE_LABEL, CAST({c} AS DOUBLE) AS score, "
    f"FAIL_WITHIN_{h}Q AS y FROM v_labels l JOIN v_slices s ON l.REPDTE BETWEEN s.first_day AND s.last_day "
    f"WHERE FORWARD_OBSERVED_{h}Q = 1 AND {c} IS NOT NULL AND FAIL_WITHIN_{h}Q IS NOT NULL"
    for h in cfg.HORIZONS for c, label in cfg.BACKTEST_SCORES.items())
FRAGMENTS["v_grid"] = " UNION ALL ".join(
    f"SELECT '{n}' AS SLICE, {h} AS HORIZON_QUARTERS, '{c}' AS SCORE_COL, '{label}' AS SCORE_LABEL"
    for n in EPISODES for h in cfg.HORIZONS for c, label in cfg.BACKTEST_SCORES.items())
_CELL = "SLICE, HORIZON_QUARTERS, SCORE_COL"
_TOPS = ", ".join(
    f"CASE WHEN p > 0 AND p < n THEN tp{k} / f{k} END AS PRECISION_AT_{k}PCT, "
    f"CASE WHEN p > 0 AND p < n THEN tp{k} / p END AS RECALL_AT_{k}PCT" for k in cfg.TOP_SHARES)
FRAGMENTS["v_metrics"] = f"""SELECT g.*, CASE WHEN p > 0 AND p < n THEN (rank_sum - p * (p + 1) / 2.0e0) / (p * (n - p)) END AS AUC,
 CASE WHEN p > 0 AND p < n THEN p ELSE 0 END AS N_FAILURES, coalesce(n, 0) AS N_TOTAL, {_TOPS}
 FROM v_grid g LEFT JOIN (
 SELECT {_CELL}, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN y = 1 THEN r END) AS rank_sum,
 {', '.join(f"CAST(count(*) FILTER (y = 1 AND score >= t{k}) AS DOUBLE) AS tp{k}, CAST(count(*) FILTER (score >= t{k}) AS DOUBLE) AS f{k}" for k in cfg.TOP_SHARES)}
 FROM (SELECT *, rank() OVER (PARTITION BY {_CELL} ORDER BY score) + (count(*) OVER (PARTITION BY {_CELL}, score) - 1) / 2.0e0 AS r,
 {', '.join(f"quantile_cont(score, {(100 - k) / 100}) OVER (PARTITION BY {_CELL}) AS t{k}" for k in cfg.TOP_SHARES)} FROM v_scored)
 GROUP BY {_CELL}) m USING ({_CELL})"""

# ---- outflow ------------------------------------------------------------------------------
FRAGMENTS["v_next"] = f"""SELECT *, lead(DEP_GROWTH_QOQ) {HISTORY} AS NEXT_DEP_GROWTH_QOQ,
 coalesce(lead(REPDTE) {HISTORY} = {quarter_end_offset('REPDTE', 1)}, false) AS NEXT_Q_OBSERVED FROM v_dyn"""
FRAGMENTS["v_outflow"] = """SELECT n.*, CASE WHEN NEXT_Q_OBSERVED AND NEXT_DEP_GROWTH_QOQ IS NOT NULL THEN
 CASE WHEN NEXT_DEP_GROWTH_QOQ <= cut THEN 1 ELSE 0 END END AS SEVERE_RELATIVE_OUTFLOW,
 CASE WHEN NEXT_Q_OBSERVED AND NEXT_DEP_GROWTH_QOQ IS NOT NULL THEN
 CASE WHEN NEXT_DEP_GROWTH_QOQ <= cut AND NEXT_DEP_GROWTH_QOQ < 0 THEN 1 ELSE 0 END END AS SEVERE_ABSOLUTE_OUTFLOW
 FROM v_next n LEFT JOIN (SELECT REPDTE, quantile_cont(NEXT_DEP_GROWTH_QOQ, 0.05) AS cut FROM v_next
 WHERE NEXT_Q_OBSERVED AND NEXT_DEP_GROWTH_QOQ IS NOT NULL GROUP BY 1) c ON n.REPDTE = c.REPDTE"""
