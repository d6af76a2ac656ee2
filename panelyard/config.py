"""Model settings: weights, scenarios, size bands, schedule codes.

All numbers and names in this file are fixed values that results depend on.
Every stage takes them as parameters, so a caller can pass its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Run-risk components (rank column source, weight, published label).
RUN_RISK_COMPONENTS = [
    ("UNINSURED_SHARE", 0.20, "Uninsured deposits"),
    ("BROKERED_SHARE", 0.17, "Brokered deposits"),
    ("LIST_SERVICE_SHARE", 0.08, "List-service deposits"),
    ("LARGE_ACCOUNT_SHARE", 0.10, "Large-account concentration"),
    ("TIME_DEPOSIT_SHARE", 0.05, "Time-deposit share"),
    ("DOMESTIC_DEPOSIT_COST", 0.08, "Domestic deposit cost"),
    ("DEP_GROWTH_VOL_4Q", 0.05, "Deposit-growth volatility"),
    ("DEP_DRAWDOWN_4Q", 0.05, "Deposit drawdown"),
]

# Pressure components (column, weight, published label).
PRESSURE_COMPONENTS = [
    ("OUTSIDE_OPTION_PREMIUM_POS_BP", 0.35, "Outside-option premium"),
    ("PASS_THROUGH_GAP_BP", 0.20, "Pass-through gap"),
    ("RATE_SENSITIVE_DEPOSIT_EXPOSURE", 0.10, "Rate-sensitive deposit exposure"),
    ("PREMIUM_X_RATE_SENSITIVE_EXPOSURE", 0.20, "Premium × rate-sensitive exposure"),
    ("PREMIUM_X_DEP_DRAWDOWN_4Q", 0.10, "Premium × deposit drawdown"),
    ("PREMIUM_X_SHORT_FHLB_SHARE", 0.05, "Premium × short FHLB share"),
]

# Mismatch index components (column, weight, published label).
MISMATCH_COMPONENTS = [
    ("LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE", 0.30, "Long-term assets / stable funding"),
    ("VOLATILE_TO_LIQUID_LOWER", 0.30, "Volatile funding / liquid assets"),
    ("SECURITY_VS_DEPOSIT_GAP_BASELINE", 0.20, "Securities / deposit gap"),
    ("LOANS_TO_CORE_DEPOSITS", 0.10, "Loans / core deposits"),
    ("SHORT_FHLB_SHARE", 0.10, "Short FHLB funding share"),
]

# Buffer index components (column, weight, published label).
BUFFER_COMPONENTS = [
    ("TREASURY_TO_UNINSURED_AFTER_100BP", 0.35, "Treasuries / uninsured after 100 bp shock"),
    ("TREASURY_AGENCY_TO_RUNNABLE", 0.35, "Treasury-agency / runnable funding"),
    ("HQLA_NARROW_LOWER_TO_RUNNABLE", 0.30, "Narrow HQLA / runnable funding"),
]

# Composite parts (key, weight, published label).
COMPOSITE_COMPONENTS = [
    ("run_risk_index", 0.40, "Run Risk Index"),
    ("alm_mismatch_index", 0.40, "ALM Mismatch Index"),
    ("inverse_treasury_buffer_index", 0.20, "Inverse Treasury Buffer"),
]

# Size bands in thousands of dollars, half open.
SIZE_BANDS = [
    ("community", 0.0, 1_000_000.0),
    ("regional", 1_000_000.0, 10_000_000.0),
    ("large_regional", 10_000_000.0, 100_000_000.0),
    ("very_large", 100_000_000.0, None),
]
UNASSIGNED = "unassigned"

# Deposit-life scenarios, category -> (base years, floor years).
DEPOSIT_CATEGORIES = {
    "ddt": "DDT",
    "trn_ex_ddt": "TRN_EX_DDT",
    "mmda": "NTRSMMDA",
    "other_savings": "NTRSOTH",
}


@dataclass(frozen=True)
class LifeScenario:
    name: str
    risk_adjustment: float
    lives: dict[str, tuple[float, float]]


LIFE_SCENARIOS = [
    LifeScenario("BASELINE", 0.60, {"ddt": (4.0, 1.0), "trn_ex_ddt": (2.5, 0.50),
                                    "mmda": (2.0, 0.25), "other_savings": (3.0, 0.50)}),
    LifeScenario("ADVERSE", 0.75, {"ddt": (2.0, 0.25), "trn_ex_ddt": (1.25, 0.10),
                                   "mmda": (1.0, 0.10), "other_savings": (1.5, 0.10)}),
    LifeScenario("SEVERE", 0.90, {"ddt": (1.0, 0.05), "trn_ex_ddt": (0.50, 0.05),
                                  "mmda": (0.35, 0.05), "other_savings": (0.75, 0.05)}),
]
STABILITY_HORIZON_YEARS = 2.0

# Maturity bucket -> years to its midpoint.
MIDPOINTS = {"0_3M": 0.125, "3_12M": 0.625, "1_3Y": 2.0, "3_5Y": 4.0,
             "5_15Y": 10.0, "15Y_PLUS": 20.0, "3Y_PLUS": 5.0}

# Time-deposit bucket -> (new field, legacy field, midpoint years).
TIME_BUCKETS = {
    "TD_LARGE_0_3": ("IDCD3LES", "CD3LES", 0.125),
    "TD_LARGE_3_12": ("IDCD3T12", "CD3T12", 0.625),
    "TD_LARGE_1_3": ("IDCD1T3", "CD1T3", 2.0),
    "TD_LARGE_3PLUS": ("IDCDOV3", "CDOV3", 4.0),
    "TD_SMALL_0_3": ("IDCD3LESS", "CD3LESS", 0.125),
    "TD_SMALL_3_12": ("IDCD3T12S", "CD3T12S", 0.625),
    "TD_SMALL_1_3": ("IDCD1T3S", "CD1T3S", 2.0),
    "TD_SMALL_3PLUS": ("IDCDOV3S", "CDOV3S", 4.0),
}

# Securities bucket -> midpoint years.
SECURITY_BUCKETS = {"SCNM3LES": 0.125, "SCNM3T12": 0.625, "SCNM1T3": 2.0,
                    "SCNM3T5": 4.0, "SCNM5T15": 10.0, "SCNMOV15": 20.0}

# Term advances by remaining life.
ADVANCE_BUCKETS = ["OTBFH1L", "OTBFH1T3", "OTBFH3T5", "OTBFHOV5"]

# Schedule codes. Loans try the domestic code, then the consolidated one.
LOAN_CODES = {
    "LOAN_0_3M": ("RCONA570", "RCFDA570"),
    "LOAN_3_12M": ("RCONA571", "RCFDA571"),
    "LOAN_1_3Y": ("RCONA572", "RCFDA572"),
    "LOAN_3_5Y": ("RCONA573", "RCFDA573"),
    "LOAN_5_15Y": ("RCONA574", "RCFDA574"),
    "LOAN_15Y_PLUS": ("RCONA575", "RCFDA575"),
}
RE_LOAN_CODES = {
    "RE_LOAN_0_3M": "RCONA564",
    "RE_LOAN_3_12M": "RCONA565",
    "RE_LOAN_1_3Y": "RCONA566",
    "RE_LOAN_3_5Y": "RCONA567",
    "RE_LOAN_5_15Y": "RCONA568",
    "RE_LOAN_15Y_PLUS": "RCONA569",
}
TIME_DEPOSIT_CODES = {
    "TD_SMALL_0_3M": "RCONHK07",
    "TD_SMALL_3_12M": "RCONHK08",
    "TD_SMALL_1_3Y": "RCONHK09",
    "TD_SMALL_3Y_PLUS": "RCONHK10",
    "TD_LARGE_0_3M": "RCONHK12",
    "TD_LARGE_3_12M": "RCONHK13",
    "TD_LARGE_1_3Y": "RCONHK14",
    "TD_LARGE_3Y_PLUS": "RCONHK15",
}
BORROWING_CODES = {
    "FHLB_LE_1Y": ("RCON2651", "RCFD2651"),
    "OTHER_BORR_LE_1Y": ("RCONB571", "RCFDB571"),
}
# Read but used by no feature; they only widen what a schedule scan keeps.
EXTRA_CODES = ["RCONHK11", "RCONK222", "RCONA555", "RCONA560", "RCONA561", "RCONA562"]

# Interest-rate derivative notionals, consolidated code first.
DERIVATIVE_CODES = {
    "IR_SWAPS": ("RCFD3450", "RCON3450"),
    "IR_FUTURES": ("RCFD8693", "RCON8693"),
    "IR_FORWARDS": ("RCFD8697", "RCON8697"),
    "IR_WRITTEN_OPTIONS": ("RCFDA126", "RCONA126"),
    "IR_PURCHASED_OPTIONS": ("RCFDA127", "RCONA127"),
}

# Part of the schedule file name that holds the mapped codes.
REPRICING_SCHEDULES = ["Schedule RCCI", "Schedule RCE ", "Schedule RCEI", "Schedule RCM ", "Schedule RCB "]
DERIVATIVE_SCHEDULES = ["Schedule RCL"]

# Market rates in percent -> basis-point column, and the benchmark order.
RATE_COLUMNS_TO_BP = {"IORB": "IORB_BP", "RRPONTSYAWARD": "RRPONTSYAWARD_BP",
                      "YC_3MO": "YC_3MO_BP", "EFFR": "EFFR_BP", "SOFR": "SOFR_BP"}
BENCHMARK_ORDER = ["IORB_BP", "RRPONTSYAWARD_BP", "YC_3MO_BP"]
EXPOSURE_WEIGHTS = {"UNINSURED_SHARE": 0.45, "BROKERED_SHARE": 0.15,
                    "LIST_SERVICE_SHARE": 0.10, "TIME_DEPOSIT_SHARE": 0.05}

SHOCKS_BP = [100, 200, 300]


@dataclass(frozen=True)
class CompetitionConfig:
    method: str = "max_available"
    benchmarks: list[str] = field(default_factory=lambda: list(BENCHMARK_ORDER))
    premium_floor_bp: float = 0.0
    exposure_weights: dict[str, float] = field(default_factory=lambda: dict(EXPOSURE_WEIGHTS))
    components: list[tuple[str, float, str]] = field(default_factory=lambda: list(PRESSURE_COMPONENTS))
    missing_rank: float = 0.5


# Columns of the panel that hold branch, schedule and hedge coverage.
BRANCH_COLUMNS = ["SOD_TOTAL_DEPOSITS", "SOD_BRANCH_COUNT", "SOD_STATE_COUNT",
                  "SOD_DEPOSIT_HHI_STATE", "SOD_COUNTY_COUNT"]
SCHEDULE_COLUMNS = ["DURATION_GAP_LITE", "LOAN_WAM_PROXY", "TD_WAM_PROXY",
                    "REPRICING_GAP_0_3M", "CUMULATIVE_GAP_3_5Y"]
HEDGE_COLUMNS = ["HAS_IR_DERIVATIVES", "IR_SWAP_PAY_FIXED_NOTIONAL", "IR_SWAP_RECEIVE_FIXED_NOTIONAL"]
REPRICING_PREFIXES = ("LOAN_", "RE_LOAN_", "TD_SMALL_", "TD_LARGE_", "TD_WAM", "TD_MATURITY", "FHLB_",
                      "OTHER_BORR_", "REPRICING_", "CUMULATIVE_", "DURATION_", "ALL_LOAN_")
DERIVATIVE_PREFIXES = ("IR_", "HAS_IR_")

# Version tags.
BASE_VERSION = "v0_fdic_only"
SCHEDULE_VERSION = "v1_ffiec_hybrid"

# Score bands.
RISK_BANDS = [(80, "critical"), (60, "high"), (40, "elevated"), (20, "moderate")]
COMPOSITE_TIERS = [(80, "very high"), (60, "elevated"), (40, "moderate")]

# Back-test episodes, horizons and scores.
EPISODES = {
    "full_sample": (None, None),
    "gfc_2008": ("2007-01-01", "2010-12-31"),
    "covid_2020": ("2019-01-01", "2021-12-31"),
    "banking_2023": ("2022-01-01", "2024-12-31"),
}
HORIZONS = [1, 2, 4]
BACKTEST_SCORES = {
    "RUN_RISK_INDEX": "Run risk index",
    "FUNDING_FRAGILITY_INDEX": "Composite fragility",
    "ALM_MISMATCH_INDEX": "ALM mismatch index",
    "DEPOSIT_COMPETITION_PRESSURE_INDEX": "Deposit competition index",
}
TOP_SHARES = [5, 10, 20]

# Published indices as id -> (score column, title).
PUBLISHED_INDICES = {
    "run_risk": ("RUN_RISK_INDEX", "Run Risk Index"),
    "alm_mismatch": ("ALM_MISMATCH_INDEX", "ALM Mismatch Index"),
    "deposit_competition": ("DEPOSIT_COMPETITION_PRESSURE_INDEX", "Deposit Competition Index"),
    "funding_fragility": ("FUNDING_FRAGILITY_INDEX", "Composite Fragility Index"),
}

# Report column lists.
INDEX_COLUMNS = ["RUN_RISK_INDEX", "DEPOSIT_STICKINESS_INDEX", "ALM_MISMATCH_INDEX", "TREASURY_BUFFER_INDEX",
                 "DEPOSIT_COMPETITION_PRESSURE_INDEX", "DEPOSIT_COMPETITION_RESILIENCE_INDEX",
                 "FUNDING_FRAGILITY_INDEX"]
FEATURE_COLUMNS = ["UNINSURED_SHARE", "BROKERED_SHARE", "CORE_DEPOSIT_SHARE", "NONINTEREST_SHARE",
                   "TIME_DEPOSIT_SHARE", "VOLATILE_TO_LIQUID_LOWER", "LONG_TERM_ASSETS_TO_STABLE_FUNDING_BASELINE",
                   "LOANS_TO_CORE_DEPOSITS", "TREASURY_TO_UNINSURED", "TREASURY_AGENCY_TO_RUNNABLE",
                   "HQLA_NARROW_LOWER_TO_RUNNABLE", "HAS_TREASURY_YIELD_HISTORY", "YC_2YR", "YC_10YR",
                   "YC_10Y_2Y_SLOPE_BP", "SECURITY_DURATION_PROXY", "SHORT_FHLB_SHARE", "SUPERVISED_OUTFLOW_SCORE",
                   "RUN_RISK_SCORE", "STICKINESS_SCORE", "OUTSIDE_OPTION_RATE_BP", "OUTSIDE_OPTION_PREMIUM_BP",
                   "OUTSIDE_OPTION_PREMIUM_POS_BP", "PASS_THROUGH_GAP_BP", "RATE_SENSITIVE_DEPOSIT_EXPOSURE",
                   "DEPOSIT_COMPETITION_PRESSURE_SCORE", "DEPOSIT_COMPETITION_RESILIENCE_SCORE"]
SCENARIO_COLUMNS = ["DEPOSIT_WAL_BASELINE", "DEPOSIT_WAL_ADVERSE", "DEPOSIT_WAL_SEVERE",
                    "DEPOSIT_STABLE_EQUIV_BASELINE", "DEPOSIT_STABLE_EQUIV_ADVERSE", "DEPOSIT_STABLE_EQUIV_SEVERE"]
SCHEDULE_REPORT_COLUMNS = ["LOAN_WAM_PROXY", "TD_WAM_PROXY", "DURATION_GAP_LITE", "REPRICING_GAP_0_3M",
                           "CUMULATIVE_GAP_3_5Y"]
BRANCH_REPORT_COLUMNS = ["SOD_BRANCH_COUNT", "SOD_STATE_COUNT", "SOD_DEPOSIT_HHI_STATE", "SOD_COUNTY_COUNT"]
LEAGUE_FEATURES = ["UNINSURED_SHARE", "VOLATILE_TO_LIQUID_LOWER", "TREASURY_TO_UNINSURED", "LOANS_TO_CORE_DEPOSITS",
                   "OUTSIDE_OPTION_PREMIUM_BP", "PASS_THROUGH_GAP_BP", "RATE_SENSITIVE_DEPOSIT_EXPOSURE"]
SUMMARY_FEATURES = ["RUN_RISK_SCORE", "UNINSURED_SHARE", "VOLATILE_TO_LIQUID_LOWER", "TREASURY_TO_UNINSURED",
                    "DEPOSIT_COMPETITION_PRESSURE_SCORE", "OUTSIDE_OPTION_PREMIUM_BP", "PASS_THROUGH_GAP_BP"]
REGIME_COLUMNS = ["TREASURY_YIELD_DATE", "HAS_TREASURY_YIELD_HISTORY", "YC_3MO", "YC_2YR", "YC_10YR", "YC_30YR",
                  "YC_10Y_3M_SLOPE_BP", "YC_10Y_2Y_SLOPE_BP", "YC_2YR_QOQ_CHANGE_BP", "YC_10YR_QOQ_CHANGE_BP",
                  "YC_10Y_3M_SLOPE_BP_QOQ_CHANGE_BP", "YC_10Y_2Y_SLOPE_BP_QOQ_CHANGE_BP"]
CORE_COLUMNS = ["CERT", "REPDTE", "NAMEFULL", "PEER_GROUP", "ASSET", "BKCLASS", "STALP", "CITY", "RSSDID", "RSSDHCR",
                "DEPDOM", "DEPDOM_EFFECTIVE", "UNINSURED_SHARE", "BROKERED_SHARE", "CORE_DEPOSIT_SHARE",
                "NONINTEREST_SHARE", "TIME_DEPOSIT_SHARE", "DOMESTIC_DEPOSIT_COST", "DEP_GROWTH_QOQ",
                "DEP_GROWTH_VOL_4Q", "DEP_DRAWDOWN_4Q", "TREASURY_TO_UNINSURED", "TREASURY_AGENCY_TO_RUNNABLE",
                "HQLA_NARROW_LOWER_TO_RUNNABLE", "HAS_TREASURY_YIELD_HISTORY", "RUN_RISK_SCORE", "STICKINESS_SCORE",
                "RUN_RISK_INDEX", "DEPOSIT_STICKINESS_INDEX", "ALM_MISMATCH_INDEX", "TREASURY_BUFFER_INDEX",
                "FUNDING_FRAGILITY_INDEX", "DEPOSIT_WAL_BASELINE", "DEPOSIT_WAL_ADVERSE", "DEPOSIT_WAL_SEVERE",
                "DEPOSIT_STABLE_EQUIV_BASELINE", "DEPOSIT_STABLE_EQUIV_ADVERSE", "DEPOSIT_STABLE_EQUIV_SEVERE",
                "INDEX_VERSION", "HAS_SOD_FEATURES", "HAS_FFIEC_FEATURES", "HAS_DERIVATIVE_FEATURES",
                "HAS_HISTORICAL_ENTITY_MAP"]
ENRICHED_FLAGS = ["HAS_FFIEC_FEATURES", "HAS_DERIVATIVE_FEATURES", "HAS_TREASURY_YIELD_HISTORY"]
