"""Deposit mix, dynamics, run-risk score and deposit-life scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import (
    clip, clip01, coalesce_columns, double, ensure_columns, nz_sum, nz_weighted, safe_div,
)
from panelyard.operators.ordered import Rank, add_ranks
from panelyard.operators.windows import drawdown, growth, history, lagged, rolling_std

SCORE_KEYS = ("CERT", "REPDTE")
MIX_INPUTS = ["DEPUNA", "BRO", "DEPLSNB", "IDDEPLAM", "IDDEPSAM", "COREDEP", "DEPNIDOM", "TRN", "DDT",
              "NTRSMMDA", "NTRSOTH"]


def deposit_mix(panel: DataFrame) -> DataFrame:
    """Shares of domestic deposits and the non-maturity total.

    A reported zero of uninsured deposits next to positive deposits is unknown, not zero.
    """
    df = panel.withColumn("DEPDOM_EFFECTIVE", coalesce_columns(panel, ["DEPDOM", "DEP"]))
    df = ensure_columns(df, MIX_INPUTS)
    deposits = F.col("DEPDOM_EFFECTIVE")
    unknown = F.coalesce((F.col("DEPUNA") == 0) & (deposits > 0), F.lit(False))
    df = df.withColumns({
        "DEPUNA_MISSING": unknown,
        "UNINSURED_SHARE": safe_div(F.when((F.col("DEPUNA") > 0) | (deposits <= 0), F.col("DEPUNA")), deposits),
        "BROKERED_SHARE": safe_div("BRO", deposits),
        "LIST_SERVICE_SHARE": safe_div("DEPLSNB", deposits),
        "LARGE_ACCOUNT_SHARE": safe_div("IDDEPLAM", F.col("IDDEPLAM") + F.col("IDDEPSAM")),
        "CORE_DEPOSIT_SHARE": safe_div("COREDEP", deposits),
        "NONINTEREST_SHARE": safe_div("DEPNIDOM", deposits),
        "TRN_EX_DDT": clip(F.col("TRN") - F.col("DDT"), lower=0),
    })
    return df.withColumn("NMD_TOTAL", F.expr(nz_sum(cfg.DEPOSIT_CATEGORIES.values())))


def time_deposit_buckets(df: DataFrame) -> DataFrame:
    """Eight maturity buckets (current field, else legacy field) and the time-deposit share."""
    buckets = {name: coalesce_columns(df, [new, old]) for name, (new, old, _) in cfg.TIME_BUCKETS.items()}
    df = ensure_columns(df.withColumns(buckets), ["NTRTIME"])
    df = df.withColumn("TD_BUCKET_SUM", F.expr(nz_sum(cfg.TIME_BUCKETS)))
    df = df.withColumn("TIME_DEPOSITS_EFFECTIVE",
                       F.when(F.col("TD_BUCKET_SUM") > 0, F.col("TD_BUCKET_SUM")).otherwise(F.col("NTRTIME")))
    return df.withColumn("TIME_DEPOSIT_SHARE", safe_div("TIME_DEPOSITS_EFFECTIVE", "DEPDOM_EFFECTIVE"))


def deposit_cost(df: DataFrame) -> DataFrame:
    """Annualised quarterly interest over the mean of this and the previous row's deposits."""
    df = ensure_columns(df, ["EDEPDOMQ"])
    mean = (F.col("DEPDOM_EFFECTIVE") + lagged("DEPDOM_EFFECTIVE")) / F.lit(2.0)
    return df.withColumn("AVG_DEPDOM_QTR", mean).withColumn(
        "DOMESTIC_DEPOSIT_COST", safe_div(F.col("EDEPDOMQ") * 4, "AVG_DEPDOM_QTR"))


def deposit_dynamics(df: DataFrame) -> DataFrame:
    """Growth, growth volatility and drawdown; every window shares one exchange on the entity."""
    over = history()
    df = df.withColumns({
        "DEP_GROWTH_QOQ": growth("DEPDOM_EFFECTIVE", 1, over),
        "DEP_GROWTH_YOY": growth("DEPDOM_EFFECTIVE", 4, over),
    })
    return df.withColumns({
        "DEP_GROWTH_VOL_4Q": rolling_std("DEP_GROWTH_QOQ", over=over),
        "DEP_DRAWDOWN_4Q": drawdown("DEPDOM_EFFECTIVE", over=over),
    })


def rank_score(df: DataFrame, components: Sequence[tuple[str, float, str]], score: str, complement: str,
               fill: float = 0.5, by: Sequence[str] = ("REPDTE",), keys: Sequence[str] = SCORE_KEYS) -> DataFrame:
    """100 x weighted mean of percentile ranks, with ``RANK_<column>`` kept per component.

    Components with a weight of zero or less are left out; an absent column ranks as ``fill``. Entities are known.
    """
    used = [(name, weight) for name, weight, _ in components if weight > 0]
    if not used:
        return df.withColumns({score: F.lit(None).cast("double"), complement: F.lit(None).cast("double")})
    ranks = [Rank(name, f"RANK_{name}", fill=fill) for name, _ in used]
    have = df.columns
    df = add_ranks(df, by, ranks, keys, entity=True).select(*have, *[r.out for r in ranks])
    weight_sum = sum(weight for _, weight in used)
    weighted = nz_weighted({f"RANK_{name}": weight for name, weight in used})
    df = df.withColumn(score, F.expr(f"({weighted}) / {double(weight_sum)} * 100D"))
    return df.withColumn(complement, F.lit(100.0) - F.col(score))


def run_risk_score(df: DataFrame, components=cfg.RUN_RISK_COMPONENTS) -> DataFrame:
    return rank_score(df, components, "RUN_RISK_SCORE", "STICKINESS_SCORE")


def time_deposit_wal(df: DataFrame, horizon: float = cfg.STABILITY_HORIZON_YEARS) -> DataFrame:
    """Midpoint-weighted life of time deposits and the part that outlasts the horizon."""
    weighted = F.expr(nz_weighted({name: mid for name, (_, _, mid) in cfg.TIME_BUCKETS.items()}))
    stable = F.expr(nz_weighted({name: min(mid / horizon, 1.0) for name, (_, _, mid) in cfg.TIME_BUCKETS.items()}))
    return df.withColumns({
        "TIME_DEPOSIT_WAL": safe_div(weighted, "TIME_DEPOSITS_EFFECTIVE"),
        "TIME_DEPOSIT_STABLE_EQUIV": stable,
    })


def deposit_life_scenarios(df: DataFrame, scenarios: Sequence[cfg.LifeScenario] = tuple(cfg.LIFE_SCENARIOS),
                           horizon: float = cfg.STABILITY_HORIZON_YEARS) -> DataFrame:
    """Deposit lives, weighted lives and stable equivalents per scenario."""
    df = df.withColumn("__risk", clip01(F.col("RUN_RISK_SCORE") / 100.0))
    # an unknown score keeps the life unknown: greatest() alone would give the floor
    df = df.withColumns({
        f"{category.upper()}_LIFE_{s.name}": F.expr(
            f"CASE WHEN __risk IS NOT NULL THEN greatest({double(base)} * (1D - {double(s.risk_adjustment)} * __risk), "
            f"{double(floor)}) END")
        for s in scenarios for category, (base, floor) in s.lives.items()})
    out = {}
    for s in scenarios:
        amounts = [(f"coalesce(`{column}`, 0D)", f"`{category.upper()}_LIFE_{s.name}`")
                   for category, column in cfg.DEPOSIT_CATEGORIES.items()]
        years = " + ".join(f"{amount} * {life}" for amount, life in amounts)
        stable = " + ".join(f"CASE WHEN {life} IS NOT NULL THEN {amount} * least({life} / {double(horizon)}, 1D) END"
                            for amount, life in amounts)
        timed = "coalesce(TIME_DEPOSIT_WAL, 0D) * coalesce(TIME_DEPOSITS_EFFECTIVE, 0D)"
        out[f"NMD_WAL_{s.name}"] = F.expr(f"try_divide({years}, NMD_TOTAL)")
        out[f"DEPOSIT_WAL_{s.name}"] = F.expr(
            f"try_divide({years} + {timed}, NMD_TOTAL + coalesce(TIME_DEPOSITS_EFFECTIVE, 0D))")
        out[f"DEPOSIT_STABLE_EQUIV_{s.name}"] = F.expr(f"{stable} + TIME_DEPOSIT_STABLE_EQUIV")
    return df.withColumns(out).drop("__risk")


def deposit_features(panel: DataFrame, components=cfg.RUN_RISK_COMPONENTS) -> DataFrame:
    """The whole deposit stage: panel rows in, the same rows with deposit features out."""
    known = panel.filter(F.col("CERT").isNotNull() & F.col("REPDTE").isNotNull())
    df = deposit_dynamics(deposit_cost(time_deposit_buckets(deposit_mix(known))))
    return deposit_life_scenarios(time_deposit_wal(run_risk_score(df, components)))
