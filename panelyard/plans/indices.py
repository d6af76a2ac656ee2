"""Peer groups, percentile indices and the composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard import config as cfg
from panelyard.functions.scalars import any_present, banded, clip, double, nz, number
from panelyard.operators.joins import merge_stages
from panelyard.operators.ordered import Rank, add_ranks

GROUP = ("REPDTE", "PEER_GROUP")
KEYS = ("CERT", "REPDTE")
# Prefixes that tell coverage when a panel carries no flags.
FLAG_PREFIXES = {
    "HAS_SOD_FEATURES": ("SOD_",),
    "HAS_FFIEC_FEATURES": ("DURATION_GAP", "REPRICING_GAP", "LOAN_WAM", "TD_WAM"),
}
# Plain indices as source -> (index, inverse).
PLAIN_INDICES = {
    "RUN_RISK_SCORE": ("RUN_RISK_INDEX", "DEPOSIT_STICKINESS_INDEX"),
    "DEPOSIT_COMPETITION_PRESSURE_SCORE": ("DEPOSIT_COMPETITION_PRESSURE_INDEX",
                                           "DEPOSIT_COMPETITION_RESILIENCE_INDEX"),
}
WEIGHTED_INDICES = {"ALM_MISMATCH_INDEX": cfg.MISMATCH_COMPONENTS, "TREASURY_BUFFER_INDEX": cfg.BUFFER_COMPONENTS}


def with_peer_group(df: DataFrame, bands=cfg.SIZE_BANDS) -> DataFrame:
    df = df.withColumn("ASSET", number("ASSET"))
    return df.withColumn("PEER_GROUP", banded("ASSET", bands, cfg.UNASSIGNED))


def _usable(df: DataFrame, components) -> list[tuple[str, float]]:
    return [(name, weight) for name, weight, _ in components if name in df.columns and weight > 0]


def _combine(df: DataFrame, index: str, components: Sequence[tuple[str, float]], rank_of) -> DataFrame:
    """Contributions and their clipped sum from percentile columns that already exist."""
    if not components:
        return df.withColumn(index, F.lit(None).cast("double"))
    weight_sum = sum(weight for _, weight in components)
    parts = {f"{index}_CONTRIB_{name}": f"{rank_of(name)} * {double(weight)} / {double(weight_sum)}"
             for name, weight in components}
    mixed = " + ".join(parts.values())
    # percentiles are never NULL here, so greatest/least keep their plain meaning
    return df.withColumns({**{name: F.expr(part) for name, part in parts.items()},
                           index: F.expr(f"least(greatest({mixed}, 0D), 100D)")})


def weighted_index(df: DataFrame, components, index: str, by: Sequence[str] = GROUP, flip: bool = False,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean of peer percentiles (0-100); each part is kept as a contribution.

    Components the frame lacks are left out and the weights renormalised.
    """
    usable = _usable(df, components)
    ranks = [Rank(name, f"__p_{name}", flip=flip, scale=100.0, fill=0.5) for name, _ in usable]
    ranked = add_ranks(df, by, ranks, keys) if ranks else df
    return _combine(ranked, index, usable, lambda name: f"__p_{name}").drop(*[r.out for r in ranks])


def fragility_indices(df: DataFrame, bands=cfg.SIZE_BANDS, weighted=None) -> DataFrame:
    """All indices from one pass of ranks inside (quarter, peer group). Entities are known."""
    weighted = weighted or WEIGHTED_INDICES
    df = with_peer_group(df, bands)
    parts = {index: _usable(df, components) for index, components in weighted.items()}
    plain = {source: names for source, names in PLAIN_INDICES.items() if source in df.columns}
    sources = list(dict.fromkeys([*plain, *[name for usable in parts.values() for name, _ in usable]]))
    ranks = [Rank(name, f"__p_{name}", scale=100.0, fill=0.5) for name in sources]
    df = add_ranks(df, GROUP, ranks, KEYS, entity=True) if ranks else df
    simple = {}
    for source, (index, inverse) in PLAIN_INDICES.items():
        value = f"__p_{source}" if source in plain else "CAST(NULL AS DOUBLE)"
        simple |= {index: F.expr(value), inverse: F.expr(f"100D - {value}")}
    df = df.withColumns(simple)
    for index, usable in parts.items():
        df = _combine(df, index, usable, lambda name: f"__p_{name}")
    weights = {key: weight for key, weight, _ in cfg.COMPOSITE_COMPONENTS}
    composite = (F.lit(weights["run_risk_index"]) * F.col("RUN_RISK_INDEX")
                 + F.lit(weights["alm_mismatch_index"]) * F.col("ALM_MISMATCH_INDEX")
                 + F.lit(weights["inverse_treasury_buffer_index"]) * (F.lit(100.0) - F.col("TREASURY_BUFFER_INDEX")))
    return df.withColumn("FUNDING_FRAGILITY_INDEX", clip(composite, 0, 100)).drop(*[r.out for r in ranks])


def version_tag(df: DataFrame, version: str = cfg.BASE_VERSION) -> DataFrame:
    """A custom tag for all rows, or base/schedule by the row's flag."""
    if version != cfg.BASE_VERSION:
        return df.withColumn("INDEX_VERSION", F.lit(version))
    flag = nz("HAS_FFIEC_FEATURES") > 0 if "HAS_FFIEC_FEATURES" in df.columns else F.lit(False)
    return df.withColumn("INDEX_VERSION", F.when(flag, F.lit(cfg.SCHEDULE_VERSION)).otherwise(F.lit(cfg.BASE_VERSION)))


def unhedged_flag(df: DataFrame) -> DataFrame:
    """1 for no derivative (missing counts as none) and a positive duration gap."""
    if "HAS_IR_DERIVATIVES" not in df.columns:
        return df
    exposed = nz("HAS_IR_DERIVATIVES") == 0
    if "DURATION_GAP_LITE" in df.columns:
        exposed = exposed & (nz("DURATION_GAP_LITE") > 0)
    return df.withColumn("UNHEDGED_DURATION_FLAG", exposed.cast("int"))


def indices_frame(first: DataFrame, *stages: DataFrame, bands=cfg.SIZE_BANDS, version: str = cfg.BASE_VERSION,
                  weighted=None) -> DataFrame:
    """Stage outputs to the published index table. One stage that carries all columns needs no join."""
    df = fragility_indices(merge_stages(first, *stages), bands, weighted)
    for flag, prefixes in FLAG_PREFIXES.items():
        if flag not in df.columns:
            df = df.withColumn(flag, any_present([c for c in df.columns if c.startswith(prefixes)]))
    if "HAS_HISTORICAL_ENTITY_MAP" not in df.columns:
        df = df.withColumn("HAS_HISTORICAL_ENTITY_MAP", F.lit(0))
    return unhedged_flag(version_tag(df, version))
