"""Published records: component arrays, league rows, summaries, freshness and the manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard import config as cfg
from panelyard.functions.scalars import finite, last_completed_quarter, survey_snapshot_date
from panelyard.operators.aggregates import profile
from panelyard.operators.windows import latest_snapshot
from panelyard.plans.backtest import last_failures
from panelyard.plans.reports import latest_with_flag, peer_sizes, top_k_per_index


def _known(records: Sequence[Column]) -> Column:
    return F.filter(F.array(*records), lambda r: r["contribution"].isNotNull())


def rank_components(df: DataFrame, components) -> Column:
    """``[{key, label, weight, percentile, contribution}]`` from ``RANK_*`` columns."""
    weight_sum = sum(weight for _, weight, _ in components)
    records = []
    for name, weight, label in components:
        rank = F.col(f"RANK_{name}") if f"RANK_{name}" in df.columns else F.lit(None).cast("double")
        percentile = F.lit(100.0) * rank
        records.append(F.struct(
            F.lit(name.lower()).alias("key"), F.lit(label).alias("label"), F.lit(weight).alias("weight"),
            percentile.alias("percentile"), (percentile * F.lit(weight) / F.lit(weight_sum)).alias("contribution")))
    return _known(records)


def contribution_components(df: DataFrame, index: str, components) -> Column:
    """``[{key, label, weight, contribution}]`` from ``<index>_CONTRIB_*`` columns."""
    records = []
    for name, weight, label in components:
        column = f"{index}_CONTRIB_{name}"
        part = F.col(column) if column in df.columns else F.lit(None).cast("double")
        records.append(F.struct(F.lit(name.lower()).alias("key"), F.lit(label).alias("label"),
                                F.lit(weight).alias("weight"), part.alias("contribution")))
    return _known(records)


def composite_components(df: DataFrame) -> Column:
    """``[{key, label, weight, score, contribution}]`` of the composite."""
    def of(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    values = {"run_risk_index": of("RUN_RISK_INDEX"), "alm_mismatch_index": of("ALM_MISMATCH_INDEX"),
              "inverse_treasury_buffer_index": F.lit(100.0) - of("TREASURY_BUFFER_INDEX")}
    return _known([
        F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(weight).alias("weight"),
                 values[key].alias("score"), (F.lit(weight) * values[key]).alias("contribution"))
        for key, weight, label in cfg.COMPOSITE_COMPONENTS])


def component_breakdown(df: DataFrame) -> DataFrame:
    """The five explanation arrays of a row."""
    return df.withColumns({
        "run_risk_components": rank_components(df, cfg.RUN_RISK_COMPONENTS),
        "deposit_competition_components": rank_components(df, cfg.PRESSURE_COMPONENTS),
        "alm_components": contribution_components(df, "ALM_MISMATCH_INDEX", cfg.MISMATCH_COMPONENTS),
        "treasury_buffer_components": contribution_components(df, "TREASURY_BUFFER_INDEX", cfg.BUFFER_COMPONENTS),
        "composite_components": composite_components(df),
    })


def top_drivers(components: str, k: int = 3) -> Column:
    """The ``k`` largest contributions of a component array (ties by key)."""
    def order(a: Column, b: Column) -> Column:
        return (F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1)
                .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

    return F.slice(F.array_sort(F.col(components), order), 1, k)


# Published field -> panel column, in order, before and after the arrays.
LEAGUE_HEAD = {
    "assets": "ASSET", "deposits": None, "uninsured_pct": "UNINSURED_SHARE", "state": "STALP", "charter": "BKCLASS",
    "repdte": "REPDTE", "run_risk_score": "RUN_RISK_SCORE", "stickiness_score": "STICKINESS_SCORE",
    "run_risk": "RUN_RISK_INDEX", "alm_mismatch": "ALM_MISMATCH_INDEX", "treasury_buffer": "TREASURY_BUFFER_INDEX",
    "deposit_competition": "DEPOSIT_COMPETITION_PRESSURE_INDEX",
    "deposit_competition_resilience": "DEPOSIT_COMPETITION_RESILIENCE_INDEX",
    "deposit_competition_score": "DEPOSIT_COMPETITION_PRESSURE_SCORE", "funding_fragility": "FUNDING_FRAGILITY_INDEX",
}
COMPONENT_ARRAYS = ["run_risk_components", "deposit_competition_components", "alm_components",
                    "treasury_buffer_components", "composite_components"]
LEAGUE_TAIL = {
    "supervised_outflow_score": "SUPERVISED_OUTFLOW_SCORE", "treasury_yield_date": "TREASURY_YIELD_DATE",
    "has_treasury_yield_history": "HAS_TREASURY_YIELD_HISTORY", "yc_2yr": "YC_2YR", "yc_10yr": "YC_10YR",
    "yc_10y_3m_slope_bp": "YC_10Y_3M_SLOPE_BP", "yc_10y_2y_slope_bp": "YC_10Y_2Y_SLOPE_BP",
    "yc_10yr_qoq_change_bp": "YC_10YR_QOQ_CHANGE_BP", "has_ffiec_features": "HAS_FFIEC_FEATURES",
    "has_sod_features": "HAS_SOD_FEATURES", "index_version": "INDEX_VERSION",
}
SUMMARY_FIELDS = ["cert", "name", "peer_group", "peer_group_bank_count", "assets", "deposits", "uninsured_pct",
                  "state", "repdte", "run_risk", "alm_mismatch", "treasury_buffer", "deposit_competition",
                  "funding_fragility"]
_TEXT = {"state", "charter", "index_version"}


def _field(df: DataFrame, name: str, source: str | None) -> Column:
    if source is None or source not in df.columns:
        return F.lit(None).cast("string" if name in _TEXT else "double").alias(name)
    dtype = df.schema[source].dataType
    if isinstance(dtype, T.DateType | T.TimestampType):
        return F.date_format(source, "yyyy-MM-dd").alias(name)
    return finite(source, dtype).alias(name)


def failure_flags(df: DataFrame, failures: DataFrame, key: str = "CERT") -> DataFrame:
    """``failed`` and ``fail_date`` text per row."""
    side = last_failures(failures).select(F.col("CERT").alias("__c"), F.date_format("FAILDATE", "yyyy-MM-dd").alias("fail_date"))
    joined = df.join(side, df[key].cast("string") == side["__c"], "left").drop("__c")
    return joined.withColumn("failed", F.col("fail_date").isNotNull())


def record_columns(mart: DataFrame) -> DataFrame:
    """The columns of ``mart`` that ``league_rows`` reads."""
    parts = [f"RANK_{name}" for name, _, _ in (*cfg.RUN_RISK_COMPONENTS, *cfg.PRESSURE_COMPONENTS)]
    parts += [f"ALM_MISMATCH_INDEX_CONTRIB_{name}" for name, _, _ in cfg.MISMATCH_COMPONENTS]
    parts += [f"TREASURY_BUFFER_INDEX_CONTRIB_{name}" for name, _, _ in cfg.BUFFER_COMPONENTS]
    named = ["CERT", "REPDTE", "NAMEFULL", "PEER_GROUP", "DEPDOM_EFFECTIVE", "DEPDOM", *LEAGUE_HEAD.values(), *LEAGUE_TAIL.values(), *parts]
    have = set(mart.columns)
    return mart.select(*[c for c in dict.fromkeys(named) if c in have])


def manifest_columns(mart: DataFrame) -> DataFrame:
    """The columns of ``mart`` that ``manifest`` and a back-test of its scores read."""
    named = ["CERT", "REPDTE", "NAMEFULL", "PEER_GROUP", *cfg.ENRICHED_FLAGS, "HAS_FFIEC_FEATURES", "HAS_SOD_FEATURES", "TREASURY_YIELD_DATE",
             "YC_2YR", "YC_10YR", "YC_10Y_3M_SLOPE_BP", *cfg.BACKTEST_SCORES, *[score for score, _ in cfg.PUBLISHED_INDICES.values()]]
    have = set(mart.columns)
    return mart.select(*[c for c in dict.fromkeys(named) if c in have])


def league_rows(mart: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """The published record of each entity: its latest row, explained and flagged.

    Records are unordered; a writer sorts them by ``funding_fragility`` (descending) and
    ``cert`` when it needs the published order.
    """
    latest = latest_snapshot(mart)
    # one row per peer group: the bands are a handful
    sized = latest.join(peer_sizes(latest), "PEER_GROUP", "left")
    rows = component_breakdown(sized)
    deposits = "DEPDOM_EFFECTIVE" if "DEPDOM_EFFECTIVE" in mart.columns else "DEPDOM"
    if failures is None:
        rows = rows.withColumns({"failed": F.lit(False), "fail_date": F.lit(None).cast("string")})
    else:
        rows = failure_flags(rows, failures)
    return rows.select(
        F.col("CERT").alias("cert"), F.col("NAMEFULL").alias("name"), F.col("PEER_GROUP").alias("peer_group"),
        F.coalesce("PEER_COUNT", F.lit(0)).alias("peer_group_bank_count"),
        *[_field(rows, n, deposits if n == "deposits" else s) for n, s in LEAGUE_HEAD.items()],
        *COMPONENT_ARRAYS,
        *[_field(rows, n, s) for n, s in LEAGUE_TAIL.items()],
        "failed", "fail_date")


def bank_summary_rows(mart: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    return league_rows(mart, failures).select(*SUMMARY_FIELDS)


def headline_metric(metrics: DataFrame, score: str, horizon: int = 4) -> DataFrame:
    return metrics.filter((F.col("SLICE") == "full_sample") & (F.col("HORIZON_QUARTERS") == horizon)
                          & (F.col("SCORE_COL") == score))


def freshness(mart: DataFrame, built_at: str) -> DataFrame:
    """One row: last date per source, coverage warnings and whether the snapshot is stale."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    one = mart.agg(
        F.max("REPDTE").alias("asof"), latest_with_flag(mart, "HAS_FFIEC_FEATURES").alias("ffiec"),
        latest_with_flag(mart, "HAS_SOD_FEATURES").alias("sod_rep"),
        (F.max("TREASURY_YIELD_DATE") if "TREASURY_YIELD_DATE" in mart.columns
         else F.lit(None).cast("date")).alias("treasury"))
    one = one.withColumn("sod", survey_snapshot_date("sod_rep"))
    warnings = []
    for source, column in (("fdic_financials", "asof"), ("ffiec", "ffiec"), ("sod", "sod"), ("treasury", "treasury")):
        warnings.append(
            F.when(F.col(column).isNull(), F.lit(f"{source} coverage is unavailable for the published site snapshot."))
            .when(F.col(column) < F.col("asof"), F.concat(
                F.lit(f"{source} coverage trails the published site snapshot ("), text(column), F.lit(" vs "),
                text("asof"), F.lit(")."))))
    target = last_completed_quarter(F.lit(built_at[:10]).cast("date"), today_counts=False)
    return one.select(
        text("asof").alias("site_snapshot_as_of"), F.lit(built_at).alias("generated_at"),
        F.struct(text("asof").alias("fdic_financials"), text("ffiec").alias("ffiec"), text("sod").alias("sod"),
                 text("treasury").alias("treasury")).alias("source_max_dates"),
        F.array_compact(F.array(*warnings)).alias("coverage_warnings"),
        (F.col("asof").isNull() | (F.col("asof") < target)).alias("stale"))


def _profile_struct(df: DataFrame) -> DataFrame:
    return profile(df, "").select(F.struct(
        F.col("BANK_QUARTERS").alias("bank_quarters"), F.col("UNIQUE_BANKS").alias("unique_banks"),
        F.col("QUARTERS").alias("quarters"), F.col("DATE_RANGE").alias("date_range")).alias("p"))


def index_records(latest: DataFrame, metrics: DataFrame | None, horizon: int = 4) -> DataFrame:
    """One row per published index: headline metric, status and its three top entities."""
    tops = top_k_per_index(latest).groupBy("INDEX_ID").agg(F.sort_array(F.collect_list(F.struct(
        F.col("RANK").alias("rank"), F.col("NAMEFULL").alias("name"), F.col("CERT").alias("cert"),
        F.col("SCORE").alias("score"), F.col("PEER_GROUP").alias("peer_group")))).alias("top_banks"))
    spark = latest.sparkSession
    names = spark.createDataFrame([(i, title, score, n) for n, (i, (score, title)) in
                                   enumerate(cfg.PUBLISHED_INDICES.items())],
                                  "INDEX_ID string, title string, SCORE_COL string, position int")
    out = names.join(tops, "INDEX_ID", "left")
    if metrics is not None:
        chosen = metrics.filter((F.col("SLICE") == "full_sample") & (F.col("HORIZON_QUARTERS") == horizon))
        out = out.join(chosen.select("SCORE_COL", F.col("AUC").alias("failure_auc"),
                                     F.col("RECALL_AT_20PCT").alias("failure_recall_20"),
                                     F.col("N_FAILURES").alias("__failures")), "SCORE_COL", "left")
    else:
        out = out.withColumns({"failure_auc": F.lit(None).cast("double"),
                               "failure_recall_20": F.lit(None).cast("double"),
                               "__failures": F.lit(None).cast("long")})
    tested = F.col("__failures").isNotNull()
    return out.withColumns({
        "headline_horizon_quarters": F.lit(horizon),
        "validation_status": F.when(tested, F.lit("backtested")).otherwise(F.lit("not_backtested_yet")),
    })


def manifest(mart: DataFrame, built_at: str, core: DataFrame | None = None, enriched: DataFrame | None = None,
             metrics: DataFrame | None = None, horizon: int = 4) -> DataFrame:
    """One row describing the published tables. Every part is a small aggregate read as a subquery."""
    latest = latest_snapshot(mart)
    indices = index_records(latest, metrics, horizon)
    records = indices.agg(F.sort_array(F.collect_list(F.struct(
        "position", F.col("INDEX_ID").alias("id"), "title", "failure_auc", "failure_recall_20",
        "headline_horizon_quarters", "validation_status", "top_banks"))).alias("i"))
    tested = indices.agg(F.coalesce(F.max(F.when(F.col("INDEX_ID") == "run_risk", F.col("__failures"))), F.lit(0)))
    groups = peer_sizes(latest).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("PEER_COUNT")).alias("order"), F.col("PEER_GROUP").alias("id"),
        F.initcap(F.replace("PEER_GROUP", F.lit("_"), F.lit(" "))).alias("label"),
        F.col("PEER_COUNT").alias("count")))).alias("g"))
    panels = [F.lit(None).cast("string").alias("none")]
    for name, panel in (("full_history_core", core), ("recent_history_enriched", enriched)):
        if panel is not None:
            panels.append(_profile_struct(panel).scalar().alias(name))
    backdrop = []
    if "TREASURY_YIELD_DATE" in latest.columns:
        fields = {"y2": "YC_2YR", "y10": "YC_10YR", "slope_10y_3m_bp": "YC_10Y_3M_SLOPE_BP"}
        known = latest.filter(F.col("TREASURY_YIELD_DATE").isNotNull())
        backdrop = [known.agg(F.struct(
            F.date_format(F.max("TREASURY_YIELD_DATE"), "yyyy-MM-dd").alias("yield_date"),
            # the value on the last row by entity id
            *[F.max_by(c, "CERT").alias(n) for n, c in fields.items() if c in latest.columns])).scalar()
            .alias("treasury_regime")]
    fresh = freshness(mart, built_at)
    return mart.sparkSession.range(1).select(
        F.lit(3).alias("schema_version"), F.lit(built_at).alias("generated_at"),
        fresh.select(F.struct(*fresh.columns)).scalar().alias("freshness"),
        _profile_struct(mart).scalar().alias("pipeline"),
        tested.scalar().alias("failures_tested"), F.lit(horizon).alias("headline_horizon_quarters"),
        F.struct(*panels).alias("published_panels"),
        F.lit("full_history_core" if enriched is None else "recent_history_enriched").alias("site_panel"),
        *backdrop,
        records.scalar().alias("indices"), groups.scalar().alias("peer_groups"))


def _finite_below(value: Column, dtype: T.DataType) -> Column:
    """A value with NaN and infinities as null at every depth."""
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite_below(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _finite_below(x, dtype.elementType))
    return finite(value, dtype)


def rows_to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row: NaN and infinities as null at every depth, dates as yyyy-MM-dd, nulls kept."""
    fields = [_finite_below(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd"}
    return df.select(F.to_json(F.struct(*fields), options).alias("JSON"))


_LEAVES = "array<struct<PATH:string,TEXT:string,NUMBER:double>>"


def _leaves(value: Column, dtype: T.DataType, path: Column) -> Column:
    """Array of (PATH, TEXT, NUMBER) of all leaves below a value of this type."""
    none = F.array().cast(_LEAVES)
    if isinstance(dtype, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in dtype.fields]
        return F.concat(none, *parts)
    if isinstance(dtype, T.ArrayType):
        below = F.transform(value, lambda x, i: _leaves(x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(below), none)
    number = isinstance(dtype, T.NumericType)
    text = F.lit(None).cast("string") if number else value.cast("string")
    amount = value.cast("double") if number else F.lit(None).cast("double")
    return F.array(F.struct(path.alias("PATH"), text.alias("TEXT"), amount.alias("NUMBER")))


def record_leaves(df: DataFrame, key: str | None = None) -> DataFrame:
    """The published JSON texts of nested rows, read back and flattened: a row per leaf with its path, like ``a.b[0].c``.

    Numbers stand in NUMBER, texts and truth values in TEXT, a JSON null has neither; the fields of a null object are null
    leaves, an empty or null list has none. With ``key``, a field of the record, each leaf carries its value. All is one
    projection over the rows, whatever their shape.
    """
    record = F.from_json("JSON", df.schema)
    rows = rows_to_json(df).select(record.alias("r"))
    leaves = [_leaves(F.col("r")[f.name], f.dataType, F.lit(f.name)) for f in df.schema.fields]
    held = [F.col("r")[key].alias(key)] if key else []
    return rows.select(*held, F.inline(F.concat(*leaves)))
