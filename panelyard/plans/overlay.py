"""Supervised overlay: outflow models fitted with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import clip, number
from panelyard.operators.aggregates import usable_features
from panelyard.operators.ordered import exact_quantiles, ranked_metrics, windowed_quantiles
from panelyard.plans.outflow import outflow_labels
from panelyard.session import cut_lineage

# Candidate features and the sign a coefficient may take (0 = free).
FEATURE_SIGNS = {
    "UNINSURED_SHARE": 1, "BROKERED_SHARE": 1, "CORE_DEPOSIT_SHARE": 0, "NONINTEREST_SHARE": 0,
    "TIME_DEPOSIT_SHARE": 0, "SHORT_FHLB_SHARE": 1, "VOLATILE_TO_LIQUID_LOWER": 1, "LOANS_TO_CORE_DEPOSITS": 1,
    "DOMESTIC_DEPOSIT_COST": 1, "DEP_GROWTH_VOL_4Q": 1, "DEP_DRAWDOWN_4Q": 1, "DURATION_GAP_LITE": 1,
    "LOAN_WAM_PROXY": 1, "TD_WAM_PROXY": -1, "SOD_DEPOSIT_HHI_STATE": 1, "SOD_DEPOSIT_HHI_COUNTY": 1,
    "SOD_TOP_STATE_SHARE": 1, "HAS_IR_DERIVATIVES": 0,
}
# Training gates.
MIN_QUARTERS, MIN_EVENTS, MIN_ROWS, MIN_FEATURES, MIN_AUC_ROWS = 4, 20, 50, 3, 10
# Model settings.
MAX_ITERATIONS, TREES, TREE_DEPTH, TREE_STEP = 1000, 200, 4, 0.05
LABEL = "SEVERE_RELATIVE_OUTFLOW"
SCORE = "SUPERVISED_OUTFLOW_SCORE"


@dataclass(frozen=True)
class Statistics:
    """What a fit has to know of its labelled rows: counts, and per feature the median and, gaps filled, mean and deviation."""

    rows: int
    positives: int
    medians: list[float]
    centres: list[float]
    spreads: list[float]

    def varying(self) -> list[int]:
        """Places of features that differ between rows; the mean of equal numbers may miss them by a rounding."""
        return [i for i, (c, s) in enumerate(zip(self.centres, self.spreads, strict=True)) if s > 1e-12 * max(1.0, abs(c))]


@dataclass(frozen=True)
class Fitted:
    """A fitted model with the imputation and scaling learnt on its training rows."""

    kind: str
    features: list[str]
    medians: list[float]
    centres: list[float]
    scales: list[float]
    model: object

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the probability of an outflow."""
        ready = _vector(_imputed(rows, self.features, self.medians), self.features, self.centres, self.scales)
        scored = self.model.transform(ready)
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias(SCORE))

    def linear(self, features: Sequence[str]) -> tuple[list[float], list[float], float]:
        """(medians, weights, offset) over ``features`` in plain units; features outside the fit weigh nothing."""
        weights = dict(zip(self.features, map(float, self.model.coefficients), strict=True))
        centre, scale, median = (dict(zip(self.features, v, strict=True)) for v in (self.centres, self.scales, self.medians))
        plain = {f: w / scale[f] for f, w in weights.items()}
        offset = float(self.model.intercept) - sum(w * centre[f] for f, w in plain.items())
        return [median.get(f, 0.0) for f in features], [plain.get(f, 0.0) for f in features], offset

    def importances(self) -> list[tuple[str, float]]:
        values = (self.model.featureImportances.toArray() if self.kind == "trees"
                  else abs(self.model.coefficients.toArray()))
        return sorted(zip(self.features, map(float, values), strict=True), key=lambda p: (-p[1], p[0]))


def _imputed(df: DataFrame, features: Sequence[str], medians: Sequence[float]) -> DataFrame:
    return df.withColumns({f"__x{i}": F.coalesce(number(name), F.lit(m))
                           for i, (name, m) in enumerate(zip(features, medians, strict=True))})


def _vector(df: DataFrame, features: Sequence[str], centres: Sequence[float], scales: Sequence[float]) -> DataFrame:
    scaled = df.withColumns({f"__x{i}": (F.col(f"__x{i}") - F.lit(c)) / F.lit(s)
                             for i, (c, s) in enumerate(zip(centres, scales, strict=True))})
    names = [f"__x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="__features").transform(scaled).drop(*names)


def train_medians(train: DataFrame, features: Sequence[str]) -> list[float]:
    """Median per feature over the training rows, 0 for an empty one (one value per feature is read)."""
    numbers = train.select(*[number(f).alias(f) for f in features])
    found = {r["__metric"]: r["q0"] for r in exact_quantiles(numbers, [], features, [0.5]).collect()}
    return [float(found.get(f, 0.0)) for f in features]


def median_impute(train: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill gaps of ``rows`` with the medians of ``train`` as a plan (no value passes the driver)."""
    numbers = train.select(*[number(f).alias(f) for f in features])
    medians = exact_quantiles(numbers, [], features, [0.5])
    wide = medians.agg(*[F.max(F.when(F.col("__metric") == f, F.col("q0"))).alias(f) for f in features])
    one = wide.select(F.struct(*features)).scalar()
    filled = rows.withColumn("__m", one)
    return filled.withColumns({f: F.coalesce(number(f), F.col("__m")[f], F.lit(0.0)) for f in features}).drop("__m")


def training_statistics(known: DataFrame, features: Sequence[str], label: str = LABEL) -> Statistics:
    """Statistics of labelled rows (one row is read)."""
    medians = train_medians(known, features)
    stats = _imputed(known, features, medians).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p"),
        *[a for i in range(len(features)) for a in (F.avg(f"__x{i}").alias(f"c{i}"),
                                                    F.stddev_pop(f"__x{i}").alias(f"s{i}"))]).first()
    some = lambda key: [float(stats[f"{key}{i}"] or 0.0) for i in range(len(features))]
    return Statistics(stats["n"], int(stats["p"] or 0), medians, some("c"), some("s"))


def _merged(parts: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and deviation of rows in blocks of (count, mean, sum of squared distances to it)."""
    n, mean, squares = 0, 0.0, 0.0
    for count, of, around in parts:
        if count:
            step = of - mean
            squares += around + step * step * n * count / (n + count)
            mean += step * count / (n + count)
            n += count
    return mean, (squares / n) ** 0.5 if n else 0.0


def prefix_statistics(table: DataFrame, features: Sequence[str], label: str = LABEL, min_quarters: int = MIN_QUARTERS,
                      min_events: int = MIN_EVENTS, time: str = "REPDTE") -> list[tuple[object, int, Statistics | None]]:
    """(date, dates before it, statistics of the labelled rows before it) for every date, in order.

    A date with fewer earlier dates or events than asked has no statistics. Whatever the number of dates, one job sums
    counts and moments per date, which are merged forward here (a row per date is read), and one histogram gives the
    medians of all windows.
    """
    names = [f"__x{i}" for i in range(len(features))]
    rows = table.filter(F.col(time).isNotNull()).select(
        time, F.col(label).alias("__y"), *[number(f).alias(x) for f, x in zip(features, names, strict=True)])
    known = [F.when(F.col("__y").isNotNull(), F.col(x)) for x in names]
    sums = rows.groupBy(time).agg(
        F.count("__y").alias("n"), F.coalesce(F.sum("__y"), F.lit(0)).alias("p"),
        *[a for x, v in zip(names, known, strict=True) for a in (
            F.count(v).alias(f"{x}n"), F.avg(v).alias(f"{x}c"), F.var_pop(v).alias(f"{x}v"))]).orderBy(time).collect()
    counts = [(sum(r["n"] for r in sums[:k]), int(sum(r["p"] for r in sums[:k]))) for k in range(len(sums))]
    ready = [k for k in range(len(sums)) if k >= min_quarters and counts[k][1] >= min_events]
    medians = {}
    if ready and names:
        before = {f"w{k}": F.col(time) < F.lit(sums[k][time]) for k in ready}
        medians = {r["__metric"]: r for r in windowed_quantiles(
            rows.filter(F.col("__y").isNotNull()), names, before, 0.5).collect()}
    out = []
    for k, row in enumerate(sums):
        stats = None
        if k in ready:
            middle = [float((medians[x][f"w{k}"] if x in medians else None) or 0.0) for x in names]
            moments = []
            for x, m in zip(names, middle, strict=True):
                parts = [(r[f"{x}n"], r[f"{x}c"], r[f"{x}v"] * r[f"{x}n"]) for r in sums[:k] if r[f"{x}n"]]
                gaps = counts[k][0] - sum(p[0] for p in parts)
                moments.append(_merged([*parts, (gaps, m, 0.0)]))
            stats = Statistics(*counts[k], middle, [c for c, _ in moments], [s for _, s in moments])
        out.append((row[time], k, stats))
    return out


def fit_model(train: DataFrame, features: Sequence[str], label: str = LABEL, kind: str = "logistic", trees: int = TREES, min_rows: int = 0,
              stats: Statistics | None = None) -> Fitted | None:
    """Fit on the labelled rows; None unless both classes and ``min_rows`` rows occur.

    A feature that is the same in all of these rows says nothing about the label and stays out of the fit; with no
    feature left there is no model. ``stats`` spares the passes that find the statistics of these rows.

    ``logistic``: L2, balanced classes. ``signed``: the same with each coefficient held to
    its expected sign. ``trees``: boosted trees (no sign constraints).
    """
    features = list(features)
    known = train.filter(F.col(label).isNotNull())
    stats = stats or training_statistics(known, features, label)
    n, positives, varying = stats.rows, stats.positives, stats.varying()
    if positives == 0 or positives == n or n < min_rows or not varying:
        return None
    filled = _imputed(known, features, stats.medians)
    filled = filled.select(label, *[F.col(f"__x{i}").alias(f"__x{j}") for j, i in enumerate(varying)])
    features, medians = [features[i] for i in varying], [stats.medians[i] for i in varying]
    centres, scales = [0.0] * len(features), [1.0] * len(features)
    if kind != "trees":
        centres = [stats.centres[i] for i in varying]
        scales = [stats.spreads[i] for i in varying]
    ready = _vector(filled, features, centres, scales)
    up, down = n / (2.0 * positives), n / (2.0 * (n - positives))
    if kind == "trees":
        up, down = (n - positives) / positives, 1.0
    ready = ready.select(
        "__features", F.col(label).cast("double").alias("__label"),
        F.when(F.col(label) == 1, F.lit(float(up))).otherwise(F.lit(float(down))).alias("__weight"))
    columns = {"featuresCol": "__features", "labelCol": "__label", "weightCol": "__weight"}
    if kind == "trees":
        learner = GBTClassifier(maxIter=trees, maxDepth=TREE_DEPTH, stepSize=TREE_STEP, seed=42, **columns)
    elif kind in ("logistic", "signed"):
        # balanced weights sum to n, so a penalty of 1/n equals a unit inverse strength
        learner = LogisticRegression(maxIter=MAX_ITERATIONS, regParam=1.0 / n, elasticNetParam=0.0,
                                     standardization=False, family="binomial", **columns)
        if kind == "signed":
            signs = [FEATURE_SIGNS.get(f, 0) for f in features]
            inf = float("inf")
            learner = learner.setLowerBoundsOnCoefficients(
                DenseMatrix(1, len(signs), [0.0 if s > 0 else -inf for s in signs]))
            learner = learner.setUpperBoundsOnCoefficients(
                DenseMatrix(1, len(signs), [0.0 if s < 0 else inf for s in signs]))
    else:
        raise ValueError(f"unknown model: {kind}")
    return Fitted(kind, features, medians, centres, scales, learner.fit(ready))


def _unscored(df: DataFrame) -> DataFrame:
    return df.withColumn(SCORE, F.lit(None).cast("double"))


def full_sample_fit(df: DataFrame, features: Sequence[str], label: str = LABEL, kind: str = "logistic", trees: int = TREES) -> tuple[DataFrame, Fitted | None]:
    """One fit over all labelled rows; unscored with fewer than 50 rows or one class."""
    fitted = fit_model(df, features, label, kind, trees, MIN_ROWS)
    return (_unscored(df) if fitted is None else fitted.score(df)), fitted


def walk_forward(df: DataFrame, features: Sequence[str], label: str = LABEL, kind: str = "logistic", min_quarters: int = MIN_QUARTERS, min_events: int = MIN_EVENTS,
                 trees: int = TREES) -> tuple[DataFrame, Fitted | None]:
    """Score each quarter with a model trained on all earlier ones.

    The statistics of all windows come from two jobs (``prefix_statistics``); the driver loops over report dates
    (dozens) for the fits only. Linear models score all quarters in one plan, trees in one plan per quarter.
    """
    keep = list(dict.fromkeys(["CERT", "REPDTE", label, *features]))
    table = cut_lineage(df.select(*keep))
    models, last = [], None
    for day, seen, stats in prefix_statistics(table, features, label, min_quarters, min_events):
        fitted = None
        if stats is not None:  # a quarter whose earlier labels are one class stays unscored
            fitted = fit_model(table.filter(F.col("REPDTE") < F.lit(day)), features, label, kind, trees, stats=stats)
            last = fitted or last
        models.append((day, seen, fitted))
    score = _tree_scores if kind == "trees" else _linear_scores
    scored = cut_lineage(score(table, models, features, label))  # read for the measure and for the result
    scored = scored.withColumn("__known", (F.col(label).isNotNull() & F.col(SCORE).isNotNull()).cast("int"))
    by_quarter = ranked_metrics(scored, ["REPDTE"], SCORE, {"label": (label, "__known")}, [])
    worth = F.col("N_TOTAL") > MIN_AUC_ROWS
    mean_auc = by_quarter.agg(F.avg(F.when(worth, F.col("AUC"))).alias("m")).first()["m"]
    scored = scored.withColumn("SUPERVISED_OOT_AUC_MEAN", F.lit(mean_auc).cast("double"))
    new = scored.select("CERT", "REPDTE", SCORE, "SUPERVISED_TRAIN_QUARTERS", "SUPERVISED_OOT_AUC_MEAN")
    return df.join(new, ["CERT", "REPDTE"], "left"), last


def _linear_scores(table: DataFrame, models: Sequence[tuple], features: Sequence[str], label: str) -> DataFrame:
    """All quarters in one plan: each row takes the model of its date (one row per date, hence broadcast)."""
    spark, day = table.sparkSession, table.schema["REPDTE"].dataType.simpleString()
    rows = [(at, seen, *fitted.linear(features)) for at, seen, fitted in models if fitted is not None]
    known = spark.createDataFrame(
        rows, f"REPDTE {day}, SUPERVISED_TRAIN_QUARTERS int, __medians array<double>, __weights array<double>, __offset double")
    margin = F.col("__offset")
    for i, name in enumerate(features):
        margin = margin + F.col("__weights")[i] * F.coalesce(number(name), F.col("__medians")[i])
    dated = table.filter(F.col("REPDTE").isNotNull())
    return dated.join(F.broadcast(known), "REPDTE", "left").select(
        "CERT", "REPDTE", label, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(SCORE), "SUPERVISED_TRAIN_QUARTERS")


def _tree_scores(table: DataFrame, models: Sequence[tuple], features: Sequence[str], label: str) -> DataFrame:
    parts = []
    for day, seen, fitted in models:
        test = table.filter(F.col("REPDTE") == F.lit(day))
        scored = _unscored(test) if fitted is None else fitted.score(test)
        trained = F.lit(None if fitted is None else seen).cast("int")
        parts.append(scored.select("CERT", "REPDTE", label, SCORE, trained.alias("SUPERVISED_TRAIN_QUARTERS")))
    if not parts:
        return _linear_scores(table, [], features, label)
    return reduce(DataFrame.unionAll, parts)


def window_table(df: DataFrame, features: Sequence[str], label: str = LABEL, min_quarters: int = MIN_QUARTERS,
                 min_events: int = MIN_EVENTS) -> DataFrame:
    """What walk-forward knows of each window: a row per date and feature (dates without a fit are absent)."""
    rows = []
    for day, seen, stats in prefix_statistics(df, features, label, min_quarters, min_events):
        if stats is not None:
            varying = set(stats.varying())
            rows += [(day, seen, stats.rows, stats.positives, name, stats.medians[i], stats.centres[i], stats.spreads[i], i in varying)
                     for i, name in enumerate(features)]
    day = df.schema["REPDTE"].dataType.simpleString()
    return df.sparkSession.createDataFrame(
        rows, f"REPDTE {day}, TRAIN_QUARTERS int, N_ROWS long, N_EVENTS long, FEATURE string, MEDIAN double, CENTRE double, "
              "SPREAD double, VARIES boolean")


def fit_certificate(df: DataFrame, features: Sequence[str], label: str = LABEL, kind: str = "logistic") -> DataFrame:
    """Proof that a linear full-sample fit is the optimum: a row per feature, and ``(intercept)``.

    ``RESIDUAL`` is how far a step against the gradient of the penalised mean loss moves the weight once it is held to
    its sign: zero for every weight means that the convex problem is solved. ``SIGN_KEPT`` tells that the weight has
    its sign. The gradient is summed over the labelled rows in one job; features outside the fit have no row.
    """
    known = df.filter(F.col(label).isNotNull())
    stats = training_statistics(known, features, label)
    fitted = fit_model(df, features, label, kind, min_rows=MIN_ROWS, stats=stats)
    schema = ("FEATURE string, N_ROWS long, N_EVENTS long, MEDIAN double, CENTRE double, SPREAD double, RESIDUAL double, "
              "SIGN_KEPT boolean")
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    n, p = stats.rows, stats.positives
    weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * p))).otherwise(F.lit(n / (2.0 * (n - p))))
    miss = weight * (F.col(SCORE) - F.col(label))
    scored = _imputed(fitted.score(known), fitted.features, fitted.medians)
    sums = scored.agg(F.sum(miss).alias("b"), *[
        F.sum(miss * (F.col(f"__x{i}") - F.lit(c)) / F.lit(s)).alias(f"g{i}")
        for i, (c, s) in enumerate(zip(fitted.centres, fitted.scales, strict=True))]).first()
    rows = [("(intercept)", n, p, None, None, None, sums["b"] / n, True)]
    for i, name in enumerate(fitted.features):
        held = FEATURE_SIGNS.get(name, 0) if kind == "signed" else 0
        w = float(fitted.model.coefficients[i])
        step = w - (sums[f"g{i}"] + w) / n
        step = max(step, 0.0) if held > 0 else min(step, 0.0) if held < 0 else step
        rows.append((name, n, p, fitted.medians[i], fitted.centres[i], fitted.scales[i], w - step, w * held >= 0))
    return df.sparkSession.createDataFrame(rows, schema)


def importance_table(spark, fitted: Fitted | None) -> DataFrame:
    """Feature, absolute weight and rank (one row per feature)."""
    rows = [(i + 1, name, value) for i, (name, value) in enumerate(fitted.importances())] if fitted else []
    return spark.createDataFrame(rows, "RANK int, FEATURE string, IMPORTANCE double")


def supervised_overlay(df: DataFrame, percentile: float = 5.0, walk: bool = True, kind: str = "signed",
                       label: str = LABEL, trees: int = TREES) -> DataFrame:
    """Labels, usable features, model scores and the 0-100 risk score."""
    labelled = cut_lineage(outflow_labels(df, percentile))
    features = usable_features(labelled, list(FEATURE_SIGNS))
    if len(features) < MIN_FEATURES:
        return _unscored(labelled).withColumn("SUPERVISED_RISK_SCORE", F.lit(None).cast("double"))
    run = walk_forward if walk else full_sample_fit
    scored, fitted = run(labelled, features, label, kind, trees=trees)
    extra = {"SUPERVISED_MODEL_TYPE": F.lit(kind), "SUPERVISED_LABEL_KIND": F.lit(label),
             "SUPERVISED_RISK_SCORE": clip(F.col(SCORE) * 100.0, 0, 100)}
    for i, (name, value) in enumerate(fitted.importances() if fitted else []):
        extra[f"SUPERVISED_IMPORTANCE_{i + 1}"] = F.lit(name)
        extra[f"SUPERVISED_COEF_{i + 1}"] = F.lit(value)
    return scored.withColumns(extra)
