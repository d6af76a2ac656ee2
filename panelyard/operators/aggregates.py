"""Group aggregates over panels and branch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.scalars import first_present, number, parse_report_date, safe_div
from panelyard.operators.ordered import exact_quantiles

# Accepted names of each branch-survey column, first present wins.
BRANCH_NAMES = {
    "cert": ["CERT", "FDICCERT"],
    "year": ["YEAR", "SOD_YEAR"],
    "deposit": ["DEPSUMBR", "DEPSUM", "SUMDEP", "DEPDOM", "DEP"],
    "state": ["STALPBR", "STALP", "STNAMEBR", "STNAME", "STATE"],
    "county": ["CNTYNAMB", "CNTYNUMB", "CNTYNAME", "COUNTY", "CNTYNUM", "COUNTYNAME"],
    "branch": ["UNINUMBR", "BRNUM", "OFFNUM", "OFFICENUM", "BRANCHID"],
    "date": ["REPDTE", "REPORT_DATE", "DATE"],
}


def normalise_branches(sod: DataFrame) -> DataFrame:
    """CERT, SOD_YEAR, DEP_AMT and, when present, STATE, COUNTY, BRANCH."""
    names = {role: first_present(sod, options) for role, options in BRANCH_NAMES.items()}
    if names["cert"] is None or names["deposit"] is None:
        raise ValueError("branch table needs an entity and a deposit column")
    if names["year"] is None and names["date"] is None:
        raise ValueError("branch table needs a year or a date column")
    year = (F.year(parse_report_date(names["date"])) if names["year"] is None
            else F.col(names["year"]).try_cast("int"))
    parts = [
        F.trim(F.col(names["cert"]).cast("string")).alias("CERT"),
        year.cast("int").alias("SOD_YEAR"),
        F.coalesce(number(names["deposit"]), F.lit(0.0)).alias("DEP_AMT"),
    ]
    parts += [F.col(names[r]).alias(r.upper()) for r in ("state", "county", "branch") if names[r]]
    return sod.select(*parts)


def concentration(df: DataFrame, entity: Sequence[str], part: str, amount: str, prefix: str,
                  digits: int = 6) -> DataFrame:
    """Distinct parts, top share and sum of squared shares per entity.

    ``df`` may be at any finer grain. Shares are taken against the total carried in the
    same aggregate (sum of squares over square of sum), so no window or join is needed.
    Totals of zero or less give NULL top share and an index of 0.
    """
    by_part = df.groupBy(*entity, part).agg(F.round(F.sum(amount), digits).alias("__a"))
    rolled = by_part.groupBy(*entity).agg(
        F.count(part).alias(f"{prefix}_COUNT"),
        F.max("__a").alias("__max"),
        F.sum("__a").alias("__sum"),
        F.sum(F.col("__a") * F.col("__a")).alias("__sq"),
    )
    positive = F.col("__sum") > 0
    return rolled.select(
        *entity,
        f"{prefix}_COUNT",
        F.when(positive, F.col("__max") / F.col("__sum")).alias(f"{prefix}_TOP_SHARE"),
        F.when(positive, F.col("__sq") / (F.col("__sum") * F.col("__sum"))).otherwise(F.lit(0.0)).alias(f"{prefix}_HHI"),
    )


def branch_totals(sod: DataFrame, digits: int = 6) -> DataFrame:
    return normalise_branches(sod).groupBy("CERT", "SOD_YEAR").agg(
        F.round(F.sum("DEP_AMT"), digits).alias("SOD_TOTAL_DEPOSITS"))


def branch_distinct(sod: DataFrame) -> DataFrame:
    """Distinct branches per entity and year (two-step aggregate, safe for a hot entity)."""
    return (
        normalise_branches(sod)
        .groupBy("CERT", "SOD_YEAR", "BRANCH").agg(F.count(F.lit(1)).alias("__n"))
        .groupBy("CERT", "SOD_YEAR").agg(F.count("BRANCH").alias("SOD_BRANCH_COUNT"))
    )


def geo_concentration(sod: DataFrame) -> DataFrame:
    """State and county variants per entity and year."""
    rows = normalise_branches(sod)
    entity = ["CERT", "SOD_YEAR"]
    fine = rows.groupBy(*entity, "STATE", "COUNTY").agg(F.sum("DEP_AMT").alias("DEP_AMT"))
    state = concentration(fine, entity, "STATE", "DEP_AMT", "STATE").select(
        *entity, F.col("STATE_COUNT").alias("SOD_STATE_COUNT"),
        F.col("STATE_TOP_SHARE").alias("SOD_TOP_STATE_SHARE"),
        F.col("STATE_HHI").alias("SOD_DEPOSIT_HHI_STATE"))
    county = concentration(fine, entity, "COUNTY", "DEP_AMT", "COUNTY").select(
        *entity, F.col("COUNTY_COUNT").alias("SOD_COUNTY_COUNT"),
        F.col("COUNTY_HHI").alias("SOD_DEPOSIT_HHI_COUNTY"))
    return state.join(county, entity, "left")


def sod_features(sod: DataFrame, digits: int = 6) -> DataFrame:
    """All branch features per entity and year from one scan and one shuffle.

    The branches of an entity and year (some thousands at most) meet in one task and are combined to (entity, year,
    state, county, branch) there. One explode then makes a row per role, so states, counties and branches share the
    second and third aggregate, and the rows that it makes are not sent on.
    """
    entity = ["CERT", "SOD_YEAR"]
    rows = normalise_branches(sod).repartition(*entity)
    roles = [r for r in ("STATE", "COUNTY", "BRANCH") if r in rows.columns]
    fine = rows.groupBy(*entity, *roles).agg(F.sum("DEP_AMT").alias("__a"))
    marks = [F.struct(F.lit(r).alias("role"), F.col(r).cast("string").alias("part")) for r in roles]
    marks.append(F.struct(F.lit("ALL").alias("role"), F.lit(None).cast("string").alias("part")))
    parts = (
        fine.select(*entity, "__a", F.inline(F.array(*marks)))
        .groupBy(*entity, "role", "part")
        .agg(F.round(F.sum("__a"), digits).alias("__a"))
    )

    def of(role: str, what: Column) -> Column:
        return F.when(F.col("role") == role, what)

    amount = F.col("__a")
    aggs = [F.max(of("ALL", amount)).alias("SOD_TOTAL_DEPOSITS")]
    for r in roles:
        aggs += [
            F.count(of(r, F.col("part"))).alias(f"__{r}_n"),
            F.max(of(r, amount)).alias(f"__{r}_max"),
            F.sum(of(r, amount)).alias(f"__{r}_sum"),
            F.sum(of(r, amount * amount)).alias(f"__{r}_sq"),
        ]
    wide = parts.groupBy(*entity).agg(*aggs)

    def hhi(r: str) -> Column:
        whole = F.col(f"__{r}_sum")
        return F.when(whole > 0, F.col(f"__{r}_sq") / (whole * whole)).otherwise(F.lit(0.0))

    out: list[Column | str] = [*entity, "SOD_TOTAL_DEPOSITS"]
    if "BRANCH" in roles:
        out.append(F.col("__BRANCH_n").alias("SOD_BRANCH_COUNT"))
    if "STATE" in roles:
        whole = F.col("__STATE_sum")
        out += [F.col("__STATE_n").alias("SOD_STATE_COUNT"),
                F.when(whole > 0, F.col("__STATE_max") / whole).alias("SOD_TOP_STATE_SHARE"),
                hhi("STATE").alias("SOD_DEPOSIT_HHI_STATE")]
    if "COUNTY" in roles:
        out += [F.col("__COUNTY_n").alias("SOD_COUNTY_COUNT"), hhi("COUNTY").alias("SOD_DEPOSIT_HHI_COUNTY")]
    return wide.select(*out)


def group_summary(df: DataFrame, by: Sequence[str], values: Sequence[str],
                  slices: int | None = None) -> DataFrame:
    """``X_MEDIAN``, ``X_MEAN``, ``X_COUNT`` per group, a NULL key being a group of its own.

    Means and counts are one partial aggregate; medians come from sliced histograms.
    """
    values = [v for v in values if v in df.columns]
    plain = df.groupBy(*by).agg(
        *[a for v in values for a in (F.avg(v).alias(f"{v}_MEAN"), F.count(v).alias(f"{v}_COUNT"))])
    # NULL keys stay a group: the quantile pass sees a stand-in struct, never NULL itself
    marked = df.withColumns({f"__by_{k}": F.struct(F.col(k).alias("k")) for k in by})
    quantiles = exact_quantiles(marked, [f"__by_{k}" for k in by], values, [0.5], slices)
    quantiles = quantiles.select("*", *[F.col(f"__by_{k}.k").alias(k) for k in by])
    medians = quantiles.groupBy(*by).agg(
        *[F.max(F.when(F.col("__metric") == v, F.col("q0"))).alias(f"{v}_MEDIAN") for v in values])
    medians = medians.select(*[F.col(k).alias(f"__by_{k}") for k in by], *[f"{v}_MEDIAN" for v in values])
    joined = plain.join(medians, [plain[k].eqNullSafe(medians[f"__by_{k}"]) for k in by], "left")
    return joined.select(*by, *[f"{v}_{s}" for v in values for s in ("MEDIAN", "MEAN", "COUNT")])


def share_of_total(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """value / group total. The total is a pre-aggregated table joined back, so a group that
    holds a third of the rows is not gathered in one task."""
    totals = df.groupBy(*by).agg(F.round(F.sum(value), 6).alias("__total"))
    return df.join(totals, list(by), "left").withColumn(out, safe_div(value, "__total")).drop("__total")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N_ROWS")).filter(F.col("N_ROWS") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key repeats; returns ``df`` so it can be chained."""
    rows = duplicate_keys(df, keys).agg(F.sum("N_ROWS")).first()[0]
    if rows:
        raise ValueError(f"Duplicate {'+'.join(keys)} rows: {rows}")
    return df


def profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, entities, quarters and date range of a panel in one pass."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return df.agg(
        F.count(F.lit(1)).alias("BANK_QUARTERS"),
        F.countDistinct("CERT").alias("UNIQUE_BANKS"),
        F.countDistinct("REPDTE").alias("QUARTERS"),
        F.concat_ws(" – ", day(F.min("REPDTE")), day(F.max("REPDTE"))).alias("DATE_RANGE"),
    ).select(F.lit(name).alias("PANEL"), "*")


def usable_features(df: DataFrame, candidates: Sequence[str], more_than: int = 10) -> list[str]:
    """Columns with enough values that vary; one aggregate, one row read on the driver."""
    names = [c for c in candidates if c in df.columns]
    if not names:
        return []
    row = feature_stats(df, names).collect()
    good = {r["FEATURE"] for r in row if r["N_VALUES"] > more_than and (r["STD"] or 0) > 0}
    return [n for n in names if n in good]


def feature_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: non-null values and sample deviation."""
    wide = df.agg(*[a for n in names for a in (F.count(n).alias(f"{n}__n"),
                                               F.stddev_samp(number(n)).alias(f"{n}__s"))])
    rows = [F.struct(F.lit(n).alias("FEATURE"), F.col(f"{n}__n").alias("N_VALUES"),
                     F.col(f"{n}__s").alias("STD")) for n in names]
    return wide.select(F.inline(F.array(*rows)))
