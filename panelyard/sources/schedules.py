"""Regulatory schedule files: tab-separated parts inside ZIP archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scalars import ColumnLike, as_col, number
from panelyard.plans.repricing import pivot_codes
from panelyard.session import cut_lineage
from panelyard.sources.archives import archive_lines

def collect_codes(mapping: dict) -> list[str]:
    """Codes of a nested map: strings of seven or more characters, in order, once."""
    out: list[str] = []
    for value in mapping.values():
        found = collect_codes(value) if isinstance(value, dict) else [value]
        out += [c for c in found if isinstance(c, str) and len(c) >= 7 and c not in out]
    return out


def _unquoted(cell: Column) -> Column:
    return F.regexp_replace(F.trim(cell), r'^"(.*)"$', "$1")


def _heads(lines: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """(path, part, codes, places) of the header line of each part; the places of ``codes`` only if given."""
    head = lines.filter(F.col("line_number") == 0).select("path", "part", F.transform(
        F.split("line", "\t"), _unquoted).alias("codes"))
    head = head.withColumn("places", F.transform("codes", lambda c, i: F.struct(i.alias("position"), c.alias("code"))))
    if codes is not None:
        head = head.withColumn("places", F.filter("places", lambda p: p["code"].isin(list(codes))))
    return head


def _bodies(lines: DataFrame, head: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_number") > 0).withColumn("cells", F.split("line", "\t")).join(head, ["path", "part"])


def _filer() -> Column:
    return _unquoted(F.element_at("cells", F.array_position("codes", "IDRSSD").cast("int"))).try_cast("bigint")


def _part_rank(patterns: Sequence[str]) -> Column:
    rank = F.lit(len(patterns))
    for i, pattern in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("part").contains(pattern), i).otherwise(rank)
    return rank


def schedule_cells(lines: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Long cells (path, part, line_number, CODE, CELL) under the header line of each part, of ``codes`` only if given.

    Line 0 holds the codes, line 1 the labels, the rest is data. There is one header per part, so the header side of the
    join is as small as the number of members. A line is split once, and cells of other codes are left out before rows
    are made of them.
    """
    return _bodies(lines, _heads(lines, codes)).select("path", "part", "line_number", _filer().alias("IDRSSD"), "cells", F.explode("places").alias("p")).select(
        "path", "part", "line_number", F.col("p.position").alias("position"), "IDRSSD", F.col("p.code").alias("CODE"),
        _unquoted(F.get("cells", F.col("p.position"))).alias("CELL"))


def schedule_facts(cells: DataFrame, codes: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """Data cells of the target codes as (path, REPDTE, IDRSSD, CODE, VALUE, part).

    A code is taken from the first part of its archive that has the column, in the order of ``patterns`` and then of
    names; cells of later parts don't fill its gaps.
    """
    wanted = cells.filter(F.col("CODE").isin(list(codes)))
    # one row per archive and code
    first = wanted.groupBy("path", "CODE").agg(F.min(F.struct(_part_rank(patterns).alias("rank"), "part"))["part"].alias("part"))
    data = wanted.filter(F.col("line_number") > 1).join(first, ["path", "CODE", "part"])
    return data.select("path", report_date_from_name("path").alias("REPDTE"), "IDRSSD", "CODE",
                       number("CELL").alias("VALUE"), "part")


def schedule_table(facts: DataFrame, codes: Sequence[str], keys: Sequence[str] = ("REPDTE", "IDRSSD")) -> DataFrame:
    """One row per filer with a column per code."""
    order = ["part"] if "part" in facts.columns else []
    return pivot_codes(facts, keys, codes, order=order)


def schedule_labels(cells: DataFrame, line: int = 1) -> DataFrame:
    """Code to label from the label line; the last part wins."""
    rows = cells.filter((F.col("line_number") == line) & (F.col("position") > 0) & (F.length("CELL") > 0))
    return rows.groupBy("CODE").agg(F.max_by(F.trim("CELL"), F.struct("path", "part")).alias("LABEL"))


def schedule_rows(lines: DataFrame, codes: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """Data lines as (REPDTE, IDRSSD, part, VALUES): the numbers of ``codes`` in their order, by the first-part rule of
    ``schedule_facts``. A line stays one row however many codes it holds; it is written once, as the rule reads it twice.
    """
    codes = list(codes)
    head = _heads(lines, codes).filter(F.size("places") > 0)
    head = head.withColumn("at", F.transform(F.array(*[F.lit(c) for c in codes]), lambda c: F.transform(
        F.filter("places", lambda p: p["code"] == c), lambda p: p["position"])))
    cell = lambda p: number(_unquoted(F.get("cells", p)))
    rows = cut_lineage(_bodies(lines, head).select("path", "part", "line_number", _filer().alias("IDRSSD"), F.transform(
        "at", lambda places: F.array_min(F.transform(places, cell))).alias("VALUES")))
    # one row per part with lines, and one per archive and code
    parts = rows.select("path", "part").distinct().join(head.select("path", "part", F.explode("places.code").alias("CODE")), ["path", "part"])
    first = parts.groupBy("path", "CODE").agg(F.min(F.struct(_part_rank(patterns).alias("rank"), "part"))["part"].alias("part"))
    taken = first.groupBy("path", "part").agg(F.collect_set("CODE").alias("taken"))
    data = rows.filter(F.col("line_number") > 1).join(taken, ["path", "part"])
    values = F.array(*[F.when(F.array_contains("taken", c), F.col("VALUES")[i]) for i, c in enumerate(codes)])
    return data.select(report_date_from_name("path").alias("REPDTE"), "IDRSSD", "part", values.alias("VALUES"))


def rows_table(rows: DataFrame, codes: Sequence[str], keys: Sequence[str] = ("REPDTE", "IDRSSD")) -> DataFrame:
    """One row per filer with a column per code; the first known value in the order of parts wins.

    A filer has about one row per part, so rows are sent as they are and not merged before.
    """
    known = lambda i: F.when(F.col("VALUES")[i].isNotNull(), F.struct("part", F.col("VALUES")[i].alias("v")))
    return rows.repartition(*keys).groupBy(*keys).agg(*[F.min(known(i))["v"].alias(c) for i, c in enumerate(codes)])


def read_schedules(spark: SparkSession, paths: str | Sequence[str], patterns: Sequence[str],
                   codes: Sequence[str]) -> DataFrame:
    """Archives to the wide schedule table."""
    return rows_table(schedule_rows(archive_lines(spark, paths, patterns), codes, patterns), codes)


def base_name(path: ColumnLike) -> Column:
    return F.regexp_extract(F.replace(as_col(path), F.lit("%20"), F.lit(" ")), r"([^/]*)/*$", 1)


def report_date_from_name(path: ColumnLike) -> Column:
    """First eight digits of the file name: month first if they start with at most 12, else year first."""
    digits = F.regexp_extract(base_name(path), r"(\d{8})", 1)
    month_first = F.substring(digits, 1, 2).try_cast("int") <= 12
    return F.when(month_first, F.try_to_date(digits, "MMddyyyy")).otherwise(F.try_to_date(digits, "yyyyMMdd"))


def status_date_from_name(path: ColumnLike) -> Column:
    """Year-first date of this century in the file name, else a month-first one."""
    name = base_name(path)
    year_first = F.try_to_date(F.regexp_extract(name, r"(20\d{6})", 1), "yyyyMMdd")
    month_first = F.try_to_date(
        F.regexp_extract(name, r"((?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])20\d{2})", 1), "MMddyyyy")
    return F.coalesce(year_first, month_first)


def year_from_name(path: ColumnLike) -> Column:
    return F.regexp_extract(base_name(path), r"(20\d{2})", 1).try_cast("int")


def crosswalk(df: DataFrame, institutions: DataFrame, on: str = "IDRSSD", source: str = "FED_RSSD",
              target: str = "CERT", order: Sequence[str] = ()) -> DataFrame:
    """Attach the entity id of each filer (first institution row per filer id)."""
    from panelyard.operators.joins import map_ids

    return map_ids(df, institutions, source, target, on, order)
