"""Registration of queries and the shared output shape of a query and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.catalog.frames import Frames
from panelyard.session import compiled_methods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}  # without the fragments they use


def _parse(spec: str) -> list[tuple[str, str]]:
    """``"CERT REPDTE:d X:r N:i"``: name and output kind.

    d = date as text, r = double rounded to six digits, i = bigint, b = boolean as bigint,
    nothing = as it is.
    """
    return [(name, kind) for name, _, kind in (token.partition(":") for token in spec.split())]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _parse(spec):
        column = F.col(name)
        if kind == "d":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "r":
            # adding zero turns a negative zero into zero
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif kind in ("i", "b"):
            column = column.cast("bigint")
        out.append(column.alias(name))
    return df.select(*out)


def shaped_sql(spec: str, source: str, where: str = "") -> str:
    out = []
    for name, kind in _parse(spec):
        column = f'"{name}"'
        if kind == "d":
            column = f"strftime({column}, '%Y-%m-%d')"
        elif kind == "r":
            column = f"round(CAST({column} AS DOUBLE), 6) + 0.0e0"
        elif kind in ("i", "b"):
            column = f"CAST({column} AS BIGINT)"
        out.append(f'{column} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM {source} {where}"


def query(name: str, spec: str | None = None, source: str | None = None, where: str = ""):
    """Register ``fn(frames) -> DataFrame``; with ``source`` also its SQL check.

    ``source`` is a fragment name or a SQL query text that may use fragment names.
    """
    def register(fn: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            compiled_methods(spark)
            out = fn(Frames(spark, sf_dir))
            return shaped(out, spec) if spec else out

        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = run
        if source is not None:
            text = source if " " not in source.strip() else f"({source})"
            CHECKS[name] = shaped_sql(spec, f"{text} AS checked", where) if spec else source
        return fn

    return register
