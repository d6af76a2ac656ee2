"""Table sources and sinks by file suffix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.scalars import number, present_columns, upper_names
from panelyard.sources.archives import file_system

#: Bytes that a written file should have, before compression.
FILE_BYTES = 128 << 20


def _kind(path: str) -> str:
    name = path.rstrip("/").lower()
    for kind in ("parquet", "csv"):
        if name.endswith(f".{kind}"):
            return kind
    raise ValueError(f"unsupported table format: {path}")


def scan_table(spark: SparkSession, path: str | Sequence[str], schema=None) -> DataFrame:
    """Parquet or CSV by suffix, with upper-case names; several paths are one scan and have one schema.

    A CSV without ``schema`` is read as text: type inference would be a pass over all data.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*paths) if _kind(paths[0]) == "parquet" else reader.option("header", True).csv(paths)
    return upper_names(df)


def file_shape(path: str) -> tuple:
    """Format and columns of a table from one footer or header line; no rows are read."""
    kind = _kind(path)
    system, inner = file_system(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        files = system.get_file_info(fs.FileSelector(inner, recursive=True))
        names = sorted(f.path for f in files if f.is_file and f.base_name[0] not in "._" and f.size)
        if not names:
            return kind, path  # nothing to look at: a scan of its own
        if any("=" in n[len(inner):] for n in names):
            return kind, path  # folders of values have columns that no footer tells
        inner = names[0]
    if kind == "parquet":
        schema = pq.read_schema(inner, filesystem=system)
        return kind, tuple((f.name, str(f.type)) for f in schema)
    with system.open_input_stream(inner) as file:
        return kind, file.read(1 << 20).partition(b"\n")[0].strip()


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with different columns; a missing column is NULL."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [upper_names(f) for f in frames])


def scan_tables(spark: SparkSession, paths: Sequence[str], empty_schema: str | None = None) -> DataFrame:
    """Read and union files; without any, an empty frame if ``empty_schema`` is given, else an error.

    Files of one shape (footer schema, header line) are one scan, so the plan grows with the number of shapes, not of files.
    """
    if not paths:
        if empty_schema is None:
            raise FileNotFoundError("no input files")
        return spark.createDataFrame([], empty_schema)
    paths, groups = sorted(paths), defaultdict(list)
    with ThreadPoolExecutor(16) as pool:
        for path, shape in zip(paths, pool.map(file_shape, paths), strict=True):
            groups[shape].append(path)
    return union_by_name([scan_table(spark, group) for group in groups.values()])


def sink_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
               file_bytes: int = FILE_BYTES) -> None:
    """Write Parquet or CSV by suffix; with ``partition_by`` only the touched partitions are replaced.

    Rows are rebalanced by partition value first, to tasks of about ``file_bytes``: small values share a task and get a
    file each, a value that holds a large part of the table is split over several tasks and files.
    """
    kind, spark = _kind(path), df.sparkSession
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = spark.conf.get(size)
    spark.conf.set(size, str(file_bytes))
    try:
        writer = df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)
    finally:
        spark.conf.set(size, now)


def promote_numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Text columns whose every known value is a number become double (one aggregate over all)."""
    text = [n for n, t in df.dtypes if t == "string" and n not in exclude]
    if not text:
        return df
    bad = df.agg(*[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("double").isNull()).alias(n) for n in text]).first()
    numeric = {n: number(n) for n in text if bad[n] == 0}
    return df.withColumns(numeric) if numeric else df


def field_audit(df: DataFrame, requested: Sequence[str], known: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """One row per requested field: known to the dictionary, returned, row and non-null counts.

    ``strict`` raises when a field is unknown or missing.
    """
    df = upper_names(df)
    have, dictionary = set(df.columns), set(known)
    unknown = [f for f in requested if dictionary and f not in dictionary]
    missing = [f for f in requested if f not in have]
    if strict and (unknown or missing):
        raise ValueError(f"unknown fields: {', '.join(unknown)}; missing fields: {', '.join(missing)}")
    found = present_columns(df, list(requested))
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in found])
    rows = [F.struct(
        F.lit(f).alias("FIELD"),
        F.lit("unknown" if f in unknown else "missing" if f in missing else "returned").alias("STATUS"),
        F.col("__rows").alias("ROW_COUNT"),
        (F.col(f) if f in have else F.lit(0).cast("long")).alias("NON_NULL")) for f in requested]
    return wide.select(F.inline(F.array(*rows)))


def exact_dedupe(df: DataFrame) -> DataFrame:
    """Identical rows once. Equal rows combine map side, so many copies are no hot group."""
    return df.distinct()
