"""Session settings every job of this package relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
#: Byte code beyond which the JVM leaves a method uncompiled.
METHOD_BYTES = 8000


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelyard")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled_methods(spark: SparkSession) -> None:
    """Keeps the code of wide rows in methods of a size that the JVM compiles; it interprets larger ones, row by row."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one that ``spark.checkpoint.dir`` names.

    Where it is unset, a session of one process (tests, the benchmark) sets one of its own; a cluster must name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelyard-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


_WRITTEN: list[str] = []


def clean_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written under the checkpoint folder after the first ``since`` of them.

    For when no frame that reads them is used any more: between jobs, and at the end of the process.
    """
    system = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _WRITTEN[since:]:
        target = system.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _WRITTEN[since:]


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean_scratch(spark)


atexit.register(_clean_at_exit)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table under the shared checkpoint root and read on from there.

    Used where a plan is read several times or grows in a loop. The table survives the
    loss of executors, is computed in one pass, and later reads take only the columns
    they need. It lives until ``clean_scratch`` or the end of the process.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint root for a written table."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path
