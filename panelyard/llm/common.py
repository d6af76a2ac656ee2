"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Upper-case ASCII letters become lower case, everything else stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
#: Rows, and bytes of their texts, that are worked on at a time; a longer text stands alone.
SLICE, SLICE_BYTES = 256, 1 << 21
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts read; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, column: str | None = None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and, with ``column``, of about ``limit`` bytes in it."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist() if column else None
        at = 0
        while at < batch.num_rows:
            end = min(at + rows, batch.num_rows)
            if sizes:
                total = sizes[at]
                stop = at + 1
                while stop < end and total + sizes[stop] <= limit:
                    total += sizes[stop]
                    stop += 1
                end = stop
            yield batch.slice(at, end - at)
            at = end


def raw(column: pa.Array) -> list[bytes]:
    """Texts of a string column as UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to Python, where the session does not; by rows alone, a batch of long texts
    is hundreds of megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives a task's memory back to the machine; workers live on for tasks of other jobs."""
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives memory that is already freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_text(docs: DataFrame, schema: str, make: Callable[[], Callable], column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``make()`` runs once a task and gives ``f(batch, texts) -> dict of columns`` for slices of the rows."""
    small_batches(docs.sparkSession)

    def run(batches):
        work = None
        for part in slices(batches, column=column, limit=limit):
            work = work or make()
            out = work(part, raw(part.column(column)))
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)
        del work
        release()

    return docs.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply-xorshift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. for sizes[0] numbers, then those of first[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def spans_hash(buf: np.ndarray, first: np.ndarray, last: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte spans [first, last) of ``buf``, which are in order; first > 0.

    About ``limit`` bytes are worked on at a time, so the arrays stay small for long texts."""
    out, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        base = int(first[i]) - 1
        j = max(i + 1, int(np.searchsorted(last, base + limit, side="right")))
        up, down = powers(int(last[j - 1]) - base)
        sums = np.cumsum((buf[base:last[j - 1]].astype(np.uint64) + np.uint64(1)) * up)
        out[i:j] = mix64((sums[last[i:j] - base - 1] - sums[first[i:j] - base - 1]) * down[first[i:j] - base])
        i = j
    return out
