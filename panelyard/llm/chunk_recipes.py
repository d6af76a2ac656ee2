"""Exact duplicates by content-defined chunk recipes.

A text is lower-cased (A-Z only) and cut where a rolling hash of its last 16 bytes has eleven zero bits, with shortest
and longest chunk lengths. Its recipe is the list of its chunks' digests. Each task sends a chunk once; the chunk's
owner compares all copies byte by byte and gives one identifier. Recipes, not texts, are then turned into ordered
identifier lists and compared. A long document is moved once, in pieces, and a piece that many documents share is sent
once by each task. Two different chunks under one 128-bit digest stop the job with an error.

Defined results. A null text is the empty text, whose recipe is empty. Of equal texts the largest doc_id stays; nulls
are smaller than all ids. Repeated rows with the id that stays are one document and all say kept. An empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, mix64, per_text, slices
from panelyard.session import cut_lineage

SHORTEST, LONGEST, MASK = 512, 16384, (1 << 11) - 1
GEAR = (mix64(np.arange(1, 257)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # after these the hash of 16 bytes stands at its last byte
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1
    ends, at = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - at > LONGEST:
            at += LONGEST
            ends.append(at)
        if mark - at >= SHORTEST and mark < n:
            at = mark
            ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def pieces(data: bytes):
    at = 0
    for end in cuts(data):
        yield data[at:end]
        at = end


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, recipe (digests joined), n_bytes, text_sha256 of the lower-cased text."""
    def make():
        def work(part, texts):
            low = [t.lower() for t in texts]  # bytes.lower changes A-Z only
            return {"doc_id": part.column("doc_id"), "recipe": pa.array([b"".join(map(digest, pieces(t))) for t in low], pa.binary()),
                    "n_bytes": pa.array([len(t) for t in low], pa.int64()), "text_sha256": [hashlib.sha256(t).hexdigest() for t in low]}
        return work

    return per_text(id_and_text(docs), "doc_id bigint, recipe binary, n_bytes bigint, text_sha256 string", make)


def chunk_ids(docs: DataFrame) -> DataFrame:
    """digest and identifier of every distinct chunk, all of whose copies were compared."""
    def make():
        sent = set()

        def work(part, texts):
            rows = []
            for text in texts:
                for piece in pieces(text.lower()):
                    key = digest(piece)
                    if key not in sent:
                        if len(sent) >= 500_000:  # then a chunk may be sent again
                            sent.clear()
                        sent.add(key)
                        rows.append((key, piece))
            return {"digest": pa.array([r[0] for r in rows], pa.binary()), "chunk": pa.array([r[1] for r in rows], pa.binary())}
        return work

    def verify(batches):
        last = content = None
        for part in slices(batches):
            first = []
            for key, chunk in zip(part.column("digest").to_pylist(), part.column("chunk").to_pylist(), strict=True):
                if key != last:
                    last, content = key, chunk
                    first.append(key)
                elif chunk != content:
                    raise ValueError("two chunks share a digest")
            yield pa.RecordBatch.from_pydict({"digest": pa.array(first, pa.binary())})

    sent = per_text(id_and_text(docs), "digest binary, chunk binary", make)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = sent.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(verify, "digest binary")
    return cut_lineage(owned.withColumn("chunk_id", F.monotonically_increasing_id()))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks."""
    rows = cut_lineage(recipes(docs))
    # rows of one recipe are summed before anything is joined, so a large group is one row from here on
    lists = cut_lineage(rows.groupBy("recipe").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n"))
                        .withColumn("list_id", F.monotonically_increasing_id()))
    at = F.sequence(F.lit(0), (F.length("recipe") / 16).cast("int") - 1)
    digests = F.when(F.length("recipe") > 0, F.transform(at, lambda i: F.substring(F.col("recipe"), i * 16 + 1, F.lit(16))))
    parts = lists.select("list_id", F.posexplode(digests).alias("place", "digest"))
    ids = (parts.join(chunk_ids(docs), "digest").groupBy("list_id")
           .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks")))
    known = cut_lineage(lists.join(ids, "list_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<bigint>"))))
    groups = known.groupBy("chunks").agg(F.max("largest").alias("keep_id"), F.sum("n").alias("group_size"))
    of = cut_lineage(known.join(groups, "chunks").select("recipe", "keep_id", "group_size", F.size("chunks").alias("n_chunks")))
    return rows.join(of, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", "n_chunks")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group."""
    stay = exact_groups(docs).where("kept").select(F.col("doc_id").alias("__kept")).dropDuplicates()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates(["doc_id"])
