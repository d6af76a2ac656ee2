"""Text members of ZIP archives as rows of lines, and the way back.

The reader is a Spark data source: planning reads only the central directory of each archive, and every wanted member is
a partition of its own (small ones share partitions of ``PACK_BYTES``), decompressed as a stream and handed on in Arrow
batches. An archive is never held as one row, and its members are read side by side. Archives lie where every executor can open them (a shared folder or an object store).
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LINES = "path string, part string, line_number bigint, line string"
LINE_BATCH = 5_000
#: Bytes of text that small members share a partition up to.
PACK_BYTES = 32 << 20
MALFORMED = "_malformed"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def archive_files(paths: Sequence[str]) -> list[str]:
    """Archives as named, and those of named folders."""
    out = []
    for path in paths:
        system, inner = file_system(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type != fs.FileType.Directory:
            out.append(path)
            continue
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        out += [path.rstrip("/") + f.path[len(inner.rstrip("/")):] for f in found if f.is_file and f.extension.lower() == "zip"]
    return sorted(out)


@dataclass
class Members(InputPartition):
    """(archive, member) pairs of one partition."""

    names: list[tuple[str, str]]


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.patterns = json.loads(options.get("patterns", "[]"))
        self.suffix = options.get("suffix", ".txt").lower()
        self.encoding = options.get("encoding", "utf-8")
        self.first_only = options.get("firstonly", "false") == "true"
        self.pack = int(options.get("packbytes", str(PACK_BYTES)))

    def members(self, path: str) -> list[tuple[int, str, str]]:
        system, inner = file_system(path)
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
            names = [i for i in archive.infolist() if i.filename.lower().endswith(self.suffix) and (not self.patterns or any(p in i.filename for p in self.patterns))]
        return [(i.file_size, path, i.filename) for i in (names[:1] if self.first_only else sorted(names, key=lambda i: i.filename))]

    def partitions(self) -> list[Members]:
        files = archive_files(self.paths)
        with ThreadPoolExecutor(16) as pool:
            found = [m for members in pool.map(self.members, files) for m in members]
        out, room = [], 0
        for size, path, name in found:
            if not out or size > room:
                out.append(Members([]))
                room = self.pack
            out[-1].names.append((path, name))
            room -= size
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        for path, name in partition.names if partition else ():  # without members there is one empty partition
            yield from self.lines(path, name)

    def lines(self, path: str, name: str) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(path)
        with system.open_input_file(inner) as file, zipfile.ZipFile(file) as archive, archive.open(name) as member:
            number, lines = 0, []

            def batch() -> pa.RecordBatch:
                n = len(lines)
                return pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string()), "part": pa.array([name] * n, pa.string()),
                                                   "line_number": pa.array(range(number - n, number), pa.int64()), "line": pa.array(lines, pa.string())})

            for line in io.TextIOWrapper(member, self.encoding, errors="replace"):
                lines.append(line.rstrip("\r\n"))
                number += 1
                if len(lines) == LINE_BATCH:
                    yield batch()
                    lines = []
            if lines:
                yield batch()


class ArchiveLines(DataSource):
    """Options: paths and patterns (JSON lists), suffix, encoding, firstonly, packbytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(dict(self.options))


def archive_lines(spark: SparkSession, paths: str | Sequence[str], patterns: Sequence[str] = (), suffix: str = ".txt",
                  encoding: str = "utf-8", first_only: bool = False, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Lines of the members whose name ends with ``suffix`` and holds one of ``patterns``.

    ``paths`` are archives or folders of them; ``first_only`` takes the first such member of each archive.
    """
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").options(
        paths=json.dumps([paths] if isinstance(paths, str) else list(paths)), patterns=json.dumps(list(patterns)), suffix=suffix,
        encoding=encoding, firstonly=str(first_only).lower(), packbytes=str(pack_bytes)).load()


def csv_lines_to_table(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """CSV members (a header line each) as one table of text columns by name, parsed by Spark.

    Names lose a leading ``#``. Members may have different columns: each is read by its own header, a missing column is
    NULL. Lines that don't parse stand in ``MALFORMED`` with NULL columns; empty lines are left out. A record is one line.
    ``keep`` names columns of ``lines`` that stay.
    """
    heads = lines.filter(F.col("line_number") == 0).groupBy("line").agg(F.count(F.lit(1)).alias("n")).orderBy("line").collect()  # distinct headers
    out = None
    for head in heads:
        names = [c.strip().strip('"').lstrip("#").strip() for c in head["line"].lstrip("\ufeff").split(",")]
        members = lines.filter((F.col("line_number") == 0) & (F.col("line") == head["line"])).select("path", "part")
        schema = ", ".join(f"`{n}` string" for n in [*names, MALFORMED])
        rows = lines.filter((F.col("line_number") > 0) & (F.length("line") > 0)).join(members, ["path", "part"])
        parsed = F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "escape": '"'})
        table = rows.select(*keep, parsed.alias("__r")).select(*keep, "__r.*")
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    if out is None:
        return lines.select(*keep, F.lit(None).cast("string").alias(MALFORMED)).limit(0)
    return out


def latin1_table(spark: SparkSession, paths: str | Sequence[str], keep: Sequence[str] = ("path", "part", "line_number")) -> DataFrame:
    """The first CSV member of each archive, in Latin-1, as a table of text columns."""
    return csv_lines_to_table(archive_lines(spark, paths, suffix=".csv", encoding="latin-1", first_only=True), keep)


def write_archives(lines: DataFrame, folder: str, encoding: str = "utf-8") -> list[str]:
    """Write (archive, part, line_number, line) as ZIP archives under ``folder`` and give their paths.

    An archive is written by one task as a stream of sorted lines, under a name of its own first, so a repeated task
    leaves one whole file. The caller deals large tables into enough archives.
    """
    def run(batches):
        import uuid

        import pandas as pd

        state: dict = {}

        def close():
            if state:
                state["member"].close()
                state["zip"].close()
                state["file"].close()
                state["system"].move(state["draft"], state["path"])
                done.append(state["target"])
                state.clear()

        done: list[str] = []
        for batch in batches:
            for (archive, part), rows in batch.groupby(["archive", "part"], sort=False):
                if state.get("archive") != archive:
                    close()
                    target = f"{folder.rstrip('/')}/{archive}"
                    system, path = file_system(target)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    draft = f"{path}.{uuid.uuid4().hex}.draft"
                    file = system.open_output_stream(draft)
                    state.update(archive=archive, target=target, system=system, path=path, draft=draft, file=file, part=None,
                                 zip=zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED))
                if state["part"] != part:
                    if state["part"] is not None:
                        state["member"].close()
                    state["part"], state["member"] = part, state["zip"].open(part, "w", force_zip64=True)
                state["member"].write("".join(f"{line}\r\n" for line in rows["line"]).encode(encoding, errors="replace"))
        close()
        if done:
            yield pd.DataFrame({"path": done})

    order = ["archive", "part", "line_number"]
    sorted_lines = lines.select(*order, "line").repartition("archive").sortWithinPartitions(*order)
    return sorted(r["path"] for r in sorted_lines.mapInPandas(run, "path string").collect())  # one row per archive


def csv_line(*columns: Column) -> Column:
    """Text columns as one CSV line; every cell quoted, quotes doubled, NULL an empty cell."""
    return F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in columns])
