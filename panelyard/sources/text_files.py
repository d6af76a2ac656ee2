"""Keyword scan over text documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line breaks of text files.
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def read_text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, text), one row per file."""
    files = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return files.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def keyword_line_scan(documents: DataFrame, keywords: Sequence[str], key: str = "file", text: str = "text",
                      length: int | None = None) -> DataFrame:
    """Lines that hold any keyword, ignoring case: (key, line_number from 1, the line without white space at its ends).

    ``length`` keeps so many characters at most."""
    # \Q..\E quoting keeps every keyword literal for the JVM's regex engine
    pattern = "(?i)" + "|".join(r"\Q" + k.replace(r"\E", r"\E\\E\Q") + r"\E" for k in keywords)
    lines = documents.select(key, F.posexplode(F.split(text, BREAKS)).alias("__p", "__line"))
    found = lines.filter(F.col("__line").rlike(pattern))
    line = F.regexp_replace("__line", r"(?U)^\s+|\s+$", "")
    return found.select(key, (F.col("__p") + 1).alias("line_number"),
                        (line if length is None else F.substring(line, 1, length)).alias("snippet"))
