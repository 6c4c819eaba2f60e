"""Day files read with an outcome for each file: a bad file stops nothing and is not lost silently.

A file is set aside whole, with one error row, if it is

- ``empty``: it has no bytes or no row but its header,
- ``unreadable``: no line of it can be read, or its compression is broken from the start,
- ``truncated``: a compressed file ends before its end mark, a plain one stops within a
  row (its last line has no line end and a row has too few columns), or fewer bytes
  could be read than it has,
- ``encoding``: a line is not valid UTF-8.

Single malformed rows of a good file go to a quarantine frame of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.scratch import checkpoint

CORRUPT = "_corrupt_record"
COMPRESSED = (".gz",)
CHUNK = 1 << 20


def _file() -> Column:
    """The path of the file a row comes from, decoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, size, value)``: the lines of the files as they are, whatever their bytes."""
    text = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths)
    return text.select(_file(), F.col("_metadata.file_size").alias("size"), "value")


def _compression(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, broken)`` of compressed files: null if whole. Such a file is never split, so one task reads it in any case."""

    def check(content: bytes) -> str | None:
        at, some = 0, False
        while at < len(content):
            decoder = zlib.decompressobj(wbits=31)
            try:
                while at < len(content) and not decoder.eof:
                    some = bool(decoder.decompress(content[at : at + CHUNK])) or some
                    at += CHUNK
            except zlib.error:
                return "truncated" if some else "unreadable"
            if not decoder.eof:
                return "truncated"
            at = min(at, len(content)) - len(decoder.unused_data)
        return None

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"file": frame["file"], "broken": [check(c) for c in frame["content"]]}, dtype="object")

    schema = "file string, broken string"
    if not paths:
        return spark.createDataFrame([], schema)
    content = spark.read.format("binaryFile").load(paths).select(_file(), "content")
    return content.mapInPandas(each, schema)


def outcomes(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """``(file, size, rows, error)``: one row for each of the files, ``error`` null for a good one. Stored."""
    columns = len(schema.split(","))
    header = _header(schema)
    value = F.rtrim("value", F.lit("\r"))
    seen = _lines(spark, paths).groupBy("file").agg(
        F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"),
        F.count_if((value != header) & (value != "")).alias("rows"),
        F.count_if(~F.is_valid_utf8("value")).alias("undecoded"),
        F.count_if((F.regexp_count("value", F.lit(",")) < columns - 1) & (value != "")).alias("short"),
    )
    sized = spark.read.format("binaryFile").load(paths).select(_file(), F.col("length").alias("size"))
    given = spark.createDataFrame([(p, 0) for p in paths], "file string, size bigint")
    place = F.regexp_replace("file", r"^\w+:(//[^/]*)?", "").alias("place")
    empty = given.select("*", place).join(sized.select(place), "place", "left_anti").drop("place")  # readers skip files of no bytes
    packed = _compression(spark, [p for p in paths if p.endswith(COMPRESSED)])
    known = sized.unionByName(empty).join(seen, "file", "left").join(packed, "file", "left")
    plain = ~F.lower(F.col("file")).rlike("|".join(e.replace(".", r"\.") + "$" for e in COMPRESSED))
    cut = plain & ((F.col("bytes") < F.col("size")) | ((F.col("bytes") == F.col("size") + 1) & (F.col("short") > 0)))
    error = (
        F.when(F.col("size") == 0, "empty").when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("bytes").isNull(), "unreadable")
        .when(F.col("undecoded") > 0, "encoding").when(cut, "truncated").when(F.col("rows") == 0, "empty")
    )
    return checkpoint(known.select("file", "size", F.coalesce("rows", F.lit(0)).alias("rows"), error.alias("error")))


def _header(schema: str) -> str:
    return ",".join(part.split()[0] for part in schema.split(","))


def read_files(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``file``, malformed rows ``(file, _corrupt_record)``, outcomes) of CSV files, which may repeat the column names.

    The paths are those of one batch, so their number is bounded. Rows of the files with an
    error are in neither frame.
    """
    found = outcomes(spark, paths, schema)
    good = F.broadcast(found.where("error is null").select("file"))  # no more rows than paths
    lines = _lines(spark, paths).join(good, "file", "left_semi").select("file", F.rtrim("value", F.lit("\r")).alias("value"))
    lines = lines.where((F.col("value") != _header(schema)) & (F.col("value") != ""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.withColumn("row", F.from_csv("value", f"{schema}, {CORRUPT} string", options))
    broken = F.col(f"row.{CORRUPT}").isNotNull()
    return (
        rows.where(~broken).select("file", "row.*").drop(CORRUPT),
        rows.where(broken).select("file", F.col("value").alias(CORRUPT)),
        found,
    )
