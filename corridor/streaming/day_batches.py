"""Folder batches: every file that has arrived is processed once, a bad one is set aside, a failed run can be repeated.

The record of visited files is the checkpoint of a file-source stream that lists the
landing folder and reads no content. A run takes all files that are new
(``availableNow``) in batches of a bounded number of files. A batch writes its rows
into partitions by date and file, replacing only those: a batch that is run again
after a failure writes the same partitions again, and a file that arrives late for a
day whose other files are long done adds to that day. Outcomes are kept per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.functions.ids import date_from_file_name
from corridor.sources import files
from corridor.sources.sinks import write_partitions

FILES = 1000
LISTING = "path string, modificationTime timestamp, length bigint, content binary"
OUTCOMES = "file string, size bigint, rows bigint, error string, bad_rows bigint, batch bigint"


def run_day_batches(
    spark: SparkSession, landing: str, out: str, marks: str, schema: str, shape: Callable[[DataFrame], DataFrame],
    glob: str = "*.csv", date: Callable[[Column], Column] = date_from_file_name, files_per_batch: int = FILES,
    after_write: Callable[[int], None] | None = None,
) -> None:
    """Process the files of ``landing`` that no earlier run with the same ``marks`` has finished.

    ``shape`` turns parsed rows (with ``date`` and ``file``) into rows that still have
    both. Under ``out`` there are then ``rows``, ``quarantine`` (malformed rows of good
    files) and ``outcomes`` (a row for every file). A file without a date in its name
    gets an outcome with the error ``no date``; one without a byte, which Spark's readers skip, gets none. ``after_write`` is called with the
    number of a batch before it counts as done.
    """
    listing = (
        spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).load(landing)
    )

    def batch(found: DataFrame, number: int) -> None:
        paths = [row["path"] for row in found.select("path").collect()]  # at most files_per_batch
        if not paths:
            return
        day = date(F.col("file"))
        rows, broken, outcomes = files.read_files(found.sparkSession, paths, schema)
        write_partitions(shape(rows.withColumn("date", day).where(F.col("date").isNotNull())), f"{out}/rows", ["date", "file"])
        write_partitions(broken.withColumn("date", day).where(F.col("date").isNotNull()), f"{out}/quarantine", ["date", "file"])
        bad = broken.groupBy("file").agg(F.count(F.lit(1)).alias("bad_rows"))
        dated = F.coalesce("error", F.when(day.isNull(), "no date")).alias("error")
        told = outcomes.join(bad, "file", "left").select(
            "file", "size", "rows", dated, F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), F.lit(number).cast("bigint").alias("batch")
        )
        write_partitions(told, f"{out}/outcomes", ["batch"])
        if after_write is not None:
            after_write(number)

    query = listing.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    """One row for every file seen: its rows, malformed rows, error (null if good) and batch."""
    return spark.read.schema(OUTCOMES).parquet(f"{out}/outcomes")
