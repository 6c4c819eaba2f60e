"""CSV and Parquet scans with explicit schemas, file dates and row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corridor.functions import ids
from corridor.scratch import checkpoint, is_small

CORRUPT = "_corrupt_record"
MOST_SPLITS = 200_000


def register_views(spark: SparkSession, paths: dict[str, str]) -> None:
    """Register Parquet folders as temporary views."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def spread(df: DataFrame) -> DataFrame:
    """Share out a scan of few splits over all cores before heavy per-row work.

    A scan that already has a split per core, as any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_csv(spark: SparkSession, path, schema: str, null_value: str | None = None) -> DataFrame:
    """Headered CSV; ``null_value='null'`` also reads that text as missing."""
    reader = spark.read.schema(schema).option("header", True)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


def with_file_date(df: DataFrame) -> DataFrame:
    """Add ``date`` from the names of the files a scan reads (``*_yyMMdd.ext``)."""
    return df.withColumn("date", ids.date_from_file_name(F.col("_metadata.file_path")))


def read_days(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of day files with the date of each."""
    return with_file_date(read_csv(spark, folder, schema))


def read_quarantine(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the raw line and its file): one bad row stops nothing.

    Lines that repeat the column names are headers and skipped.
    """
    header = ",".join(part.split()[0] for part in schema.split(","))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = spark.read.text(folder).withColumn("file", F.col("_metadata.file_name")).where(F.col("value") != header)
    rows = raw.withColumn("row", F.from_csv("value", f"{schema}, {CORRUPT} string", options))
    broken = F.col(f"row.{CORRUPT}").isNotNull()
    good = rows.where(~broken).select("row.*").drop(CORRUPT)
    return good, rows.where(broken).select("file", F.col("value").alias(CORRUPT))


def parquet_row_index(df: DataFrame) -> DataFrame:
    """Row position inside its file, as the Parquet reader reports it."""
    return df.withColumn("row_idx", F.col("_metadata.row_index"))


def file_row_index(df: DataFrame) -> DataFrame:
    """Row position inside its file for any file scan, from 0.

    The scan numbers rows within its splits and is checkpointed, since another
    scan could be split differently. One row per split (file, start offset) gives
    the rows before it in the same file; the splits are counted before they are
    sent to every task.
    """
    split = ["_file", "_start"]
    numbered = df.withColumns(
        {
            "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"),
            "_mid": F.monotonically_increasing_id(),
        }
    )
    numbered = checkpoint(numbered)
    sizes = numbered.groupBy(*split).agg(F.min("_mid").alias("_base"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, "_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = checkpoint(offsets)
    return (
        numbered.join(F.broadcast(offsets) if is_small(offsets, MOST_SPLITS) else offsets, split)
        .withColumn("row_idx", F.col("_offset") + F.col("_mid") - F.col("_base"))
        .drop(*split, "_mid", "_base", "_offset")
    )


def unvisited_days(inputs: DataFrame, done: DataFrame, key: str = "date") -> DataFrame:
    """Input files whose day has no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
