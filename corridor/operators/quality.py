"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """Non-null values of ``column`` per key."""
    return df.groupBy(key).agg(F.count(column).alias("n"))


def distributions(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``counts_by`` of several keys at once, from a single pass over the rows."""
    one = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key_value")) for k in keys
    ]))
    finest = df.groupBy(*keys).agg(F.count(column).alias("_n"))
    return finest.select(one.alias("k"), "_n").groupBy("k.key_name", "k.key_value").agg(F.sum("_n").alias("n"))


def top_steps(df: DataFrame, step: str, ties: list[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest step, ties broken by ``ties``."""
    return df.orderBy(F.col(step).desc(), *ties).limit(n)


def id_lengths(df: DataFrame, trip_id: str, split_at: str) -> DataFrame:
    """Rows per date and id length, before and from a date on."""
    return (
        df.withColumns(
            {
                "id_length": F.length(F.col(trip_id).cast("string")),
                "era": F.when(F.col("date") < F.lit(split_at).cast("date"), "before").otherwise("after"),
            }
        )
        .groupBy("era", "date", "id_length").agg(F.count(F.lit(1)).alias("n"))
    )


def reconcile_counts(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Counts per key of two frames and whether they are the same; keys of ``left``."""
    a = left.groupBy(key).agg(F.count(column).alias("count_x"))
    b = right.groupBy(key).agg(F.count(column).alias("count_y"))
    return a.join(b, key, "left").withColumn("same", F.coalesce(F.col("count_x") == F.col("count_y"), F.lit(False)))


def status_ratios(segments: DataFrame, trip: list[str], status: str, length: str, total: str) -> DataFrame:
    """Share of a trip's distance in each of the five traffic states."""
    names = ["unknown", "smooth", "slow", "congested", "verycongested"]
    parts = [F.sum(F.when(F.col(status) == code, F.col(length)).otherwise(0.0)).alias(name) for code, name in enumerate(names)]
    sums = segments.groupBy(*trip).agg(*parts, F.max(total).alias("_total"))
    return sums.select(*trip, *[F.try_divide(F.col(n), F.col("_total")).alias(n) for n in names])
