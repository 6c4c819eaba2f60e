"""Sinks: date-partitioned Parquet, CSV, and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet partitioned by ``keys``, replacing only the partitions that occur in ``df``.

    Rows are rebalanced by the keys rather than hashed to one task per partition:
    adaptive execution splits one that holds much of the data and joins small ones.
    """
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)


def write_by_date(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet partitioned by date, so that a day filter reads one folder; the folders of other dates stay."""
    write_partitions(df, path, [date])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def geojson_feature(df: DataFrame, coords: str = "coords", list_columns: tuple[str, ...] = ()) -> Column:
    """A row as GeoJSON feature text; list columns become text."""
    attributes = [c for c in df.columns if c != coords]
    listed = [
        F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c)
        if c in list_columns else F.col(c)
        for c in attributes
    ]
    line = F.struct(
        F.lit("LineString").alias("type"),
        F.transform(coords, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"),
    )
    return F.to_json(
        F.struct(F.lit("Feature").alias("type"), F.struct(*listed).alias("properties"), line.alias("geometry"))
    )


def geojson_features(df: DataFrame, coords: str = "coords", list_columns: tuple[str, ...] = ()) -> DataFrame:
    return df.select(geojson_feature(df, coords, list_columns).alias("feature"))


def write_geojson(df: DataFrame, path: str, coords: str = "coords", list_columns: tuple[str, ...] = ()) -> None:
    """One feature per line."""
    geojson_features(df, coords, list_columns).write.mode("overwrite").text(path)
