"""Shared scratch space, lineage cuts and the size check behind broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; on a cluster the
    setting is required, because a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corridor-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never used path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh Parquet folder of the shared scratch and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives its executors.

    A written table also gives later joins its true size, and unlike
    ``DataFrame.checkpoint`` it does not hand down the constraints of its plan,
    which grow from round to round in iterative jobs and stall the optimizer.
    """
    return stored(df, "cut")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
