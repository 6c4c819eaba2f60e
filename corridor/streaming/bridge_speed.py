"""Mean bridge speed per polling window, while answers keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.functions.numbers import speed_kmh
from corridor.functions.text import label
from corridor.constants import BRIDGE_NAMES
from corridor.operators.steps import on_bridges
from corridor.sources.routes import parse_routes, step_rows


def step_stream(raw: DataFrame) -> DataFrame:
    """Raw answers (``polled_at, od, crawl, body``) to step rows with their poll time."""
    return step_rows(parse_routes(raw), keep=("polled_at",))


def windowed_speed(steps: DataFrame, time: str, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Mean speed per window and bridge; state is dropped ``late`` after the window."""
    moving = on_bridges(steps).withColumns(
        {
            "speed": speed_kmh(F.col("distance"), F.col("duration")),
            "_time": F.col(time).cast("timestamp"),
        }
    )
    return (
        moving.withWatermark("_time", late)
        .groupBy(F.window("_time", window).alias("w"), "bridge")
        .agg(F.avg("speed").alias("avg_speed"), F.count("speed").alias("steps"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            label(F.col("bridge"), BRIDGE_NAMES).alias("bridge"), "avg_speed", "steps",
        )
    )


def with_open_windows(finished: DataFrame, steps: DataFrame, time: str, window: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """The windows that the stream has finished and, from the steps at rest, those still open.

    The watermark closes windows in order of time, so all windows that start after
    the last finished one are open; only the steps since then are read for them.
    """
    last = finished.agg(F.max("window_start").alias("last")).first()["last"]
    newest = windowed_speed(steps if last is None else steps.where(F.col(time).cast("timestamp_ntz") >= F.lit(last)), time, window, late)
    return finished.unionByName(newest if last is None else newest.where(F.col("window_start") > F.lit(last)))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and append the finished windows to Parquet."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
