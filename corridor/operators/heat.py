"""Segment heat maps and the merging of nearly equal edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import geometry as G
from corridor.functions.numbers import ratio
from corridor.operators.frames import dense_ids, join_unique, with_group_stats
from corridor.operators.spatial import near_groups, near_pairs
from corridor.scratch import checkpoint

SEGMENT = ["a_lon", "a_lat", "b_lon", "b_lat"]


def explode_segments(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """One row per pair of consecutive vertices; direction matters."""
    parts = lines.withColumn("_s", F.explode(G.segments(F.col(coords)))).drop(coords)
    return parts.withColumns(
        {
            "a_lon": F.col("_s.a.lon"), "a_lat": F.col("_s.a.lat"),
            "b_lon": F.col("_s.b.lon"), "b_lat": F.col("_s.b.lat"),
        }
    ).drop("_s")


def segment_coords(df: DataFrame) -> DataFrame:
    """Segment columns back to a two-point line."""
    line = F.array(G.point(F.col("a_lon"), F.col("a_lat")), G.point(F.col("b_lon"), F.col("b_lat")))
    return df.withColumn("coords", line)


def path_use(trips: DataFrame, keys: list[str], fid: str = "fid") -> DataFrame:
    """Trips per path: collapse repeated paths before their lines are exploded."""
    return trips.dropna(subset=[fid, *keys]).groupBy(*keys, fid).agg(F.count(F.lit(1)).alias("used"))


def segment_count(trips: DataFrame, paths: DataFrame) -> DataFrame:
    """How many trips use each segment."""
    lines = path_use(trips, []).join(paths.select("fid", "coords"), "fid")
    return explode_segments(lines).groupBy(*SEGMENT).agg(F.sum("used").alias("count"))


def segment_ratio(trips: DataFrame, paths: DataFrame) -> DataFrame:
    """Use of a segment relative to the busiest one of the OD, mean over the ODs that use it."""
    lines = path_use(trips, ["OD"]).join(paths.select("fid", "coords"), "fid")
    counts = checkpoint(explode_segments(lines).groupBy("OD", *SEGMENT).agg(F.sum("used").alias("n")))
    return (
        with_group_stats(counts, ["OD"], top=F.max("n")).withColumn("r", ratio(F.col("n"), F.col("top")))
        .groupBy(*SEGMENT).agg(F.avg("r").alias("freq"))
    )


def merge_equal_edges(
    edges: DataFrame, key: str = "id", freq: str = "freq", coords: str = "coords",
    cap: float | None = 1.0, decimal: int = 4, ties: list[str] | None = None,
) -> DataFrame:
    """Fold nearly equal edges into one and add up their frequencies.

    Edges joined by a path of near-equal pairs form a group. The member with the
    highest frequency stands for it, the lowest ``ties`` columns (the key) deciding
    among equals. With ``cap``, a group whose sum would exceed it stays as it is.
    """
    tagged = checkpoint(edges.join(near_groups(edges, key, coords, decimal), key, "left"))
    order = F.struct(-F.col(freq), *(ties or [key]))
    summary = checkpoint(tagged.where("component is not null").groupBy("component").agg(
        F.sum(freq).alias("_sum"), F.count(F.lit(1)).alias("_members"), F.min_by(key, order).alias("_leader")
    ))
    counts = summary.select("component", F.col("_members").alias("_n"))
    if cap is not None:
        summary = summary.where(F.round("_sum", 9) <= F.lit(cap))
    full = join_unique(tagged, summary, ["component"], "left", counts)
    merged = F.col("_leader").isNotNull()
    return (
        full.where(~merged | (F.col(key) == F.col("_leader")))
        .withColumn(freq, F.when(merged, F.col("_sum")).otherwise(F.col(freq)))
        .withColumn("members", F.coalesce(F.col("_members"), F.lit(1)).cast("bigint"))
        .drop("component", "_sum", "_members", "_leader")
    )


def _order(key: str, freq: str) -> Column:
    """Sorts first what is folded first: the highest frequency, ties by a digest of the key, then the key.

    The digest scatters ties, so that a long row of equal edges is decided in few rounds.
    """
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.struct((-F.col(freq)).alias("f"), digest.alias("t"), F.col(key).alias("k"))


def fold_pairs(edges: DataFrame, pairs: DataFrame, key: str = "id", freq: str = "freq", cap: float | None = 1.0) -> DataFrame:
    """``(key, leader)`` of a greedy fold: edges in the order of their frequency take all partners that are still open.

    ``pairs`` are rows ``(a, b)``, each unordered pair once. The result is that of going
    through the edges one by one: an edge that is open takes its open direct
    partners, and with ``cap`` only if their sum does not exceed it; if it does, the edge
    stays alone and its partners stay open. Leaders have themselves as leader, and edges
    without a partner no row.

    All edges that come first among their open partners and the partners of those
    are decided in the same round, since nothing before them can change what they
    find. A decided edge leaves with its pairs, so a round handles open pairs only,
    and the frequencies travel with the pairs. Hubs are met by aggregates and by
    joins that do not shuffle hot keys.
    """
    named = edges.select(key, _order(key, freq).alias("o"))
    known = checkpoint(pairs.select("a", "b").where("a <> b").distinct())
    left = join_unique(known, named.select(F.col(key).alias("a"), F.col("o").alias("oa")), ["a"])
    both = checkpoint(join_unique(left, named.select(F.col(key).alias("b"), F.col("o").alias("ob")), ["b"]))
    open_ = checkpoint(both.select("oa", "ob").unionByName(both.select(F.col("ob").alias("oa"), F.col("oa").alias("ob"))).distinct())
    decided = []
    while not open_.isEmpty():
        first = checkpoint(open_.groupBy("oa").agg(F.least("oa", F.min("ob")).alias("m"), F.count(F.lit(1)).alias("_n")))
        around = join_unique(open_, first.select(F.col("oa").alias("ob"), F.col("m").alias("mb")), ["ob"], counts=first.select(F.col("oa").alias("ob"), "_n"))
        tops = around.groupBy("oa").agg(F.min("mb").alias("m"), F.sum(-F.col("ob.f")).alias("s")).where("m = oa")
        fits = F.lit(True) if cap is None else F.round(F.col("s") - F.col("oa.f"), 9) <= F.lit(cap)
        tops = checkpoint(tops.select("oa", fits.alias("fits")))
        taken = join_unique(open_, tops, ["oa"], counts=first.select("oa", "_n")).where("fits").select(F.col("ob").alias("o"), F.col("oa.k").alias("leader"))
        gone = checkpoint(taken.unionByName(tops.select(F.col("oa").alias("o"), F.col("oa.k").alias("leader"))))
        decided.append(gone.select(F.col("o.k").alias(key), "leader"))
        removed = gone.select("o", F.lit(True).alias("_gone"))
        for side in ("oa", "ob"):
            marked = join_unique(open_, removed.withColumnRenamed("o", side), [side], "left", first.select(F.col("oa").alias(side), "_n"))
            open_ = marked.where("_gone is null").drop("_gone")
        open_ = checkpoint(open_)
    if not decided:
        return edges.select(key, F.col(key).alias("leader")).limit(0)
    return reduce(DataFrame.unionByName, decided)


def fold_equal_edges(
    edges: DataFrame, key: str = "id", freq: str = "freq", coords: str = "coords", cap: float | None = 1.0, decimal: int = 4
) -> DataFrame:
    """Fold nearly equal edges into their direct partner with the highest frequency and add up their frequencies.

    Unlike ``merge_equal_edges`` no edge is folded into one that it is not nearly equal to,
    and an edge over the cap does not keep its whole component unmerged: see ``fold_pairs``.
    """
    tagged = checkpoint(edges.join(fold_pairs(edges, near_pairs(edges, key, coords, decimal), key, freq, cap), key, "left"))
    folded = tagged.where("leader is not null").groupBy("leader").agg(F.sum(freq).alias("_sum"), F.count(F.lit(1)).alias("_members"))
    folded = checkpoint(folded.withColumnRenamed("leader", key))
    kept = join_unique(tagged.where(F.col("leader").isNull() | (F.col("leader") == F.col(key))), folded, [key], "left")
    return (
        kept.withColumn(freq, F.coalesce("_sum", freq)).withColumn("members", F.coalesce("_members", F.lit(1)).cast("bigint"))
        .drop("leader", "_sum", "_members")
    )


def merge_fine(lines: DataFrame, freq: str = "freq", cap: float | None = None, decimal: int = 4) -> DataFrame:
    """Cut lines into segments, add up identical ones, then merge nearly equal ones."""
    parts = explode_segments(lines).groupBy(*SEGMENT).agg(F.sum(freq).alias(freq))
    numbered = segment_coords(checkpoint(dense_ids(checkpoint(parts), SEGMENT, "id", F.lit(0))))
    return merge_equal_edges(numbered, "id", freq, "coords", cap, decimal, SEGMENT)
