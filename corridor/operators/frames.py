"""General frame operators: composition, group statistics, set and key operations.

Group statistics are aggregated first (partial aggregates collapse a hot group on
the map side) and then joined back with ``join_unique``, so no task ever holds
all rows of one group the way a whole-partition window would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.functions.numbers import to_int
from corridor.scratch import checkpoint, is_small

SMALL_SIDE = 100_000
HOT_SHARE = 1000


def compose(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply frame-to-frame functions in order."""
    return reduce(lambda frame, step: frame.transform(step), steps, df)


def join_unique(
    df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
    counts: DataFrame | None = None, small: int = SMALL_SIDE,
) -> DataFrame:
    """Join rows with a narrow ``side`` that has one row per key; hot keys are not shuffled.

    A side of up to ``small`` rows (counted) goes to every task. Beyond that, the
    keys that hold more than a thousandth of the repeated rows (fewer than a
    thousand, whatever the data) meet their side rows by broadcast, and only the
    other rows are shuffled. ``counts`` gives the rows per key as ``_n`` if known.
    Rows with a null key meet nothing, however many there are, so they are never
    shuffled: a left join adds them as they are, an inner join drops them first.
    """
    if is_small(side, small):
        return df.join(F.broadcast(side), keys, how)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name not in keys]
        loose = df.where(~known).select(*keys, *[c for c in df.columns if c not in keys], *empty)
        return _join_known(df.where(known), side, keys, how, counts).unionByName(loose)
    return _join_known(df.where(known), side, keys, how, counts)


def _join_known(df: DataFrame, side: DataFrame, keys: list[str], how: str, counts: DataFrame | None) -> DataFrame:
    """``join_unique`` for rows without a null key and a large side."""
    if counts is None:
        counts = checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") * HOT_SHARE > total).select(*keys))
    met = df.join(hot, keys, "left_semi").join(F.broadcast(side.join(hot, keys, "left_semi")), keys, how)
    return met.unionByName(df.join(hot, keys, "left_anti").join(side, keys, how))


def join_small(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", small: int = SMALL_SIDE) -> DataFrame:
    """Join with a dimension table: broadcast if counted small, else left to Spark."""
    return df.join(F.broadcast(side) if is_small(side, small) else side, keys, how)


def with_group_stats(df: DataFrame, keys: list[str], how: str = "inner", **stats: Column) -> DataFrame:
    """Add per-group aggregates to the rows; with an inner join rows with a null key vanish.

    The aggregate is checkpointed, so that it is computed once and its size known.
    """
    measures = [value.alias(name) for name, value in stats.items()]
    summary = checkpoint(df.groupBy(*keys).agg(*measures, F.count(F.lit(1)).alias("_n")))
    return join_unique(df, summary.drop("_n"), keys, how, summary.select(*keys, "_n"))


def cast_ints(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast columns to int; text that is no number becomes null."""
    return df.withColumns({c: to_int(F.col(c)) for c in columns})


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type their observed range allows.

    One aggregation reads every column's range; only that single row reaches the
    driver. Bounds are exclusive, and doubles go to float only within its range.
    """
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    reals = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if not ints + reals:
        return df
    ranges = df.agg(
        *[F.min(c).alias(f"{c}__low") for c in ints + reals],
        *[F.max(c).alias(f"{c}__high") for c in ints + reals],
    ).first().asDict()

    def target(name: str) -> str | None:
        low, high = ranges[f"{name}__low"], ranges[f"{name}__high"]
        if low is None:
            return None
        if name in reals:
            limit = 3.4028234663852886e38
            return "float" if -limit < low and high < limit else None
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(2**bits) < low and high < 2**bits - 1:
                return kind
        return None

    casts = {c: F.col(c).cast(kind) for c in ints + reals if (kind := target(c))}
    return df.withColumns(casts) if casts else df


def positional_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join sibling files on their row position, adding only the missing columns.

    Siblings have a row for every row of the other, so neither goes to every task: a
    few columns of a wide, well compressed file look small to the planner at any size.
    """
    missing = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *missing).hint("merge"), keys, "inner")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], theirs: bool = False) -> DataFrame:
    """``positional_join`` that raises if the siblings disagree as ``consistency`` would report it; joined once and stored.

    Columns of both, ``columns`` among them, are those of ``left``, or with ``theirs`` of ``right``.
    """
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    a = left.withColumnsRenamed({c: f"{c}_l" for c in shared}).withColumn("in_l", F.lit(1))
    b = right.withColumnsRenamed({c: f"{c}_r" for c in shared}).withColumn("in_r", F.lit(1))
    joined = checkpoint(a.join(b, keys, "full"))
    assert_consistent(_differences(joined, columns))
    mine, other = ("_r", "_l") if theirs else ("_l", "_r")
    kept = joined.drop("in_l", "in_r", *[c + other for c in shared])
    return kept.withColumnsRenamed({c + mine: c for c in shared})


def consistency(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: row counts of two sibling frames, unmatched rows, differing values.

    Values are compared row by row, so differences of opposite sign cannot cancel.
    """
    a = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in columns], F.lit(1).alias("in_l"))
    b = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in columns], F.lit(1).alias("in_r"))
    return _differences(a.join(b, keys, "full"), columns)


def _differences(joined: DataFrame, columns: list[str]) -> DataFrame:
    """The report of ``consistency`` on a full join with columns ``_l`` and ``_r`` and marks ``in_l`` and ``in_r``."""
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    differs = [
        F.count_if(both & ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))).alias(f"{c}_differs")
        for c in columns
    ]
    return joined.agg(
        F.count("in_l").alias("rows_left"),
        F.count("in_r").alias("rows_right"),
        F.count_if(~both).alias("rows_unmatched"),
        *differs,
    )


def assert_consistent(check: DataFrame) -> None:
    """Raise if a ``consistency`` frame reports any difference."""
    row = check.first().asDict()
    bad = {k: v for k, v in row.items() if (k.endswith("_differs") or k == "rows_unmatched") and v}
    if row["rows_left"] != row["rows_right"] or bad:
        raise ValueError(f"sibling files do not agree: {row}")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the frames hold in different numbers, with ``surplus`` = copies in ``a`` - copies in ``b``.

    One aggregation over both; copies are counted and not repeated, so a row with
    very many copies costs no more than any other.
    """
    columns = a.columns
    signed = a.withColumn("_sign", F.lit(1)).unionByName(b.withColumn("_sign", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("surplus")).where("surplus <> 0")


def only_once(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur exactly once in both frames together."""
    both = a.unionByName(b)
    return both.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def semi_distinct(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Distinct rows whose key occurs in ``keys``; rows of a hot key are not shuffled by it."""
    wanted = checkpoint(keys.select(*on).dropna().distinct())
    return join_unique(df, wanted, on).select(*df.columns).distinct()


def without_seen(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(seen.select(*on).distinct(), on, "left_anti")


def dense_ids(df: DataFrame, keys: list[str], name: str, start: Column, buckets: int = 4096) -> DataFrame:
    """Number distinct-key rows densely from ``start`` without a global sort.

    Rows are hashed to buckets, numbered inside them, and shifted by the bucket
    counts before; the only unpartitioned window runs over the bucket counts.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    hashed = df.withColumn("_bucket", bucket)
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return (
        hashed.withColumn("_rank", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (start + F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_bucket", "_rank", "_offset")
    )


def previous_in_group(
    df: DataFrame, keys: list[str], position: str, tie: str, value: str, name: str, block: int = 65536
) -> DataFrame:
    """``lag(value)`` along an integer position, for groups of any size.

    A group is cut into position blocks; inside a block a window finds the
    previous row, and the first row of a block takes the last value of the block
    before, found on one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position, tie)
    marked = blocked.withColumn("_lag", F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = blocked.groupBy(*keys, "_block").agg(
        F.max_by(value, F.struct(position, tie)).alias("_last")
    )
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
    return (
        marked.join(carried.select(*keys, "_block", "_carry"), [*keys, "_block"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_block", "_lag", "_first", "_carry")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, probabilities: list[float], margin: float = 0.002
) -> DataFrame:
    """Interpolated quantiles per group, exact for groups of any size.

    Approximate quantiles (bounded sketches) a ``margin`` before and after each
    probability cut a group into ranges. Exact counts give every range its offset,
    so only the rows of the narrow ranges that hold a wanted rank are shuffled and
    sorted. A poor sketch makes a wider range, never a wrong result. Equal values
    collapse into counts.
    """
    edges = sorted({min(max(p + side, 0.0), 1.0) for p in probabilities for side in (-margin, margin)})
    known = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    cutting = with_group_stats(
        known, keys, _cuts=F.percentile_approx("_v", edges, 10_000), _total=F.count(F.lit(1))
    )
    below = sum(((F.col("_cuts")[i] < F.col("_v")).cast("int") for i in range(len(edges))), F.lit(0))
    ranged = cutting.withColumn("_range", below).drop("_cuts")
    weights = checkpoint(
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_w"), F.max("_total").alias("_total"))
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = weights.withColumn("_offset", F.coalesce(F.sum("_w").over(before), F.lit(0)))

    def target(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = F.lit(False)
    for p in probabilities:
        for at in (F.floor(target(p)), F.ceil(target(p))):
            wanted = wanted | ((F.col("_offset") <= at) & (at < F.col("_offset") + F.col("_w")))
    chosen = checkpoint(placed.where(wanted).select(*keys, "_range", "_offset"))
    values = (
        join_unique(ranged, chosen, [*keys, "_range"])
        .groupBy(*keys, "_range", "_offset", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    running = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_to", F.col("_offset") + F.sum("_n").over(running)).withColumn(
        "_from", F.col("_to") - F.col("_n")
    )
    picks = []
    for i, p in enumerate(probabilities):
        rank = target(p)
        for side, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            hit = (F.col("_from") <= at) & (at < F.col("_to"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_frac{i}"))
    found = ranked.groupBy(*keys).agg(*picks, F.max("_total").alias("n"))
    quantiles = [
        (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_frac{i}")).alias(f"q{round(p * 100)}")
        for i, p in enumerate(probabilities)
    ]
    return found.select(*keys, "n", *quantiles)


def apply_in_pieces(df: DataFrame, fn, schema: str) -> DataFrame:
    """Run a pandas function over pieces of the frame on the executors.

    A piece is one Arrow batch of whatever partition the rows are in: no shuffle,
    no group to collect, bounded memory. ``fn`` must work on any subset of rows,
    as the per-row geometry jobs this serves do.
    """
    def each(frames):
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(each, schema)
