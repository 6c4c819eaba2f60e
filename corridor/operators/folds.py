"""User functions per group, for groups of any size: a state that pieces of a group build and that is merged in a tree.

A function that needs a whole group at once (``applyInPandas``) ends with the largest
group in one task. A ``Fold`` works on pieces instead: every task folds the rows
it has into a state per group, without a shuffle, and only states are shuffled. A
group that holds most rows is then as many states as there were tasks, and these are
merged a bounded number at a time, level by level. Rows are never gathered.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 64
HELD_GROUPS = 10_000
STATES = "_group string, _piece bigint, _state binary"
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


@dataclass(frozen=True)
class Fold:
    """``start() -> state``, ``add(state, rows) -> state``, ``merge(state, state) -> state``, ``finish(state) -> values``.

    ``add`` gets any part of a group's rows as a pandas frame, in no order; ``merge``
    must not depend on the order of its arguments. ``finish`` returns the result columns
    as a tuple. A state is pickled, and its size should not grow with the rows.
    """

    start: Callable[[], Any]
    add: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]


def apply_by_group(df: DataFrame, keys: list[str], fold: Fold, schema: str, fan: int = FAN, held: int = HELD_GROUPS) -> DataFrame:
    """One row per group: its keys and what ``fold`` finishes with, as ``schema``. Null keys are a group.

    A task holds at most ``held`` states and passes them on when there are more. A
    merge task reads its states one after the other.
    """
    values = [c for c in df.columns if c not in keys]
    kind = T.StructType([df.schema[k] for k in keys])
    named = df.select(F.to_json(F.struct(*keys), EXACT_TIMES).alias("_group"), *values, F.spark_partition_id().cast("long").alias("_piece"))
    start, add, merge, finish = fold.start, fold.add, fold.merge, fold.finish

    def rows_of(states: dict, piece: int) -> pd.DataFrame:
        return pd.DataFrame({"_group": list(states), "_piece": piece, "_state": [pickle.dumps(s) for s in states.values()]})

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        piece = 0
        for frame in frames:
            if not len(frame):
                continue
            piece = int(frame["_piece"].iloc[0])
            for group, rows in frame.groupby("_group", sort=False):
                state = states[group] if group in states else start()
                states[group] = add(state, rows.drop(columns=["_group", "_piece"]))
            if len(states) > held:
                yield rows_of(states, piece)
                states = {}
        if states:
            yield rows_of(states, piece)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            out = []
            for group, piece, packed in zip(frame["_group"], frame["_piece"], frame["_state"]):
                if at == (group, piece):
                    state = merge(state, pickle.loads(packed))
                    continue
                if at is not None:
                    out.append((*at, pickle.dumps(state)))
                at, state = (group, piece), pickle.loads(packed)
            yield pd.DataFrame(out, columns=["_group", "_piece", "_state"])
        if at is not None:
            yield pd.DataFrame([(*at, pickle.dumps(state))], columns=["_group", "_piece", "_state"])

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(g, *finish(pickle.loads(s))) for g, s in zip(frame["_group"], frame["_state"])]
            yield pd.DataFrame(found, columns=["_group", *names])

    names = [f.name for f in T._parse_datatype_string(schema).fields]
    states = named.mapInPandas(gather, STATES)
    pieces = df.rdd.getNumPartitions()
    for _ in range(max(1, math.ceil(math.log(max(pieces, 2), fan)))):
        higher = states.withColumn("_piece", F.floor(F.col("_piece") / fan))
        states = higher.repartition("_group", "_piece").sortWithinPartitions("_group", "_piece").mapInPandas(merged, STATES)
    done = states.mapInPandas(finished, f"_group string, {schema}")
    return done.select(F.from_json("_group", kind, EXACT_TIMES).alias("_k"), *names).select("_k.*", *names)


def regression(x: str, y: str) -> Fold:
    """Least-squares line of ``y`` on ``x``: ``(n, slope, intercept, r2)``; rows with a null or NaN do not count.

    The state holds count, means and centred sums of squares and products, which are
    merged without cancellation. Without spread in ``x`` slope and intercept are null,
    without spread in ``y`` r2 is.
    """
    def add(state: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        pair = rows[[x, y]].astype(float).dropna().to_numpy()
        if not len(pair):
            return state
        mean = pair.mean(axis=0)
        dx, dy = (pair - mean).T
        return merge(state, np.array([len(pair), *mean, dx @ dx, dx @ dy, dy @ dy]))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        if not n:
            return a
        share = a[0] * b[0] / n
        dx, dy = b[1:3] - a[1:3]
        means = (a[1:3] * a[0] + b[1:3] * b[0]) / n
        return np.array([n, *means, a[3] + b[3] + dx * dx * share, a[4] + b[4] + dx * dy * share, a[5] + b[5] + dy * dy * share])

    def finish(s: np.ndarray) -> tuple:
        if not s[3]:
            return int(s[0]), None, None, None
        slope = s[4] / s[3]
        return int(s[0]), slope, s[2] - slope * s[1], s[4] * s[4] / (s[3] * s[5]) if s[5] else None

    return Fold(lambda: np.zeros(6), add, merge, finish)
