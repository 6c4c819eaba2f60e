"""Embedding whitening by Chebyshev-filtered subspace iteration.

``fit`` finds the leading eigenvectors of the covariance of all distinct whole
vectors without forming the covariance: every step is one distributed pass that
turns a narrow block of directions ``Q`` into the centred product ``XᵀXQ / n``. A
task multiplies its rows batch by batch and passes on one small matrix; Spark adds
the matrices up. A polynomial of the covariance is applied to the block by the
Chebyshev recurrence, a pass per degree: it stays small on the unwanted spectrum
(from zero to the smallest Ritz value of the block) and grows fast above it. QR and
Rayleigh-Ritz turn the block into approximate eigenvectors, whose residuals are known
from the same pass. When the wanted residuals are at rounding level, all other
directions of the block are drawn anew and filtered once more; only if no larger
eigenvalue turns up then, the components are certified.

``whiten`` projects the centred rows and divides by the roots of the eigenvalues.

Defined cases: a vector that is null or empty, or that holds null or non-finite
components, is dropped. Components beyond the range of a long become its ends. A
vector shorter than another counts as filled with zeros. A component whose variance
is zero, or no more than rounding beside the total, has a null ``whitened`` value and
its true share of zero; where no component has variance, ``identity_error`` is null.
Rows are told apart before they are filled. Repeated rows each have their rows in the result, but count once in the fit. A
``deviation`` that no long can hold is null. Null and repeated ids are kept as they are.
Columns other than the id and the vector are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.topk import LONG, filled, quantised
from corridor.scratch import stored

COMPONENTS = 4
GUARDS = 8
DEGREE = 10
MOST_ROUNDS = 200
TOLERANCE = 1e-13
#: A component with less than this share of the variance counts as none.
ROUNDING = 1e-13
BATCH_CELLS = 1 << 20
EXACT = 2.0**62


@dataclass
class Fit:
    """What ``fit`` learns: rows, exact sums, mean, eigenvalues and vectors (as columns), share of the variance, the packed rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    rounds: int
    blocks: DataFrame | None


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part, stored once."""
    picked = vectors.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    return stored(picked.where(F.col("x").isNotNull()), "whiten-rows")


def _batches(frame: pd.DataFrame, width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, BATCH_CELLS // width)
    for at in range(0, len(frame), step):
        part = frame.iloc[at : at + step]
        yield part, filled(list(part["x"]), width)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """The vectors as blocks of a few MB, stored: the passes read them without decoding lists again and again."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, x in _batches(frame, width):
                yield pd.DataFrame({"x": [x.tobytes()]})

    return stored(rows.select("x").mapInPandas(each, "x binary"), "whiten-blocks")


def _blocks(frame: pd.DataFrame, width: int) -> Iterator[np.ndarray]:
    for block in frame["x"]:
        yield np.frombuffer(block, np.int64).reshape(-1, width)


def _added(df: DataFrame, task, rows: int, columns: int) -> np.ndarray:
    """The sum over all batches of ``task(batch) -> matrix``: each task adds its own up, Spark adds the tasks'."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            part = task(frame)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(rows, dtype=np.int32), **{f"c{j}": total[:, j] for j in range(columns)}})

    names = [f"c{j}" for j in range(columns)]
    parts = df.mapInPandas(each, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((rows, columns))
    for row in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per dimension
        out[row["i"]] = row[1:]
    return out


def _moments(fit_rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of every dimension; a short vector adds nothing to the last ones."""
    parts = fit_rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = {row["i"]: int(row["s"]) for row in parts.collect()}  # one row per dimension
    return fit_rows.count(), [sums[i] for i in range(len(sums))]


def _product(blocks: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """``XᵀX block / n`` with the rows of X centred before they are multiplied."""
    width = len(mean)

    def task(frame: pd.DataFrame) -> np.ndarray:
        total = np.zeros(block.shape)
        for x in _blocks(frame, width):
            centred = x - mean
            total += centred.T @ (centred @ block)
        return total

    return _added(blocks, task, *block.shape) / n


def _total_variance(blocks: DataFrame, mean: np.ndarray, n: int) -> float:
    width = len(mean)

    def task(frame: pd.DataFrame) -> np.ndarray:
        return np.array([[sum(float(((x - mean) ** 2).sum()) for x in _blocks(frame, width))]])

    return float(_added(blocks, task, 1, 1)[0, 0]) / n


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, their products, residuals) of the block, highest value first."""
    small = q.T @ vq
    values, u = np.linalg.eigh((small + small.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    x, vx = q @ u, vq @ u
    return values, x, vx, np.linalg.norm(vx - x * values, axis=0)


def fit(fit_rows: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, seed: int = 7) -> Fit:
    """Leading eigenvectors of the covariance of ``fit_rows`` (column ``x``), certified; raises if they can't be."""
    n, sums = _moments(fit_rows)
    width = len(sums)
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0, None)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    k = min(components, width)
    m = min(width, components + guards)
    blocks = packed(fit_rows, width)
    trace = _total_variance(blocks, mean, n)
    draw = np.random.default_rng(seed)
    apply = lambda b: _product(blocks, mean, n, b)
    q = np.linalg.qr(draw.standard_normal((width, m)))[0]
    values, x, vx, residual = _ritz(q, apply(q))
    fresh = False
    for rounds in range(MOST_ROUNDS):
        small = bool((residual[:k] <= TOLERANCE * max(values[0], 0.0)).all())
        if small and (fresh or m == width or not trace):  # with as many directions as dimensions none can hide
            shares = np.maximum(values[:k], 0.0) / trace if trace else np.zeros(k)
            return Fit(n, sums, mean, values[:k], x[:, :k], shares, rounds, blocks)
        fresh = small
        start, v_start = x, vx
        low = max(values[-1], values[0] * 1e-6)  # the spectrum below is damped
        if small:
            new = draw.standard_normal((width, m - k))
            new -= x[:, :k] @ (x[:, :k].T @ new)
            start = np.hstack([x[:, :k], np.linalg.qr(new)[0]])
            v_start = apply(start)
        half = low / 2
        sigma = first = half / (values[0] - half)
        before, now = start, (v_start - half * start) * (sigma / half)
        for _ in range(degree - 1):
            following = 1 / (2 / first - sigma)
            before, now = now, (apply(now) - half * now) * (2 * following / half) - before * (sigma * following)
            sigma = following
        q = np.linalg.qr(now)[0]
        values, x, vx, residual = _ritz(q, apply(q))
    raise ArithmeticError(f"components not certified after {MOST_ROUNDS} rounds: residuals {residual[:k]}, value {values[0]}")


def _scales(found: Fit) -> np.ndarray:
    """One over the root of each eigenvalue; not a number where there is no variance."""
    real = found.explained > ROUNDING
    return np.where(real, 1 / np.sqrt(np.where(real, found.values, 1.0)), np.nan)


def identity_error(found: Fit) -> float | None:
    """Largest absolute entry of the whitened fit rows' covariance minus the identity, over the components with variance."""
    real = np.flatnonzero(~np.isnan(_scales(found)))
    if not len(real):
        return None
    width, mean = len(found.mean), found.mean
    turn = found.vectors[:, real] * _scales(found)[real]

    def sums(frame: pd.DataFrame) -> np.ndarray:
        return sum(((x - mean) @ turn).sum(axis=0)[:, None] for x in _blocks(frame, width))

    centre = (_added(found.blocks, sums, len(real), 1) / found.n)[:, 0]

    def products(frame: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(real), len(real)))
        for x in _blocks(frame, width):
            w = (x - mean) @ turn - centre
            total += w.T @ w
        return total

    covariance = _added(found.blocks, products, len(real), len(real)) / found.n
    return float(np.abs(covariance - np.eye(len(real))).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - sums) ** 2)`` of every row, exact; by Python's integers where longs could overflow."""
    most = float(n) * float(np.abs(x.astype(float)).max(initial=0)) + float(max(map(abs, sums)))
    if most * most * len(sums) < EXACT:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= LONG[1] else None for v in exact]


def project(rows: DataFrame, found: Fit) -> DataFrame:
    """``(vec_id, component, deviation, whitened, explained)``: a row for each row and component."""
    width, mean, scales = len(found.mean), found.mean, _scales(found)
    k, turn, n, sums = len(scales), found.vectors * np.nan_to_num(scales), found.n, found.sums
    if not width:
        return rows.selectExpr("vec_id", "0 as component", "0L as deviation", "0D as whitened", "0D as explained").limit(0)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, x in _batches(frame, width):
                whitened = (x - mean) @ turn
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy(), "deviation": pd.array(_deviations(x, n, sums), dtype="Int64"),
                    "whitened": list(whitened),
                })

    kind = rows.schema["vec_id"].dataType.simpleString()
    # as text, since pandas would turn ids beside a null into floats
    done = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(each, "vec_id string, deviation bigint, whitened array<double>")
    shares = F.array(*[F.lit(float(e)) for e in found.explained])
    real = F.array(*[F.lit(not np.isnan(s)) for s in scales])
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.struct((i + 1).alias("component"), F.when(real[i], F.col("whitened")[i]).alias("whitened"), shares[i].alias("explained")),
    )
    return done.select(F.col("vec_id").cast(kind), "deviation", F.inline(parts)).select("vec_id", "component", "deviation", "whitened", "explained")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The projection of all rows with ``n`` and ``identity_error`` of the fit."""
    rows = whole_vectors(vectors, id_col, vector_col)
    fit_rows = stored(rows.select("x").distinct(), "whiten-fit")
    found = fit(fit_rows, components)
    error = identity_error(found) if found.n else None
    done = project(rows, found).withColumns({"n": F.lit(found.n).cast("bigint"), "identity_error": F.lit(error).cast("double")})
    return done.select(F.col("vec_id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
