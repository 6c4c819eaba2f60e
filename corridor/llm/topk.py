"""Exact top-k inner products over a bit-sliced index.

``quantise`` turns vectors into whole numbers. ``build_index`` cuts the rows into
blocks, sorted by id inside, and stores each component of a block as bit slices:
slice ``b`` of a component is a bitmap with the ``b``-th bit of that component of
every row (two's complement). ``search`` answers queries from the slices alone.
The score of all rows of a block is the sum of the slices, each shifted by a set bit
of the query's component; the bitmaps are added column by column with carry-save
adders (exclusive or, and, or), so a block is added 64 rows at a time whatever the
query. The rows with the highest scores are then picked from the most significant
slice of the sum downward. Rows that are still equal after the last slice are the
boundary: all of them have the same score, and since a block is sorted by id the
first ones of that bitmap are the ones with the smallest ids.

Queries meet the blocks in chunks: every chunk is sent to every block once, and
a pair gives at most ``k`` rows per query, so nothing is compared row by row. The
winners of the blocks are ranked by a window whose limit Spark applies before its
shuffle, so a task passes on ``k`` rows per query.

Defined cases: a vector that is null or empty, or that holds null or non-finite
components, takes no part. Components beyond the range of a long become its ends, and
so do scores. A vector shorter than another counts as filled with zeros. A row
without an id is a candidate (its id is null and ranks last among ties) and no
query. Rows with one id are rows of their own: each is a query and a candidate of
the others. A query with no other row has no result. Columns other than the id and
the vector are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.operators.frames import dense_ids
from corridor.scratch import stored

SCALE = 256
K = 5
#: Rows of a block and the components it may hold in all (16 MB of numbers before they are cut to slices).
BLOCK_ROWS = 1 << 15
BLOCK_CELLS = 1 << 21
#: Components of a chunk of queries, and words (64 rows each) that are added at a time.
CHUNK_CELLS = 1 << 14
STRIPE_WORDS = 1 << 12
#: Bounds of the grid: groups of blocks, chunks in a group, tasks.
PARTS = 1024
GROUP_CHUNKS = 64
MOST_TASKS = 8192
LONG = (-(2**63), 2**63 - 1)
INDEX = "block bigint, n int, width int, bits int, rows binary, ids binary, known binary, slices binary"
FOUND = "query_row bigint, query_id bigint, score bigint, vec_id bigint, known boolean"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as a long array; null if a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, whole)


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, x)``: a number for each row that takes part, its id and its whole components. Stored once."""
    picked = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col), scale).alias("x"))
    kept = picked.where(F.col("x").isNotNull())
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "topk-rows")


def filled(vectors: list, width: int) -> np.ndarray:
    """The vectors as rows of a matrix, short ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for at, x in enumerate(vectors):
        out[at, : len(x)] = x
    return out


def _width(numbers: np.ndarray) -> int:
    """Bits that hold all the numbers in two's complement."""
    if not numbers.size:
        return 1
    return 1 + max(int(numbers.max()).bit_length(), (~int(numbers.min())).bit_length() if numbers.min() < 0 else 0)


def slices_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """``(components, bits, words)``: bitmaps of the bits of each column of ``numbers``."""
    n, width = numbers.shape
    words = -(-n // 64)
    out = np.zeros((width, bits, words * 8), np.uint8)
    for b in range(bits):
        out[:, b, : -(-n // 8)] = np.packbits(((numbers >> b) & 1).astype(bool).T, axis=1, bitorder="little")
    return out.view(np.uint64)


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The rows as blocks of bit slices, stored. A block is cut from the rows of one input partition."""

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["known", "vec_id", "row"], ascending=[False, True, True])
        numbers = filled(list(frame["x"]), max(map(len, frame["x"])))
        bits = _width(numbers)
        return pd.DataFrame({
            "block": [int(frame["row"].min())], "n": [len(frame)], "width": [numbers.shape[1]], "bits": [bits],
            "rows": [frame["row"].to_numpy(np.int64).tobytes()], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
            "known": [frame["known"].to_numpy(bool).tobytes()], "slices": [slices_of(numbers, bits).tobytes()],
        })

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, cells = [], 0, 0
        for frame in frames:
            start = 0
            for at, size in enumerate(map(len, frame["x"])):
                if n and (n >= block_rows or cells + size > block_cells):
                    yield block(pd.concat([*held, frame.iloc[start:at]]))
                    held, n, cells, start = [], 0, 0, at
                n, cells = n + 1, cells + size
            held.append(frame.iloc[start:])
        if n:
            yield block(pd.concat(held))

    # a null id would turn a batch of ids into floats
    safe = rows.select("row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), "x")
    return stored(safe.mapInPandas(each, INDEX), "topk-index")


def add_bitmap(columns: list[list[np.ndarray]], weight: int, bitmap: np.ndarray) -> None:
    """Add ``2**weight`` times a bitmap to a sum kept as one or two bitmaps per weight; the bitmap is used up.

    A third bitmap of a weight makes a carry-save addition: one bitmap stays and one
    is carried to the next weight. Carries out of the last weight are dropped.
    """
    while weight < len(columns):
        column = columns[weight]
        column.append(bitmap)
        if len(column) < 3:
            return
        a, b, c = column
        ab = a ^ b
        columns[weight] = [ab ^ c]
        a &= b
        c &= ab
        a |= c
        weight, bitmap = weight + 1, a


def settled(columns: list[list[np.ndarray]], empty: np.ndarray) -> list[np.ndarray]:
    """The bits of the sum, least first: the last carries ripple through."""
    out, carry = [], empty
    for column in columns:
        a, b = [*column, empty, empty][:2]
        ab = a ^ b
        out.append(ab ^ carry)
        carry = (a & b) | (ab & carry)
    return out


def score_slices(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Bits of ``2**(T-1) + score`` for every query and row, least first; each is ``(queries, words)``.

    A product with the sign bit of one side counts negative: its complement is added
    instead, and the constants that this leaves are added once, as whole bitmaps.
    """
    width, bits, words = slices.shape
    q_bits = _width(queries)
    total = bits + q_bits + max(width - 1, 1).bit_length() + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(total)]
    constant = 1 << (total - 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(width):
        for b in range(q_bits):
            mask = np.where((queries[:, j] >> b) & 1, full, np.uint64(0))[:, None]
            if not mask.any():
                continue
            for a in range(bits):
                part = mask & slices[j, a]
                if (a == bits - 1) != (b == q_bits - 1):
                    np.invert(part, out=part)
                    constant -= 1 << (a + b)
                add_bitmap(columns, a + b, part)
    for w in range(total):
        if constant >> w & 1:
            add_bitmap(columns, w, np.full((len(queries), words), full))
    return settled(columns, np.zeros((len(queries), words), np.uint64))


def top_rows(scores: list[np.ndarray], open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, boundary) bitmaps per query: fewer than ``k`` rows that surely belong to the top, and equal rows that fill it up."""
    sure = np.zeros_like(open_)
    count = lambda bitmap: np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
    for slice_ in reversed(scores):
        ones = open_ & slice_
        many = (count(sure) + count(ones) >= k)[:, None]
        sure = np.where(many, sure, sure | ones)
        open_ = np.where(many, ones, open_ & ~slice_)
    return sure, open_


def _positions(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` set positions."""
    found: list[np.ndarray] = []
    n = 0
    for at in np.flatnonzero(bitmap):
        bits = np.flatnonzero(np.unpackbits(bitmap[at : at + 1].view(np.uint8), bitorder="little")) + 64 * at
        found.append(bits)
        n += len(bits)
        if n >= most:
            break
    return np.concatenate(found)[:most] if found else np.empty(0, np.int64)


def search_block(block: dict, query_rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """At most ``k`` rows of one block for each query, its own row left out."""
    n, width = int(block["n"]), int(block["width"])
    slices = np.frombuffer(block["slices"], np.uint64).reshape(width, int(block["bits"]), -1)
    rows, ids = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64)
    known = np.frombuffer(block["known"], bool)
    words = slices.shape[2]
    every = np.zeros(words * 8, np.uint8)
    every[: -(-n // 8)] = np.packbits(np.ones(n, bool), bitorder="little")
    order = np.argsort(rows, kind="stable")
    side = np.zeros((len(queries), width), np.int64)
    side[:, : min(width, queries.shape[1])] = queries[:, :width]
    out: list[tuple] = []
    step = max(1, STRIPE_WORDS // words)
    for start in range(0, len(queries), step):
        part = slice(start, min(start + step, len(queries)))
        scores = score_slices(slices, side[part])
        open_ = np.tile(every.view(np.uint64), (part.stop - part.start, 1))
        spots = np.minimum(np.searchsorted(rows, query_rows[part], sorter=order), n - 1)
        for q, spot in enumerate(order[spots]):
            if rows[spot] == query_rows[start + q]:
                open_[q, spot // 64] &= ~(np.uint64(1) << np.uint64(spot % 64))
        sure, boundary = top_rows(scores, open_, k)
        for q in range(part.stop - part.start):
            at = _positions(sure[q], k)
            at = np.concatenate([at, _positions(boundary[q], k - len(at))]).astype(np.int64)
            bits = [(s[q, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) for s in scores]
            for i, spot in enumerate(at):
                score = sum(int(b[i]) << w for w, b in enumerate(bits)) - (1 << (len(scores) - 1))
                score = min(max(score, LONG[0]), LONG[1])
                out.append((int(query_rows[start + q]), int(query_ids[start + q]), score, int(ids[spot]), bool(known[spot])))
    frame = pd.DataFrame(out, columns=["query_row", "query_id", "score", "vec_id", "known"])
    return frame.astype({"query_row": "int64", "query_id": "int64", "score": "int64", "vec_id": "int64", "known": "bool"})


def search(index: DataFrame, queries: DataFrame, k: int = K, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """``(query_row, query_id, rank, vec_id, score)``: each query's ``k`` highest scores, ties to the smaller id.

    ``queries`` are rows ``(row, vec_id, x)`` as ``quantise`` gives them, with an id.
    Blocks and chunks of queries form a grid; a cell of it is the work of one task.
    """
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            step = max(1, chunk_cells // max(map(len, frame["x"]), default=1))
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step]
                x = filled(list(part["x"]), max(map(len, part["x"])))
                yield pd.DataFrame({
                    "chunk": [int(part["row"].min())], "q_width": [x.shape[1]], "q_rows": [part["row"].to_numpy(np.int64).tobytes()],
                    "q_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "q_x": [x.tobytes()],
                })

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.to_dict("records"):
                rows, ids = np.frombuffer(pair["q_rows"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
                x = np.frombuffer(pair["q_x"], np.int64).reshape(len(rows), int(pair["q_width"]))
                yield search_block(pair, rows, ids, x, k)

    cells = queries.agg(F.sum(F.size("x"))).first()[0] or 0
    picked = queries.select("row", "vec_id", "x").repartition(max(1, round(cells / chunk_cells)))
    packed = stored(picked.mapInPandas(chunks, "chunk bigint, q_width int, q_rows binary, q_ids binary, q_x binary"), "topk-queries")
    blocks, n_chunks = index.count(), packed.count()
    cores = index.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(blocks, PARTS))
    groups = max(1, min(n_chunks, max(-(-n_chunks // GROUP_CHUNKS), -(-4 * cores // parts))))

    def numbered(df: DataFrame, key: str, modulus: int, name: str) -> DataFrame:
        numbers = dense_ids(df.select(key), [key], name, F.lit(0)).withColumn(name, (F.col(name) % modulus).cast("int"))
        return df.join(numbers, key)

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    cell = (F.col("part") * groups + F.col("group")).alias("cell")
    tasks = min(parts * groups, MOST_TASKS)
    placed = numbered(index, "block", parts, "part").select("*", every(groups, "group")).withColumn("cell", cell)
    asked = numbered(packed, "chunk", groups, "group").select("*", every(parts, "part")).withColumn("cell", cell)
    pairs = placed.drop("part", "group", "block").repartition(tasks, "cell").join(asked.drop("part", "group", "chunk").repartition(tasks, "cell"), "cell")
    found = pairs.drop("cell").mapInPandas(each, FOUND).withColumn("vec_id", F.when(F.col("known"), F.col("vec_id")))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows whose id is divisible by ``every`` against all rows but themselves."""
    rows = quantise(vectors, id_col, vector_col)
    return search(build_index(rows), rows.where(F.col("vec_id") % every == 0), k)
