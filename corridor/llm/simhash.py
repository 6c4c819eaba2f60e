"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

``fingerprints`` gives every text 64 bits. ``near_components`` links fingerprints
that differ in at most ``radius`` bits and names the connected components.

Two fingerprints within the radius of 3 differ in at most one bit in one of their
32-bit halves (in general: in one of ``radius // 2 + 1`` blocks). So each
fingerprint emits, for every block, all variants of that block within half the
radius, rounded down: one bit. One side of a pair may stay in the middle: blocks
with an odd number of set bits emit their whole ball and even ones only
themselves, and blocks one bit apart always are one odd and one even. Variants
meet in a shuffle; the colliding fingerprints are verified on all 64 bits.

A bucket that holds many fingerprints is cut further, by the variants of the
blocks of the remaining bits, which loses no pair. Inside a bucket only a
spanning forest of the links is emitted, never all pairs, and equal fingerprints
are one row from the start, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import in_pieces
from corridor.operators.frames import join_small, join_unique
from corridor.operators.graph import components
from corridor.scratch import stored

SEED = 42
RADIUS = 3
SHINGLE = 3
CROWD = 512
BITS = 64


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text's word shingles, as a signed 64-bit integer; 0 without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        grams = [joined]
    else:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        grams = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row. Letters A-Z are lower-cased; a null or blank text has fingerprint 0.

    The text goes to Python once, as UTF-8 bytes, whole and without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(frames):
        for frame in frames:
            for part in in_pieces(frame, "text", 1 << 26):
                yield pd.DataFrame({"id": part["id"], "fp": np.array([simhash(t, shingle) for t in part["text"]], np.int64)})

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return picked.mapInPandas(each, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def _blocks(bits: int, radius: int) -> list[tuple[int, int]]:
    """(offset, width) of ``radius // 2 + 1`` blocks; within the radius, one of them differs in a bit at most."""
    n = radius // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _ball(value: str, width: int) -> str:
    """The block and, if it has an odd number of set bits, all blocks one bit away."""
    ring = f"transform(sequence(0, {width - 1}), i -> {value} ^ shiftleft(1L, i))"
    return f"if(bit_count({value}) % 2 = 1, concat(array({value}), {ring}), array({value}))"


def _variants(bits: str, total: int, radius: int, name: str) -> Column:
    """One struct ``(block, value)`` for each variant of each block."""
    parts = []
    for n, (offset, width) in enumerate(_blocks(total, radius)):
        mask = (1 << width) - 1 if width < 64 else -1
        value = f"(shiftrightunsigned({bits}, {offset}) & {mask}L)"
        parts.append(f"transform({_ball(value, width)}, v -> named_struct('block', {n}, 'value', v))")
    return F.explode(F.expr(f"concat({', '.join(parts)})")).alias(name)


def _rest(radius: int) -> str:
    """The bits outside the bucket's block, moved together."""
    case = " ".join(
        f"when {n} then ({f'(fp & {(1 << offset) - 1}L) | ' if offset else ''}"
        f"{f'shiftleft(shiftrightunsigned(fp, {offset + width}), {offset})' if offset + width < BITS else '0L'})"
        for n, (offset, width) in enumerate(_blocks(BITS, radius))
    )
    return f"case key.block {case} end"


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph in which values within the radius are neighbours.

    Memory is linear in the number of values. Each value is taken out of the open
    ones when it is first reached, so the links number fewer than the values.
    """
    open_, links = values.astype(np.uint64), []
    while len(open_) > 1:
        reached, open_ = [open_[0]], open_[1:]
        while reached and len(open_):
            at = reached.pop()
            near = np.bitwise_count(open_ ^ at) <= radius
            if near.any():
                found, open_ = open_[near], open_[~near]
                links.extend((int(np.int64(at)), int(np.int64(v))) for v in found)
                reached.extend(found)
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    Not all pairs: links of spanning forests, with the same components. ``crowd``
    is the bucket size beyond which a bucket is cut further; it bounds work, not rows.
    """
    emitted = distinct.select("fp", _variants("fp", BITS, radius, "key"))
    met = stored(emitted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    members = emitted.join(met, "key")
    inner = min(w for w in (BITS - width for _, width in _blocks(BITS, radius)))
    cut = members.where(F.col("n") > crowd).withColumn("rest", F.expr(_rest(radius)))
    if inner:
        sub = cut.select("key", "fp", _variants("rest", inner, radius, "sub"))
    else:
        sub = cut.select("key", "fp", F.expr("named_struct('block', 0, 'value', 0L)").alias("sub"))
    plain = members.where(F.col("n") <= crowd).select("key", "fp", F.expr("cast(null as struct<block:int, value:bigint>)").alias("sub"))
    buckets = plain.unionByName(sub).groupBy("key", "sub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def each(frames):
        for frame in frames:
            links = {link for fps in frame["fps"] for link in forest(np.asarray(fps, np.int64), radius)}
            yield pd.DataFrame(list(links), columns=["a", "b"], dtype="int64")

    return buckets.select("fps").mapInPandas(each, "a bigint, b bigint")


def near_components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """``(id, fp, component_id)``: the smallest id reachable over links of at most ``radius`` bits.

    Rows of one fingerprint are linked to each other. Null ids are kept and are
    never the smallest; a component of null ids has a null id. Repeated ids stay
    repeated rows. An empty table gives an empty one.
    """
    prints = stored(prints, "simhash-prints")
    distinct = stored(
        prints.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("_n")), "simhash-distinct"
    )
    links = stored(near_links(distinct, radius, crowd).distinct(), "simhash-links")
    named = components(links)
    grouped = stored(join_small(distinct, named.select(F.col("node").alias("fp"), "component"), ["fp"], "left"), "simhash-grouped")
    linked = grouped.where("component is not null")
    lowest = stored(linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_n")), "simhash-lowest")
    # a component may hold a third of the fingerprints, so it is not shuffled by its name
    met = join_unique(linked, lowest.drop("_n"), ["component"], "inner", lowest.select("component", "_n"))
    alone = grouped.where("component is null").select("fp", F.col("rep").alias("component_id"), "_n")
    labels = stored(alone.unionByName(met.select("fp", "component_id", "_n")), "simhash-labels")
    return join_unique(prints, labels.drop("_n"), ["fp"], "inner", labels.select("fp", "_n")).select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Keep one row of each group of linked fingerprints: the one with the smallest id, then row number.

    Rows are told apart by a number they get here, not by their id: rows with the
    same id are copies only if their fingerprints are linked, and rows without an id are
    copies as all others, but the last choice. Texts without a word share the
    fingerprint zero and are linked like any others, so one of them stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"))
    numbered = stored(rows, "simhash-rows")
    prints = fingerprints(numbered.select("number", F.col("row")[text_col].alias("text")), "number", "text", shingle)
    linked = stored(near_components(prints, "number", radius), "simhash-linked")
    groups = stored(linked.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "simhash-groups")
    members = stored(join_unique(linked, groups.select("component_id"), ["component_id"], "inner", groups).select("number", "component_id"), "simhash-members")
    named = join_small(numbered.select("number", F.col("row")[id_col].alias("id")), members, ["number"])
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "number"))["number"]
    winners = named.groupBy("component_id").agg(first.alias("number")).select("number")
    losers = stored(members.select("number").join(winners, "number", "left_anti"), "simhash-losers")
    return join_small(numbered, losers, ["number"], "left_anti").select("row.*")
