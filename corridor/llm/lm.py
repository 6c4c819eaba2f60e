"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

``P(w | v) = l2(b) c(vw) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)``. ``b`` buckets the
context's frequency (its binary logarithm). The weights of a bucket are learned
by expectation-maximisation on a held-out part of the training documents, whose
own counts are deleted from the estimates for that; the final counts hold all
training documents.

How the counts meet the tokens. Documents are encoded in chunks: local word
numbers and the hash of each distinct word. A chunk sends each distinct word and
bigram once, with its count, as sorted hash arrays cut by hash range; a task per
range adds the counts up over all chunks and answers each chunk with an array in
the order of its keys; the chunk then scores its tokens. A very frequent word is
so one key per chunk, no task holds more than a range or a chunk, and what moves
grows with the distinct pairs of the chunks. The encoded chunks and the answers
are written tables, so a lost executor costs its tasks only.

Defined cases: a null or blank text is the end token alone; rows are scored one
by one, so repeated and null ids are kept; without training rows every token has
probability 1 / (V + 1) = 1; without held-out rows the weights stay equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.scratch import stored

TRAIN, DELETED, TEST = 0, 1, 2
CHUNK_BYTES = 6 << 20
RANGE_KEYS = 2_000_000
LEVELS = 41
STEPS = 4
ROUNDS = 60
END_HASH = np.uint64(0x9E3779B97F4A7C15)

CHUNKS = "chunk bigint, part int, tokens bigint, ids array<string>, sizes binary, words binary, hashes binary"
KEYS = "kind int, slot bigint, chunk bigint, part int, n bigint, keys binary, counts binary"
TOTALS = "kind int, slot bigint, chunk bigint, full binary, kept binary, n_full bigint, v_full bigint, n_kept bigint, v_kept bigint"
CELLS = "level int, q2 int, q1 int, n bigint"
SCORES = "id string, part int, n_tokens bigint, n_known bigint, base_score double, score double"


def _pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64, copy=False)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def encode(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents as chunks of one part each: word numbers (0: end) and the hashes of the chunk's words."""

    def each(frames) -> Iterator[pd.DataFrame]:
        prefix, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[int, list] = {}

        def chunk(part: int) -> pd.DataFrame:
            nonlocal made
            ids, texts, _ = open_.pop(part)
            numbers: dict = {None: 0}
            sizes, parts = [], []
            for text in texts:
                words = text.lower().split()
                line = [numbers.setdefault(w, len(numbers)) for w in words]
                line.append(0)
                sizes.append(len(line))
                parts.append(np.array(line, np.uint32))
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(w) if w is not None else int(END_HASH) for w in numbers), np.uint64, len(numbers))
            words = np.concatenate(parts)
            made += 1
            return pd.DataFrame([(
                prefix + made, part, len(words), ids, _pack(np.array(sizes, np.uint64)), _pack(words.astype(np.uint64)), hashes.tobytes()
            )], columns=[c.split(" ")[0] for c in CHUNKS.split(", ")])

        for frame in frames:
            for row in frame.itertuples(index=False):
                held = open_.setdefault(row.part, [[], [], 0])
                held[0].append(row.id)
                held[1].append(row.text or b"")
                held[2] += len(held[1][-1]) + 1
                if held[2] >= chunk_bytes:
                    yield chunk(row.part)
        for part in sorted(open_):
            yield chunk(part)

    picked = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), part.cast("int").alias("part")
    )
    return picked.mapInPandas(each, CHUNKS)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of ordered pairs of 64-bit hashes."""
    x = a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(31))


class _Chunk:
    """A decoded chunk: tokens, their contexts, and its distinct words and bigrams in key order."""

    def __init__(self, row):
        self.sizes = _unpack(row.sizes).astype(np.int64)
        self.words = _unpack(row.words).astype(np.int64)
        hashes = np.frombuffer(row.hashes, np.uint64)
        self.before = np.roll(self.words, 1)
        self.before[0] = 0  # the end of a text is the context of the next one's first word
        order = np.argsort(hashes)
        self.word_keys = hashes[order]
        self.word_rank = np.empty_like(order)
        self.word_rank[order] = np.arange(len(order))
        codes, inverse, self.pair_counts = np.unique(self.before * len(hashes) + self.words, return_inverse=True, return_counts=True)
        keys = _mixed(hashes[codes // len(hashes)], hashes[codes % len(hashes)])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pair_at = rank[inverse]
        self.pair_counts = self.pair_counts[order]

    def kinds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 1, self.word_keys, np.bincount(self.word_rank[self.words], minlength=len(self.word_keys))
        yield 2, self.pair_keys, self.pair_counts


def _cuts(keys: np.ndarray, slots: int) -> np.ndarray:
    """Where sorted keys pass from one of ``slots`` equal hash ranges to the next."""
    slot = ((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    return np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))


def count(chunks: DataFrame, slots: int) -> DataFrame:
    """``TOTALS``: for each chunk and hash range the corpus counts of its keys, and each range's sums.

    ``full`` counts all training documents, ``kept`` those that are not deleted.
    A range's own row has a null chunk and the number of tokens and of distinct words.
    """

    def send(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                made = []
                chunk = _Chunk(row)
                for kind, keys, counts in chunk.kinds():
                    cuts = _cuts(keys, slots)
                    for slot in range(slots):
                        a, b = cuts[slot], cuts[slot + 1]
                        if a < b:
                            made.append((kind, slot, row.chunk, row.part, b - a, _pack_sorted(keys[a:b]), _pack(counts[a:b])))
                yield pd.DataFrame(made, columns=[c.split(" ")[0] for c in KEYS.split(", ")])

    def total(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        kind, slot = (int(k) for k in key)
        keys, at = np.unique(np.concatenate([_unpack_sorted(k) for k in frame["keys"]]), return_inverse=True)
        full, kept = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        edges = np.concatenate([[0], np.cumsum(frame["n"].to_numpy())])
        for i, row in enumerate(frame.itertuples(index=False)):
            if row.part != TEST:
                places, counts = at[edges[i] : edges[i + 1]], _unpack(row.counts)
                full[places] += counts  # a chunk has a key once
                if row.part == TRAIN:
                    kept[places] += counts
        made = [(kind, slot, None, None, None, int(full.sum()), int((full > 0).sum()), int(kept.sum()), int((kept > 0).sum()))]
        for i, row in enumerate(frame.itertuples(index=False)):
            places = at[edges[i] : edges[i + 1]]
            made.append((kind, slot, row.chunk, _pack(full[places]), _pack(kept[places]) if row.part == DELETED else b"", 0, 0, 0, 0))
        out = pd.DataFrame(made, columns=[c.split(" ")[0] for c in TOTALS.split(", ")])
        return out.astype({"chunk": "Int64"})

    sent = chunks.mapInPandas(send, KEYS)
    return sent.groupBy("kind", "slot").applyInPandas(total, TOTALS)


def _estimates(row, answers: pd.DataFrame, column: str, size: int):
    """Per token: c(w), c(v), c(vw)."""
    chunk = _Chunk(row)
    found = {}
    for kind in (1, 2):
        mine = answers[answers["kind"] == kind].sort_values("slot")
        found[kind] = np.concatenate([_unpack(b) for b in mine[column]])
    words = found[1][chunk.word_rank].astype(np.float64)
    return chunk.sizes, words[chunk.words], words[chunk.before], found[2][chunk.pair_at].astype(np.float64)


def _level(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), LEVELS - 1)


def learn_weights(chunks: DataFrame, totals: DataFrame, size: int, n: int, v: int) -> np.ndarray:
    """``LEVELS x 3`` weights (bigram, unigram, uniform) by expectation-maximisation on the deleted part.

    The held-out tokens are reduced to a table of cells (context level and both
    estimates to a ``STEPS``-th of a binary order), whose size has a fixed bound.
    """

    def cells(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples(index=False):
            _, word, context, pair = _estimates(row, right, "kept", size)
            with np.errstate(divide="ignore", invalid="ignore"):
                q2 = np.where(pair > 0, np.round(-STEPS * np.log2(pair / context)), -1).astype(np.int64)
                q1 = np.where(word > 0, np.round(-STEPS * np.log2(word / n)), -1).astype(np.int64)
            code, counts = np.unique((_level(context) << 32) + ((q2 + 1) << 16) + (q1 + 1), return_counts=True)
            made.append(pd.DataFrame({"level": code >> 32, "q2": ((code >> 16) & 0xFFFF) - 1, "q1": (code & 0xFFFF) - 1, "n": counts}))
        return pd.concat(made) if made else pd.DataFrame(columns=["level", "q2", "q1", "n"])

    held = chunks.where(F.col("part") == DELETED)
    met = held.groupBy("chunk").cogroup(totals.join(held.select("chunk"), "chunk", "left_semi").groupBy("chunk")).applyInPandas(cells, CELLS)
    rows = met.groupBy("level", "q2", "q1").agg(F.sum("n").alias("n")).collect()
    weights = np.full((LEVELS, 3), 1 / 3)
    if not rows:
        return weights
    level, q2, q1, mass = (np.array([r[c] for r in rows]) for c in ("level", "q2", "q1", "n"))
    order = np.lexsort((q1, q2, level))
    level, q2, q1, mass = level[order], q2[order], q1[order], mass[order].astype(np.float64)
    p = np.stack([np.where(q2 >= 0, 2.0 ** (-q2 / STEPS), 0), np.where(q1 >= 0, 2.0 ** (-q1 / STEPS), 0), np.full(len(q1), 1 / (v + 1))], axis=1)
    for _ in range(ROUNDS):
        joint = weights[level] * p
        share = joint / joint.sum(axis=1, keepdims=True) * mass[:, None]
        gathered = np.stack([np.bincount(level, share[:, k], LEVELS) for k in range(3)], axis=1) + 1e-3
        weights = gathered / gathered.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, test: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text",
          chunk_bytes: int = CHUNK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """A row per document: ``<id>, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``test`` marks rows that nothing is learned from, ``deleted`` training rows
    whose counts are held out while the weights are learned. Scores are base-10
    logarithms; ``base_score`` is the add-one unigram model's.
    """
    part = F.when(test, TEST).when(deleted, DELETED).otherwise(TRAIN)
    chunks = stored(encode(docs, part, id_col, text_col, chunk_bytes), "lm-chunks")
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    slots = max(1, math.ceil(tokens / range_keys))
    totals = stored(count(chunks, slots), "lm-totals")
    sums = totals.where("chunk is null and kind = 1").agg(*[F.sum(c).alias(c) for c in ("n_full", "v_full", "n_kept", "v_kept")]).first()
    n, v, n_kept, v_kept = (int(x or 0) for x in sums)
    answers = totals.where("chunk is not null").select("kind", "slot", "chunk", "full", "kept")
    weights = learn_weights(chunks, answers, slots, n_kept, v_kept)

    def each(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for row in left.itertuples(index=False):
            sizes, word, context, pair = _estimates(row, right, "full", slots)
            mix = weights[_level(context)]
            total = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * word / max(n, 1) + mix[:, 2] / (v + 1)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            base = np.log10((word + 1) / (n + 1 * (v + 1)))
            made.append(pd.DataFrame({
                "id": row.ids, "part": row.part, "n_tokens": sizes, "n_known": np.add.reduceat((word > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(total), starts),
            }))
        return pd.concat(made) if made else pd.DataFrame(columns=[c.split(" ")[0] for c in SCORES.split(", ")])

    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(each, SCORES)
    return scored.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), (F.col("part") == TEST).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
