"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Their TF-IDF matrix, with document
frequencies counted over the whole corpus, is decomposed by a distributed
randomised SVD. Every document is then projected block by block: three
neighbouring blocks of ``BLOCK`` words are a window, and a passage is a candidate
where the window's projection on it reaches ``COARSE`` of the passage's own
length. Inside a candidate window, stretches of the passage's length give the
cosine; from ``COSINE`` on, the words are compared by their longest common
subsequence. A document leaks an item if the subsequence holds ``COPIED`` of a
passage's words, or ``REWORDED`` of them with a cosine of ``CLOSE`` and the answer
(the passage's last sentence) among the words.

The benchmark is worked off in blocks of at most ``ITEMS`` items and ``RANK``
passages, so what tasks and the driver hold has a fixed bound (an item of more
passages is a block of its own); each block reads the corpus twice, without any
shuffle of texts. All windows of all documents are searched. The latent space is
fitted to the block's passages, with a rank that keeps them apart: with fewer
dimensions than passages, common words carry most projections.

Defined cases: null and blank texts leak nothing; items of fewer than
``LEAST_WORDS`` words are no evidence and are not searched; equal items are found
each; repeated and null document ids give a row each; an empty benchmark or
corpus gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import in_pieces
from corridor.operators.frames import dense_ids, join_small
from corridor.scratch import stored

BLOCK = 32
WINDOW_BLOCKS = 3
PASSAGE, STEP = 64, 32
ITEMS = 256
RANK, EXTRA, POWERS = 320, 16, 2
LEAST_WORDS = 5
COARSE, COSINE, CLOSE = 0.4, 0.4, 0.7
COPIED, REWORDED, ANSWER = 0.6, 0.5, 0.8
PIECE = 1 << 22
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@dataclass
class Passage:
    item: str
    words: list[str]
    answer: frozenset


def passages(item: str, text: str | None) -> list[Passage]:
    """Passages of an item: the whole if short enough, else overlapping runs; with the words of its last sentence."""
    words = words_of(text)
    if len(words) < LEAST_WORDS:
        return []
    sentences = [s for s in _SENTENCE.split(text) if _WORD.search(s)]
    answer = frozenset(words_of(sentences[-1]))
    starts = range(0, max(1, len(words) - PASSAGE + STEP), STEP)
    return [Passage(item, words[s : s + PASSAGE], answer) for s in starts]


def _document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many texts hold each word, and the number of texts."""

    def tally(frames):
        seen, n = Counter(), 0
        for frame in frames:
            for text in frame["text"]:
                seen.update(vocabulary.keys() & set(words_of(text)))
                n += 1
        terms = [vocabulary[w] for w in seen]
        yield pd.DataFrame({"term": [*terms, -1], "n": [*seen.values(), n]})

    counted = docs.select("text").mapInPandas(tally, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency, total = np.zeros(len(vocabulary)), 0
    for row in counted:
        if row["term"] < 0:
            total = row["n"]
        else:
            frequency[row["term"]] = row["n"]
    return frequency, total


def _product(postings: DataFrame, by: str, other: str, size: int, dense: np.ndarray) -> np.ndarray:
    """Sparse matrix times dense: rows ``by``, columns ``other``. A partition holds whole rows."""
    width = dense.shape[1]

    def multiply(frames):
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            parts = frame["weight"].to_numpy()[:, None] * dense[frame[other].to_numpy()]
            keys, at = np.unique(frame[by].to_numpy(), return_inverse=True)
            block = np.zeros((len(keys), width))
            np.add.at(block, at, parts)
            for key, row in zip(keys.tolist(), block):
                sums[key] = sums[key] + row if key in sums else row
        if sums:
            yield pd.DataFrame({"key": list(sums), "row": [r.tobytes() for r in sums.values()]})

    out = np.zeros((size, width))
    # a block's passages or words times the width: a fixed bound
    for row in postings.repartition(by).mapInPandas(multiply, "key int, row binary").collect():
        out[row["key"]] = np.frombuffer(row["row"])
    return out


def randomised_svd(postings: DataFrame, n_rows: int, n_terms: int, rank: int, seed: int = 23) -> np.ndarray:
    """Right singular vectors (terms x rank) of the matrix ``(passage, term, weight)``.

    Range finding with power iterations (Halko, Martinsson and Tropp): the
    products with the matrix run on Spark, the driver holds factors of
    ``rank + EXTRA`` columns only.
    """
    width = min(rank + EXTRA, n_rows, n_terms)
    sketch = np.random.default_rng(seed).standard_normal((n_terms, width))
    basis = np.linalg.qr(_product(postings, "passage", "term", n_rows, sketch))[0]
    for _ in range(POWERS):
        turned = np.linalg.qr(_product(postings, "term", "passage", n_terms, basis))[0]
        basis = np.linalg.qr(_product(postings, "passage", "term", n_rows, turned))[0]
    short = _product(postings, "term", "passage", n_terms, basis)  # transposed: terms x width
    values, vectors = np.linalg.eigh(short.T @ short)
    order = np.argsort(values)[::-1][: min(rank, width)]
    order = order[values[order] > 1e-9 * max(values.max(initial=0.0), 1e-300)]
    return short @ (vectors[:, order] / np.sqrt(values[order]))


@dataclass
class Index:
    """Passages and the latent space of one block of the benchmark."""

    passages: list[Passage]
    vocabulary: dict[str, int]
    terms: np.ndarray  # one row per word: idf times its latent vector; the last row, for other words, is zero
    vectors: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        """Which words a passage has, how many words, how many of them repeat another, and each word's part in a projection."""
        self.members = np.zeros((len(self.passages), len(self.vocabulary) + 1), bool)  # the last column: other words
        for i, p in enumerate(self.passages):
            self.members[i, [self.vocabulary[w] for w in p.words]] = True
        self.counts = np.array([len(p.words) for p in self.passages])
        self.scores = self.terms @ self.vectors.T
        self.repeats = self.counts - self.members.sum(axis=1)

    def windows(self, ids: np.ndarray, block: np.ndarray, n_blocks: int, last: np.ndarray) -> np.ndarray:
        """Latent sums of the window that starts at each block: it and the next ones of the same text."""
        sums = np.zeros((n_blocks + WINDOW_BLOCKS - 1, self.terms.shape[1]), np.float32)
        known = np.flatnonzero(ids < len(self.terms) - 1)
        for at in range(0, len(known), 1 << 15):
            where = known[at : at + (1 << 15)]
            first = np.flatnonzero(np.diff(block[where], prepend=-1))
            sums[block[where[first]]] += np.add.reduceat(self.terms[ids[where]], first, axis=0)
        out = sums[:n_blocks].copy()
        for k in range(1, WINDOW_BLOCKS):
            inside = np.arange(n_blocks) + k <= last
            out[inside] += sums[k : n_blocks + k][inside]
        return out

    def search(self, texts: list[str | None]) -> list[tuple]:
        """``(text number, item, cosine, lcs, lcs_share, answer_share, start, end)`` of all leaks; words count from 0."""
        other = len(self.terms) - 1
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        per_text = -(-sizes // BLOCK)
        if not per_text.sum() or not self.passages:
            return []
        ids = np.array(list(map(self.vocabulary.get, chain.from_iterable(words), repeat(other))), np.int64)
        first_block = np.concatenate([[0], np.cumsum(per_text)])
        owner = np.repeat(np.arange(len(texts)), per_text)
        start_of = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.arange(len(ids)) - np.repeat(start_of[:-1], sizes)
        block = np.repeat(first_block[:-1], sizes) + inside // BLOCK
        last = first_block[1:][owner] - 1
        sums = self.windows(ids, block, len(owner), last)
        # a window shorter than the others is searched only where it is its text's first
        whole = (np.arange(len(owner)) + WINDOW_BLOCKS - 1 <= last) | (np.arange(len(owner)) == first_block[owner])
        target = (self.vectors / self.lengths[:, None] ** 2).T.astype(np.float32)
        best: dict[tuple, tuple] = {}
        for at in range(0, len(owner), 1 << 13):
            row, passage = np.nonzero((sums[at : at + (1 << 13)] @ target >= COARSE) & whole[at : at + (1 << 13), None])
            for window in np.unique(row):
                text = int(owner[at + window])
                first = int(at + window - first_block[text]) * BLOCK
                a = int(start_of[text]) + first
                stretch = ids[a : min(a + WINDOW_BLOCKS * BLOCK, int(start_of[text + 1]))]
                near = passage[row == window]
                # no subsequence can be longer than the shared words allow; it may reach half a passage beyond the window
                low = max(a - PASSAGE // 2, int(start_of[text]))
                reach = ids[low : min(a + WINDOW_BLOCKS * BLOCK + PASSAGE // 2, int(start_of[text + 1]))]
                shared = self.members[near][:, np.unique(reach)].sum(axis=1)
                near = near[shared + self.repeats[near] >= REWORDED * self.counts[near]]
                for p in near:
                    found = self.compare(int(p), words[text], stretch, a - low, reach, low - int(start_of[text]))
                    key = (text, self.passages[p].item)
                    if found and (key not in best or (found[2], found[0]) > (best[key][2], best[key][0])):
                        best[key] = found
        return [(text, item, *found) for (text, item), found in sorted(best.items())]

    def compare(self, passage: int, words: list[str], stretch: np.ndarray, behind: int, reach: np.ndarray, low: int) -> tuple | None:
        """Cosine, subsequence and answer of a candidate; None if it is no leak.

        The region for the subsequence is twice as long as the passage: the part of
        ``reach`` (it begins at word ``low``, ``behind`` words before the stretch)
        with most of the passage's words, of equal ones the nearest around the
        stretch of the cosine. So words that are spread by insertions are all met.
        """
        cosine, at = self.cosine(stretch, passage)
        if cosine < COSINE:
            return None
        p = self.passages[passage]
        size = len(p.words)
        sums = np.concatenate([[0], np.cumsum(self.members[passage][reach])])
        held = sums[2 * size :] - sums[: -2 * size] if len(reach) > 2 * size else sums[-1:]
        full = np.flatnonzero(held == held.max())
        start = low + int(full[np.argmin(np.abs(full - (behind + at - size // 2)))])
        end = min(start + 2 * size, low + len(reach))
        region = words[start:end]
        have = set(region)
        if sum(map(have.__contains__, p.words)) < REWORDED * size:
            return None
        common = lcs_length(p.words, region)
        share, answer = common / size, len(p.answer & have) / len(p.answer)
        if share >= COPIED or share >= REWORDED and cosine >= CLOSE and answer >= ANSWER:
            return cosine, common, share, answer, start, end
        return None

    def cosine(self, ids: np.ndarray, passage: int) -> tuple[float, int]:
        """Cosine of the stretch of the passage's length with the largest projection on it, and where that starts."""
        size = self.counts[passage]
        sums = np.concatenate([[0.0], np.cumsum(self.scores[ids, passage], dtype=np.float64)])
        starts = np.arange(max(1, len(ids) - size + 1))
        best = int(np.argmax(sums[np.minimum(starts + size, len(ids))] - sums[starts]))
        part = self.terms[ids[best : best + size]].sum(axis=0)
        length = float(np.linalg.norm(part)) * float(self.lengths[passage])
        return float(part @ self.vectors[passage]) / max(length, 1e-12), best


def build_index(found: list[Passage], docs: DataFrame, rank: int = RANK) -> Index:
    """Document frequencies, TF-IDF and the latent space for the passages of a block."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for p in found for w in p.words}))}
    frequency, total = _document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows = [(i, vocabulary[w], float(n * idf[vocabulary[w]])) for i, p in enumerate(found) for w, n in Counter(p.words).items()]
    frame = pd.DataFrame(rows, columns=["passage", "term", "weight"]).astype({"passage": "int32", "term": "int32"})
    postings = stored(docs.sparkSession.createDataFrame(frame, "passage int, term int, weight double"), "latent-postings")
    space = randomised_svd(postings, len(found), len(vocabulary), rank)
    terms = np.concatenate([idf[:, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)
    vectors = np.stack([terms[[vocabulary[w] for w in p.words]].sum(axis=0) for p in found])
    return Index(found, vocabulary, terms, vectors, np.maximum(np.linalg.norm(vectors, axis=1), 1e-9))


def passage_blocks(items: list[tuple], most: int) -> list[list[Passage]]:
    """Passages of ``(item, text)`` rows in blocks of at most ``most``; an item stays whole, so one of more is a block of its own."""
    blocks: list[list[Passage]] = []
    for item, text in items:
        found = passages(item, text)
        if blocks and len(blocks[-1]) + len(found) <= most:
            blocks[-1] += found
        elif found:
            blocks.append(found)
    return blocks


LEAKS = "cosine double, lcs int, lcs_share double, answer_share double, start_word int, end_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", items: int = ITEMS, rank: int = RANK, piece: int = PIECE) -> DataFrame:
    """A row per document and leaked item: ``<id>, <item>, cosine, lcs, lcs_share, answer_share, start_word, end_word``.

    ``piece`` is about how many characters of text a task works on at a time; it bounds memory, not results.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    numbered = stored(dense_ids(named, ["item", "text"], "number", F.lit(0)), "latent-items")
    total = numbered.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, item string, {LEAKS}"
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]
    result = spark.createDataFrame([], schema)
    for first in range(0, total, items):
        block = numbered.where((F.col("number") >= first) & (F.col("number") < first + items)).orderBy("number").collect()
        for found in passage_blocks([(row["item"], row["text"]) for row in block], rank):
            index = spark.sparkContext.broadcast(build_index(found, texts, max(rank, len(found))))

            def each(frames, index=index):
                for frame in frames:
                    for part in in_pieces(frame, "text", piece):
                        found = index.value.search(part["text"].tolist())
                        if found:
                            out = pd.DataFrame(found, columns=["at", *columns[1:]])
                            out.insert(0, "id", part["id"].to_numpy()[out.pop("at")])
                            yield out

            result = result.unionByName(texts.mapInPandas(each, schema))
    return result.select(F.col("id").alias(id_col), F.col("item").cast(item_kind).alias(item_col), *columns[2:])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item.

    A leak depends on the text alone, so texts are told apart by their digest, not
    by the row's id: ids may repeat or be null. Leaking digests are a written
    table, broadcast if counted small.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(F.col(text_col).cast("string").cast("binary"), 256).alias("digest"))
    texts = rows.select("digest", F.col("row")[text_col].alias("text"))
    leaking = stored(find_leaks(texts, benchmark, "digest", "text", **options).select("digest").distinct(), "latent-leaks")
    return join_small(rows, leaking, ["digest"], "left_anti").select("row.*")
