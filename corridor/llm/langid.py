"""Language identification with interpolated Kneser-Ney character models.

One model per language over letters (other characters become one blank), with the
order as a parameter. Counts come from a bounded sample of labelled rows, as one
distributed aggregate; lower orders use continuation counts. Each order is a
sorted array of n-gram hashes with one row of log probabilities (a column per
language), and a sorted array of contexts with their back-off weights. A text is
scored on all its characters: an n-gram that no language has seen backs off to
the next shorter one. The language with the lowest cross-entropy per character
wins.

Rejection is calibrated on rows of the sample that were not counted: a language's
limit is the cross-entropy that all but a ``REJECTED`` share of them stay under.
``rejected`` marks texts above their language's limit; the language is still told.

Defined cases: a null text and one without a letter are ``und`` with score 0 and
not rejected; equal cross-entropies go to the first language in order; without
training rows every text is ``und``; null labels are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import in_pieces
from corridor.operators.frames import join_small
from corridor.scratch import stored

ORDER = 4
#: The sample holds about this many rows of each language at most, whole texts.
SAMPLE_ROWS = 1500
REJECTED = 0.005
UNKNOWN = "und"
DISCOUNT = 0.75
ALPHABET = 0x110000
BLANK = 32
PIECE = 1 << 22


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text: letters stay, each other run becomes one blank, one at either end."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    kept = letter | np.concatenate([[False], letter[:-1]])
    out = np.where(letter, points, BLANK)[kept].astype(np.uint64)
    ends = [[BLANK], out] if out[-1] == BLANK else [[BLANK], out, [BLANK]]
    return np.concatenate(ends).astype(np.uint64)


def _letters() -> np.ndarray:
    """Which code points are letters, by their Unicode category."""
    return np.fromiter((chr(i).isalpha() for i in range(ALPHABET)), bool, ALPHABET)


_LETTER = _letters()


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all runs of ``order`` characters; for up to four characters of the first plane no two are equal."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(order):
        value = (value << np.uint64(16) | value >> np.uint64(48)) ^ points[k : k + n]
    return value


@dataclass
class Model:
    """Sorted hash arrays: per order n-grams with log2 probabilities, and contexts with log2 back-off weights."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    context_keys: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray
    scale: float = 1.0

    def entropies(self, points: np.ndarray) -> np.ndarray:
        """Bits per character in each language; the first character is context only."""
        total = np.zeros(len(self.languages))
        for at in range(1, len(points), PIECE):
            start = max(0, at - self.order + 1)
            total += self._bits(points[start : at + PIECE], at - start)
        return total / max(1, len(points) - 1)

    def _bits(self, points: np.ndarray, skip: int) -> np.ndarray:
        """Sum of bits of the characters from ``skip`` on."""
        ends = np.arange(skip, len(points))
        total = np.zeros(len(self.languages))
        for order in range(self.order, 0, -1):
            if not len(ends):
                break
            known = ends >= order - 1  # at the start of a text the context is shorter
            hashes = grams(points, order)[ends[known] - order + 1]
            at = np.minimum(np.searchsorted(self.keys[order - 1], hashes), len(self.keys[order - 1]) - 1)
            hit = self.keys[order - 1][at] == hashes
            counts = np.bincount(at[hit], minlength=len(self.keys[order - 1]))
            total -= counts @ self.logs[order - 1]
            missed = ends[known][~hit]
            if order > 1 and len(missed):
                contexts = grams(points, order - 1)[missed - order + 1]
                keys = self.context_keys[order - 1]
                at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
                hit = keys[at] == contexts
                total -= np.bincount(at[hit], minlength=len(keys)) @ self.backoffs[order - 1]
            elif order == 1:
                total -= len(missed) * self.floor
            ends = np.concatenate([ends[~known], missed])
        return total

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(language, score, bits per character, rejected)."""
        points = codes(text)
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0, None, False
        bits = self.entropies(points)
        best = int(np.argmin(bits))
        # a posterior over the languages whose evidence grows with the length up to a limit
        evidence = (bits[best] - bits) * min(len(points) - 1, 200) * self.scale
        return self.languages[best], float(1 / np.exp2(evidence).sum()), float(bits[best]), bool(bits[best] > self.limits[best])


def sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of each language at most, picked by a hash of the text; ``(lang, text, held)``.

    The languages' sizes are one small aggregate; ``held`` marks a fifth for calibration.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    place = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kept = join_small(known, sizes, ["lang"]).where(place * F.col("n") < rows)
    return kept.select("lang", "text", (F.pmod(F.xxhash64("text", F.lit(6)), F.lit(5)) == 0).alias("held"))


def train(examples: DataFrame, order: int = ORDER) -> Model:
    """Kneser-Ney models of the languages in a bounded ``sample``.

    Repeated texts count once. The n-gram counts of the sample, whose size bounds
    them, come to the driver as the model that every task needs.
    """
    examples = stored(examples.distinct(), "langid-sample")

    def tally(frames):
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                both = [grams(codes(t), order) for t in part["text"]]
                keys, counts = np.unique(np.concatenate(both), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": counts})

    tallied = examples.where("not held").mapInPandas(tally, "lang string, gram bigint, n bigint")
    table = tallied.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    languages = sorted(table["lang"].unique())
    model = _kneser_ney(table, languages, order)

    def judge(frames):
        for frame in frames:
            bits = [model.entropies(codes(t)) for t in frame["text"]]
            best = [int(np.argmin(b)) for b in bits]
            yield pd.DataFrame({"lang": frame["lang"], "best": [languages[b] for b in best], "bits": [float(x[b]) for x, b in zip(bits, best)]})

    if languages:
        held = examples.where("held").mapInPandas(judge, "lang string, best string, bits double").where("lang = best")
        limits = held.groupBy("lang").agg(F.percentile_approx("bits", 1 - REJECTED, 10_000).alias("limit")).collect()
        found = {r["lang"]: r["limit"] for r in limits}
        model.limits = np.array([found.get(lang, np.inf) for lang in languages])
    return model


def _kneser_ney(table: pd.DataFrame, languages: list[str], order: int) -> Model:
    """Interpolated probabilities of every n-gram any language has seen, all orders.

    Highest order: counts; below: the number of different characters before.
    """
    width = len(languages)
    model = Model(languages, order, [], [], [], [], np.zeros(width), np.full(width, np.inf))
    if not width:
        return model
    column = table["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    gram, n = table["gram"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.float64)
    mask = [np.uint64((1 << 16 * k) - 1) if k < 4 else np.uint64(0xFFFFFFFFFFFFFFFF) for k in range(order + 1)]
    counts = {}
    keys, at = np.unique(gram, return_inverse=True)
    counts[order] = (keys, np.zeros((len(keys), width)))
    np.add.at(counts[order][1], (at, column), n)
    for k in range(order - 1, 0, -1):  # continuation counts from the order above
        above, values = counts[k + 1]
        keys, at = np.unique(above & mask[k], return_inverse=True)
        matrix = np.zeros((len(keys), width))
        np.add.at(matrix, at, (values > 0).astype(np.float64))
        counts[k] = (keys, matrix)
    below = None
    for k in range(1, order + 1):
        keys, matrix = counts[k]
        context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, types = np.zeros((len(context), width)), np.zeros((len(context), width))
        np.add.at(total, at, matrix)
        np.add.at(types, at, (matrix > 0).astype(np.float64))
        seen = total > 0
        back = np.where(seen, DISCOUNT * types / np.maximum(total, 1), 1.0)
        if k == 1:
            lower = np.full((1, width), 1.0 / ALPHABET)
            model.floor = np.log2(back[0] * lower[0])
        else:
            where = np.searchsorted(model.keys[k - 2], keys & mask[k - 1])
            lower = below[where]
        below = np.maximum(matrix - DISCOUNT, 0) / np.maximum(total, 1)[at] + back[at] * lower
        model.keys.append(keys)
        model.logs.append(np.log2(below))
        model.context_keys.append(context)
        model.backoffs.append(np.log2(back))
    return model


def identify(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows: int = SAMPLE_ROWS, order: int = ORDER) -> DataFrame:
    """A row per document: ``<id>, lang_pred, score, bits, rejected``; learned from the rows that ``learn_from`` marks."""
    spark = docs.sparkSession
    model = train(sample(docs.where(learn_from), lang_col, text_col, rows), order)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample
    kind = docs.schema[id_col].dataType.simpleString()

    def each(frames):
        for frame in frames:
            for part in in_pieces(frame, "text", 1 << 25):
                found = [sent.value.predict(t) for t in part["text"]]
                yield pd.DataFrame({
                    "id": part["id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                    "bits": pd.Series([f[2] for f in found], index=part.index, dtype="float64"), "rejected": [f[3] for f in found],
                })

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInPandas(each, f"id {kind}, lang_pred string, score double, bits double, rejected boolean").withColumnRenamed("id", id_col)
