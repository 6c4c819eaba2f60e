"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features are rates of a text: lexicon densities, lexicon words near the second
person, capitals, punctuation and obfuscation. The lexicon is a short list of
insults and what a part of the labelled sample adds: words, and word beginnings
for inflected forms, that toxic documents hold far more often than others.

Learning uses a bounded sample of labelled rows in three parts, told apart by a
hash: the first makes the lexicon, the second fits the trees (Spark ML), the third
fits the isotonic calibration, so that no part judges what it made. Near copies
would make one document's words look like a lexicon, so of rows that agree in
their smallest shingle hash one stays.

Defined cases: null and blank texts have all features 0 and are scored like any
other; repeated and null ids are scored row by row; a document labelled more than
once has its mean label, rounded up at one half; if a part lacks one of the two labels, the
score of every row is the sample's share of toxic rows (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.scratch import stored

#: The sample holds about this many labelled rows at most.
SAMPLE_ROWS = 30_000
TREES, DEPTH, STEP = 30, 4, 0.2
MOST_ENTRIES = 400
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.004, math.log(8)
STEMS = (4, 5, 6)
NEAR = 6
SEED_WORDS = frozenset(
    "idiot idiots moron stupid dumb loser scum trash worthless pathetic disgusting clown bastard imbecile filth vermin "
    "dumm trottel abschaum ekelhaft wertlos arschloch stupide imbécile ordure connard minable estúpido imbécil basura asqueroso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros eres".split()
)
FEATURES = [
    "hits", "hit_density", "distinct_hits", "hit_weight", "best_weight", "stem_hits", "stem_density", "best_stem", "near_second_person", "second_person",
    "capitals", "capital_words", "exclaims", "questions", "obfuscated", "hidden_hits", "stretched", "words",
]
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])[^\W_]*[0-9@$*#.\-_|!+][^\W_][^\s]*")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_STRETCH = re.compile(r"([^\W\d_])\1\1")


@dataclass
class Lexicon:
    """Words and word beginnings with their log odds."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_WORDS, 2.0))
    stems: dict[str, float] = field(default_factory=dict)


def entries(text: str) -> set[str]:
    """Distinct lexicon candidates of a text: words as they are, beginnings marked by ``-``."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def signature(text: str) -> int:
    """Smallest hash of the five-word shingles."""
    words = text.lower().split()
    grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(g) for g in grams) >> 1


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features, in the order of ``FEATURES``."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counted = Counter(words)
    hit = {w: lexicon.words[w] for w in counted.keys() & lexicon.words.keys()}
    hits = sum(counted[w] for w in hit)
    stem_hits, best_stem = 0, 0.0
    if lexicon.stems:
        for w, c in counted.items():
            weight = max((lexicon.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k), default=0.0)
            if weight > 0:
                stem_hits += c
                best_stem = max(best_stem, weight)
    second = sum(counted[w] for w in counted.keys() & SECOND_PERSON)
    near = 0
    if hits and second:
        at = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        for i in (i for i, w in enumerate(words) if w in hit):
            k = np.searchsorted(at, i)
            near += any(abs(int(at[j]) - i) <= NEAR for j in (k - 1, k) if 0 <= j < len(at))
    masked = _MASKED.findall(text)
    hidden = 0
    for token in masked:
        plain = "".join(_WORD.findall(token.lower().translate(_LEET)))
        hidden += plain in lexicon.words and token.lower().strip(".,;:!?-\"'()") not in lexicon.words
    capitals = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    tokens = text.split()
    return [
        math.log1p(hits), 100 * hits / n, math.log1p(len(hit)), math.log1p(sum(counted[w] * x for w, x in hit.items())), max(hit.values(), default=0.0),
        math.log1p(stem_hits), 100 * stem_hits / n, best_stem, math.log1p(near), 100 * second / n,
        capitals / len(text), sum(1 for t in tokens if len(t) > 1 and t.isupper()) / len(tokens), text.count("!") / n, text.count("?") / n,
        len(masked) / n, math.log1p(hidden), len(_STRETCH.findall(lower)) / n, math.log1p(n),
    ]


def with_features(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "_features") -> DataFrame:
    """Add the feature vector; only the text goes through Python, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts], index=texts.index, dtype=object)

    return docs.withColumn(name, array_to_vector(made(F.col(text_col).cast("string"))))


def labelled(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, label, part)`` of about ``rows`` labelled documents that ``learn_from`` marks, near copies left out.

    The sample's ids are bounded by ``rows``, so they go to every task.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn_from).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")
    )
    total = known.count()
    place = F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(1 << 20))
    chosen = known.where(place < int(min(1.0, rows / max(total, 1)) * (1 << 20))).groupBy("label_id").agg(
        (F.avg("label") >= 0.5).cast("double").alias("label")
    )
    picked = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = picked.join(F.broadcast(chosen), "label_id").select("text", "label")

    @F.pandas_udf("bigint")
    def signed(texts: pd.Series) -> pd.Series:
        return texts.map(signature)

    distinct = found.withColumn("sign", signed("text")).groupBy("sign").agg(F.min(F.struct("text", "label")).alias("x"))
    cut = F.pmod(F.xxhash64("sign"), F.lit(10))
    return stored(distinct.select("x.text", "x.label", F.when(cut < 5, 0).when(cut < 8, 1).otherwise(2).alias("part")), "toxicity-sample")


def learn_lexicon(sample: DataFrame, most: int = MOST_ENTRIES) -> Lexicon:
    """The seed words and the ``most`` entries with the largest log odds of documents, among frequent enough ones."""
    totals = {bool(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    lexicon = Lexicon()
    if not toxic or not clean:
        return lexicon

    def tally(frames):
        for frame in frames:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(frame["text"], frame["label"]):
                seen[int(label)].update(entries(text))
            for label, counted in seen.items():
                yield pd.DataFrame({"entry": list(counted), "label": label, "n": list(counted.values())})

    counted = sample.select("text", "label").mapInPandas(tally, "entry string, label int, n bigint").groupBy("entry").agg(
        F.sum(F.expr("if(label = 1, n, 0)")).alias("a"), F.sum(F.expr("if(label = 0, n, 0)")).alias("b")
    )
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    strong = counted.where(F.col("a") >= least).withColumn("odds", odds).where(F.col("odds") > LEAST_ODDS)
    best = strong.orderBy(F.desc(F.col("odds") * F.sqrt("a")), "entry").limit(most)  # a bounded lexicon
    for row in best.collect():
        if row["entry"].endswith("-"):
            lexicon.stems[row["entry"][:-1]] = row["odds"]
        else:
            lexicon.words[row["entry"]] = row["odds"]
    return lexicon


@dataclass
class Model:
    """A lexicon, trees and calibration, or a constant share where they could not be learned."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    share: float = 0.0

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """Add the calibrated probability of the toxic label as ``name``, in the place of any such column."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.share))
        packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
        raw = self.trees.transform(with_features(packed, self.lexicon, "_text").drop("_text"))
        scored = self.calibration.transform(raw.withColumn("_margin", vector_to_array("_raw")[1]))
        value = F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0)).alias(name)
        kept = [f"_row.{c}" for c in docs.columns if c != name]
        return scored.select(*kept, value)


def learn(sample: DataFrame) -> Model:
    """Lexicon, trees and calibration from the three parts of a ``labelled`` sample."""
    lexicon = learn_lexicon(sample.where("part = 0"))
    rest = stored(with_features(sample.where("part > 0"), lexicon).select("_features", "label", "part"), "toxicity-features")
    counts = {(r["part"], r["label"]): r["n"] for r in sample.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = sum(n for (_, label), n in counts.items() if label > 0) / total if total else 0.0
    if not all(counts.get((part, label)) for part in (1, 2) for label in (0.0, 1.0)):
        return Model(lexicon, share=share)
    booster = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_class",
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=4, seed=11,
    ).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    trees = booster.fit(rest.where("part = 1"))
    margins = trees.transform(rest.where("part = 2")).select("label", vector_to_array("_raw")[1].alias("_margin"))
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_calibrated").fit(margins)
    return Model(lexicon, trees, calibration, share)


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with ``score`` (0 to 1); labels of rows outside ``learn_from`` (over the id) are not read."""
    model = learn(labelled(docs, labels, learn_from, id_col, text_col, label_col, rows))
    return model.score(docs, text_col)
