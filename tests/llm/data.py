"""Documents and helpers for the operators' tests."""

import re

BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = SCHEMA + ", row string, size long, score string, kept string, fp long, mix_shard string, count long, label string"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "b", len(LONG)),
    (5, "same words in this text and a few more of them here", "en", "b", 1),
    (5, "same words in this text and a few more of them here", "en", "b", 1),
    (None, "a text without an id but with enough words to be kept by the rules", "en", None, 2),
    (6, "Ünïcode Ælfric 😀 ÉCOLE über straße", "de", "ä", 3),
]


def words(text):
    return [w for w in BLANK.split(text or "") if w]


def edge_docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def clashing_docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2, "s", 3, "l") for r in EDGES], CLASHING)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
