"""Language identification: model properties, held-out accuracy, edges."""

import numpy as np
from pyspark.sql import functions as F

from corridor.llm import langid
from tests.llm.data import clashing_docs, edge_docs, empty_docs


def test_probabilities_add_up(spark):
    """After any context the probabilities of all characters of the alphabet add up to one."""
    rows = [("en", "the theme of the hat", False), ("de", "der hut und das haus", False), ("en", "that hat", False)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string, held boolean"), order=3)
    for context in ("th", "zz", " h", "d "):
        points = [ord(c) for c in context]
        ends = np.arange(1, langid.ALPHABET, 1, dtype=np.uint64)
        known = np.unique(model.keys[0])
        total = np.zeros(len(model.languages))
        for point in known:
            total += 2.0 ** -model._bits(np.array([*points, point], np.uint64), 2)
        unseen = next(e for e in ends if e not in known)
        total += (langid.ALPHABET - len(known)) * 2.0 ** -model._bits(np.array([*points, unseen], np.uint64), 2)
        assert np.allclose(total, 1.0, atol=1e-6)


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, F.col("doc_id") % 4 != 2, rows=200).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2")
    right, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.98 and rejected < 0.1


def test_long_texts_are_read_whole():
    assert len(langid.codes("ab, c--d")) == len(" ab c d ")
    long = "é" * (langid.PIECE + 10)
    assert len(langid.codes(long)) == len(long) + 2


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        rows = langid.identify(docs, F.lit(True)).collect()
        assert len(rows) == 8
        told = {r.doc_id: (r.lang_pred, r.score) for r in rows}
        assert told[1] == told[2] == told[3] == ("und", 0.0)
        assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in rows)
    assert {r.lang_pred for r in langid.identify(edge_docs(spark), F.lit(False)).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), F.lit(True)).count() == 0


def test_only_letters_of_any_plane_count():
    for text in ("\U0001F600 \U0001F600!", "\U0001F1E9\U0001F1EA", "12 %", "", None):
        assert not len(langid.codes(text))
    assert langid.codes("\U00020000").tolist() == [32, 0x20000, 32] and langid.codes("a\U0001F600b").tolist() == [32, 97, 32, 98, 32]
