"""Toxicity: held-out results and edges."""

from pyspark.sql import functions as F

from corridor.llm import toxicity
from tests.llm.data import clashing_docs, edge_docs, empty_docs, no_labels


def test_features():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {"lowei": 2.0})
    made = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! an id1ot, loweiß soooo 😀", lexicon)))
    assert made["hits"] > 0 and made["near_second_person"] > 0 and made["hidden_hits"] > 0 and made["stem_hits"] > 0
    assert made["stretched"] > 0 and made["capital_words"] > 0 and made["exclaims"] > 0 and made["best_weight"] == 3.0
    assert toxicity.features(None, lexicon) == toxicity.features(" \n", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    few = docs.join(labels.select("doc_id"), "doc_id").select("doc_id", "text")
    scored = toxicity.score(few, labels, F.col("doc_id") % 5 != 0).join(labels, "doc_id").where("doc_id % 5 = 0")
    caught, flagged = scored.agg(
        F.avg(F.when(F.col("toxic") == 1, (F.col("score") >= 0.5).cast("int"))), F.avg(F.when(F.col("toxic") == 0, (F.col("score") >= 0.5).cast("int")))
    ).first()
    assert caught > 0.8 and flagged < 0.02


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        scored = toxicity.score(docs, no_labels(spark), F.lit(True))
        assert [r.score for r in scored.collect()] == [0.0] * 8
        assert set(scored.columns) == {*docs.columns, "score"}
    one_kind = spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(edge_docs(spark), one_kind, F.lit(True)).collect()} == {1.0}
    assert toxicity.score(empty_docs(spark), no_labels(spark), F.lit(True)).count() == 0
