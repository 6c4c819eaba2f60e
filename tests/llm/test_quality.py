"""Quality statistics against plain Python; rules on planted and on given labels."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corridor.llm import quality
from tests.llm.data import clashing_docs, edge_docs, empty_docs, no_labels, words


def by_hand(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_statistics(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = ["a b c d e a b c d e a b c d e f", "a a a a a a a", "a b c d e\n\n a b c d e\na b c d e", "x y\nx y\n z", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 10**6)), "doc_id long, text string"))
    docs = docs.unionByName(edge_docs(spark).select("doc_id", "text"))
    texts = [r.text for r in docs.collect()]
    for r in quality.measure(docs).collect():
        assert r.row.text in texts or r.row.text is None
        assert {k: r[k] for k in by_hand("")} == by_hand(r.row.text)


def test_rules_are_learned(spark):
    """Symbol-laden texts are labelled bad; the list finds the threshold and keeps the rest."""
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, " ".join(f"word{(i * 7 + k) % 91}{'###' if bad and k % 2 else ''}" for k in range(40))))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.passing(docs, marks).collect()}
    assert kept == {i for i in range(600) if i % 6}
    rules = quality.learn(quality.labelled(docs, marks))
    assert rules and all(op in (">", "<=") for rule in rules for _, op, _ in rule.conditions)


def test_held_out_accuracy(spark):
    """Rules learned from even ids judge the odd ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.where("doc_id % 2 = 1").select("doc_id", "text")
    found = quality.judged(odd.unionByName(docs.where("doc_id % 2 = 0").select("doc_id", "text")), labels.where("doc_id % 2 = 0"))
    judged = found.select("row.doc_id", "kept", "base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.93


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        kept = quality.passing(docs, no_labels(spark))
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "None"]
    assert quality.passing(empty_docs(spark), no_labels(spark)).count() == 0
