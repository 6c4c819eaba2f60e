"""Language-model scores against a model counted in plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import lm
from tests.llm.data import clashing_docs, edge_docs, empty_docs, words

TEST, DELETED = "doc_id % 5 = 0", "doc_id % 5 = 1"


def lines(text):
    return [*words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def by_hand(texts, train, held):
    """Counts, EM on the held-out tokens one by one, and scores."""
    full, kept = (Counter(), Counter()), (Counter(), Counter())
    for i in train:
        for counts in (full, kept) if i not in held else (full,):
            t = lines(texts[i])
            counts[0].update(t)
            counts[1].update(zip([None, *t], t))
    n, n_kept = sum(full[0].values()), sum(kept[0].values())
    level = lambda c: min(int(math.log2(c + 1)), lm.LEVELS - 1)

    def parts(counts, total, v, w):
        c = counts[0][v]
        return level(c), (counts[1][v, w] / c if c else 0.0, counts[0][w] / total if total else 0.0, 1 / (len(counts[0]) + 1 if counts is kept else len(full[0]) + 1))

    tokens = [(v, w) for i in held for t in [lines(texts[i])] for v, w in zip([None, *t], t)]
    weights = np.full((lm.LEVELS, 3), 1 / 3)
    seen = [parts(kept, n_kept, v, w) for v, w in tokens]
    for _ in range(lm.ROUNDS if seen else 0):
        sums = np.full((lm.LEVELS, 3), 1e-3)
        for b, p in seen:
            joint = weights[b] * p
            sums[b] += joint / joint.sum()
        weights = sums / sums.sum(axis=1, keepdims=True)
    out = {}
    for i, text in enumerate(texts):
        t = lines(text)
        total = [parts(full, n, v, w) for v, w in zip([None, *t], t)]
        out[i] = (
            len(t), sum(full[0][w] > 0 for w in t), n, sum(math.log10((full[0][w] + 1) / (n + len(full[0]) + 1)) for w in t),
            sum(math.log10(float(weights[b] @ p)) for b, p in total),
        )
    return out


@pytest.mark.parametrize(("chunk_bytes", "range_keys"), [(1 << 22, 2_000_000), (3000, 500)])
def test_scores(spark, chunk_bytes, range_keys):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = [r.text[:1500] for r in rows] + [None, "", "THE the of  unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = [i for i in range(len(texts)) if i % 5]
    expected = by_hand(texts, train, [i for i in train if i % 5 == 1])
    found = {r.doc_id: r for r in lm.score(docs, F.expr(TEST), F.expr(DELETED), chunk_bytes=chunk_bytes, range_keys=range_keys).collect()}
    assert len(found) == len(texts)
    for i, (n_tokens, n_known, total, base, score) in expected.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, total, i % 5 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=0.02, abs=0.05)  # the cells of the EM round to a quarter of a binary order


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        rows = lm.score(docs, F.lit(False), F.lit(False)).collect()
        assert len(rows) == 8 and all(r.score <= 0 for r in rows)
        assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
        assert {r.n_tokens for r in rows if r.doc_id == 4} == {30_001}
    untrained = lm.score(edge_docs(spark), F.lit(True), F.lit(False)).collect()
    assert all(r.score == pytest.approx(r.n_tokens * math.log10(1 / 3)) and r.train_tokens == 0 for r in untrained)
    assert lm.score(empty_docs(spark), F.expr(TEST), F.expr(DELETED)).count() == 0
