"""Decontamination: subsequences, recall against brute force, edges."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corridor.llm import decontaminate as dc
from tests.llm.data import clashing_docs, edge_docs, empty_docs

ITEM = "item_id long, text string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_lcs(a, b):
    assert dc.lcs_length(a, b) == slow_lcs(a, b)


def planted(seed=3):
    """Items and documents of random words; some hold an item whole, cut, or with words replaced."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.35 else f"w{rng.randrange(4000)}"
    items = [[word() for _ in range(rng.randint(15, 60))] for _ in range(40)]
    docs = []
    for i in range(240):
        body = [word() for _ in range(rng.randint(30, 500))]
        if i % 3 == 0:
            item = list(rng.choice(items))
            kind = i % 9
            if kind == 3:
                item = item[: int(0.85 * len(item))]
            if kind == 6:
                for k in rng.sample(range(len(item)), int(0.15 * len(item))):
                    item[k] = word()
            at = rng.randrange(len(body))
            body[at:at] = item
        docs.append(" ".join(body))
    return [" ".join(i) + "." for i in items], docs


def test_recall_against_brute_force(spark):
    items, docs = planted()
    wanted = set()
    for d, text in enumerate(docs):
        body = dc.words_of(text)
        for i, item in enumerate(items):
            p = dc.words_of(item)
            if len(set(p) & set(body)) < 0.6 * len(set(p)):
                continue
            if any(slow_lcs(p, body[a : a + len(p) + 4]) >= 0.75 * len(p) for a in range(0, max(1, len(body) - len(p) // 2), 3)):
                wanted.add((d, i))
    frame = dc.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), ITEM), items=30)
    found = {(r.doc_id, r.item_id) for r in frame.collect()}
    assert len(wanted) >= 70
    assert len(found & wanted) >= 0.9 * len(wanted)
    assert all(d % 3 == 0 for d, _ in found)  # no clean document


def test_words_spread_by_insertions(spark):
    """Copies of whole passages with other words put between theirs, against the rule itself over the widest region."""
    rng = random.Random(11)
    item = [f"w{i}" for i in range(64)]
    docs = []
    for kept in (40, 42, 48, 56, 64):
        for length in (96, 112, 128):
            for shift in (0, 7, 16, 31):
                body = [f"other{rng.randrange(10**6)}" for _ in range(500)]
                places = sorted(rng.sample(range(length), kept))
                for place, k in zip(places, sorted(rng.sample(range(64), kept))):
                    body[200 + shift + place] = item[k]
                docs.append(" ".join(body))
    wanted = set()
    for d, text in enumerate(docs):
        body = text.split()
        if any(slow_lcs(item, body[a : a + 128]) >= dc.COPIED * 64 for a in range(180, 260, 4)):
            wanted.add(d)
    frame = dc.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], ITEM))
    found = {r.doc_id for r in frame.collect()}
    assert len(wanted) >= 50 and found <= wanted
    assert len(found) >= 0.9 * len(wanted)


def test_blocks_hold_few_passages(spark):
    """Long items come in blocks of their own and are found all the same, one row per document and item."""
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([300, 20, 200, 40, 150, 30])]
    sizes = [len(b) for b in dc.passage_blocks([(str(i), t) for i, t in items], 6)]
    assert sum(sizes) == sum(len(dc.passages(str(i), t)) for i, t in items) and sorted(sizes)[:-1] == [n for n in sorted(sizes)[:-1] if n <= 6]
    docs = [(10 + i, f"before {text} behind") for i, text in items]
    found = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), rank=6).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(10 + i, i) for i, _ in items]


def test_randomised_svd(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((20, 6)) @ rng.standard_normal((6, 30))
    rows = [(i, j, float(dense[i, j])) for i in range(20) for j in range(30)]
    space = dc.randomised_svd(spark.createDataFrame(rows, "passage int, term int, weight double"), 20, 30, 6)
    exact = np.linalg.svd(dense)[2][:6].T
    assert np.allclose(space @ space.T, exact @ exact.T, atol=1e-6)


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, "same words in this text and a few more of them here"),
                                   (4, "same words in this text and a few more of them here"), (None, "entirely unrelated sentence for nobody to find anywhere else")], ITEM)
    for docs in (edge_docs(spark), clashing_docs(spark)):
        rows = dc.find_leaks(docs, bench).collect()
        assert [(r.doc_id, r.item_id) for r in rows] == [(5, 4), (5, 4)]
        kept = dc.clean(docs, bench)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    assert dc.find_leaks(empty_docs(spark), bench).count() == 0
    assert dc.find_leaks(edge_docs(spark), bench.where("false")).count() == 0


def test_clean_by_row_not_by_id(spark):
    item = "a passage that the benchmark holds and that no document of the corpus may hold"
    docs = spark.createDataFrame(
        [(None, item), (None, "a clean text without an id"), (3, item), (3, "a clean text that shares the id of a leaking one"), (4, None)],
        "doc_id long, text string",
    )
    kept = dc.clean(docs, spark.createDataFrame([(1, item)], ITEM)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [
        ("3", "a clean text that shares the id of a leaking one"), ("4", "None"), ("None", "a clean text without an id")]
