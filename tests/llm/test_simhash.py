"""SimHash against its definition and against all pairs."""

import random

import pytest
import xxhash

from corridor.llm import simhash
from tests.llm.data import clashing_docs, edge_docs, empty_docs, words


def by_definition(text, shingle=3):
    parts = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + shingle]) for i in range(len(parts) - shingle + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", [None, "", "  ", "one", "one two", "One TWO three", "a b c d e f a b c", "Ü É straße 😀 x y", "x " * 300])
def test_fingerprint(text):
    assert simhash.simhash(text.encode() if text is not None else None) == by_definition(text)


def components_by_pairs(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= radius:
                parent[root(i)] = root(j)
    lowest = {}
    for i in range(len(prints)):
        lowest[root(i)] = min(i, lowest.get(root(i), i))
    return {i: lowest[root(i)] for i in range(len(prints))}


@pytest.mark.parametrize(("radius", "crowd"), [(3, 512), (3, 4), (2, 4), (1, 2), (4, 4)])
def test_components_equal_all_pairs(spark, radius, crowd):
    rng = random.Random(radius * 31 + crowd)
    prints = []
    for _ in range(12):  # clusters, chains and copies around random centres
        centre = rng.getrandbits(64)
        for _ in range(18):
            value = centre
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
                value ^= 1 << bit
            prints.append(value)
            if rng.random() < 0.3:
                centre = value
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.near_components(frame, "doc_id", radius, crowd).collect()}
    assert found == components_by_pairs(prints, radius)


def test_edges(spark):
    rows = simhash.near_components(simhash.fingerprints(edge_docs(spark))).collect()
    assert len(rows) == 8
    found = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert found[1] == (0, 1) and found[2] == (0, 1) and found[3] == (0, 1)
    assert [r.component_id for r in rows if r.doc_id == 5] == [5, 5]
    assert found[None][1] is None
    assert simhash.near_components(simhash.fingerprints(empty_docs(spark))).collect() == []


@pytest.mark.parametrize("make", [edge_docs, clashing_docs])
def test_deduplicate(spark, make):
    docs = make(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]  # 1, 2 and 3 have no word
    assert simhash.deduplicate(empty_docs(spark)).count() == 0


def test_one_large_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(300):
        text = list(base)
        text[i % 400] = f"other{i}"
        rows.append((i, " ".join(text)))
    rows.append((300, " ".join(f"far{i}" for i in range(400))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs)
    values = {r.doc_id: r.fp & (1 << 64) - 1 for r in prints.collect()}
    found = {r.doc_id: r.component_id for r in simhash.near_components(prints, crowd=16).collect()}
    assert found == components_by_pairs([values[i] for i in range(301)], 3)


def test_deduplicate_by_row_not_by_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(None, text), (None, text), (None, other), (7, third), (7, other), (7, "unrelated words under the same id")], "doc_id long, text string"
    )
    kept = sorted((str(r.doc_id), r.text) for r in simhash.deduplicate(docs).collect())
    assert kept == sorted([("None", text), ("7", third), ("7", other), ("7", "unrelated words under the same id")])


def test_deduplicate_keeps_the_smallest_id_of_each_component(spark):
    rng = random.Random(8)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(150):  # copies with one word changed; the row order is not the id order
        text = list(base)
        text[rng.randrange(300)] = f"other{i}"
        rows.append((500 - 3 * i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"t{i}x{k}" for k in range(40))) for i in range(20)] + [(None, " ".join(base)), (1001, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    values = [by_definition(t) & (1 << 64) - 1 for _, t in rows]
    component = components_by_pairs(values, simhash.RADIUS)
    best = {}
    for at, (number, _) in enumerate(rows):
        key = (number is None, number or 0, at)
        best[component[at]] = min(key, best.get(component[at], key))
    wanted = sorted(str(rows[at][0]) for _, _, at in best.values())
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect()) == wanted
