"""License scan against all blocks and templates."""

import random
import re

from corridor.llm import licenses
from tests.llm.data import clashing_docs, edge_docs, empty_docs

TEMPLATES = {"t1": "a b c d e", "t2": "c d e f g h i j", "t3": "a a b", "t4": "x y z w v u t s r q p o"}


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def contained(text, templates, threshold):
    out = set()
    for n, line in enumerate((text or "").split("\n")):
        have = set(tokens(line))
        for label, template in templates.items():
            need = set(template.split())
            if len(have & need) >= threshold * len(need) - 1e-9 and have & need:
                out.add((n, label, round(len(have & need) / len(need), 9)))
    return out


def test_join_equals_all_pairs(spark):
    rng = random.Random(4)
    letters = "a b c d e f g h i j o p q r s t u v w x y z the of and".split()
    texts = ["\n".join(" ".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        found = {r.doc_id: {(b.block, b.label, round(b.containment, 9)) for b in r.blocks} for r in licenses.scan(docs, templates=TEMPLATES, threshold=threshold).collect()}
        assert found == {i: contained(t, TEMPLATES, threshold) for i, t in enumerate(texts)}


def test_places(spark):
    texts = [
        "Under the MIT license, under the mit\nLICENSE!", "cc by nc cc by nc", "CC-BY-NC 4.0 x Apache License, Version 2.0", "under the mit licenses",
        "sunder the mit license", "", None, "é under the mit license é",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        w = tokens(text)
        places = [(at, label) for phrase, label in licenses.PHRASES.items() for at in range(len(w)) if w[at : at + len(phrase.split())] == phrase.split()]
        spots = [p for p, _ in places]
        assert found[i] == (len(w), len(places), min(spots, default=None), max(spots, default=None), sorted({x for _, x in places}))


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        rows = licenses.scan(docs).collect()
        assert len(rows) == 8 and all(r.score == 0 and r.labels == [] for r in rows)
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_wrapped_notices_by_runs(spark):
    filler = "some other words stand here and there in between " * 12
    wrapped = {
        "gpl-redistribute": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
        "bsd-redistribution": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    }
    scattered = "released " + filler + "under the " + filler + "mit " + filler + "license"
    texts = [filler + "\n" + text + "\n" + filler for text in wrapped.values()] + [scattered, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.scan(docs, by_runs=True).collect()}
    for i, label in enumerate(wrapped):
        assert label in found[i]
    assert found[3] == found[4] == found[5] == []
