"""License scan: phrase places and an exact set-similarity join with templates.

Base: the places where the words of a phrase stand consecutively.

Method: a text block (a line, or a run of words) contains a template if it has at least
``threshold`` of the template's distinct words. All blocks that do are found by
the exact join of prefix filtering. Words are ordered by their frequency in the
whole corpus, rarest first. A block that shares ``a = ceil(threshold * |T|)`` words
with template T shares one of the first ``|T| - a + 1`` words of T, and that word
is among the block's first ``|B| - a + 1`` words (prefix filter); it has at least
``a`` words (length filter); and behind the first shared word enough words are
left on both sides (positional filter). What passes is verified. A block's words
outside all templates cannot be shared, so a block is reduced to its template
words before the join; that changes neither the shared words nor the order.

Templates are a parameter and few: their words go into the expressions, and the
join's template side is a small table. Everything is DataFrame expressions.

Defined cases: a null text has no words; a text without a match has empty labels
and score 0; repeated rows and null ids are scanned row by row; empty tables give
empty results.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm.common import ascii_lower, text_of
from corridor.scratch import stored

#: Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Usual notices, as published with the licenses; labels are this scan's own.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "gpl-3-notice": "licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
}
THRESHOLD = 0.8
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_text(text: Column) -> Column:
    """The words, lower-cased, between single blanks; lines stay apart by ``\\n``."""
    return F.regexp_replace(ascii_lower(text), GAPS_IN_LINE, " ")


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ ]+")).cast("long")


def phrase_places(normal: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """``n_words, n_base, first_word, last_word, base_labels`` from a column of words between single blanks, padded.

    A place is found by the blank before it, so places of one phrase may overlap.
    """
    found = {p: F.regexp_count(normal, F.lit(f" (?={p} )")) for p in phrases}
    any_of = f" (?=(?:{'|'.join(phrases)}) )"
    has = F.regexp_like(normal, F.lit(any_of))
    n_words = _count_words(normal)
    pieces = F.split(normal, any_of)
    labels = F.array(*[F.when(n > 0, F.lit(phrases[p])) for p, n in found.items()])
    return {
        "n_words": n_words,
        "n_base": F.when(has, sum(found.values(), F.lit(0))).otherwise(0).cast("long"),
        "first_word": F.when(has, _count_words(F.get(pieces, F.lit(0)))),
        "last_word": F.when(has, n_words - _count_words(F.element_at(pieces, -1))),
        "base_labels": F.when(has, F.array_sort(F.array_distinct(F.array_compact(labels)))).otherwise(F.array().cast("array<string>")),
    }


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(label, words)``: a template's distinct words."""
    rows = [(label, sorted(set(text.split()))) for label, text in templates.items() if text.split()]
    return spark.createDataFrame(rows, "label string, words array<string>")


def _least(templates: dict[str, str], threshold: float) -> dict[str, int]:
    """Shared words that containment needs, by label; the margin keeps 0.8 * 5 at 4."""
    return {label: max(1, ceil(threshold * len(set(text.split())) - 1e-9)) for label, text in templates.items() if text.split()}


def _vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for text in templates.values() for w in text.split()})


def containing_blocks(blocks: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(rid, block, label, containment)`` for all blocks that contain a template.

    ``blocks`` has ``(rid, block, hits)``, ``hits`` being a block's distinct template words.
    """
    least = _least(templates, threshold)
    vocabulary = _vocabulary(templates)
    counted = blocks.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = {r["word"]: r["n"] for r in counted.collect()}  # at most one row per template word
    ranked = sorted(vocabulary, key=lambda w: (order.get(w, 0), w))
    rank = F.create_map(*[x for i, w in enumerate(ranked) for x in (F.lit(w), F.lit(i))])
    needed = F.create_map(*[x for label, a in least.items() for x in (F.lit(label), F.lit(a))])
    ranks = lambda c: F.array_sort(F.transform(c, lambda w: rank[w]))
    sides = _template_rows(blocks.sparkSession, templates).select("label", ranks(F.col("words")).alias("t"), needed[F.col("label")].alias("a"))
    prefixes = sides.select("label", "t", "a", F.posexplode(F.expr("slice(t, 1, size(t) - a + 1)")).alias("j", "rank"))
    fewest = min(least.values())
    sized = blocks.where(F.size("hits") >= fewest).select("rid", "block", ranks(F.col("hits")).alias("b"))
    heads = sized.select("rid", "block", "b", F.posexplode(F.expr(f"slice(b, 1, size(b) - {fewest} + 1)")).alias("i", "rank"))
    met = heads.join(F.broadcast(prefixes), "rank").where("size(b) >= a and i <= size(b) - a")
    # a pair meets at each shared word of its prefixes; the first one stands for it, and
    # behind that word both sides must still have enough
    first = met.where("element_at(array_intersect(b, t), 1) = rank and 1 + least(size(b) - i - 1, size(t) - j - 1) >= a")
    verified = first.withColumn("shared", F.size(F.array_intersect("b", "t"))).where("shared >= a")
    return verified.select("rid", "block", "label", (F.col("shared") / F.size("t")).alias("containment"))


def _run_hits(words: Column, listed: Column, templates: dict[str, str]) -> Column:
    """``(block, hits)`` of overlapping runs of words, twice as long as the longest template and one template apart.

    Every stretch as long as a template lies whole in a run, so line breaks do not matter.
    """
    longest = max((len(text.split()) for text in templates.values()), default=1)
    # the outer transform binds the words once, not for each run
    return F.flatten(F.transform(F.array(words), lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(w) - 1) / longest).cast("int")),
        lambda i: F.struct(i.cast("long").alias("block"), F.array_intersect(F.slice(w, i * longest + 1, F.lit(2 * longest)), listed).alias("hits")))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
         threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, by_runs: bool = False) -> DataFrame:
    """A row per document: ``<id>, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``labels`` and ``base_labels`` are sorted arrays. ``blocks`` lists ``(block,
    label, containment)`` of the lines that contain a template, lines counted from
    0; with ``by_runs`` of the runs of words (see ``_run_hits``), which find a notice
    however its lines are broken. ``score`` is 1 with a base place, else the best containment, else 0. The text
    is read once; a table of the base results and of each line's template words
    goes on, with a row number, so repeated and null ids keep their own results.
    """
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace("normal", "[ \n]+", " ")), F.lit(" "))
    listed = F.array(*[F.lit(w) for w in _vocabulary(templates)])
    hits = _run_hits(F.split(F.trim("flat"), " "), listed, templates) if by_runs else F.transform(F.split("normal", "\n"), lambda line, i: F.struct(
        i.cast("long").alias("block"), F.array_intersect(F.split(F.trim(line), " +"), listed).alias("hits")))
    normal = docs.select(F.col(id_col).alias("id"), normal_text(text_of(text_col)).alias("normal")).withColumn("flat", flat)
    base = stored(normal.select(
        F.monotonically_increasing_id().alias("rid"), "id", *[c.alias(name) for name, c in phrase_places(F.col("flat"), phrases).items()],
        F.filter(hits, lambda h: F.size(h["hits"]) > 0).alias("lines"),
    ), "license-lines")
    blocks = base.select("rid", F.explode("lines").alias("l")).select("rid", "l.block", "l.hits")
    found = containing_blocks(blocks, templates, threshold).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("block", "label", "containment"))).alias("blocks")
    )
    joined = base.drop("lines").join(found, "rid", "left").withColumn(
        "blocks", F.coalesce("blocks", F.expr("cast(array() as array<struct<block:bigint, label:string, containment:double>>)"))
    )
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", "blocks.label")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "blocks",
    )
