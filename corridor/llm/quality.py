"""Quality rules: base limits and a learned decision list, all as Spark expressions.

``measure`` adds the statistics of every whole text. ``learn`` grows and prunes
threshold conjunctions by sequential covering (as in RIPPER) from the binned
statistics of a bounded sample of labelled rows; each step is one small
aggregate. ``decide`` emits the ordered rules as one conditional expression.

Defined cases: a null text has no words; a text of under ten words fails the
base limits; without usable labels the list is empty and the base limits decide;
a document that is labelled more than once counts once, with its mean label.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import BLANKS, text_of, words
from corridor.scratch import stored

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 10, 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims"]
#: Features of the rules, as SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "capital_rate": "n_capitals / greatest(word_chars, 1)",
    "exclaim_rate": "n_exclaims / greatest(n_words, 1)",
}
#: The learning sample holds about this many labelled rows at most.
SAMPLE_ROWS = 20_000
CUTS = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
LEAST_COVER, LEAST_PRECISION = 8, 0.75


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, <statistics>)``: the document as a struct and its statistics as longs.

    Repeated windows are found inside the row: window hashes are made distinct,
    and only texts in which some are equal sort them with their places; the words
    that the repeated windows cover then follow from the gaps between places.
    Each step is a lambda's argument and so is computed once, wherever the
    statistic is moved to by the optimizer.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    split = docs.select(F.struct(*docs.columns).alias("row"), text_of(text_col).alias("text")).select(
        "row", "text", words(text).alias("w"), lines.alias("lines")
    )
    at = ", ".join(f"h[i + {k}]" if k else "h[i]" for k in range(WINDOW))
    windows = f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({at}))"
    ordered = "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    places = "sort_array(transform(filter(o, (x, j) -> x.h <=> get(o, j - 1).h or x.h <=> get(o, j + 1).h), x -> x.i))"
    covered = f"aggregate(sequence(0, size(p) - 1), 0L, (t, k) -> t + least({WINDOW}, coalesce(get(p, k + 1) - get(p, k), {WINDOW})))"
    repeated = (
        f"if(size(w) <= {WINDOW}, 0L, aggregate(array(transform(w, x -> xxhash64(x))), 0L, (a, h) -> "
        f"aggregate(array({windows}), 0L, (b, windows) -> if(size(array_distinct(windows)) = size(windows), 0L, "
        f"aggregate(array({ordered}), 0L, (c, o) -> aggregate(array({places}), 0L, (d, p) -> {covered}))))))"
    )
    return split.select(
        "row", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")


@dataclass
class Rule:
    """A conjunction of ``(feature, '>' or '<=', threshold)`` that rejects what it covers, with its precision on pruning rows."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    precision: float = 0.0

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {value!r}D" for f, op, value in self.conditions)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, bad, part)`` of a sample of about ``rows`` labelled ids, picked by hash; part 0 is for pruning.

    The sample's ids are bounded by ``rows``, so they go to every task and the
    documents are not shuffled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")
    )
    total = known.count()
    share = min(1.0, rows / total) if total else 1.0
    place = F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(1 << 20))
    sample = (
        known.where(place < int(share * (1 << 20))).groupBy("label_id").agg((F.avg("label") < 0.5).alias("bad"))
        .withColumn("part", F.pmod(F.xxhash64("label_id", F.lit(4)), F.lit(3)))
    )
    picked = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    return picked.join(F.broadcast(sample), "label_id").select("text", "bad", "part")


def learn(sample: DataFrame) -> list[Rule]:
    """Rules from a ``labelled`` sample, most certain coverage first.

    Every feature is binned at its quantiles. A rule grows by the condition with
    the largest FOIL gain on the growing rows it still covers, is pruned to the
    prefix that does best on the pruning rows, and stays if it is precise enough
    there; the rows it covers then leave.
    """
    measured = measure(sample).selectExpr(
        "row.bad as bad", "row.part as part", *[f"{sql} as {name}" for name, sql in FEATURES.items()]
    )
    measured = stored(measured, "quality-sample")
    steps = [i / CUTS for i in range(1, CUTS)]
    row = measured.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(row[f] or [])) for f in FEATURES}
    bins = [F.expr(" + ".join([f"cast({f} > {c!r}D as int)" for c in cuts[f]]) or "0").alias(f) for f in FEATURES]
    counts = stored(
        measured.select("bad", "part", *bins).groupBy("bad", "part", *FEATURES).agg(F.count(F.lit(1)).alias("n")), "quality-bins"
    )
    left, rules = "true", []

    def tally(where: str) -> dict:
        """Rows per (feature, bin, bad) among the growing rows that satisfy ``where``."""
        unpivoted = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
        grouped = counts.where(f"part <> 0 and ({where})").select("bad", "n", unpivoted).groupBy("x.f", "x.b", "bad").agg(F.sum("n").alias("n"))
        return {(r["f"], r["b"], r["bad"]): r["n"] for r in grouped.collect()}  # features x bins x 2 rows at most

    while len(rules) < MAX_RULES:
        conditions: list[tuple[str, str, int]] = []
        covered = left
        while len(conditions) < MAX_CONDITIONS:
            found = tally(covered)
            any_f = next(iter(FEATURES))
            p0 = sum(n for (f, _, bad), n in found.items() if f == any_f and bad)
            n0 = sum(n for (f, _, bad), n in found.items() if f == any_f and not bad)
            if p0 < LEAST_COVER or n0 == 0:
                break
            best = _best_condition(found, cuts, p0, n0)
            if best is None:
                break
            conditions.append(best)
            covered = f"{covered} and {best[0]} {best[1]} {best[2]}"
        if not conditions:
            break
        prefixes = [" and ".join(f"{f} {op} {b}" for f, op, b in conditions[: k + 1]) for k in range(len(conditions))]
        scored = counts.where(f"part = 0 and {left}").agg(
            *[F.sum(F.expr(f"if({c} and bad, n, 0)")).alias(f"p{k}") for k, c in enumerate(prefixes)],
            *[F.sum(F.expr(f"if({c} and not bad, n, 0)")).alias(f"n{k}") for k, c in enumerate(prefixes)],
        ).first()
        sums = [(scored[f"p{k}"] or 0, scored[f"n{k}"] or 0) for k in range(len(prefixes))]
        best_k = max(range(len(sums)), key=lambda k: ((sums[k][0] - sums[k][1]) / (sums[k][0] + sums[k][1] + 1), -k))
        p, n = sums[best_k]
        if p < LEAST_COVER / 2 or p < LEAST_PRECISION * (p + n):
            break
        kept = conditions[: best_k + 1]
        named = [(f, "<=", cuts[f][b]) if op == "<=" else (f, ">", cuts[f][b - 1]) for f, op, b in kept]
        rules.append(Rule(named, p / (p + n)))
        left = f"{left} and not ({prefixes[best_k]})"
    return rules


def _best_condition(found: dict, cuts: dict, p0: int, n0: int) -> tuple[str, str, int] | None:
    """The bin condition with the largest FOIL gain: ``f >= b`` (above cut b - 1) or ``f <= b`` (not above cut b)."""
    best, gain = None, 1e-9
    start = log2(p0 / (p0 + n0))
    for f, edges in cuts.items():
        p = [found.get((f, b, True), 0) for b in range(len(edges) + 1)]
        n = [found.get((f, b, False), 0) for b in range(len(edges) + 1)]
        for b in range(len(edges)):
            for op, at, pos, neg in ((">=", b + 1, sum(p[b + 1 :]), sum(n[b + 1 :])), ("<=", b, sum(p[: b + 1]), sum(n[: b + 1]))):
                if pos >= LEAST_COVER and (value := pos * (log2(pos / (pos + neg)) - start)) > gain:
                    best, gain = (f, op, at), value
    return best


def decide(rules: list[Rule]) -> Column:
    """The decision list over ``measure``'s statistics: false for what a rule covers, else true."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.expr(rule.sql()), F.lit(False)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(row, <statistics>, base_failed, kept, place)`` for every document; rules are learned from ``labels`` first.

    ``place`` numbers the rows. A filter that mentions it stays above the
    statistics; any other would be pushed into them and compute them once per use.
    """
    rules = learn(labelled(docs, labels, id_col, text_col, rows=rows))
    measured = measure(docs, text_col).withColumn("base_failed", base_failed())
    return measured.withColumn("kept", ~F.col("base_failed") & decide(rules)).withColumn("place", F.monotonically_increasing_id())


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass the base limits and that no rule rejects, with their own columns."""
    return judged(docs, labels, id_col, text_col, rows).where("kept and place >= 0").select("row.*")
