"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target of words. Its documents lie in a fixed random order
(a hash of the id), cut into blocks. The mix draws whole passes over the source
and then the first blocks of one more pass, the last document cut so that the
target is met to the word. The numbers of blocks drawn, one quota per source, are
divided among the output shards by a binary tree: each node gives half of its
blocks to either child, as if all its blocks had been shuffled, so the children's
quotas follow a multivariate hypergeometric distribution and always add up. Each
shard then takes its own range of every source's block sequence and is shuffled
by itself.

Only tables with a row per source, per block and per (source, shard) are
aggregated; a source that holds most rows is spread over its blocks. All of it
is DataFrame expressions.

Rows that share an id share a place; where they overfill a block it is cut on into
runs of about a block's words, so blocks and shards stay bounded whatever repeats.

Defined cases: null texts have no words; a null source is a source of its own,
ordered last; rows with a null id are ordered by their text, rows of
one id by their size and text; equal rows are drawn one by one; a source without words has target 0; empty tables give empty
results. Columns of the documents that bear a name of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.llm.common import text_of, word_count
from corridor.operators.frames import join_small, join_unique
from corridor.scratch import stored

WEIGHTS = (5.0, 2.0, 1.0)
RATIO = 1.5
CAP = 2.0
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SEED = 17
GROUP = 256
RESULT = ["size", "source_size", "target", "taken"]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, source, size, at, key, tie)``: the row as a struct, its words, its place in [0, 1) of the source's order, and what orders rows of one place."""
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{SEED}")).cast("binary")), 1, 12)
    return docs.select(
        F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("source"),
        word_count(text_of(text_col)).alias("size"),
        (F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))).alias("at"),
        F.col(id_col).cast("string").alias("key"), F.xxhash64(text_of(text_col)).alias("tie"),
    )


def targets(rows: DataFrame, weights: tuple = WEIGHTS, ratio: float = RATIO, cap: float = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: ``sid, source, docs, source_size, target, quota, passes, rest, n_blocks``.

    Weights repeat over the sources in code-point order, null last. Targets stop
    at ``cap`` times the size and the excess is shared again by weight until none
    is above: that is the one level at which ``min(cap * size, level * weight)``
    adds up to ``ratio`` times all words. The windows run over one row per source.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy()
    ranked = (
        totals.withColumn("sid", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(listed, (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(float(ratio)))
        .withColumn("all_weight", F.sum("weight").over(whole))
    )
    before = Window.orderBy("full_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level).withColumn(
        "level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")),
                          F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid"))).over(whole)
    )
    aimed = leveled.withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
    quota = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return aimed.select(
        "sid", "source", "docs", "source_size", "target", quota.alias("quota"),
        F.floor(quota / size).cast("long").alias("passes"), (quota % size).alias("rest"),
        F.ceil((F.col("source_size") + F.col("docs")) / F.lit(float(block_words))).cast("long").alias("n_blocks"),
    )


def _running(df: DataFrame, base: list[str], levels: list[list[str]], values: list[str]) -> DataFrame:
    """Add ``<value>_before``: the sum over the rows of the same ``base`` that come earlier in the order of all ``levels``.

    The sums are taken level by level, so a window holds only what differs in its own
    level. No column may be null.
    """
    sums = {f"{v}_before": F.sum(v) for v in values}
    upper = [*base, *[c for level in levels[:-1] for c in level]]
    window = Window.partitionBy(*upper).orderBy(*levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({name: F.coalesce(value.over(window), F.lit(0)) for name, value in sums.items()})
    if len(levels) == 1:
        return inside
    above = _running(df.groupBy(*upper).agg(*[F.sum(v).alias(v) for v in values]), base, levels[:-1], values)
    carried = above.select(*upper, *[F.col(name).alias(f"_{name}") for name in sums])
    joined = inside.join(carried, upper)
    return joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).select(*df.columns, *sums)


def _cut(placed: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``sub``, blocks): blocks that hold far more than their share are cut into runs of about ``block_words``.

    A block's share is exceeded where an id repeats: all its rows have one place. Such
    a block is ordered on by size, id, text and, for equal rows, a written number, and
    its rows and words before are summed in those levels; all other blocks have ``sub`` 0.

    The blocks are ``sid, block, sub, words, passes, rest`` and, from the start of the source,
    ``words_before, one_before``. They are summed from the rows once and written, so the running
    sums do not plan the reading of the rows once per level; the levels of ``sub`` are left out
    where it is 0 everywhere.
    """
    weight = F.sum(F.col("size") + 1)
    totals = [F.sum("size").alias("words"), F.max("passes").alias("passes"), F.max("rest").alias("rest")]
    whole = F.lit(0).cast("long").alias("sub")
    blocks = stored(placed.groupBy("sid", "block").agg(*totals, weight.alias("held")), "mix-sums")
    columns = ["sid", "block", "sub", "words", "passes", "rest"]
    crowded = blocks.where(F.col("held") > 4 * block_words).select("sid", "block")
    if crowded.isEmpty():
        return placed.select("*", whole), _before(blocks.select("*", whole).select(*columns), [["blocks_4096"], ["block"]])
    crowded = stored(crowded, "mix-crowded")
    calm = join_small(placed, crowded, ["sid", "block"], "left_anti").select("*", whole)
    hot = join_small(placed, crowded, ["sid", "block"], "left_semi").select(
        *placed.columns, F.concat(F.col("key").isNotNull().cast("string"), F.coalesce("key", F.lit(""))).alias("name"),
        F.shiftright("tie", 52).alias("high"), F.monotonically_increasing_id().alias("copy"),
    )
    hot = stored(hot.withColumn("salt", F.shiftright("copy", 12)), "mix-hot")
    levels = [["at", "size", "name"], ["high"], ["tie"], ["salt"]]
    keys = ["sid", "block", *[c for level in levels for c in level]]
    held = stored(hot.groupBy(*keys).agg(weight.alias("held")), "mix-places")
    held = stored(_running(held, ["sid", "block"], levels, ["held"]).select(*keys, "held_before"), "mix-held")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("copy")) - 1
    ordered = hot.withColumn("number", number).join(held, keys)
    sub = F.floor((F.col("held_before") + F.col("number") * (F.col("size") + 1)) / block_words).cast("long")
    runs = ordered.withColumn("sub", sub).select(*calm.columns)
    kept = join_small(blocks, crowded, ["sid", "block"], "left_anti").select("*", whole).select(*columns)
    blocks = stored(kept.unionByName(runs.groupBy("sid", "block", "sub").agg(*totals).select(*columns)), "mix-runs")
    return calm.unionByName(runs), _before(blocks, [["blocks_4096"], ["block"], ["subs_4096"], ["sub"]])


def _before(blocks: DataFrame, levels: list[list[str]]) -> DataFrame:
    """The blocks with the words and the number of blocks before them in their source, written."""
    marked = blocks.withColumns(
        {"one": F.lit(1).cast("long"), "blocks_4096": F.shiftright("block", 12), "subs_4096": F.shiftright("sub", 12)}
    )
    return stored(_running(marked, ["sid"], levels, ["words", "one"]).drop("one", "blocks_4096", "subs_4096"), "mix-blocks")


def _hypergeometric(population: str, successes: str, draws: str, uniform: str) -> str:
    """SQL for a hypergeometric draw by inversion.

    The support is cut at 12 standard deviations (plus 12) on either side of the
    mode; what lies beyond has a probability under 1e-30.
    """
    p, k, n = (f"cast({x} as double)" for x in (population, successes, draws))
    spread = f"cast(ceil(12 * sqrt({n} * ({k} / {p}) * (1 - {k} / {p}))) as bigint) + 12"
    mode = f"cast(floor(({n} + 1) * ({k} + 1) / ({p} + 2)) as bigint)"
    low = f"greatest(0L, {draws} + {successes} - {population}, {mode} - ({spread}))"
    high = f"least({draws}, {successes}, {mode} + ({spread}))"
    ratio = f"({k} - (i - 1)) * ({n} - (i - 1)) / (i * ({p} - {k} - {n} + i))"
    # probabilities relative to the lowest value of the support, added up twice: for the total and up to the draw
    chance = f"if(m.last = 0, 1D, m.last * {ratio})"
    total = (
        f"aggregate(sequence({low}, {high}), named_struct('last', 0D, 'sum', 0D), "
        f"(m, i) -> named_struct('last', {chance}, 'sum', m.sum + {chance})).sum"
    )
    passed = (
        f"aggregate(sequence({low}, {high}), named_struct('last', 0D, 'sum', 0D, 'passed', 0L), (m, i) -> named_struct("
        f"'last', {chance}, 'sum', m.sum + {chance}, 'passed', m.passed + if(m.sum + {chance} < {uniform} * whole, 1L, 0L))).passed"
    )
    return (
        f"if({population} <= 0 or {successes} <= 0 or {draws} <= 0, 0L, if({draws} >= {population}, {successes}, "
        f"least({high}, {low} + aggregate(array({total}), 0L, (z, whole) -> {passed}))))"
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``(sid, shard, blocks)``: quotas ``(sid, blocks)`` divided among ``shards`` (a power of two).

    A node of the tree is a row for each ``group`` sources, with one quota per source.
    Its left child gets half of its blocks: source by source, a hypergeometric number
    of what is left. More sources than one group holds are first drawn as groups, by a
    tree of their own; a group's own draw then starts from the number its tree gives.
    """
    levels = max(shards - 1, 0).bit_length()
    if not levels:
        return quotas.select("sid", F.lit(0).cast("long").alias("shard"), "blocks")
    bucket = F.floor(F.col("sid") / group).cast("long")
    groups = None
    if (quotas.agg(F.max("sid")).first()[0] or 0) >= group:
        upper = quotas.groupBy(bucket.alias("sid")).agg(F.sum("blocks").alias("blocks"))
        groups = stored(split_quotas(upper, shards, seed + 1, group), "mix-groups")
    node = quotas.groupBy(bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("sid", "blocks"))).alias("q"))
    node = node.select(F.lit(0).cast("long").alias("node"), "bucket", "q")
    uniform = f"(pmod(xxhash64({seed}L, node, depth, x.sid), 9007199254740992L) / 9007199254740992D)"
    draw = _hypergeometric("s.pool", "x.blocks", "s.draws", uniform)
    left = (
        "aggregate(q, named_struct('pool', total, 'draws', draws, 'out', cast(array() as array<bigint>), 'got', 0L), "
        f"(s, x) -> aggregate(array({draw}), s, (t, g) -> named_struct('pool', t.pool - x.blocks, 'draws', t.draws - g, "
        "'out', concat(t.out, array(g)), 'got', g))).out"
    )
    for depth in range(levels):
        whole = node.withColumn("depth", F.lit(depth)).withColumn("total", F.expr("aggregate(q, 0L, (t, x) -> t + x.blocks)"))
        if groups is None:
            split = whole.withColumn("draws", F.expr("total div 2"))
        else:
            child = F.shiftright("shard", levels - depth - 1)
            lefts = groups.where(child % 2 == 0).groupBy(F.col("sid").alias("bucket"), F.shiftright(child, 1).alias("node")).agg(
                F.sum("blocks").alias("draws")
            )
            split = whole.where("total > 0").join(lefts, ["bucket", "node"], "left").fillna(0, ["draws"])
        halves = F.expr(
            "array(named_struct('node', 2 * node, 'q', transform(q, (x, i) -> named_struct('sid', x.sid, 'blocks', left[i]))), "
            "named_struct('node', 2 * node + 1, 'q', transform(q, (x, i) -> named_struct('sid', x.sid, 'blocks', x.blocks - left[i]))))"
        )
        node = split.withColumn("left", F.expr(left)).select("bucket", F.explode(halves).alias("half")).select("half.node", "bucket", "half.q")
    return node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("x.sid", "shard", "x.blocks")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add a source's values to its rows; rows of a source that holds many are not shuffled by it."""
    name = F.concat(F.col("source").isNotNull().cast("string"), F.coalesce("source", F.lit(""))).alias("_name")
    side = sources.select(name, *[c for c in sources.columns if c not in ("source", "docs")])
    counts = sources.select(name, F.col("docs").alias("_n"))
    return join_unique(rows.select("*", name), side, ["_name"], "inner", counts).drop("_name")


def allocate(
    rows: DataFrame, weights: tuple = WEIGHTS, ratio: float = RATIO, cap: float = CAP,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """The ``sized`` rows with ``source_size, target, draws``.

    ``draws`` lists what the mix takes of a row: ``(pass, shard, words)``, with
    fewer words than the row has only where the target cuts its source's last
    row. Rows that are not taken have an empty list.
    """
    spark = rows.sparkSession
    sources = stored(targets(rows, weights, ratio, cap, block_words), "mix-sources")
    placed, blocks = _cut(_with_source(rows, sources).withColumn(
        "block", F.least(F.floor(F.col("at") * F.col("n_blocks")), F.col("n_blocks") - 1).cast("long")
    ), block_words)
    counted = blocks.groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("words_before") < F.col("rest")).alias("more"), F.max("passes").alias("passes")
    )
    quotas = stored(counted.select("sid", "n", (F.col("passes") * F.col("n") + F.col("more")).alias("blocks")), "mix-quotas")
    taken = sources.agg(F.sum("quota")).first()[0] or 0
    shards = 1
    while shards * shard_words < taken:
        shards *= 2
    tree = split_quotas(quotas.select("sid", "blocks"), shards, seed)
    ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = tree.withColumn("first", F.coalesce(F.sum("blocks").over(ahead), F.lit(0))).where("blocks > 0")
    ordinals = ranges.select("sid", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("ordinal"))
    numbered = blocks.join(quotas.select("sid", "n"), "sid").select(
        "sid", "block", "sub",
        F.explode(F.expr("sequence(0L, if(words_before < rest, passes, passes - 1))")).alias("pass"),
        "words_before", "one_before", "n", "passes",
    ).where("pass >= 0 and pass <= passes").withColumn("ordinal", F.col("pass") * F.col("n") + F.col("one_before"))
    # blocks that are not drawn have no row here
    plan = stored(
        numbered.join(ordinals, ["sid", "ordinal"]).groupBy("sid", "block", "sub").agg(
            F.max("words_before").alias("words_before"), F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn")
        ), "mix-plan",
    )
    before = Window.partitionBy("sid", "block", "sub").orderBy("at", "size", "key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(plan, ["sid", "block", "sub"], "left").withColumn(
        "past", F.col("words_before") + F.coalesce(F.sum("size").over(before), F.lit(0))
    )
    part = "greatest(0L, least(size, rest - past))"
    draws = F.expr(
        f"filter(transform(coalesce(drawn, array()), d -> named_struct('pass', d.pass, 'shard', d.shard, "
        f"'words', if(d.pass < passes, size, {part}))), d -> d.words > 0)"
    )
    return joined.select("row", "source", "size", "at", "key", "tie", "source_size", "target", draws.alias("draws"))


def taken_words() -> Column:
    return F.expr("aggregate(draws, 0L, (t, d) -> t + d.words)")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: a row per draw, with the document's columns and ``mix_shard, mix_position, mix_pass, mix_words``.

    Rows of a shard are numbered in an order shuffled inside the shard; shards
    hold about ``shard_words`` words each, so that a shard is one bounded task.
    """
    names = ["mix_shard", "mix_position", "mix_pass", "mix_words"]
    rows = allocate(sized(docs, id_col, text_col, source_col), **options)
    drawn = rows.select("row", "at", "key", "tie", "size", F.explode("draws").alias("d"))
    order = Window.partitionBy("d.shard").orderBy(F.xxhash64("at", "key", "tie", "d.pass"), "at", "key", "size", "tie", "d.pass")
    placed = drawn.withColumn("position", F.row_number().over(order) - 1)
    kept = [f"row.{c}" for c in docs.columns if c not in names]
    return placed.select(
        *kept, F.col("d.shard").alias(names[0]), F.col("position").cast("long").alias(names[1]),
        F.col("d.pass").alias(names[2]), F.col("d.words").alias(names[3]),
    )
