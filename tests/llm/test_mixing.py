"""Mixing: targets, quotas and draws."""

from pyspark.sql import functions as F

from corridor.llm import mixing
from tests.llm.data import clashing_docs, edge_docs, empty_docs, words


def targets_by_rounds(sizes, weights=(5.0, 2.0, 1.0), ratio=1.5, cap=2.0):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = ratio * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in full or open_:
            target[s] = cap * sizes[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ -= full or open_
    return target


def test_targets_and_draws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    wanted = targets_by_rounds(sizes)
    mixed = mixing.mix(docs, block_words=300, shard_words=4000)
    drawn = mixed.collect()
    taken = {}
    for r in drawn:
        taken[r.source] = taken.get(r.source, 0) + r.mix_words
        assert 0 < r.mix_words <= len(words(r.text))
    assert {s: round(t) for s, t in wanted.items()} == {s: taken[s] for s in wanted}
    assert len({(r.mix_shard, r.mix_position) for r in drawn}) == len(drawn)
    assert len({(r.doc_id, r.mix_pass) for r in drawn}) == len(drawn)
    shards = {r.mix_shard for r in drawn}
    assert len(shards) > 16
    for s in shards:
        places = sorted(r.mix_position for r in drawn if r.mix_shard == s)
        assert places == list(range(len(places)))
    again = mixing.mix(docs.repartition(7), block_words=300, shard_words=4000)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, drawn), key=str)


def test_tree_keeps_quotas(spark):
    quotas = {0: 1000, 1: 300, 2: 50, 3: 1, 4: 0, 5: 700}
    tree = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "sid int, blocks long"), 16)
    rows = tree.collect()
    sums, shards = {}, {}
    for r in rows:
        assert r.blocks >= 0
        sums[r.sid] = sums.get(r.sid, 0) + r.blocks
        shards[r.shard] = shards.get(r.shard, 0) + r.blocks
    assert sums == quotas
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 1


def test_tree_spreads_like_a_shuffle(spark):
    """Among 256 shards of 39 blocks each, a source of 60 % has the hypergeometric mean and variance."""
    frame = spark.createDataFrame([(0, 6000), (1, 3984)], "sid int, blocks long")
    tree = mixing.split_quotas(frame, 256).where("sid = 0")
    stats = tree.agg(F.avg("blocks").alias("m"), F.var_samp("blocks").alias("v")).first()
    assert abs(stats.m - 6000 / 256) < 1e-9 and 6 < stats.v < 14  # 39 * .6 * .4 = 9.4


def test_edges(spark):
    for docs in (edge_docs(spark), clashing_docs(spark)):
        rows = mixing.allocate(mixing.sized(docs)).withColumn("taken", mixing.taken_words()).collect()
        assert len(rows) == 8
        assert all(r.taken <= 2 * r.size for r in rows)
        assert mixing.mix(docs).columns == [c for c in docs.columns if c != "mix_shard"] + ["mix_shard", "mix_position", "mix_pass", "mix_words"]
        assert mixing.mix(docs).count() > 0
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_one_source_with_equal_documents(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(100)] + [(7, "a b c", "s")], "doc_id long, text string, source string")
    rows = mixing.allocate(mixing.sized(docs), block_words=20, shard_words=50).withColumn("taken", mixing.taken_words()).collect()
    assert sum(r.taken for r in rows) == 455  # 454.5, rounded up


def test_one_id_on_most_rows(spark):
    """60 % of the rows share an id (some with equal texts), more have none: places and shards stay bounded, totals exact, reruns agree."""
    docs = spark.range(5000).selectExpr(
        "case when id % 5 < 3 then 7 when id % 50 = 3 then null else id end as doc_id",
        "case when id % 5 = 0 then 'same old words' when id % 50 = 3 then '' else concat_ws(' ', transform(sequence(0, id % 13), i -> concat('w', id))) end as text",
        "case when id % 4 = 0 then 'b' else 'a' end as source",
    )
    sizes = {r.source: r.n for r in docs.selectExpr("source", "regexp_count(text, '[^ ]+') as w").groupBy("source").agg(F.sum("w").alias("n")).collect()}
    wanted = targets_by_rounds(sizes)
    mixed = mixing.mix(docs, block_words=500, shard_words=3000)
    drawn = mixed.collect()
    taken, shards = {}, {}
    for r in drawn:
        taken[r.source] = taken.get(r.source, 0) + r.mix_words
        shards[r.mix_shard] = shards.get(r.mix_shard, 0) + r.mix_words
    assert {s: round(t) for s, t in wanted.items()} == taken
    assert max(shards.values()) < 3 * 3000
    key = lambda r: (r.doc_id or -1, r.text, r.source, r.mix_pass, r.mix_words, r.mix_shard)
    again = mixing.mix(docs.repartition(5), block_words=500, shard_words=3000).collect()
    assert sorted(map(key, again)) == sorted(map(key, drawn))


def test_tree_of_groups(spark):
    """More sources than a group holds: quotas kept, shards even, and a source spread as by one tree."""
    quotas = {i: 40 + i % 7 for i in range(1, 60)} | {0: 3000}
    frame = spark.createDataFrame(list(quotas.items()), "sid int, blocks long")
    rows = mixing.split_quotas(frame, 32, group=4).collect()
    sums, shards, first = {}, {}, []
    for r in rows:
        assert r.blocks >= 0
        sums[r.sid] = sums.get(r.sid, 0) + r.blocks
        shards[r.shard] = shards.get(r.shard, 0) + r.blocks
        first += [r.blocks] if r.sid == 0 else []
    assert sums == quotas and len(shards) == 32 and max(shards.values()) - min(shards.values()) <= 1
    assert abs(sum(first) / 32 - 3000 / 32) < 1e-9 and 60 < max(first) < 130


def test_few_jobs(spark):
    """Every job and exchange takes memory of the driver, whatever the input: the rows are read once for all blocks, not once per level."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("mix-jobs", "mix")
    try:
        assert mixing.mix(docs).count() > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert len(jobs("mix-jobs")) <= 36
