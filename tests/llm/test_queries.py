"""The registered training-data queries: names, SQL, and the pipeline's stages."""

import shutil

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from corridor.llm import queries
from corridor.scratch import new_path
from tests.llm.data import clashing_docs, edge_docs, empty_docs
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == []


def test_pipeline_drops_what_its_stages_find(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    found = queries.QUERIES["op3_quality_rules"](spark, FOLDER).where("not kept").collect()
    assert kept and not kept & {r.doc_id for r in found}


@pytest.mark.parametrize("make", [edge_docs, clashing_docs, empty_docs])
def test_stages_on_edges(spark, make, tmp_path):
    folder = str(tmp_path)
    for name in ("labels", "benchmark"):
        shutil.copy(f"{FOLDER}/{name}.parquet", folder)
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert [c for c in out.columns if not c.startswith("mix_")] == [c for c in docs.columns if not c.startswith("mix_")]
        path = new_path(spark, "edge")
        out.write.parquet(path)
        assert spark.read.parquet(path).count() >= 0


