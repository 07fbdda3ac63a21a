from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tickloom.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and returns."""
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "pipeline-test")
        stage(spark, docs, FOLDER).write.parquet(path)
        seen[name] = docs, spark.read.parquet(path)
        docs = seen[name][1]
    return seen


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema == before.schema, name


def test_each_stage_takes_effect(stages):
    count = {name: (before.count(), after.count()) for name, (before, after) in stages.items()}
    assert count["quality rules"][1] < count["quality rules"][0]
    before, after = stages["exact dedup"]
    texts = {re.sub("[ \t-\r]+", " ", r.text) for r in before.collect()}
    assert {re.sub("[ \t-\r]+", " ", r.text) for r in after.collect()} == texts and after.count() == len(texts)
    assert count["near dedup"][1] < count["near dedup"][0]
    before, after = stages["mixing"]
    words = lambda rows: sum(len(re.findall("[^ \t-\r]+", r.text)) for r in rows)
    assert words(after.collect()) == pytest.approx(1.5 * words(before.collect()), rel=0.1)
    before, after = stages["packing"]
    assert after.selectExpr("sum(length)").first()[0] > 0
    sequences = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r["sum(length)"] == 4096 for r in sequences) >= len(sequences) - 12


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    result = entry.queries()["pipeline"](spark, FOLDER)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(result.columns) and result.count() > 0
