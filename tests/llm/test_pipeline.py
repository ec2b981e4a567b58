"""The stages, each on its own input."""

import os
import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.helpers import DOCS, linked_groups, near_copies

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.exceptAll(docs).count() == 0
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "word " * 60_000, "en", None, None),
            (4, "a plain little text", "en", None, None), (4, "a plain little text", "en", None, None), (None, "b c d", None, None, 1)]
    df = spark.createDataFrame([(*r, 1.0, "x", 3) for r in rows], DOCS + ", score double, lang_pred string, predicted int")
    out = stage(spark, df, SF)
    if name != "packing":
        assert out.columns == df.columns
    assert out.count() >= 1 or name == "quality"
    assert stage(spark, df.limit(0), SF).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(random.Random(11))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, df, SF).collect()}
    assert kept == {d for d, (_, group) in linked_groups(rows, 5, 80).items() if d == group}


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "en", "s", 1)] * 3 + [(None, "x", "en", "s", 1)] * 2, DOCS)
    assert sorted((r["doc_id"] or 0) for r in pipeline.near_duplicates(spark, df, SF).collect()) == [0, 0, 5]


def test_texts_that_share_an_id_are_decided_one_by_one(spark):
    copy, own = "one two three four five six seven", "quite another text of a few words"
    rows = [(1, copy, "en", "s", 1), (2, copy, "en", "s", 1), (2, own, "en", "s", 1), (2, own, "en", "s", 1), (3, None, None, None, None),
            (3, "", None, None, None), (None, copy, "en", "s", 1)]
    df = spark.createDataFrame([(*r, {"k": 1}) for r in rows], DOCS + ", extra map<string,int>")
    out = pipeline.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    kept = sorted(((r["doc_id"] or 0), r["text"] or "") for r in out.collect())
    assert kept.count((2, own)) == 1 and (2, copy) not in kept and (1, copy) in kept and (0, copy) in kept
