"""Registered queries against their SQL on the smallest tables. TASTEMILL_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tastemill.session import drop_stages

SF = os.environ.get("TASTEMILL_SF", "/root/testdata/sf0.001")
SOME = [
    "x1_sessionize", "x4_ab_effects", "x9_session_starts", "x10_start_pairs", "a7_summarize", "a13_histogram", "s1_read_events",
    "k1_write_user_recs", "jn3_join_last", "w2_leave_last_out_test", "w7_recent_history", "i8_unseen_negatives", "i16_label_encode",
    "c2_user_cf", "l8_similar_items", "r3_recommend_unseen", "m4_ndcg_log3", "m9_serendipity", "l2_gini", "v4_sticky_mixed",
    "v6_item_to_item", "c8_propagate", "x11_effects_report", "l6_mmr_rerank", "l6_listing_relevance", "k6_upsert_serving_table",
    "k8_write_embeddings", "z4_stream_ab_effects", "a11_group_list", "l8_item_cf", "l16_personalised_pagerank", "l17_content_profile", "z3_stream_sessions",
]
NAMES = sorted(entry.queries()) if os.environ.get("TASTEMILL_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(con, df, sql) == ""
    drop_stages(spark)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
