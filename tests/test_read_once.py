"""Steps that several readers share are computed once, and nothing wide travels for rows that drop out later."""

import math

from tastemill.operators import bias as bi
from tastemill.operators import factors as fa
from tastemill.operators import serving as sv
from tastemill.operators import text as tx
from tastemill.plans import q_models, q_properties


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_token_weights_read_written_counts(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, "a c"), (2, "C d"), (None, "a x"), (3, None)], "doc long, text string")
    for weights in (tx.tf_idf, tx.bm25):
        assert "split(" not in plan(weights(docs, "doc"))
    got = {(r["doc"], r["token"]): r["weight"] for r in tx.tf_idf(docs, "doc").collect()}
    # four documents, the one without a number among them; "a" is in three, and document 2 has four tokens in two rows
    expected = {(1, "a"): 2 / 3 * math.log(5 / 4), (1, "b"): 1 / 3 * math.log(5 / 2), (2, "a"): 1 / 4 * math.log(5 / 4),
                (2, "c"): 2 / 4 * math.log(5 / 2), (2, "d"): 1 / 4 * math.log(5 / 2)}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - w) < 1e-12 for k, w in expected.items())
    mean = (3 + 4 + 2) / 3
    ranked = {(r["doc"], r["token"]): r["weight"] for r in tx.bm25(docs, "doc").collect()}
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    assert abs(ranked[2, "c"] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / mean))) < 1e-12


def test_an_anchor_meets_its_list_as_one_row(spark):
    one = "event_id long, user long, track long, history array<struct<track: long, time: double>>"
    events = spark.createDataFrame([(1, 7, 1, [(1, 0.5), (1, 0.2)]), (2, 7, 2, [(2, 0.4), (3, 0.0)]), (3, 8, 9, [(9, 1.0)])], one)
    i2i = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 4, 2), (2, 3, 1), (2, None, 2), (2, 6, 3), (None, 8, 1)], "track long, item long, rank int")
    dense = spark.createDataFrame([(100, 0)], "track long, at long")
    out = sv.recommend_i2i(events, i2i, dense)
    assert "collect_list" in plan(out)
    # a seen item is passed over, of equal ranks the smaller item goes first, an event without neighbours gets any track
    assert {r["event_id"]: (r["anchor"], r["next"]) for r in out.collect()} == {1: (1, 4), 2: (2, 6), 3: (None, 100)}


def test_settings_share_their_numbers(spark, monkeypatch):
    rows = [(u, t, ((u * 7 + t * 3) % 10) / 10) for u in range(20) for t in range(12) if (u + t) % 3]
    calls, numbers = [], fa._numbers
    monkeypatch.setattr(fa, "_numbers", lambda df, column: calls.append(column) or numbers(df, column))
    df = spark.createDataFrame(rows, "user long, track long, time double")
    best, results = fa.tune(df, {"rank": [2, 3], "regParam": [0.05, 0.2]}, maxIter=2)
    assert sorted(calls) == ["track", "track", "user", "user"]  # of the train rows and, for the best setting, of all
    found = {r["setting"]: r["rmse"] for r in results.collect()}
    assert len(found) == 4 and best.model.rank in (2, 3)
    parts = fa.random_split(df, [0.8, 0.2], ["user", "track"], seed=42)
    alone = fa._fit(parts.where("part = 0").drop("part"), rank=3, regParam=0.2, maxIter=2)
    rmse = fa.model_rmse(alone, parts.where("part = 1").drop("part"))
    assert abs(rmse - found["rank=3, regParam=0.2"]) < 1e-6


def test_lists_are_computed_once(spark, monkeypatch):
    recs = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 12, 0.5, 1)], "user long, track long, score double, rank int")
    vec = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0])], "id long, vector array<double>")
    calls = []
    for module in (q_models, q_properties):
        monkeypatch.setattr(module, "candidates", lambda *a: calls.append(a) or (recs, vec))
    got = q_properties.d2_lists(spark, "unused")
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (2, 1, True)]
    assert len(calls) == 1
    plays = spark.createDataFrame([(1, 11), (2, 13)], "user long, track long")
    monkeypatch.setattr(q_properties, "implicit_lists", lambda *a: recs)
    monkeypatch.setattr(q_properties, "interactions", lambda *a: plays)
    got = q_properties.c5_lists(spark, "unused")
    assert "implicit-lists" in "".join(got.inputFiles())
    assert sorted(map(tuple, got.collect())) == [(1, 2, True, 1), (2, 1, True, 0)]


def test_pairs_without_two_vectors_drop_before_vectors_travel(spark):
    side = "id long, vector array<double>, bias double"
    users, items = spark.createDataFrame([(1, [1.0, 2.0], 0.1)], side), spark.createDataFrame([(5, [3.0, 1.0], 0.2)], side)
    pairs = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (None, 5)], "user long, track long")
    out = bi.pair_features(pairs, users, items)
    assert "LeftSemi" in plan(out)
    assert [(r["user"], r["track"], r["product"]) for r in out.collect()] == [(1, 5, 5.0), (1, 5, 5.0)]


def test_blocks_of_a_fit_follow_the_ratings(spark, monkeypatch):
    """Ten blocks of any table held 21.6 million ratings each at 360 times sf0.1."""
    assert [fa._blocks(n) for n in (0, 600_000, 36_000_000, 216_000_000, 10**12)] == [10, 10, 10, 54, 100]
    given, als = [], fa.ALS
    monkeypatch.setattr(fa, "ALS", lambda **params: given.append(params) or als(**params))
    monkeypatch.setattr(fa, "BLOCK_RATINGS", 10)
    df = spark.createDataFrame([(u, t, ((u * 7 + t * 3) % 10) / 10) for u in range(20) for t in range(6)], "user long, track long, time double")
    model = fa.fit_als(df, rank=2, max_iter=1)
    assert (given[0]["numUserBlocks"], given[0]["numItemBlocks"]) == (12, 12)
    assert (model.model.userFactors.count(), model.model.itemFactors.count()) == (20, 6)


def test_profiles_read_written_ratings(spark, monkeypatch):
    """The mean, both biases and the profiles each ran the join of orders and lines and its aggregate."""
    from tastemill.plans import q_serving

    rows = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25), (2, 10, 1.0)], "user long, track long, time double")
    vec = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "id long, vector array<double>")
    given, baseline, means = [], fa.bias_baseline, q_serving.rt.mean_vectors
    monkeypatch.setattr(q_serving, "rated", lambda *a: rows)
    monkeypatch.setattr(q_serving, "vectors", lambda *a: vec)
    monkeypatch.setattr(fa, "bias_baseline", lambda df, *a, **k: given.append(df) or baseline(df, *a, **k))
    monkeypatch.setattr(q_serving.rt, "mean_vectors", lambda df, *a, **k: given.append(df) or means(df, *a, **k))
    users, items = q_serving.profile_factors(spark, "unused")
    assert len(given) == 2 and all("profile-ratings" in "".join(df.inputFiles()) for df in given)
    assert {r["id"]: r["vector"] for r in users.collect()} == {1: [0.5, 0.5], 2: [1.0, 0.0]}
    assert items.count() == 2
