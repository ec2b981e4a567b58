"""Searches that copy no vector per block, sums per chunk of users, small buckets searched together."""

import numpy as np
import pandas as pd
import pytest

from tastemill.operators import inverted as iv
from tastemill.operators import retrieval as rt

VECTORS = "id long, vector array<double>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def points(spark):
    v = np.random.default_rng(5).standard_normal((30, 4))
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], VECTORS)


def test_no_vector_is_copied_per_block(spark, points, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 7)
    monkeypatch.setattr(rt, "ITEM_BLOCK", 5)
    v, df = points
    seen = spark.createDataFrame([(q, i) for q in range(30) for i in range(q % 4)], "query long, item long")
    for found in (rt.knn(df, df, 3, seen=seen), iv.ivf_knn(iv.build(df, 4), df, 3, 4, exact=True)):
        assert "Generate" not in plan(found)
    got = {}
    for r in sorted(rt.knn(df, df, 3, seen=seen).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["item"])
    scores = v @ v.T
    for q in range(30):
        scores[q, : q % 4] = -np.inf
    assert got == {q: list(np.argsort(-scores[q])[:3]) for q in range(30)}


def test_mean_vectors_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(rt, "PAIRS", 4)
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, None]), (2, [5.0, None]), (3, None), (4, [7.0, 7.0])], VECTORS)
    plays = [(u, t) for u in range(9) for t in (1, 2) if u != 8] + [(8, 3), (None, 1), (20, 99), (21, None), (0, 1)] + [(30, t) for t in (1, 2, 3, 4)]
    means = rt.mean_vectors(spark.createDataFrame(plays, "user long, track long"), items)
    assert "FlatMapCoGroupsInArrow" in plan(means)
    got = {r["id"]: r["vector"] for r in means.collect()}
    want = {u: [3.0, 2.0 / 3] for u in range(8)} | {8: [None, None], None: [1.0, 2.0], 30: [16.0 / 5, 9.0 / 5]}
    assert got.keys() == want.keys()
    for u, x in want.items():
        assert got[u] == [None if y is None else pytest.approx(y) for y in x]


@pytest.mark.parametrize("metric", ["ip", "match", "l2", "cosine"])
def test_small_buckets_are_searched_together(metric):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"bucket": [f"b{n % 5}" for n in range(40)], "id": np.arange(40), "vector": [rng.integers(1, 4, 6).astype(float) for _ in range(40)]})
    best = rt._best(3, metric, 9, True)
    got = rt._in_buckets(best, 3, metric, 9, True)(rows, rows)
    want = pd.concat([best(part, part) for _, part in rows.groupby("bucket")])
    key = ["query", "item"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_repeated_vectors_take_one_place(points, metric):
    v, df = points
    twice = df.union(df.filter("id % 3 < 2")).union(df.filter("id < 4"))
    got = {}
    found = iv.ivf_knn(iv.build(twice, 4, metric), twice, 6, 2, exact=True, exclude_self=True)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["item"])
    scores = v @ v.T if metric == "ip" else -np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(scores, -np.inf)
    assert got == {q: list(np.argsort(-scores[q])[:6]) for q in range(30)}


def test_vectors_are_not_sent_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(rt, "PAIRS", 10)
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 4)
    v = np.random.default_rng(6).standard_normal((20, 3))
    items = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(20, None), (None, [9.0] * 3), (3, [1.0, None, 2.0])], VECTORS)
    own = {u: sorted({(u * 7 + n * n) % 20 for n in range(1 + u % 5)}) for u in range(40)} | {None: [1, 2], 99: list(range(21))}
    history = spark.createDataFrame([(u, i) for u, tracks in own.items() for i in tracks * 2], "user long, track long")
    found = rt.mean_vectors(history, items)
    assert "CoGroups" not in plan(found)  # they pass by in blocks instead
    got = {r["id"]: r["vector"] for r in found.collect()}
    rows = [[*v[i], 1.0] for i in range(20)]
    for u, tracks in own.items():
        sums, n = np.zeros(3), 0
        for i in tracks:
            if i < 20:
                sums, n = sums + rows[i][:3], n + 1
            if i == 3:
                sums = sums + np.array([1.0, 0.0, 2.0])
            n += i in (3, 20)  # a repeated row, and one without a vector, count as rows
        assert np.allclose(got[u], sums / n), u
    assert set(got) == set(own)


def test_a_query_sends_its_list_once(spark, points, monkeypatch):
    monkeypatch.setattr(rt, "ENOUGH", 1)
    monkeypatch.setattr(rt, "SHARE", 64)  # a share of two vectors
    monkeypatch.setattr(rt, "ITEM_BLOCK", 5)
    v, df = points
    found = rt.knn(df.union(df.limit(3)), df, 4)
    assert "Window" not in plan(found)  # no lists of shares are left to merge
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["item"], r["rank"]))
    best = np.argsort(-(v @ v.T), axis=1)
    twice = {r["id"] for r in df.limit(3).collect()}
    for q in range(30):
        items = np.repeat(best[q], 2)[:4] if q in twice else best[q][:4]
        assert got[q] == [(i, n + 1) for n, i in enumerate(items)]


@pytest.mark.parametrize("metric", ["ip", "cosine"])
@pytest.mark.parametrize("kind", ["near", "whole", "large", "tiny"])
def test_rough_scores_lose_no_neighbour(monkeypatch, metric, kind):
    """Scores that single precision cannot tell apart, equal ones, and hidden pairs; the rough ones show what is scored in full."""
    rng = np.random.default_rng(11)
    q, v = rng.normal(size=(30, 6)), rng.normal(size=(900, 6))
    if kind == "near":
        v = v[:3][rng.integers(0, 3, 900)] + rng.normal(size=(900, 6)) * 1e-8
    elif kind == "whole":
        q, v = rng.integers(-2, 3, (30, 6)).astype(float), rng.integers(-2, 3, (900, 6)).astype(float)
    elif kind == "large":
        v[::50] *= 1e9
    else:
        q, v = q * 1e-3, v * 1e-5
    for name, value in (("SCORES", 30 * 20), ("TILE", 8), ("WIDTH", 50), ("FEW", 16)):
        monkeypatch.setattr(rt, name, value)
    sifted, sift, lifted, lift = [], rt._Lists._sift, [], rt._Lists.lift
    monkeypatch.setattr(rt._Lists, "_sift", lambda self, *a: sifted.append(1) or sift(self, *a))
    monkeypatch.setattr(rt._Lists, "lift", lambda self: lifted.append(1) or lift(self))
    ids = np.arange(900) * 3
    line, known = np.repeat(np.arange(30), 5), rng.choice(ids, 150)
    lists = rt._Lists(np.arange(30), q, line, known, 7, metric, 9, False)
    for a in range(0, 900, 300):
        lists.add(ids[a : a + 300], v[a : a + 300])
    got = [(x["query"], x["item"], x["rank"]) for x in lists.ranked().to_pylist()]
    full = np.round(rt._scores(q, v, metric), 9)
    full[line, known // 3] = -np.inf
    want = [(u, ids[i], n + 1) for u in range(30) for n, i in enumerate(np.lexsort((ids, -full[u]))[:7])]
    assert len(sifted) == 3 and (lifted or kind == "large") and got == want


def test_floors_of_lifted_lists_are_bounds():
    rng = np.random.default_rng(2)
    lists = rt._Lists(np.arange(4), rng.normal(size=(4, 2)), np.array([], int), np.array([], int), 3, "ip", 9, False)
    line = np.r_[np.zeros(40, int), np.ones(40, int), np.full(2, 2)]
    score = np.r_[rng.normal(size=40), -rng.random(40) * 1e-7, 1.0, -1.0]
    lists.found = [(line, np.arange(82), score)]
    lists.size = 82
    lists.lift()
    third = [np.sort(score[line == n])[-3] for n in (0, 1)]
    assert (lists.floor[:2] <= third).all() and np.allclose(lists.floor[:2], third, rtol=1e-6) and np.isinf(lists.floor[2:]).all()
    kept = lists.found[0]
    assert [(kept[0] == n).sum() for n in range(4)] == [3, 3, 2, 0]


def test_a_signature_travels_only_for_shared_bands(spark, monkeypatch):
    written, write = {}, rt.materialize
    monkeypatch.setattr(rt, "materialize", lambda df, name="stage": written.setdefault(name, write(df, name)))
    rows = [(u, t) for u in (1, 2) for t in range(30)] + [(None, t) for t in range(30)] + [(u, 1000 * u + t) for u in range(3, 12) for t in range(30)]
    found = rt.minhash_neighbours(spark.createDataFrame(rows, "user long, track long"), 3, 12, 6)
    assert {(1, 2, 1.0), (2, 1, 1.0)} <= {(r["query"], r["item"], r["score"]) for r in found.collect()}
    assert written["signatures"].count() == 12
    assert written["bands"].groupBy("id").count().count() == 3 and written["bands"].count() == 3 * 6
