import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import bias as bi
from tastemill.operators import graph as gr
from tastemill.operators import interactions as it
from tastemill.operators import metrics as me
from tastemill.operators import neighbours as nb
from tastemill.operators import factors as fa
from tastemill.operators import rerank as rr
from tastemill.operators import retrieval as rt
from tastemill.operators import serving as sv
from tastemill.operators import tiles as ti
from tastemill.operators.ordering import recent_history
from tastemill.operators.text import class_log_prior


def ratings(seed=1, users=30, items=25):
    """Item 0 is played by everybody and user 0 plays everything."""
    rng = random.Random(seed)
    cells = {(u, i) for u in range(users) for i in range(items) if u == 0 or i == 0 or rng.random() < 0.2}
    return sorted((u, i, rng.randint(1, 50) / 50) for u, i in cells)


def dense(rows):
    m = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1))
    for u, i, t in rows:
        m[u, i] = t
    return m


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 8)
    monkeypatch.setattr(nb, "CHUNK", 60)
    monkeypatch.setattr(nb, "SCORE_CHUNK", 90)
    monkeypatch.setattr(nb, "SLAB", 50)
    monkeypatch.setattr(ti, "LINES", 7)
    monkeypatch.setattr(ti, "SIDE", 8)
    monkeypatch.setattr(ti, "RUN", 60)
    monkeypatch.setattr(rt, "QUERY_BLOCK", 7)
    monkeypatch.setattr(rt, "ITEM_BLOCK", 5)


def top(scores, k, mask=None):
    out = {}
    for u in range(len(scores)):
        order = sorted(((-round(s, 9), i) for i, s in enumerate(scores[u]) if round(s, 9) != 0 and (mask is None or mask[u, i])))
        out[u] = [i for _, i in order[:k]]
    return out


def lists_of(df, key="user", item="track"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(r[item])
    return out


def test_user_cf_equals_the_dense_matrices(spark, small_blocks):
    rows = ratings()
    df = spark.createDataFrame(rows, "user long, track long, time double")
    m = dense(rows)
    r = m / np.linalg.norm(m, axis=1, keepdims=True)
    w = r @ r.T
    np.fill_diagonal(w, 0)
    assert lists_of(nb.user_cf(df, "l2", 7)) == top(w @ r, 7)


def test_centred_neighbours_equal_the_dense_matrices(spark, small_blocks):
    rows = ratings(2)
    df = spark.createDataFrame(rows, "user long, track long, time double")
    m = dense(rows)
    known = m > 0
    r = np.where(known, m - (m.sum(1) / known.sum(1))[:, None], 0)
    q = r / np.linalg.norm(r, axis=1, keepdims=True)
    w = q @ q.T
    np.fill_diagonal(w, 0)
    assert lists_of(nb.user_cf(df, "center", 5)) == top(w @ r, 5)
    stats = nb.neighbour_stats(df, "center").first()
    assert stats["mean_positive"] == pytest.approx((np.round(w, 12) > 0).sum(1).mean())
    assert stats["mean_negative"] == pytest.approx((np.round(w, 12) < 0).sum(1).mean())


def test_item_weights_and_linear_model(spark, small_blocks):
    rows = ratings(3)
    df = spark.createDataFrame(rows, "user long, track long, time double")
    m = dense(rows)
    c = m / np.linalg.norm(m, axis=0)
    w = c.T @ c
    np.fill_diagonal(w, 0)
    assert lists_of(nb.item_cf(df, 6)) == top(m @ w, 6)
    got = {(r["j"], r["i"]): r["w"] for r in nb.item_linear(df, 100, 3.0).collect()}
    gram = m.T @ m
    for i in (0, 7):
        near = [j for j in range(m.shape[1]) if j != i and gram[j, i] > 0]
        solved = np.linalg.solve(gram[np.ix_(near, near)] + 3.0 * np.eye(len(near)), gram[near, i])
        assert [got[j, i] for j in near] == pytest.approx(list(solved))


def test_pearson_on_common_users(spark, small_blocks):
    rows = ratings(4)
    m = dense(rows)
    df = spark.createDataFrame(rows, "user long, track long, time double")
    got = {(r["j"], r["i"]): r["w"] for r in nb.item_weights(df, "pearson").collect()}
    for a, b in itertools.permutations(range(m.shape[1]), 2):
        both = (m[:, a] > 0) & (m[:, b] > 0)
        if both.sum() >= 2 and np.ptp(m[both, a]) > 0 and np.ptp(m[both, b]) > 0:
            assert got[a, b] == pytest.approx(np.corrcoef(m[both, a], m[both, b])[0, 1], abs=1e-6)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((23, 6))
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<double>")


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_knn_over_many_blocks(points, small_blocks, metric):
    v, df = points
    score = {"ip": v @ v.T, "l2": -np.linalg.norm(v[:, None] - v[None], axis=2), "cosine": None}[metric]
    if score is None:
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        score = u @ u.T
    mask = ~np.eye(len(v), dtype=bool)
    got = lists_of(rt.knn(df, df, 4, metric, exclude_self=True), "query", "item")
    assert got == top(score, 4, mask)


def test_recommend_leaves_out_seen_items(spark, points, small_blocks):
    v, df = points
    seen = [(u, i) for u in range(23) for i in range(23) if (u * i) % 3 == 0]
    mask = np.ones((23, 23), dtype=bool)
    for u, i in seen:
        mask[u, i] = False
    got = lists_of(rt.recommend(df, df, 20, spark.createDataFrame(seen, "user long, track long")))
    assert got == {u: x for u, x in top(v @ v.T, 20, mask).items() if x}


def test_lsh_finds_only_true_scores(points, small_blocks):
    v, df = points
    found = rt.lsh_knn(df, 5, "ip", tables=4, bits=2).collect()
    assert found and all(r["score"] == pytest.approx(v[r["query"]] @ v[r["item"]], abs=1e-8) for r in found)
    assert all(r["query"] != r["item"] for r in found)


def test_minhash_finds_equal_users(spark, small_blocks):
    rows = [(u, i) for u in range(12) for i in range((u // 3) * 10, (u // 3) * 10 + 8)]
    got = lists_of(rt.minhash_neighbours(spark.createDataFrame(rows, "user long, track long"), 2, 8, 4), "query", "item")
    assert got == {u: [x for x in range(u // 3 * 3, u // 3 * 3 + 3) if x != u] for u in range(12)}


def test_mean_similarity_without_pairs(spark, points):
    v, df = points
    grouped = df.withColumn("g", F.when(F.col("id") == 0, 9).otherwise(F.col("id") % 3))
    got = {r["g"]: r["similarity"] for r in rt.mean_similarity(grouped, "g").collect()}
    assert got[9] == 0.0
    for g in range(3):
        ids = [i for i in range(1, 23) if i % 3 == g]
        assert got[g] == pytest.approx(np.mean([v[a] @ v[b] for a, b in itertools.combinations(ids, 2)]))


def determinant_order(kernel, window):
    """The definition: try every determinant."""
    rest, order = list(range(len(kernel))), []
    while rest:
        chosen = []
        for _ in range(min(window, len(rest))):
            free = [c for c in rest if c not in chosen]
            dets = [np.linalg.det(kernel[np.ix_(chosen + [c], chosen + [c])]) for c in free]
            chosen.append(free[int(np.argmax(dets))])
        order += chosen
        rest = [c for c in rest if c not in chosen]
    return order


@pytest.mark.parametrize("seed", range(5))
def test_dpp_equals_determinants(seed):
    rng = np.random.default_rng(seed)
    scores, vectors = rng.uniform(0.5, 2, (3, 9)), rng.standard_normal((3, 9, 4))
    usable = np.ones((3, 9), bool)
    kernels = rr.dpp_kernels(scores, vectors)
    assert np.linalg.eigvalsh(kernels).min() > -1e-9
    order = rr.dpp_orders(scores, vectors, usable, 4)
    for kernel, got in zip(kernels, order, strict=True):
        assert got.tolist() == determinant_order(kernel, 4)


def test_mmr_step_by_step():
    rng = np.random.default_rng(1)
    scores, vectors = rng.uniform(0, 1, (2, 7)), rng.standard_normal((2, 7, 3))
    usable = np.ones((2, 7), bool)
    usable[1, 4] = False
    order = rr.mmr_orders(scores, vectors, usable, 0.4)
    assert order[1, -1] == 4
    for s, v, ok, got in zip(scores, vectors, usable, order, strict=True):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        chosen = []
        for at in got[: ok.sum()]:
            def value(c):
                return 0.6 * s[c] - (0.4 * max(unit[c] @ unit[j] for j in chosen) if chosen else 0.0)

            free = [c for c in range(7) if ok[c] and c not in chosen]
            assert value(at) == pytest.approx(max(map(value, free)))
            chosen.append(at)


def test_reranking_keeps_every_item(spark, points):
    _, df = points
    recs = spark.createDataFrame(
        [(u, t, 1.0 / (1 + t), t + 1) for u in range(3) for t in range(8)] + [(7, 10**12, 0.5, 1), (7, 2, 0.4, 2), (8, None, None, 1)],
        "user long, track long, score double, rank int",
    )
    for out in (rr.dpp_rerank(recs, df, 3), rr.mmr_rerank(recs, df, 0.5)):
        got = lists_of(out)
        assert all(sorted(got[u]) == list(range(8)) for u in range(3))
        assert got[7] == [2, 10**12] and got[8] == [None]  # what has no vector closes the list
    catalog = spark.createDataFrame([(t, "a" if t < 6 else "b") for t in range(8)], "track long, artist string")
    gain = lists_of(rr.greedy_feature_gain(recs, catalog, 0.5, "artist"))
    assert sorted(gain[0]) == list(range(8)) and gain[0][:2] == [0, 6] and sorted(gain[7]) == [2, 10**12]
    capped = lists_of(rr.cap_per_group(recs, catalog, "artist", 2, 3))
    assert capped[0] == [0, 1, 6] and capped[7] == [10**12, 2]


def test_negatives_are_unseen_and_exactly_n(spark, monkeypatch):
    monkeypatch.setattr(it, "RANK_SLICE", 3)
    rng = random.Random(5)
    pairs = [(u, i) for u in range(8) for i in range(30) if rng.random() < u / 8] + [(9, i) for i in range(30)]
    items = spark.createDataFrame([(i,) for i in range(30)], "track long")
    got = it.sample_negatives(spark.createDataFrame(pairs, "user long, track long"), items, 5, exclude_seen=True).collect()
    assert len(got) == 5 * sum(1 for u, _ in pairs if u != 9)  # user 9 has seen everything
    assert not {(r["user"], r["negative"]) for r in got} & set(pairs)
    free = {i for i in range(30) if (7, i) not in pairs}
    assert {r["negative"] for r in got if r["user"] == 7} == free


def test_popular_items_not_played(spark):
    rows = ratings(6)
    got = lists_of(sv.toppop_unseen(spark.createDataFrame(rows, "user long, track long, time double"), 4))
    counts = {i: sum(1 for r in rows if r[1] == i) for i in range(25)}
    order = sorted(counts, key=lambda i: (-counts[i], i))
    seen = {(u, i) for u, i, _ in rows}
    want = {u: [i for i in order if (u, i) not in seen][:4] for u in range(30)}
    assert got == {u: x for u, x in want.items() if x}


def test_history_vector(spark):
    plays = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 5), (2, 5)], "user long, track long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    got = {r["user"]: r["history"] for r in it.play_history(plays, 30, 50_000, users).collect()}
    assert len(set(got[1])) == 30 and got[2] == [5] + [50_000] * 29 and got[3] == [50_000] * 30


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "user long, track long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 10), (3, 1)], "user long, track long")
    assert {r[0]: r[1] for r in me.recall_at_k(recs, truth, 2).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    ndcg = {r[0]: r[1] for r in me.ndcg_at_k(recs, truth, 3, achievable=True).collect()}
    assert ndcg[2] == 1.0 and ndcg[3] == 0.0 and ndcg[1] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert {r[0]: r[1] for r in me.map_at_k(recs, truth, 3).collect()} == {1: 0.25, 2: 1.0, 3: 0.0}
    even = spark.createDataFrame([(i, 4) for i in range(5)], "track long, n long")
    assert me.gini(even).first()[0] == pytest.approx(0.0)
    one = spark.createDataFrame([(0, 9)], "track long, n long")
    assert me.gini(one, even).first()[0] == pytest.approx(1.0)


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]
    pairs = [(p, q) for a, p in rows for b, q in rows if a == 1 and b == 0]
    want = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)
    assert me.auc(spark.createDataFrame(rows, "label int, score double")).first()[0] == pytest.approx(want)


def test_sticky_artist_fallbacks(spark):
    catalog = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "track long, artist string")
    events = spark.createDataFrame([(n, t, 0.5) for n, t in enumerate([1, 2, 3, 77] * 5)], "event_id long, track long, time double")
    dense_ = sv.dense_catalog(catalog)
    for r in sv.recommend_sticky(events, sv.artist_index(catalog), dense_).collect():
        assert r["next"] in {1: {2}, 2: {1}, 3: {3}, 77: {1, 2, 3}}[r["track"]]


def test_item_to_item_rules(spark):
    events = [(0, 1, 10, 1, 0.9), (1, 1, 20, 2, 0.0), (2, 2, 10, 9, 0.0)]
    log = spark.createDataFrame(events, "event_id long, user long, timestamp long, track long, time double")
    i2i = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8), (2, 1, 1, 0.7)], "track long, item long, rank int, score double")
    dense_ = sv.dense_catalog(spark.createDataFrame([(7,)], "track long"))
    out = {r["event_id"]: (r["anchor"], r["next"]) for r in sv.recommend_i2i(recent_history(log, 10, ties=("event_id",)), i2i, dense_).collect()}
    # event 1 has heard 1 and 2, so only 3 is fresh; track 9 has no neighbours, so the fallback answers
    assert out == {0: (1, 2), 1: (1, 3), 2: (None, 7)}


def test_pagerank_of_five_nodes(spark):
    p = np.array([[0, 1 / 2, 1 / 2, 0, 0], [1 / 2, 0, 1 / 2, 0, 0], [1 / 3, 1 / 3, 0, 1 / 3, 0], [0, 0, 1 / 2, 0, 1 / 2], [0, 0, 0, 1, 0]])
    edges = spark.createDataFrame([(i, j) for i in range(5) for j in range(5) if p[i, j] > 0], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0, 1.0)], "seed long, id long, weight double")
    want = 0.4 * np.eye(5)[0] @ np.linalg.inv(np.eye(5) - 0.6 * p)
    got = {r["id"]: r["score"] for r in gr.ppr(edges, seeds, 0.6, 30).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(list(want), abs=1e-6)


def test_factor_models_take_ids_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(10**12 + u, f"track-{t}", float(1 + (u % 2 == t % 2) * 3)) for u in range(30) for t in range(20) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "user long, track string, time double")
    model = fa.fit_als(df, rank=3, max_iter=5, reg=0.01)
    assert fa.model_rmse(model, df) < 0.5
    assert {r["user"] for r in fa.predictions(model, df).collect()} == {r[0] for r in rows}
    numbers = spark.createDataFrame([(u, hash(t) % 10**12, x) for u, t, x in rows], "user long, track long, time double")
    lists = lists_of(fa.recommend_all(fa.fit_als(numbers, rank=3, max_iter=3), 5))
    assert set(lists) == {r[0] for r in rows} and all(len(set(x)) == 5 for x in lists.values())


def test_tuning_does_not_depend_on_the_storage(spark):
    rows = [(u, t, float((u * t) % 5)) for u in range(12) for t in range(10)]
    df = spark.createDataFrame(rows, "user long, track long, time double")
    found = [sorted(map(tuple, fa.tune(x, {"rank": [2, 3]}, maxIter=2)[1].collect())) for x in (df.coalesce(1), df.repartition(7))]
    assert [(a, round(b, 6)) for a, b in found[0]] == [(a, round(b, 6)) for a, b in found[1]]


def test_single_plays_and_silent_tracks_harm_nobody(spark, small_blocks):
    """A user with one play is zero after centring, a track that nobody listened to has no length: both count as zeros."""
    rows = [(1, 1, 0.5), (1, 2, 0.9), (2, 1, 0.4), (2, 2, 0.1), (2, 3, 0.0), (3, 1, 0.7), (4, 2, 0.0), (5, 3, 0.0)]
    df = spark.createDataFrame(rows, "user long, track long, time double")
    for out in (nb.user_cf(df, "center", 3), nb.user_cf(df, "l2", 3), nb.item_cf(df, 3)):
        got = out.collect()
        assert all(np.isfinite(r["score"]) for r in got)
        assert all(sorted(x) == [1, 2, 3] for x in lists_of(out).values()) and len(lists_of(out)) == 5


def test_metrics_of_degenerate_inputs(spark):
    one = spark.createDataFrame([(1, 5)], "track long, n long")
    assert me.gini(one).first()["gini"] == 0.0
    none = spark.createDataFrame([(1, 0), (2, 0)], "track long, n long")
    assert me.gini(none).first()["gini"] == 0.0
    recs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "user long, track long")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    got = {r["user"]: r["diversity"] for r in me.intra_list_diversity(recs, vec).collect()}
    assert got[1] == pytest.approx(1 - 1 / 3) and got[2] is None
    empty = spark.createDataFrame([], "user long, track long")
    assert {r["novelty"] for r in me.popularity_novelty(recs, empty).collect()} == {1.0}
    for labels, want in (([1, 1], np.log(3)), ([0], -np.log(2)), ([], 0.0), ([1, 1, 0], np.log(2))):
        df = spark.createDataFrame([(y,) for y in labels], "y int")
        assert class_log_prior(df, "y").first()["log_prior"] == pytest.approx(want)


def test_draws_from_no_counts(spark):
    rows = spark.createDataFrame([(1, 0.3)], "k long, u double")
    assert bi.draw_by_count(rows, spark.createDataFrame([], "track long, n long"), "track", "u").count() == 0


def test_gradient_bandit_is_the_lecture_step_by_step(spark):
    rng = random.Random(3)
    log = [(u, t, rng.choice("abc"), rng.random()) for u in range(4) for t in range(rng.randrange(1, 40))]
    log += [(0, 99, None, 0.5), (1, 99, "a", None), (None, 1, "a", 0.5)]
    df = spark.createDataFrame(log, "user long, t long, arm string, r double").repartition(3)
    got = {(r["user"], r["arm"]): r for r in bi.gradient_bandit(df, "arm", "r", ["t"], ["user"], 0.3).collect()}
    assert len(got) == 12
    for u in range(4):
        h, mean, n = dict.fromkeys("abc", 0.0), 0.0, 0
        for _, _, a, r in sorted(x for x in log if x[0] == u and x[2] and x[3] is not None):
            total = sum(np.exp(x) for x in h.values())
            pi = {k: np.exp(x) / total for k, x in h.items()}
            h = {k: x + 0.3 * (r - mean) * ((1 - pi[k]) if k == a else -pi[k]) for k, x in h.items()}
            n += 1
            mean += (r - mean) / n
        total = sum(np.exp(x) for x in h.values())
        for k in "abc":
            assert got[u, k]["preference"] == pytest.approx(h[k]) and got[u, k]["chance"] == pytest.approx(np.exp(h[k]) / total)
            assert got[u, k]["steps"] == n
    with pytest.raises(ValueError):
        bi.gradient_bandit(df, "arm", "r", ["t"], ["user"], most_arms=2)


def test_bandit_rates(spark):
    stats = spark.createDataFrame([("a", 60, 0.5, 30.0, 0.1), ("b", 40, 0.7, 28.0, 0.1)], "arm string, pulls long, mean double, total double, std double")
    ucb = {r["arm"]: r["ucb"] for r in bi.ucb_choice(stats, "arm", 1.5).collect()}
    assert ucb["b"] == pytest.approx(0.7 + 1.5 * np.sqrt(np.log(100) / 40))
    chance = {r["arm"]: r["chance"] for r in bi.epsilon_greedy(stats, "arm", bi.decayed(0.01)).collect()}
    assert chance == {"a": pytest.approx(0.25), "b": pytest.approx(0.75)}


@pytest.mark.parametrize("sizes", [{}, {"lines": 7, "side": 5}])
def test_propagation_in_tiles_equals_the_edge_join(spark, sizes):
    rng = random.Random(5)
    pairs = [(u, i) for u in range(30) for i in range(20) if u == 0 or i == 0 or rng.random() < 0.2]
    rng2 = np.random.default_rng(1)
    users = [(u, [float(x) for x in rng2.standard_normal(3)]) for u in range(32)]  # 30 and 31 play nothing
    items = [(i, [float(x) for x in rng2.standard_normal(3)]) for i in range(20)]
    plays = spark.createDataFrame([*pairs, pairs[0], (None, 3), (4, None)], "user long, track long")
    uv, iv = (spark.createDataFrame(v, "id long, vector array<double>") for v in (users, items))
    edges = gr.bipartite_edges(spark.createDataFrame(pairs, "user long, track long"))
    named = uv.select(F.concat(F.lit("u"), "id").alias("id"), "vector").unionByName(iv.select(F.concat(F.lit("i"), "id").alias("id"), "vector"))
    want = {r["id"]: r["vector"] for r in gr.propagate(edges, named, 3).collect()}
    got_u, got_i = gr.propagate_pairs(plays, uv, iv, 3, **sizes)
    got = {f"u{r['id']}": r["vector"] for r in got_u.collect()} | {f"i{r['id']}": r["vector"] for r in got_i.collect()}
    assert set(got) == set(want)
    assert all(got[n] == pytest.approx(want[n]) for n in want)


def test_many_dimensions(spark):
    vec = [(n, [float(n % 7)] * 128) for n in range(12)]
    plays = spark.createDataFrame([(u, i) for u in range(12) for i in range(12) if (u + i) % 3], "user long, track long")
    df = spark.createDataFrame(vec, "id long, vector array<double>")
    users, _ = gr.propagate_pairs(plays, df, df, 4, lines=5, side=5)
    assert {len(r["vector"]) for r in users.collect()} == {128}
