"""Tiles of sparse tables and the dense linear model against whole matrices in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import linear as li
from tastemill.operators import neighbours as nb
from tastemill.operators import tiles as ti

SCHEMA = "user long, track long, time double"


def table(seed=0, users=41, items=27):
    """Item 0 is rated by everybody, user 3 rates everything."""
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((users, items)) < 0.15, rng.integers(1, 50, (users, items)) / 50, 0.0)
    m[:, 0], m[3] = 0.5, rng.integers(1, 50, items) / 50
    return m, [(int(u) * 10, int(i) + 100, float(m[u, i])) for u, i in zip(*np.nonzero(m), strict=True)]


def unpacked(cells, side, n):
    out = np.zeros((n, n))
    for r in cells.collect():
        j, i = np.frombuffer(r["j"], "<u2"), np.frombuffer(r["i"], "<u2")
        assert not out[r["jb"] * side + j, r["ib"] * side + i].any()
        out[r["jb"] * side + j, r["ib"] * side + i] = np.frombuffer(r["w"], "<f8")
    return out


@pytest.mark.parametrize("lines,side,run", [(7, 5, 30), (8192, 1024, 4_000_000), (16, 27, 1)])
def test_products_are_those_of_whole_matrices(spark, monkeypatch, lines, side, run):
    monkeypatch.setattr(ti, "RUN", run)
    m, rows = table()
    df = spark.createDataFrame([(*r, r[2] ** 2) for r in rows], SCHEMA + ", square double")
    parts = ti.tile(df, "user", "track", ["time", "square"], lines=lines, side=side)
    assert (parts.n_rows, parts.n_columns, parts.n_entries) == (*m.shape, len(rows))
    most = parts.table.agg({"n": "max"}).first()[0]
    assert most <= lines * side
    got = unpacked(ti.column_products(parts, "time", "square"), side, m.shape[1])
    assert np.allclose(got, m.T @ m**2)
    weights = ti.column_products(parts, "time", "time", diagonal=False)
    dense = m.T @ m
    np.fill_diagonal(dense, 0)
    scores = np.round(m @ dense - m, 9)
    want = {(u * 10, r + 1): (i + 100, scores[u, i]) for u in range(len(m)) for r, i in enumerate(np.lexsort((np.arange(m.shape[1]), -scores[u]))[:4])}
    found = ti.top_products(parts, "time", weights, 4, minus="time").collect()
    assert {(r["row"], r["rank"]): (r["col"], pytest.approx(r["score"])) for r in found} == want


def test_a_dense_group_stays_within_its_tile(spark):
    """One user with every item and one item with every user: tiles hold what their sides allow, not what the keys hold."""
    rows = [(0, i, 1.0) for i in range(400)] + [(u, 0, 1.0) for u in range(1, 400)]
    parts = ti.tile(spark.createDataFrame(rows, SCHEMA), "user", "track", ["time"], lines=20, side=10)
    sizes = [r["n"] for r in parts.table.collect()]
    assert max(sizes) == 29 and sum(sizes) == len(rows)


def test_missing_values_teach_nothing_and_keep_their_items(spark):
    m, rows = table(2, 12, 9)
    plain = spark.createDataFrame(rows, SCHEMA)
    odd = [(10, 100, None), (None, 500, 0.3), (20, None, 0.2), (30, 600, float("nan")), (777, 100, None)]
    both = plain.unionByName(spark.createDataFrame(odd, SCHEMA))
    for model in (nb.user_cf, nb.item_cf):
        few, more = ({(r["user"], r["track"]): r["score"] for r in model(df, k=20).collect()} for df in (plain, both))
        assert {key for key in more if key[1] not in (500, 600)} == set(few)
        assert all(more[key] == pytest.approx(few[key]) for key in few)
        assert {key[1] for key in more if key not in few} == {500, 600} and {more[k] for k in more if k not in few} == {0.0}
        assert model(plain.limit(0), k=3).count() == 0


@pytest.mark.parametrize("lines,side,wide", [(7, 5, 2), (8192, 1024, 2), (64, 3, 1), (64, 4, 3)])
def test_linear_weights_are_those_of_the_whole_matrix(spark, monkeypatch, lines, side, wide):
    monkeypatch.setattr(li, "WIDE", wide)
    m, rows = table(5)
    parts, weights, gram = li.item_linear(spark.createDataFrame(rows, SCHEMA), 3.0, lines=lines, side=side)
    p = np.linalg.inv(m.T @ m + 3.0 * np.eye(m.shape[1]))
    want = -p / np.diag(p)[None, :]
    np.fill_diagonal(want, 0)
    assert np.allclose(unpacked(weights, side, m.shape[1]), want, atol=1e-10)
    found = {r["i"]: r for r in li.normal_residuals(parts, weights, gram, 3.0).collect()}
    assert set(found) == {i + 100 for i in range(m.shape[1])}
    assert all(r["residual"] < 1e-9 and r["n_weights"] == (want[:, i - 100] != 0).sum() for i, r in found.items())
    every = {(r["j"], r["i"]): r["w"] for r in li.weight_rows(parts, weights).collect()}
    assert len(every) == (want != 0).sum() and all(w == pytest.approx(want[j - 100, i - 100]) for (j, i), w in every.items())
    few = {}
    for r in li.weight_rows(parts, weights, 3).collect():
        few.setdefault(r["i"], set()).add(r["j"])
    assert few[105] == {j + 100 for j in np.lexsort((np.arange(27), -np.where(np.arange(27) == 5, -9, np.round(want[:, 5], 9))))[:3]}


def test_each_weight_is_the_ridge_fit_on_all_other_items(spark):
    m, rows = table(6, 30, 12)
    _, weights, _ = li.item_linear(spark.createDataFrame(rows, SCHEMA), 2.0, lines=8, side=5)
    got = unpacked(weights, 5, 12)
    for i in range(12):
        others = [j for j in range(12) if j != i]
        a = m[:, others]
        assert got[others, i] == pytest.approx(np.linalg.solve(a.T @ a + 2.0 * np.eye(11), a.T @ m[:, i]), abs=1e-10)


def test_linear_lists(spark):
    m, rows = table(7, 20, 15)
    p = np.linalg.inv(m.T @ m + 10.0 * np.eye(15))
    w = -p / np.diag(p)[None, :]
    np.fill_diagonal(w, 0)
    scores = np.round(m @ w, 9)
    got = {(r["user"], r["rank"]): r["track"] - 100 for r in li.linear_recommend(spark.createDataFrame(rows, SCHEMA), 5, lines=6, side=4).collect()}
    assert got == {(u * 10, r + 1): i for u in range(20) for r, i in enumerate(np.lexsort((np.arange(15), -scores[u]))[:5])}


def test_a_file_holds_one_block(spark):
    width, count = 4, 12  # 78 blocks, where the session's shuffles have 4 partitions
    none = spark.createDataFrame([], ti.CELLS)
    blocks = li.dense_lower(none, width * count, 2, 1.0)
    for stored in (blocks, li._sweep(blocks, 3, count, width)):
        files = stored.groupBy(F.input_file_name().alias("f")).count().collect()
        assert sum(r["count"] for r in files) == 78 and max(r["count"] for r in files) <= 11  # the pivot's row and column are one narrow table
    assert all(r["count"] == 1 for r in blocks.groupBy(F.input_file_name().alias("f")).count().collect())
