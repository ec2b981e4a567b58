"""Products by strips against whole matrices in NumPy."""

import numpy as np
import pytest

from tastemill.operators import neighbours as nb
from tastemill.operators import strips as st

SCHEMA = "user long, track long, time double"


def table(seed=0, users=41, items=27):
    """Item 0 is rated by everybody, user 3 rates everything."""
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((users, items)) < 0.15, rng.integers(-20, 50, (users, items)) / 50, 0.0)
    m[:, 0], m[3] = 0.5, rng.integers(1, 50, items) / 50
    return m, [(int(u) * 10, int(i) + 100, float(m[u, i])) for u, i in zip(*np.nonzero(m), strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, r[2] ** 2) for r in rows], SCHEMA + ", square double")


@pytest.mark.parametrize("size,slab,held,few", [(1_000_000, 1_000_000, 1 << 30, 256), (30, 8, 1 << 30, 256), (50, 40, 100, 3)])
@pytest.mark.parametrize("diagonal", [True, False])
def test_lists_are_those_of_whole_matrices(spark, monkeypatch, size, slab, held, few, diagonal):
    """Also with rows and columns that make more products than are expanded at a time."""
    for name, value in (("SLAB", slab), ("HELD", held), ("FEW", few)):
        monkeypatch.setattr(st, name, value)
    m, rows = table(1)
    columns = spark.createDataFrame([(i + 100,) for i in range(30)], "track long")  # three of them without entries
    got = st.top_scores(frame(spark, rows), 6, "time", "square", "time", "square", diagonal, columns=columns, size=size).collect()
    w = m.T @ m**2
    if not diagonal:
        np.fill_diagonal(w, 0)
    scores = np.zeros((len(m), 30))
    scores[:, : m.shape[1]] = np.round(m @ w - m**2, 9)
    want = {(u * 10, n + 1): (i + 100, scores[u, i]) for u in range(len(m)) for n, i in enumerate(np.lexsort((np.arange(30), -scores[u]))[:6])}
    assert {(r["row"], r["rank"]): (r["col"], pytest.approx(r["score"])) for r in got} == want


def test_free_places_and_long_lines():
    rng = np.random.default_rng(3)
    width, k = 400, 5
    for share in (0.002, 0.05, 0.9):
        there = rng.random((30, width)) < share
        there[4], there[5] = False, True
        dense = np.where(there, np.round(rng.normal(size=there.shape), 1), 0.0)
        key = np.flatnonzero(there.ravel())
        line, place, score = st._best(key, dense.ravel()[key], 30, width, k)
        want = [(u, i, dense[u, i]) for u in range(30) for i in np.lexsort((np.arange(width), -dense[u]))[:k]]
        assert list(zip(line, place, score, strict=True)) == want


def test_an_entry_is_packed_once_however_many_strips(spark):
    """The written table holds every entry once; pairs come from a cross join of it."""
    _, rows = table(2)
    out = st.column_pairs(frame(spark, rows), "user", "track", ["time"], lambda *_: None, "j long", {"w": ("time", "time")}, size=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan


def test_propagation_copies_vectors_to_few_blocks(spark):
    """At 60 times sf0.1 blocks of the fixed sizes took 1,172 copies of every user's vector."""
    from tastemill.operators import graph as gr

    assert [gr.block_size(n) for n in (0, 20_000, 1_200_000)] == [1024, 2048, 65536]
    assert all(-(-n // gr.block_size(n)) <= 20 for n in (0, 1, 900, 15_000, 20_001, 900_000, 1_200_000))


def test_a_missing_value_is_no_weight(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.0), (2, 1, None), (2, 2, 0.5), (2, 3, 1.0), (1, 3, 0.2), (None, 1, 0.3), (None, 3, 0.3), (1, None, 0.1)], SCHEMA)
    sums = {(r["j"], r["i"]): r["w"] for r in nb.column_products(df, {"w": ("time", "time")}).collect()}
    assert sums[1, 2] is None and sums[2, 3] == pytest.approx(0.7) and (1, 3) in sums and not any(None in p for p in sums)
    assert all(r["w"] is not None for r in nb.item_weights(df, "pearson").collect())
    assert [r["rank"] for r in nb.similar_items(nb.item_weights(df), 1).collect()] == [1, 1, 1]


def test_sums_by_cell_need_no_sort(monkeypatch):
    rng = np.random.default_rng(5)
    marks, width = st._Marks(), 50
    for n, lines in ((400, 9), (30, 9), (700, 3), (5, 9), (0, 4)):  # cells keep what earlier sums left in them
        key = np.sort(rng.integers(0, lines, n)) * width + rng.integers(0, width, n)
        value = rng.normal(size=n)
        less = np.sort(rng.choice(lines * width, 6, replace=False))  # some of them without a product
        want = np.bincount(np.r_[key, less], weights=np.r_[value, -np.ones(6)], minlength=lines * width)
        for sparse in (1 << 30, 0):
            monkeypatch.setattr(st, "SPARSE", sparse)
            got, sums = marks.added(key, value, lines * width, less, np.ones(6))
            assert sorted(got) == sorted({*key, *less}) and (np.diff(got // width) >= 0).all()
            assert np.allclose(sums, want[got])


def test_a_merge_sorts_only_what_can_be_listed():
    part = lambda line, column, score: tuple(map(np.array, (line, column, score)))
    parts = [part([0, 0, 2], [5, 7, 1], [0.9, 0.5, 0.1]), part([0, 0, 1, 2], [2, 8, 8, 3], [0.8, 0.5, -1.0, 0.7]), part([], [], [])]
    line, column, score = st._hopeful([(x.astype(int), y, z) for x, y, z in parts], 2)
    assert sorted(zip(line, column, score, strict=True)) == [(0, 2, 0.8), (0, 5, 0.9), (0, 7, 0.5), (0, 8, 0.5), (1, 8, -1.0), (2, 1, 0.1), (2, 3, 0.7)]
    line, column, score = st._hopeful([tuple(a[:2] for a in parts[0]), part([0, 0], [9, 3], [0.4, 0.3])], 2)
    assert sorted(column) == [5, 7]


@pytest.mark.parametrize("size", [1_000_000, 30])
def test_best_pairs_leave_a_task(spark, monkeypatch, size):
    """At least the k largest of every column, far fewer than all pairs, in a plan without an exchange."""
    monkeypatch.setattr(nb, "CHUNK", size)
    _, rows = table(4, 60, 40)
    df = spark.createDataFrame([*rows, (None, 105, 0.4), (20, None, 0.4), (30, 107, None)], SCHEMA)
    every = nb.item_weights(df)
    best = nb.item_weights(df, best=3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = sorted(map(tuple, nb.similar_items(every, 3).collect()), key=str)
    got = sorted(map(tuple, nb.similar_items(best, 3).collect()), key=str)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], nan_ok=True)
    assert 3 * best.count() < every.count()


def test_equal_pairs_go_out_rather_than_pile_up(monkeypatch):
    monkeypatch.setattr(st, "LISTED", 10)
    kept, out = st._Kept(2, 2), 0
    for n in range(50):
        full = kept.add(np.array([0, 0, 1]), np.array([2 * n, 2 * n + 1, n]), "w", {"w": np.array([0.5, 0.5, n / 50])})
        out += 0 if full is None else len(full[0])
        assert kept.size <= 16 + 3
    assert out >= 100 - 19 and kept.floor[0] < 0.5


def test_pairs_of_wanted_items_only(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK", 40)
    _, rows = table(6)
    df = spark.createDataFrame(rows, SCHEMA)
    every = {(r["i"], r["j"]): r["npmi"] for r in nb.npmi(df).collect()}
    wanted = spark.createDataFrame([(100,), (103,), (999,), (None,), (103,)], "track long")
    got = {(r["i"], r["j"]): r["npmi"] for r in nb.npmi(df, of=wanted).collect()}
    assert got == {k: pytest.approx(v) for k, v in every.items() if k[0] in (100, 103)} and got


def test_strips_are_packed_in_one_exchange(spark, monkeypatch):
    plans, write = [], st.materialize
    monkeypatch.setattr(st, "materialize", lambda df, name="stage": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    cells = spark.createDataFrame([(n % 3, n % 5, n, n / 2) for n in range(40, 0, -1)], "s int, r long, c long, x double")
    out = st.packed(cells, "s", 3, "r", "c", {"r": "<i8", "c": "<i4", "x": "<f8"}).collect()
    assert [p.count("Exchange") for _, p in plans] == [1] and sorted(r["s"] for r in out) == [0, 1, 2]
    for line in out:
        r, c, x = st.i8(line["r"]), st.i4(line["c"]), st.f8(line["x"])
        assert [*zip(r, c, strict=True)] == sorted((n % 5, n) for n in range(1, 41) if n % 3 == line["s"]) and (x == c / 2).all()


def test_floors_are_bounds_of_the_kth_score():
    from tastemill.operators.tiles import floors

    score = np.array([3.0, -1.0, 2.0, 1e300, -1e300, 0.1, np.nan, 5.0, -0.0, 0.0])
    line = np.array([0, 0, 0, 1, 1, 2, 2, 2, 4, 4])
    got = floors(line, score, 2, 5)
    assert got[0] == 2.0 and got[1] == -np.inf and 0.0999 < got[2] <= 0.1 and got[3] == -np.inf and got[4] <= 0.0
