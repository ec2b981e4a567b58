"""The inverted file against exact search."""

import numpy as np
import pytest

from tastemill.operators import inverted as iv
from tastemill.operators import retrieval as rt

SCHEMA = "id long, vector array<double>"


def clusters(n=600, groups=30, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 6
    return centres[rng.integers(groups, size=n)] + rng.standard_normal((n, dim)) * 0.4


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], SCHEMA)


def listed(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["item"], r["score"]))
    return out


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
@pytest.mark.parametrize("kind", ["tight", "random"])
def test_exact_search_through_cells(spark, metric, kind):
    v = clusters(200, 12) if kind == "tight" else np.random.default_rng(4).standard_normal((150, 8))
    v[7] = v[9]  # equal vectors: ties
    v[5] = 0.0
    df = frame(spark, v)
    index = iv.build(df, 12, metric)
    assert index.sizes.agg({"n": "sum"}).first()[0] == len(v)
    got = listed(iv.ivf_knn(index, df, 6, probes=1, exact=True, exclude_self=True))
    assert got == listed(rt.knn(df, df, 6, metric, exclude_self=True))


def test_few_cells_find_the_neighbours_of_tight_groups(spark):
    df = frame(spark, clusters())
    index = iv.build(df, metric="l2", cells=30)
    exact = rt.knn(df, df, 5, "l2", exclude_self=True)
    probes = iv.probes_for(index, df, 5, 0.95, exclude_self=True)
    assert iv.share_compared(index, df, probes) < 0.12
    found = iv.recall(iv.ivf_knn(index, df, 5, probes, exclude_self=True), exact).agg({"hits": "sum", "wanted": "sum"}).first()
    assert found["sum(hits)"] >= 0.9 * found["sum(wanted)"]
    assert iv.probes_for(index, df, 5, 1.0, exclude_self=True) >= probes


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for metric in ("ip", "cosine", "l2"):
        got = rt.knn(df, df, 3, metric, exclude_self=True)
        assert {(r["query"], r["item"]) for r in got.collect()} == {(a, b) for a in (0, 1, 6) for b in (0, 1, 6) if a != b}
        index = iv.build(df, 2, metric)
        assert listed(iv.ivf_knn(index, df, 3, 2, exclude_self=True)) == listed(got)
    none = df.limit(0)
    assert iv.ivf_knn(iv.build(none), df, 3, exact=True).count() == 0
    assert iv.ivf_knn(iv.build(df), none, 3, exact=True).count() == 0
    assert iv.probes_for(iv.build(none), df, 3, 0.9) == 1


def test_bands_follow_the_threshold():
    assert rt.band_shape(96, 0.15) == (48, 2) and rt.band_shape(16, 0.9)[1] >= 4
    bands, rows = rt.band_shape(128, 0.5)
    assert abs((1 / bands) ** (1 / rows) - 0.5) < 0.05


def test_minhash_of_similar_users(spark):
    rows = [(u, i) for u in (1, 2) for i in range(20)] + [(3, i) for i in range(100, 120)] + [(2, 50)]
    df = spark.createDataFrame(rows, "user long, track long")
    got = {(r["query"], r["item"]) for r in rt.minhash_neighbours(df, 3, hashes=64, threshold=0.7).collect()}
    assert got == {(1, 2), (2, 1)}
