"""Vantage-point trees against brute force."""

import numpy as np
import pytest

from tastemill.llm.queries import VPTREE_FACTOR
from tastemill.llm.vptree import Tree, vptree_knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    out = {}
    for q in asked:
        x = np.array(rows[q], float)
        score = [(-(x * np.array(v, np.float32).astype(float)).sum(), i) for i, v in rows.items() if i != q and len(v) == len(x)]
        out[q] = [i for _, i in sorted(score)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_exact_with_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(300)}
    for i in range(300, 420):
        rows[i] = rows[7]  # a large group of copies
    rows[420], rows[421] = [1.0, 2.0], [3.0, 1.0]  # another length
    bad = [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [float("nan")] * 8, 1),
           (504, [float("inf")] + [0.0] * 7, 1), (505, [], 1), (None, [1.0] * 8, 1), (7, rows[7], 9)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows.items()] + bad, SCHEMA)
    asked = [0, 7, 20, 310, 420]
    queries = df.filter(df["vec_id"].isin(asked))
    got = found(vptree_knn(df, queries, "vec_id", "embedding", k=20, factor=1.0, shard_floats=600, leaf=8, block_rows=2))
    assert got == brute({i: v for i, v in rows.items()}, asked, 20)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vptree_knn(df, df, "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (VPTREE_FACTOR, 0.98), (30.0, 0.0)])
def test_recall_and_pruning(factor, least):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(20, size=3000)] + 0.2 * rng.normal(size=(3000, 16))
    tree = Tree(x, 32)
    scores, _, work = tree.search(x[:100], 10, factor)
    exact = -np.sort(-(x[:100] @ x.T), 1)[:, 9]
    assert (scores >= exact[:, None] - 1e-9).mean() >= least
    assert work < 3000 * 100 or factor == 1.0
