"""Nearest neighbours by inner product: a vantage-point tree per shard, searched by blocks of queries.

Rows are dealt by a hash of their id to shards of a bounded number of floats. Each shard holds its distinct vectors, with
the smallest ids of each, in one vantage-point tree over the usual lifting of inner product to distance: with the shard's
largest norm M, x becomes (x, sqrt(M^2 - |x|^2)) and q becomes (q, 0), so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x. A
subtree whose points lie at distances [low, high] from its vantage point is skipped when
``factor * max(d - high, low - d) > radius``, radius being the distance of the k-th best so far. Factor 1 is the
triangle inequality and exact; larger factors skip more.

Defined results: rows with a NULL id, and vectors that are NULL, empty, zero or hold NULL or non-finite numbers, take no
part; rows that repeat an id count once, with their smallest vector; vectors of different lengths never meet; equal
scores go to the smaller id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import materialize

#: Slack on computed distances, and spare candidates that are scored again, so that rounding loses no neighbour.
SLACK, SPARE = 1e-7, 12


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(usable)
    one = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec).alias("vec"))
    return one.withColumn("dim", F.size("vec"))


class Tree:
    """Distinct vectors of one shard in tree order. A node is (from, to, vantage, low/high of both halves, both halves)."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.x = vectors
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.top = square.max()
        self.rest = np.sqrt(np.maximum(self.top - square, 0))
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(vectors), leaf, np.random.default_rng(len(vectors)))

    def _spread(self, vantage: int, rows: np.ndarray) -> np.ndarray:
        dot = self.x[rows] @ self.x[vantage] + self.rest[rows] * self.rest[vantage]
        return np.sqrt(np.maximum(2 * (self.top - dot), 0))

    def _build(self, a: int, b: int, leaf: int, draw: np.random.Generator) -> int:
        if b - a <= leaf:
            self.nodes.append((a, b, -1, 0.0, 0.0, 0.0, 0.0, -1, -1))
            return len(self.nodes) - 1
        rows = self.order[a:b]
        tries = draw.choice(rows, min(8, b - a), replace=False)
        sample = draw.choice(rows, min(256, b - a), replace=False)
        vantage = max(tries, key=lambda v: self._spread(v, sample).std())  # the widest spread parts best
        away = self._spread(vantage, rows)
        half = (b - a) // 2
        turn = np.argpartition(away, half)
        self.order[a:b], away = rows[turn], away[turn]
        near, far = away[:half], away[half:]
        left = self._build(a, a + half, leaf, draw)
        right = self._build(a + half, b, leaf, draw)
        self.nodes.append((a, b, int(vantage), near.min(), near.max(), far.min(), far.max(), left, right))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, rows) of the k best of each query, unsorted, -inf where there are fewer; and the scores computed."""
        size = np.einsum("ij,ij->i", q, q)
        scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        packed = np.ascontiguousarray(self.x[self.order])
        work = 0

        def visit(at: int, who: np.ndarray) -> None:
            nonlocal work
            if not len(who):
                return
            a, b, vantage, near_low, near_high, far_low, far_high, left, right = self.nodes[at]
            if vantage < 0:
                work += len(who) * (b - a)
                both = np.concatenate([scores[who], q[who] @ packed[a:b].T], 1)
                rows = np.concatenate([found[who], np.broadcast_to(self.order[a:b], (len(who), b - a))], 1)
                best = np.argpartition(-both, min(k, both.shape[1]) - 1, 1)[:, :k]
                scores[who], found[who] = np.take_along_axis(both, best, 1), np.take_along_axis(rows, best, 1)
                return
            work += len(who)
            away = np.sqrt(np.maximum(size[who] + self.top - 2 * (q[who] @ self.x[vantage]), 0))

            def need(low: float, high: float, those: np.ndarray) -> np.ndarray:
                radius = np.sqrt(np.maximum(size[who[those]] + self.top - 2 * scores[who[those]].min(1), 0))
                gap = np.maximum(away[those] - high, low - away[those])
                return those[~(factor * gap > radius + SLACK * (1 + radius))]

            inner = away < (near_high + far_low) / 2
            first, second = np.nonzero(inner)[0], np.nonzero(~inner)[0]
            visit(left, who[need(near_low, near_high, first)])
            visit(right, who[need(far_low, far_high, second)])
            visit(right, who[need(far_low, far_high, first)])
            visit(left, who[need(near_low, near_high, second)])

        with np.errstate(invalid="ignore"):
            visit(self.root, np.arange(len(q)))
        return scores, found, work


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_shards(rows: DataFrame, shards: int, k: int, leaf: int) -> DataFrame:
    """One row per shard: dim, shard and its tree."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy()
        vectors = np.stack(frame["vec"].to_numpy()).astype(float)
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        turn = np.lexsort((ids, which.ravel()))
        which, ids = which.ravel()[turn], ids[turn]
        start = np.searchsorted(which, np.arange(len(distinct) + 1))
        # of equal vectors only the k + 1 smallest ids of the shard can be among k neighbours
        keep = np.arange(len(ids)) - start[which] <= k
        start = np.searchsorted(which[keep], np.arange(len(distinct) + 1))
        tree = Tree(distinct, leaf)
        nodes = np.array(tree.nodes, float)
        blob = _pack(x=tree.x, order=tree.order, nodes=nodes, ids=ids[keep], start=start)
        return pd.DataFrame({"dim": [vectors.shape[1]], "shard": [frame["shard"].iloc[0]], "tree": [blob]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")


def _load(blob: bytes) -> tuple[Tree, np.ndarray, np.ndarray]:
    held = np.load(io.BytesIO(blob))
    tree = Tree.__new__(Tree)
    tree.x, tree.order = held["x"], held["order"]
    square = np.einsum("ij,ij->i", tree.x, tree.x)
    tree.top = square.max()
    tree.rest = np.sqrt(np.maximum(tree.top - square, 0))
    tree.nodes = [(int(n[0]), int(n[1]), int(n[2]), *n[3:7], int(n[7]), int(n[8])) for n in held["nodes"]]
    tree.root = len(tree.nodes) - 1
    return tree, held["ids"], held["start"]


def search_shard(blob: bytes, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> pd.DataFrame:
    """The k best of one shard for each query, without the query's own id; exact scores, ties to the smaller id."""
    tree, ids, start = _load(blob)
    _, found, work = tree.search(q, min(k + 1 + SPARE, len(tree.x)), factor)
    who, col = np.nonzero(found >= 0)
    rows = found[who, col]
    score = np.empty(len(rows))
    for a in range(0, len(rows), 65_536):  # one sum per pair, the same wherever the pair stands
        b = a + 65_536
        score[a:b] = (q[who[a:b]] * tree.x[rows[a:b]]).sum(1)
    many = start[rows + 1] - start[rows]
    at = np.repeat(start[rows] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    out = pd.DataFrame({"query_id": query_ids[np.repeat(who, many)], "vec_id": ids[at], "score": np.repeat(score, many)})
    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    out = out.groupby("query_id", sort=False).head(k)
    return out.assign(compared=work / max(1, len(q) * len(tree.x)))


def vptree_knn(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 20, factor: float = 1.0,
               shard_floats: int = 1 << 19, leaf: int = 256, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` rows of largest inner product, the query's own id left out.

    ``factor`` 1 is exact, larger ones trade recall for skipped subtrees. A task holds one shard of ``shard_floats``
    numbers and about ``block_rows`` queries. ``compared`` is the share of the shard that the block was scored against.
    """
    rows = materialize(clean_vectors(vectors, id_col, vec_col), "vectors")
    asked = clean_vectors(queries, id_col, vec_col)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    shards = max(1, -(-size["n"] * size["dim"] // shard_floats))
    trees = materialize(build_shards(rows, shards, k, leaf), "trees")
    blocks = max(1, -(-asked.count() // block_rows))

    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def meet(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "compared": []})
        q = np.stack(block["vec"].to_numpy()).astype(float)
        return search_shard(tree["tree"].iloc[0], block["id"].to_numpy(), q, k, factor)

    key = ["dim", "shard", "block"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        meet, "query_id long, vec_id long, score double, compared double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "compared")
