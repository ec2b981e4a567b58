"""Nearest neighbours through an inverted file: vectors in the cells of a coarse quantiser, searched cell by cell.

Centres are fitted on a bounded sample; every vector is then placed in the cell of its nearest centre, and a cell keeps the
largest distance of a member to its centre (its radius). A query visits the ``probes`` cells with the best centres and scores
their members exactly. What other cells could hold is bounded by centre and radius: with ``exact`` a second round visits
the cells whose bound reaches the query's k-th score so far, so that nothing is lost; without it the result is approximate,
and ``probes_for`` measures how many probes a wanted recall takes. Centres are the only broadcast, ``cells`` rows of one vector.

How much is saved depends on the vectors: tight groups need a few cells, directions without structure in many dimensions need
most of them, whatever the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import unit_vectors
from ..session import materialize
from .neighbours import MAX_TASKS
from .ordering import top_k_per
from .retrieval import ITEM_BLOCK, SCHEMA, _flat, _Lists, _packed, knn, query_blocks, shares, usable
from .tiles import expand, f8, walk

PLACED = "id long, vector array<double>, bucket long, residual double"
#: Rows that are held against all centres at a time.
ROWS = 2048


@dataclass
class InvertedFile:
    """``items``: (id, vector, bucket); ``sizes``: (bucket, n, radius); ``centres``: one row per cell."""

    items: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    metric: str

    @property
    def cells(self) -> int:
        return len(self.centres)


def _values(vectors: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return unit_vectors(x) if metric == "cosine" else x


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0.0)


def _fit(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by k-means: starts far apart, Lloyd rounds; cells that lose all members are dropped."""
    rng = np.random.default_rng(seed)
    x = x[np.lexsort(x.T[::-1])]  # whatever order Spark returned the sample in
    centres = [x[rng.integers(len(x))]]
    far = nearest_centres(x, np.array(centres))[:, 0]
    while len(centres) < min(cells, len(x)) and far.sum() > 0:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, nearest_centres(x, np.array(centres[-1:]))[:, 0])
    out = np.array(centres)
    for _ in range(rounds):
        own = nearest_centres(x, out).argmin(1)
        used = np.unique(own)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out = sums[used] / np.bincount(own, minlength=len(out))[used][:, None]
    return out


def build(items: DataFrame, cells: int | None = None, metric: str = "ip", sample: int = 50_000, rounds: int = 8, seed: int = 0) -> InvertedFile:
    """Inverted file of ``items(id, vector)`` for 'ip', 'cosine' or 'l2'. ``cells`` (default: the square root of the number of
    items, at most 16,384) centres are fitted on at most ``sample`` items, drawn by their id; every usable item is placed."""
    items = materialize(usable(items).select("id", F.col("vector").cast("array<double>").alias("vector")), "items")
    count = items.count()
    cells = cells or max(1, min(16_384, math.isqrt(count)))
    drawn = items.orderBy(uniform("id", seed=seed), "id").limit(sample).select("vector").toPandas()
    centres = _fit(_values(drawn["vector"], metric), cells, rounds, seed) if len(drawn) else np.zeros((0, 0))
    shared = items.sparkSession.sparkContext.broadcast(centres)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                part = frame.iloc[a : a + ROWS]
                far = nearest_centres(_values(part["vector"], metric), shared.value)
                yield part.assign(bucket=far.argmin(1), residual=np.sqrt(far.min(1)))

    placed = materialize(items.mapInPandas(place, PLACED), "cells")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("residual").alias("radius"))
    return InvertedFile(placed.select("id", "vector", "bucket"), materialize(sizes, "cell-sizes"), centres, metric)


def _visits(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the centres per row of ``x``."""
    return -np.sqrt(nearest_centres(x, centres)) if metric == "l2" else x @ centres.T


def _first(near: np.ndarray, probes: int) -> np.ndarray:
    """Whether a cell is among the ``probes`` with the best centres, per row; of equals the first cells."""
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
    return out


def _cells(index: InvertedFile) -> DataFrame:
    """(bucket, radius, ids, vectors): the items of a cell packed into rows of at most about ``ITEM_BLOCK``; written."""
    cuts = index.sizes.select("bucket", "radius", F.ceil(F.col("n") / ITEM_BLOCK).alias("_cuts"))
    rows = index.items.join(cuts, "bucket").select("bucket", "radius", F.pmod(F.xxhash64("id"), F.col("_cuts")).alias("_cut"), "id", "vector")

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({"bucket": [key[0].as_py()], "radius": [t["radius"][0].as_py()], "_ids": [ids[order].astype("<i8").tobytes()],
                         "_vectors": [np.ascontiguousarray(_flat(t["vector"])[order], "<f8").tobytes()]},
                        schema=pa.schema([("bucket", pa.int64()), ("radius", pa.float64()), ("_ids", pa.binary()), ("_vectors", pa.binary())]))

    packed = rows.groupBy("bucket", "_cut").applyInArrow(pack, "bucket long, radius double, _ids binary, _vectors binary")
    return materialize(packed, "cell-blocks")


def _searched(index: InvertedFile, queries: DataFrame, k: int, probes: int, digits: int, exclude_self: bool, least: DataFrame | None = None) -> DataFrame:
    """(query, item, score, rank) from the ``probes`` best cells of each query, or with ``least`` (id, least) from all others whose
    bound reaches the query's ``least``. Tasks walk through query blocks and their share of the cells, and score the
    queries of the block that visit a cell; no vector is copied per cell."""
    count = query_blocks(queries.count())
    left = _packed(queries, count).repartition(min(count, MAX_TASKS))
    if least is not None:
        bounds = least.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("b"), "id", "least").groupBy("b").agg(
            F.collect_list("id").alias("of"), F.collect_list("least").alias("least"))  # a block's queries
        left = left.join(bounds, "b", "left")
    else:
        left = left.select("*", F.lit(None).cast("array<long>").alias("of"), F.lit(None).cast("array<double>").alias("least"))
    right = _cells(index).coalesce(shares(index.items))
    centres, metric, exact = index.centres, index.metric, least is not None
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, near, first, length = None, None, None, None, None
        for b, ids, vectors, of, floors, cell, radius, item_ids, item_vectors in walk(batches):
            if b != now:
                if lists is not None:
                    yield lists.rows()
                names = np.frombuffer(ids, "<i8")
                x = f8(vectors).reshape(len(names), -1)
                none = np.array([], np.int64)
                now, lists = b, _Lists(names, x, none, none, k, metric, digits, exclude_self, once=True)
                own = unit_vectors(x) if metric == "cosine" else x
                near = _visits(own, shared.value, metric)
                first = _first(near, probes)
                length = np.sqrt((x * x).sum(axis=1)) if metric == "ip" else np.ones(len(x))
                for a, times, at in expand(np.array(of or [], np.int64), names):
                    lists.floor[at] = np.repeat(np.array(floors, float)[a], times)
            visit = first[:, cell]
            if exact:  # one unit of the last digit covers rounding
                visit = ~visit & (near[:, cell] + radius * length + 10.0**-digits >= lists.floor)
            if visit.any():
                others = np.frombuffer(item_ids, "<i8")
                lists.add(others, f8(item_vectors).reshape(len(others), -1), np.flatnonzero(visit))
        if lists is not None:
            yield lists.rows()

    parts = left.select("b", "ids", "vectors", "of", "least").crossJoin(right).mapInArrow(search, SCHEMA)
    parts = parts.groupBy("query", "item").agg(F.max("score").alias("score"))  # ids may repeat on both sides
    return top_k_per(parts, ["query"], [F.col("score").desc(), "item"], k)


def ivf_knn(index: InvertedFile, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, exclude_self: bool = False,
            digits: int = 9) -> DataFrame:
    """(query, item, score, rank): the k best items of each query among the cells it visits, or with ``exact`` among all."""
    asked = materialize(usable(queries).select("id", F.col("vector").cast("array<double>").alias("vector")), "queries")
    found = materialize(_searched(index, asked, k, probes, digits, exclude_self), "found")
    if not exact:
        return found
    last = found.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("least"))
    rest = _searched(index, asked, k, probes, digits, exclude_self, last)
    both = found.drop("rank").unionByName(rest.drop("rank")).groupBy("query", "item").agg(F.max("score").alias("score"))
    return top_k_per(both, ["query"], [F.col("score").desc(), "item"], k)


def share_compared(index: InvertedFile, queries: DataFrame, probes: int) -> float:
    """Share of all (query, item) pairs that a search with ``probes`` cells scores."""
    asked = usable(queries).select("id", F.col("vector").cast("array<double>").alias("vector"))
    shared, metric = queries.sparkSession.sparkContext.broadcast(index.centres), index.metric

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame) if len(shared.value) else 0, ROWS):
                near = _visits(_values(frame["vector"].iloc[a : a + ROWS], metric), shared.value, metric)
                times = _first(near, probes).sum(axis=0)
                yield pd.DataFrame({"bucket": np.arange(len(times)), "times": times})

    visits = asked.mapInPandas(visit, "bucket long, times long").join(index.sizes, "bucket")
    scored = visits.agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("n")).first()["n"]
    return scored / max(usable(queries).count() * index.items.count(), 1)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, hits, wanted): how many of each query's exact neighbours were found."""
    hit = exact.select("query", "item").join(found.select("query", "item", F.lit(1).alias("hit")), ["query", "item"], "left")
    return hit.groupBy("query").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def probes_for(index: InvertedFile, queries: DataFrame, k: int, wanted: float, sample: int = 256, exclude_self: bool = False,
               seed: int = 0) -> int:
    """The fewest probes that find a share ``wanted`` of the exact neighbours of at most ``sample`` queries, drawn by their id."""
    drawn = usable(queries).orderBy(uniform("id", seed=seed), "id").limit(sample).select("id", F.col("vector").cast("array<double>").alias("vector"))
    drawn = materialize(drawn, "sample")
    best = knn(drawn, index.items.select("id", "vector"), k, index.metric, exclude_self=exclude_self)
    cells = best.select("query", "item").join(index.items.select(F.col("id").alias("item"), "bucket"), "item")
    shared = drawn.sparkSession.sparkContext.broadcast(index.centres)
    metric = index.metric

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, centres = _values(frame["vector"], metric), shared.value
                near = -nearest_centres(x, centres) if metric == "l2" else x @ centres.T
                order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                yield pd.DataFrame({"place": order[np.arange(len(x)), frame["bucket"].to_numpy()] + 1})

    where = cells.join(drawn.select(F.col("id").alias("query"), "vector"), "query").select("vector", "bucket")
    counts = where.mapInPandas(places, "place long").groupBy("place").count().toPandas().sort_values("place")
    if not len(counts):
        return 1
    upto = counts["count"].cumsum() / counts["count"].sum()
    return int(counts["place"][upto >= wanted - 1e-12].iloc[0])
