"""Propagation over the user-item graph: layer averages of embeddings and personalised PageRank.

Every round is one join and one map-side combined aggregate. Results are written after each round, so the plan does not
grow and a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors, vector_dim
from ..session import materialize
from .tiles import Tiles, dealt, f8, tile, u2, walk

#: Numbers multiplied at a time inside a task.
SLAB = 500_000
BLOCKS = "b int, data binary"


def bipartite_edges(df: DataFrame, user: str = "user", item: str = "track") -> DataFrame:
    """Undirected user-item graph as directed (src, dst) edges; node names keep the two id spaces apart."""
    pairs = df.select(F.concat(F.lit("u"), user).alias("a"), F.concat(F.lit("i"), item).alias("b")).distinct()
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def propagate(edges: DataFrame, embeddings: DataFrame, layers: int = 4) -> DataFrame:
    """(id, vector): mean over layers 0..L of e(k+1)_i = sum over neighbours j of e(k)_j / sqrt(deg i * deg j)."""
    dim = vector_dim(embeddings)
    degree = degrees(edges)
    weighted = (
        edges.join(degree.withColumnRenamed("degree", "_a"), "src")
        .join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("_b")), "dst")
        .select("src", "dst", (1 / F.sqrt(F.col("_a") * F.col("_b"))).alias("w"))
    )
    weighted = materialize(weighted, "edges")
    layer = embeddings.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    total = layer
    for _ in range(layers):
        moved = weighted.join(layer.withColumnRenamed("id", "src"), "src")
        layer = materialize(
            moved.groupBy(F.col("dst").alias("id")).agg(sum_vectors("vector", dim, F.col("w")).alias("vector")), "layer"
        )
        total = total.unionByName(layer)
    sums = total.groupBy("id").agg(sum_vectors("vector", dim).alias("vector"))
    return sums.select("id", F.transform("vector", lambda x: x / (layers + 1)).alias("vector"))


def _blocks(vectors: DataFrame, numbers: DataFrame, key: str, size: int, dim: int) -> DataFrame:
    """(b, data) dense blocks of ``size`` numbered nodes; a node without a vector is zero. ``vectors``: (id, vector)."""
    placed = numbers.join(vectors.select(F.col("id").alias(key), "vector"), key, "left")
    cells = placed.select(F.floor(F.col("number") / size).cast("int").alias("b"), (F.col("number") % size).cast("int").alias("place"),
                          F.transform("vector", lambda x: x.cast("double")).alias("vector"))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = np.zeros((size, dim))
        known = np.flatnonzero(np.asarray(t["vector"].is_valid()))
        if len(known):
            lists = t["vector"].take(pa.array(known)).combine_chunks()
            flat = (lists if isinstance(lists, pa.Array) else lists.chunk(0)).flatten().to_numpy(zero_copy_only=False)
            out[t["place"].to_numpy()[known]] = flat.reshape(len(known), dim)
        return pa.table({"b": [key[0].as_py()], "data": [out.tobytes()]}, schema=pa.schema([("b", pa.int32()), ("data", pa.binary())]))

    return materialize(cells.groupBy("b").applyInArrow(pack, BLOCKS), "layer")


def _layer(parts: Tiles, blocks: DataFrame, dim: int, to_rows: bool) -> DataFrame:
    """The next layer's blocks of rows (from those of columns), or of columns: the tiles' weights times the vectors. Vectors'
    blocks are copied to the blocks they reach; of the edges, packed tiles of twelve bytes an edge are all that moves."""
    size, reached = (parts.lines, parts.row_blocks) if to_rows else (parts.side, parts.column_blocks)
    mine, other = ("rb", "cb") if to_rows else ("cb", "rb")
    sources = parts.column_blocks if to_rows else parts.row_blocks
    none = F.lit(None).cast("binary")
    vectors = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(max(reached - 1, 0)))).alias("t"), F.col("b").alias("o"),
                            F.lit(0).alias("second"), none.alias("r"), none.alias("c"), F.col("data").alias("v"))
    edges = parts.table.select(F.col(mine).alias("t"), F.col(other).alias("o"), F.lit(1).alias("second"), "r", "c", F.col("v_w").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, held = None, np.zeros((size, dim)), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["b", "data"])

        for t, o, second, r, c, v in walk(batches):
            if t != now:
                if now is not None:
                    yield done()
                now, held = t, None
                sums.fill(0.0)
            if not second:
                held = (o, f8(v).reshape(-1, dim))
            elif held is not None and held[0] == o:
                to, source, w = (u2(r), u2(c), f8(v)) if to_rows else (u2(c), u2(r), f8(v))
                if not to_rows:
                    order = np.argsort(to, kind="stable")
                    to, source, w = to[order], source[order], w[order]
                step = max(1, SLAB // dim)
                for a in range(0, len(to), step):
                    part = w[a : a + step, None] * held[1][source[a : a + step]]
                    line = to[a : a + step]
                    opens = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                    sums[line[opens]] += np.add.reduceat(part, opens, axis=0)
        if now is not None:
            yield done()

    spread = dealt(vectors.union(edges), reached, max(sources, 1), ["t"], ["o", "second"])
    return materialize(spread.mapInArrow(add, BLOCKS), "layer")


def _mean_rows(layers: list[DataFrame], numbers: DataFrame, key: str, size: int, dim: int) -> DataFrame:
    """(id, vector): the mean of each node's vectors over the layers' blocks."""
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    count = len(layers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(size * dim)

        def done() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * dim, pa.int32()), pa.array(sums / count))
            return pa.RecordBatch.from_arrays([pa.array(now * size + np.arange(size)), lists], ["number", "vector"])

        for b, data in walk(batches):
            if b != now:
                if now is not None:
                    yield done()
                now = b
                sums.fill(0.0)
            sums += f8(data)
        if now is not None:
            yield done()

    blocks = every.select("b").distinct().count()
    rows = dealt(every, blocks, 1, ["b"], []).mapInArrow(add, "number long, vector array<double>")
    return rows.join(numbers, "number").select(F.col(key).alias("id"), "vector")


def block_size(n: int) -> int:
    """Nodes of a block, of which every block of the other side gets a copy: about 16 blocks, or more of the largest size."""
    return min(1 << 16, max(1 << 10, 1 << max(0, -(-n // 16) - 1).bit_length()))


def propagate_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, layers: int = 4, user: str = "user", item: str = "track",
                    **sizes) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of users and of items: ``propagate`` over the graph of ``pairs(user, item)``, in tiles.

    ``users`` and ``items`` have (id, vector). Nodes are numbered once and the weighted edges packed once; a round moves dense
    blocks of vectors and the packed tiles, no row per edge. Pairs without user or item are left out, repeated ones count
    once; a node without a vector begins at zero; one without pairs keeps its share of the mean.
    """
    dim = vector_dim(users.unionByName(items))
    known = materialize(pairs.select(user, item).dropna().distinct(), "pairs")
    du = known.groupBy(user).agg(F.count(F.lit(1)).alias("_a"))
    di = known.groupBy(item).agg(F.count(F.lit(1)).alias("_b"))
    weighted = known.join(du, user).join(di, item).select(user, item, (1 / F.sqrt(F.col("_a") * F.col("_b"))).alias("w"))
    sizes = {"lines": block_size(du.count()), "side": block_size(di.count())} | sizes
    parts = tile(weighted, user, item, ["w"], **sizes)
    of_users = [_blocks(users, parts.rows, "row", parts.lines, dim)]
    of_items = [_blocks(items, parts.columns, "col", parts.side, dim)]
    for _ in range(layers):
        next_users = _layer(parts, of_items[-1], dim, True)
        of_items.append(_layer(parts, of_users[-1], dim, False))
        of_users.append(next_users)
    out = []
    for vectors, blocks, numbers, key, size in ((users, of_users, parts.rows, "row", parts.lines), (items, of_items, parts.columns, "col", parts.side)):
        alone = vectors.join(numbers.select(F.col(key).alias("id")), "id", "left_anti")
        alone = alone.select("id", F.transform("vector", lambda x: x.cast("double") / (layers + 1)).alias("vector"))
        out.append(_mean_rows(blocks, numbers, key, size, dim).unionByName(alone))
    return out[0], out[1]


def ppr(edges: DataFrame, seeds: DataFrame, follow: float = 0.85, rounds: int = 20) -> DataFrame:
    """(seed, id, score): personalised PageRank p = c * p P + (1 - c) * s0 by power iteration. ``seeds`` has (seed, id,
    weight) with weights summing to 1 per seed; P follows out-edges evenly. A node without out-edges sends its weight
    back to the seed's start."""
    degree = degrees(edges)
    steps = materialize(edges.join(degree, "src").select("src", "dst", (1 / F.col("degree")).alias("w")), "steps")
    start = materialize(seeds.select("seed", "id", F.col("weight").cast("double").alias("weight")), "seeds")
    score = start.withColumnRenamed("weight", "score")
    for _ in range(rounds):
        moved = (
            score.withColumnRenamed("id", "src")
            .join(steps, "src")
            .select("seed", F.col("dst").alias("id"), (F.col("score") * F.col("w") * follow).alias("score"))
        )
        kept = moved.groupBy("seed").agg(F.sum("score").alias("_kept"))
        # everything not moved on (the restart share and dead ends) returns to the start
        back = (
            start.join(kept, "seed", "left")
            .select("seed", "id", (F.col("weight") * (1 - F.coalesce("_kept", F.lit(0.0)))).alias("score"))
        )
        score = materialize(moved.unionByName(back).groupBy("seed", "id").agg(F.sum("score").alias("score")), "ranks")
    return score
