"""Products of sparse tables in tiles of a known largest size.

Rows and columns are numbered densely. A tile holds the entries of ``LINES`` rows and ``SIDE`` columns as packed arrays in one
row of a table, at most ``LINES * SIDE`` of them, however often a user or an item occurs. Spark deals out, sorts and copies
tiles; a task walks through the tiles of its cells one after the other and adds their products to one dense block. It never
holds more than that block and two tiles. Sums over many rows are cut into runs, whose partial blocks are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import number_rows, top_k_per

LINES = 8192
SIDE = 1024
#: Entries of the row blocks that one run adds up.
RUN = 4_000_000
#: Products expanded at a time inside a task: few enough to stay in a core's cache.
SLAB = 100_000

CELLS = "jb int, ib int, j binary, i binary, w binary"


@dataclass
class Tiles:
    """``table``: (rb, cb, n, r, c, one packed column ``v_name`` per value); ``rows`` and ``columns``: (id, number)."""

    table: DataFrame
    rows: DataFrame
    columns: DataFrame
    n_rows: int
    n_columns: int
    n_entries: int
    lines: int = LINES
    side: int = SIDE

    @property
    def row_blocks(self) -> int:
        return math.ceil(self.n_rows / self.lines)

    @property
    def column_blocks(self) -> int:
        return math.ceil(self.n_columns / self.side)


def dense_numbers(ids: DataFrame, name: str) -> DataFrame:
    """(id, number) of the distinct values of the only column, numbered from 0 in their order; NULL has no number."""
    key = ids.columns[0]
    known = ids.filter(F.col(key).isNotNull()).distinct()
    return number_rows(known, [], [key], "number").select(F.col(key).alias(name), (F.col("number") - 1).alias("number"))


def tile(entries: DataFrame, row: str, col: str, values: list[str], columns: DataFrame | None = None, lines: int | None = None, side: int | None = None) -> Tiles:
    """Tiles of ``entries``, unique by (row, col) and without NULLs. ``columns``: all ids of columns, if there are more."""
    lines, side = lines or LINES, side or SIDE
    if max(lines, side) > 1 << 16:
        raise ValueError("places within a tile are 16-bit numbers")
    rows = materialize(dense_numbers(entries.select(row), "row"), "row-numbers")
    cols = materialize(dense_numbers(entries.select(col) if columns is None else columns, "col"), "column-numbers")
    numbered = (
        entries.join(rows.select(F.col("row").alias(row), F.col("number").alias("_r")), row)
        .join(cols.select(F.col("col").alias(col), F.col("number").alias("_c")), col)
    )
    cells = numbered.select(
        F.floor(F.col("_r") / lines).cast("int").alias("rb"), F.floor(F.col("_c") / side).cast("int").alias("cb"),
        (F.col("_r") % lines).cast("int").alias("r"), (F.col("_c") % side).cast("int").alias("c"),
        *[F.col(v).cast("double").alias(f"v_{v}") for v in values],
    )

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r, c = t["r"].to_numpy(), t["c"].to_numpy()
        order = np.lexsort((c, r))
        out = {"rb": [key[0].as_py()], "cb": [key[1].as_py()], "n": [len(r)],
               "r": [r[order].astype("<u2").tobytes()], "c": [c[order].astype("<u2").tobytes()]}
        for v in values:
            out[f"v_{v}"] = [t[f"v_{v}"].to_numpy()[order].astype("<f8").tobytes()]
        return pa.table(out, schema=pa.schema([("rb", pa.int32()), ("cb", pa.int32()), ("n", pa.int64()), *[(x, pa.binary()) for x in ("r", "c", *(f"v_{v}" for v in values))]]))

    schema = "rb int, cb int, n long, r binary, c binary" + "".join(f", v_{v} binary" for v in values)
    table = materialize(cells.groupBy("rb", "cb").applyInArrow(pack, schema), "tiles")
    return Tiles(table, rows, cols, rows.count(), cols.count(), table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], lines, side)


def expand(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """All (a, b) with left[a] == right[b], slab by slab, as (slice of a, how often each a occurs, b); ``right`` ascends."""
    start = np.searchsorted(right, left, "left")
    size = np.searchsorted(right, left, "right") - start
    upto = np.concatenate([[0], np.cumsum(size)])
    at, n = 0, len(left)
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + SLAB, "right")) - 1)
        total = upto[end] - upto[at]
        yield slice(at, end), size[at:end], np.arange(total) + np.repeat(start[at:end] - (upto[at:end] - upto[at]), size[at:end])
        at = end


def u2(value) -> np.ndarray:
    return np.frombuffer(value, "<u2").astype(np.int64)


def f8(value) -> np.ndarray:
    return np.frombuffer(value, "<f8")


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches, one at a time."""
    for batch in batches:
        columns = batch.columns
        for n in range(batch.num_rows):
            yield tuple(c[n].as_py() if not pa.types.is_binary(c.type) else c[n].as_buffer() for c in columns)


def cells_of(jb: int, ib: int, block: np.ndarray, diagonal: bool = True) -> pa.RecordBatch:
    """The cells of a square block that are not zero, row by row."""
    side = len(block)
    if not diagonal and jb == ib:
        np.fill_diagonal(block, 0.0)
    at = np.flatnonzero(block.ravel())
    packed = [(at // side).astype("<u2"), (at % side).astype("<u2"), block.ravel()[at].astype("<f8")]
    arrays = [pa.array([jb], pa.int32()), pa.array([ib], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in packed]]
    return pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in CELLS.split(", ")])


def dealt(df: DataFrame, groups: int, width: int, keys: list[str], order: list[str]) -> DataFrame:
    """``groups`` groups of ``keys``, all but the first numbers below ``width``, dealt out in turn to at most four times as many
    tasks as the session's shuffles have, and sorted."""
    number = reduce(lambda a, k: a * width + F.col(k), keys[1:], F.col(keys[0]).cast("long"))
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(groups, most))
    return df.repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int")).sortWithinPartitions(*keys, *order)


def column_products(tiles: Tiles, left: str, right: str, diagonal: bool = True) -> DataFrame:
    """(jb, ib, j, i, w) packed cells of leftᵀ · right, columns by columns, one row per block; written."""
    blocks, side = tiles.column_blocks, tiles.side
    runs = max(1, math.ceil(tiles.n_entries / RUN))
    per_run = max(1, math.ceil(tiles.row_blocks / runs))
    run = F.floor(F.col("rb") / per_run).cast("int").alias("run")
    every = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))
    own = F.col("cb")
    lefts = tiles.table.select(run, own.alias("jb"), every.alias("ib"), "rb", F.lit(0).alias("second"), "r", "c", F.col(f"v_{left}").alias("v"))
    rights = tiles.table.select(run, every.alias("jb"), own.alias("ib"), "rb", F.lit(1).alias("second"), "r", "c", F.col(f"v_{right}").alias("v"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, np.zeros(side * side), None
        for run_, jb, ib, rb, right_side, r, c, v in walk(batches):
            if (run_, jb, ib) != now:
                if now is not None:
                    yield cells_of(now[1], now[2], block.reshape(side, side), diagonal)
                now, held = (run_, jb, ib), None
                block.fill(0.0)
            if not right_side:
                held = (rb, u2(r), u2(c), f8(v))
            elif held is not None and held[0] == rb:
                other, values = u2(c), f8(v)
                for a, times, b in expand(held[1], u2(r)):
                    cells = np.repeat(held[2][a] * side, times) + other[b]
                    np.add.at(block, cells, np.repeat(held[3][a], times) * values[b])
        if now is not None:
            yield cells_of(now[1], now[2], block.reshape(side, side), diagonal)

    pairs = dealt(lefts.union(rights), blocks * blocks * runs, max(blocks, 1), ["run", "jb", "ib"], ["rb", "second"])
    parts = materialize(pairs.mapInArrow(multiply, CELLS), "products")
    if runs == 1:
        return parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, np.zeros(side * side)
        for jb, ib, j, i, w in walk(batches):
            if (jb, ib) != now:
                if now is not None:
                    yield cells_of(*now, block.reshape(side, side), diagonal)
                now = (jb, ib)
                block.fill(0.0)
            block[u2(j) * side + u2(i)] += f8(w)
        if now is not None:
            yield cells_of(*now, block.reshape(side, side), diagonal)

    return materialize(dealt(parts, blocks * blocks, max(blocks, 1), ["jb", "ib"], []).mapInArrow(add, CELLS), "products")


def floors(line: np.ndarray, score: np.ndarray, k: int, lines: int) -> np.ndarray:
    """Per line a number just below its k-th largest score or equal to it, -inf for a line of fewer scores. Line and score, rounded down
    to single precision, are one number, whose sort costs a fraction of that of columns. NaN counts as -inf."""
    score = np.where(np.isnan(score), -np.inf, score)
    with np.errstate(over="ignore"):
        near = score.astype(np.float32)
    near = np.where(near > score, np.nextafter(near, np.float32(-np.inf)), near)
    bits = near.view(np.int32).astype(np.int64)
    falling = np.where(bits < 0, (bits & 0x7FFFFFFF) | 1 << 31, 0x7FFFFFFF - bits)  # larger scores first
    key = np.sort((line.astype(np.int64) << 32) | falling)
    full = np.flatnonzero(np.bincount(line, minlength=lines) >= k)
    last = key[np.searchsorted(key, full << 32) + k - 1] & 0xFFFFFFFF
    out = np.full(lines, -np.inf)
    out[full] = np.where(last >= 1 << 31, last, 0x7FFFFFFF - last).astype(np.uint32).view(np.float32)
    return out


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns per row, -inf left out, ties to the first column; rows stay in order."""
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above = scores > cut
        # of the columns equal to the k-th best only as many as are needed, first ones first
        level = (scores == cut) & (cut > -np.inf)
        level &= level.cumsum(axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)
        rows, columns = np.nonzero(above | level)
    else:
        rows, columns = np.nonzero(scores > -np.inf)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    return rows[order], columns[order]


def top_products(tiles: Tiles, value: str, weights: DataFrame, k: int, minus: str | None = None, digits: int = 9) -> DataFrame:
    """(row, col, score, rank): the k best columns of every row of value · weights, less the row's own ``minus`` in a column.

    Every column is a candidate, one without weights with score 0; ties go to the smaller id. ``weights`` are packed cells.
    """
    n_rows, n_columns, blocks = tiles.n_rows, tiles.n_columns, tiles.column_blocks
    lines, side = tiles.lines, tiles.side
    every = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("ib")
    own = F.col(f"v_{minus}") if minus else F.lit(None).cast("binary")
    lefts = tiles.table.select("rb", every, F.col("cb").alias("jb"), F.lit(0).alias("second"), "r", "c", F.col(f"v_{value}").alias("v"), own.alias("own"))
    rights = weights.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(tiles.row_blocks - 1, 0)))).alias("rb"), "ib", "jb", F.lit(1).alias("second"),
        F.col("j").alias("r"), F.col("i").alias("c"), F.col("w").alias("v"), F.lit(None).cast("binary").alias("own"),
    )

    def finish(rb: int, ib: int, block: np.ndarray) -> pa.RecordBatch:
        height, width = min(lines, n_rows - rb * lines), min(side, n_columns - ib * side)
        scores = np.round(block.reshape(lines, side)[:height, :width], digits) + 0.0
        if not np.isfinite(scores).all():
            raise ValueError("values and weights must be finite numbers")
        line, best = best_columns(scores, k)
        arrays = [pa.array(rb * lines + line), pa.array(ib * side + best), pa.array(scores[line, best])]
        return pa.RecordBatch.from_arrays(arrays, ["r", "c", "score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, np.zeros(lines * side), None
        for rb, ib, jb, right_side, r, c, v, mine in walk(batches):
            if (rb, ib) != now:
                if now is not None:
                    yield finish(*now, block)
                now, held = (rb, ib), None
                block.fill(0.0)
            if not right_side:
                held = (jb, u2(r), u2(c), f8(v))
                if mine is not None and jb == ib:
                    block[held[1] * side + held[2]] -= f8(mine)
            elif held is not None and held[0] == jb:
                other, values = u2(c), f8(v)
                for a, times, b in expand(held[2], u2(r)):
                    cells = np.repeat(held[1][a] * side, times) + other[b]
                    np.add.at(block, cells, np.repeat(held[3][a], times) * values[b])
        if now is not None:
            yield finish(*now, block)

    pairs = dealt(lefts.union(rights), tiles.row_blocks * blocks, max(blocks, 1), ["rb", "ib"], ["jb", "second"])
    ranked = top_k_per(pairs.mapInArrow(score, "r long, c long, score double"), ["r"], [F.col("score").desc(), "c"], k)
    rows, columns = tiles.rows.withColumnRenamed("number", "r"), tiles.columns.withColumnRenamed("number", "c")
    return ranked.join(rows, "r").join(columns, "c").select("row", "col", "score", "rank")
