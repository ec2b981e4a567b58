"""Nearest neighbours and top-n retrieval over vector tables.

Exact search compares every query with every item by definition. Both tables are cut into blocks, each packed into one
row of a table. A task holds its query blocks, by which the item blocks pass, scores them in NumPy a slab at a time and keeps
the best k per query, so only k rows per query travel on and no vector is shuffled per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.vectors import cosine, dot, scale, sum_vectors, unit_vectors, vector_dim
from ..session import materialize
from .joins import semi
from .neighbours import MAX_TASKS, top_columns
from .ordering import number_rows, sample_weighted, top_k_per
from .tiles import expand, f8, floors, walk

QUERY_BLOCK = 4096
ITEM_BLOCK = 8192
#: Bytes of the item vectors that one task walks through.
SHARE = 1 << 26
#: Query blocks from which on all cores have work.
ENOUGH = 48
#: Scores held at a time.
SCORES = 1_000_000
#: Queries and items whose single-precision scores lie in a core's cache; largest number that single precision is used for.
TILE, WIDTH, LARGEST = 512, 512, 1e15
#: Rows up to which a bucket counts as small, rows of small buckets searched together, pairs up to which no matrix pays.
SMALL, CHUNK, FEW = 1000, 20_000, 4096
#: Pairs of a user and an item whose vectors one task adds up, vectors that pass it at a time.
PAIRS, VECTOR_BLOCK = 200_000, 32_768


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Higher is better for every metric."""
    if metric == "match":  # share of equal places of two signatures
        same = np.zeros((len(q), len(v)))
        for place in range(q.shape[1]):
            same += q[:, place][:, None] == v[:, place][None, :]
        return same / q.shape[1]
    if metric == "cosine":
        q, v = unit_vectors(q), unit_vectors(v)  # a zero vector has cosine 0 with every other
    products = q @ v.T
    if metric == "l2":
        square = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * products
        return -np.sqrt(np.maximum(square, 0.0))
    return products


def _best(k: int, metric: str, digits: int, exclude_self: bool):
    def best(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "item": [], "score": []}).astype(
            {"query": "int64", "item": "int64", "score": "float64"}
        )
        if not len(lp) or not len(rp):
            return empty
        rp = rp.sort_values("id")
        kind = np.int64 if metric == "match" else np.float64
        ids, items = rp["id"].to_numpy(), np.stack(rp["vector"].to_numpy()).astype(kind)
        out = []
        step = max(1, SCORES // len(ids))
        for at in range(0, len(lp), step):
            part = lp.iloc[at : at + step]
            names = part["id"].to_numpy()
            scores = np.round(_scores(np.stack(part["vector"].to_numpy()).astype(kind), items, metric), digits)
            if exclude_self:
                scores[names[:, None] == ids[None, :]] = -np.inf
            line, best = top_columns(scores, k)
            out.append(pd.DataFrame({"query": names[line], "item": ids[best], "score": scores[line, best]}))
        return pd.concat(out) if out else empty

    return best


SCHEMA = "query long, item long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of (id, vector, ..) that take part in a search: with an id and a vector of finite numbers. The others, with a
    NULL vector or component, or one that is not finite, neither ask nor are found."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))


def _joined(column: pa.ChunkedArray) -> pa.Array:
    one = column.combine_chunks()
    return one if isinstance(one, pa.Array) else one.chunk(0)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, without NULLs, as a matrix."""
    lists = _joined(column)
    size = np.diff(lists.offsets.to_numpy())
    if len(size) and size.min() != size.max():
        raise ValueError(f"vectors of different lengths: {size.min()} .. {size.max()}")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(size), int(size[0]) if len(size) else 0)


PACKED = "b int, ids binary, vectors binary"


def _packed(vectors: DataFrame, blocks: int, seen: DataFrame | None = None) -> DataFrame:
    """One row per block of (id, vector) rows, ordered by id: (b, ids, vectors), with ``seen`` (query, item) also the pairs
    (line, known) of the block's queries; written."""
    block = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    rows = vectors.select(block("id").alias("b"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> dict:
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return {"b": [key[0].as_py()], "ids": [ids[order].astype("<i8").tobytes()],
                "vectors": [np.ascontiguousarray(_flat(t["vector"])[order], "<f8").tobytes()]}

    schema = pa.schema([("b", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
    if seen is None:
        done = rows.groupBy("b").applyInArrow(lambda key, t: pa.table(pack(key, t), schema=schema), PACKED)
        return materialize(done, "blocks")
    known = seen.select(block("query").alias("b"), F.col("query").cast("long").alias("query"), F.col("item").cast("long").alias("item"))

    def pack_seen(key: tuple[pa.Scalar, ...], t: pa.Table, s: pa.Table) -> pa.Table:
        full = schema.append(pa.field("line", pa.binary())).append(pa.field("known", pa.binary()))
        if not t.num_rows:
            return full.empty_table()
        out = pack(key, t)
        query, item = s["query"].to_numpy(), s["item"].to_numpy()
        lines, items = [], []
        for a, times, b in expand(query, np.frombuffer(out["ids"][0], "<i8")):
            lines.append(b)
            items.append(np.repeat(item[a], times))
        out["line"] = [np.concatenate([*lines, []]).astype("<i4").tobytes()]
        out["known"] = [np.concatenate([*items, np.array([], "<i8")]).astype("<i8").tobytes()]
        return pa.table(out, schema=full)

    both = rows.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(pack_seen, PACKED + ", line binary, known binary")
    return materialize(both, "blocks")


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the few that are true, found eight at a time."""
    if len(mask) % 8:
        return np.flatnonzero(mask)
    at = (np.flatnonzero(mask.view(np.int64))[:, None] * 8 + np.arange(8)).ravel()
    return at[mask[at]]


class _Lists:
    """The k best items so far of every query of a block. What cannot reach a query's k-th score is left out early."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, line: np.ndarray, known: np.ndarray, k: int | None, metric: str, digits: int, exclude_self: bool, once: bool = False):
        self.once = once  # an item that comes in several rows takes one place
        self.ids, self.vectors, self.line, self.known = ids, unit_vectors(vectors) if metric == "cosine" else vectors, line, known
        self.k, self.metric, self.digits, self.exclude_self = k, metric, digits, exclude_self
        self.square = (vectors * vectors).sum(axis=1)[:, None]
        self.floor = np.full(len(ids), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray | None = None) -> None:
        """Score items for all queries or those at ``lines``; ``ids`` ascend."""
        if self.metric == "cosine":
            vectors = unit_vectors(vectors)
        every = lines is None
        lines = np.arange(len(self.ids)) if every else lines
        mine, square = (self.vectors, self.square) if every else (self.vectors[lines], self.square[lines])
        at = np.minimum(np.searchsorted(ids, self.known), len(ids) - 1)
        there = ids[at] == self.known
        out_line, out_at = self.line[there], at[there]
        if self.exclude_self:
            own = [(np.repeat(np.arange(s.start, s.stop), times), b) for s, times, b in expand(self.ids, ids)]
            out_line = np.concatenate([out_line, *[x for x, _ in own]]).astype(np.int64)
            out_at = np.concatenate([out_at, *[x for _, x in own]]).astype(np.int64)
        if not every:
            place = np.full(len(self.ids), -1)
            place[lines] = np.arange(len(lines))
            out_line, out_at = place[out_line][place[out_line] >= 0], out_at[place[out_line] >= 0]
        order = np.argsort(out_at, kind="stable")
        out_line, out_at = out_line[order], out_at[order]
        step = max(1, SCORES // max(1, len(lines)))
        for a in range(0, len(ids), step):
            if self._rough(mine, vectors, lines):
                self._sift(ids, vectors, mine, lines, out_line, out_at, a)
                return
            part = vectors[a : a + step]
            scores = mine @ part.T
            if self.metric == "l2":
                scores = -np.sqrt(np.maximum(square + (part * part).sum(axis=1)[None, :] - 2 * scores, 0.0))
            lo, hi = np.searchsorted(out_at, [a, a + step])
            scores[out_line[lo:hi], out_at[lo:hi] - a] = -np.inf
            floor = self.floor[lines]
            if self.k is not None and not self.once and not np.isfinite(floor).all():
                line, col = top_columns(np.round(scores, self.digits), self.k)
            else:  # what rounds to the k-th score is less than a unit of the last digit below it
                line, col = np.nonzero(scores >= (floor - 10.0**-self.digits)[:, None])
            values = scores[line, col]
            some = values > -np.inf
            self.found.append((lines[line[some]], ids[a + col[some]], np.round(values[some], self.digits)))
            self.size += int(some.sum())
            if self.k is not None and (every and len(self.found) == 1 or self.size > 2 * self.k * len(self.ids)):
                self.cut()

    def _rough(self, mine: np.ndarray, vectors: np.ndarray, lines: np.ndarray) -> bool:
        """Whether single precision can tell what need not be scored: every query has a floor and the numbers are not too large."""
        if self.k is None or self.once or self.metric == "l2" or not len(lines) or not np.isfinite(self.floor[lines]).all():
            return False
        return max(np.abs(mine).max(initial=0.0), np.abs(vectors).max(initial=0.0)) < LARGEST

    def _sift(self, ids, vectors, mine, lines, out_line, out_at, first: int) -> None:
        """Add the items from place ``first``: tiles of single-precision scores show which pairs may reach a query's floor, these
        are scored in full. What the rough score may be off by is a bound on the rounding of its inputs and of its sum."""
        dim = max(1, vectors.shape[1])
        q, v = mine.astype(np.float32), vectors.astype(np.float32)
        off = (dim + 4) * 2.0**-23 * np.sqrt((mine * mine).sum(axis=1)) * math.sqrt((vectors * vectors).sum(axis=1).max(initial=0.0))
        hidden = np.sort(out_line * len(ids) + out_at)
        low = self._lowest(lines, off)
        rough, above = np.empty(TILE * WIDTH, np.float32), np.empty(TILE * WIDTH, bool)
        for a in range(first, len(ids), WIDTH):
            part = v[a : a + WIDTH].T
            some = []
            for b in range(0, len(lines), TILE):
                block = q[b : b + TILE]
                shape = len(block), part.shape[1]
                scores, mask = (x[: shape[0] * shape[1]].reshape(shape) for x in (rough, above))
                np.matmul(block, part, out=scores)
                np.greater_equal(scores, low[b : b + TILE, None], out=mask)
                at = _true(mask.ravel())
                if len(at):
                    some.append((at // shape[1] + b) * len(ids) + (at % shape[1] + a))
            if not some:
                continue
            pair = np.concatenate(some)
            if len(hidden):
                pair = pair[hidden[np.minimum(np.searchsorted(hidden, pair), len(hidden) - 1)] != pair]
            line, col = pair // len(ids), pair % len(ids)
            values = np.concatenate([np.zeros(0), *[(mine[line[n : n + FEW]] * vectors[col[n : n + FEW]]).sum(axis=1) for n in range(0, len(line), FEW)]])
            kept = values >= self.floor[lines[line]] - 10.0**-self.digits
            self.found.append((lines[line[kept]], ids[col[kept]], np.round(values[kept], self.digits)))
            self.size += int(kept.sum())
            if self.size > 2 * self.k * len(self.ids):
                self.lift()
                low = self._lowest(lines, off)

    def _lowest(self, lines: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The single-precision score from which on a pair may reach the floor."""
        return np.nextafter((self.floor[lines] - 10.0**-self.digits - off).astype(np.float32), np.float32(-np.inf))

    def lift(self) -> None:
        """Raise the floors to about the k-th scores and drop what is below."""
        line, item, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.floor = np.maximum(self.floor, floors(line, score, self.k, len(self.ids)))
        kept = score >= self.floor[line]
        line, item, score = line[kept], item[kept], score[kept]
        self.found, self.size = [(line, item, score)], len(line)
        if self.size > 2 * self.k * len(self.ids):  # many equal scores
            self.cut()

    def cut(self) -> None:
        line, item, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        if self.once:
            order = np.lexsort((-score, item, line))
            line, item, score = line[order], item[order], score[order]
            fresh = np.r_[True, (line[1:] != line[:-1]) | (item[1:] != item[:-1])][: len(line)]
            line, item, score = line[fresh], item[fresh], score[fresh]
        order = np.lexsort((item, -score, line))
        line, item, score = line[order], item[order], score[order]
        if self.k is not None:
            place = np.arange(len(line)) - np.searchsorted(line, line, "left")
            last = place == self.k - 1
            self.floor[line[last]] = score[last]
            kept = place < self.k
            line, item, score = line[kept], item[kept], score[kept]
        self.found, self.size = [(line, item, score)], len(line)

    def rows(self) -> pa.RecordBatch:
        if self.found:
            self.cut()
        line, item, score = self.found[0] if self.found else (np.array([], int), np.array([], "<i8"), np.array([], float))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[line]), pa.array(item), pa.array(score)], ["query", "item", "score"])

    def ranked(self) -> pa.RecordBatch:
        """The k best of every query that has seen all items, with their rank; rows of one query share its list."""
        query, item, score = (x.to_numpy() for x in self.rows().columns)
        if (self.ids[1:] == self.ids[:-1]).any():
            order = np.lexsort((item, -score, query))
            query, item, score = query[order], item[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        kept = rank < self.k
        arrays = [pa.array(x[kept]) for x in (query, item, score, (rank + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["query", "item", "score", "rank"])


def query_blocks(n: int) -> int:
    """Blocks of ``n`` queries; few of them are cut finer so that all cores get work."""
    return max(1, math.ceil(n / QUERY_BLOCK), min(16, math.ceil(n / 256)))


def shares(items: DataFrame) -> int:
    """How many shares the items' blocks are walked in: a share takes about ``SHARE`` bytes."""
    n, size = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return max(1, math.ceil(n * (size or 0) * 8 / SHARE))


def passes(items: DataFrame, blocks: int) -> int:
    """In how many parts the items pass by ``blocks`` query blocks: one as soon as the blocks alone give all cores work, since
    every part passes on k rows per query."""
    return 1 if blocks >= ENOUGH else min(shares(items), math.ceil(ENOUGH / blocks))


def knn(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    metric: str = "ip",
    exclude_self: bool = False,
    seen: DataFrame | None = None,
    digits: int = 9,
) -> DataFrame:
    """(query, item, score, rank): the k best items per query by inner product 'ip', 'cosine' or 'l2' (negated distance).

    Both tables have (id, vector). ``seen`` (query, item) pairs are left out before the cut, so every list is full when
    enough items remain. Ties go to the smaller item id. ``k=None`` keeps all scores (for small samples). Rows that are not
    ``usable`` take no part.
    """
    queries, items = usable(queries), usable(items)
    # written once: their rows are counted, then packed
    queries, items = materialize(queries.select("id", "vector"), "queries"), materialize(items.select("id", "vector"), "items")
    nq = query_blocks(queries.count())
    ni = max(1, math.ceil(items.count() / ITEM_BLOCK))
    if seen is not None:
        seen = semi(semi(seen.select("query", "item"), queries.select(F.col("id").alias("query")), ["query"]), items.select(F.col("id").alias("item")), ["item"]).distinct()
    # The items' blocks are read where they are written and pass by the query blocks that a task holds: no vector is shuffled
    # again, and a query's k best leave a task once, however many items there are
    parts, count = min(nq, MAX_TASKS), passes(items, nq)
    asked = _packed(queries, nq, seen)
    if seen is None:
        asked = asked.withColumn("line", F.lit(b"")).withColumn("known", F.lit(b""))
    asked = asked.select("b", "ids", "vectors", "line", "known").repartitionById(parts, F.pmod("b", F.lit(parts)).cast("int"))
    passing = _packed(items, ni).select(F.col("ids").alias("_ids"), F.col("vectors").alias("_vectors")).coalesce(count)
    final = count == 1 and k is not None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Lists] = {}
        for item_ids, item_vectors, b, ids, vectors, line, known in walk(batches):
            if b not in held:
                names = np.frombuffer(ids, "<i8")
                held[b] = _Lists(names, f8(vectors).reshape(len(names), -1), np.frombuffer(line, "<i4").astype(np.int64),
                                 np.frombuffer(known, "<i8"), k, metric, digits, exclude_self)
            others = np.frombuffer(item_ids, "<i8")
            held[b].add(others, f8(item_vectors).reshape(len(others), -1))
        for lists in held.values():
            yield lists.ranked() if final else lists.rows()

    found = passing.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(score, SCHEMA + ", rank int" if final else SCHEMA)
    if final:
        return found
    if k is None:
        return number_rows(found, ["query"], [F.col("score").desc(), "item"], "rank")
    return top_k_per(found, ["query"], [F.col("score").desc(), "item"], k)


def recommend(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(user, track, score, rank) from factor tables (id, vector); ``seen`` has (user, track)."""
    known = None if seen is None else seen.select(F.col("user").alias("query"), F.col("track").alias("item"))
    found = knn(users, items, k, "ip", seen=known)
    return found.select(F.col("query").alias("user"), F.col("item").alias("track"), "score", "rank")


def item_to_item(items: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """k nearest other items per item."""
    return knn(items, items, k, metric, exclude_self=True)


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, alias: str = "score", how: str = "inner") -> DataFrame:
    """Inner product of the vectors of given (user, track) pairs."""
    u = users.select(F.col("id").alias("user"), F.col("vector").alias("_uv"))
    i = items.select(F.col("id").alias("track"), F.col("vector").alias("_iv"))
    if how == "inner":  # pairs without two vectors go before any vector travels
        pairs = semi(semi(pairs, i.select("track"), ["track"]), u.select("user"), ["user"])
    return pairs.join(u, "user", how).join(i, "track", how).withColumn(alias, dot("_uv", "_iv")).drop("_uv", "_iv")


def mean_vectors(history: DataFrame, items: DataFrame, user: str = "user", item: str = "track") -> DataFrame:
    """(id, vector): mean vector of each user's distinct items.

    Users are dealt into chunks, one packed row each; a chunk with many pairs, such as that of one busy user, is cut by items.
    Up to ``VECTOR_BLOCK`` items, a chunk gets the vectors of its items. More items than that would send about a vector per
    pair; their blocks are read where they are written and pass by the chunk that a task holds, so no vector is shuffled per
    chunk. A chunk passes on one sum per user.
    """
    dim = vector_dim(items)
    vectors = items.select(F.col("id").alias(item), F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(None).cast("double"), dim)).alias("_v"))
    plays = materialize(semi(history.select(user, item), vectors.select(item), [item]).distinct(), "plays")
    n_plays, blocks = plays.count(), max(1, math.ceil(vectors.count() / VECTOR_BLOCK))
    chunks = max(1, math.ceil(n_plays / PAIRS), min(16, math.ceil(n_plays / 10_000)) if blocks > 1 else 1)
    block = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int").alias("b")
    dealt = plays.withColumn("_u", F.pmod(F.xxhash64(user), F.lit(chunks)).cast("int"))
    sizes = materialize(dealt.groupBy("_u").agg(F.ceil(F.count(F.lit(1)) / (2 * PAIRS)).cast("int").alias("_cuts")), "chunk-sizes")
    whole = (sizes.agg(F.max("_cuts")).first()[0] or 1) == 1
    dealt = dealt.join(sizes, "_u").select("_u", F.pmod(F.xxhash64(item), F.col("_cuts")).cast("int").alias("_t"), block, F.col(user).alias("id"), F.col(item).alias("item"))
    kind, item_kind = plays.schema[user].dataType, plays.schema[item].dataType

    def pack(pairs: pa.Table) -> pa.Table:
        names, b = _joined(pairs["id"]).dictionary_encode("encode"), pairs["b"].to_numpy()
        place = names.indices.to_numpy()
        order = np.lexsort((place, b))
        opens = np.searchsorted(b[order], np.arange(blocks + 1))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names.dictionary, _joined(pairs["item"]).take(pa.array(order)))]
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (place[order].astype("<i4"), opens.astype("<i8"))]
        return pa.table([pairs["_u"][:1], pairs["_t"][:1], lists[0], packed[0], lists[1], packed[1]], names=["_u", "_t", "names", "who", "asked", "opens"])

    def pack_vectors(rows: pa.Table) -> pa.Table:
        ids = _joined(rows["id"])
        values = _joined(rows["_v"]).flatten()
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (values.fill_null(0.0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False))]
        return pa.table([rows["b"][:1], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *packed], names=["b", "ids", "values", "there"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                b, ids, values, there, u, t, names, who, asked, opens = (x[n] for x in batch.columns)
                key = u.as_py(), t.as_py()
                if key not in held:
                    size = len(names.values)
                    held[key] = names.values, np.zeros((size, dim)), np.zeros((size, dim), bool), np.zeros(size, np.int64)
                _, sums, some, count = held[key]
                lo, hi = np.frombuffer(opens.as_buffer(), "<i8")[b.as_py() :][:2]
                place = np.frombuffer(who.as_buffer(), "<i4")[lo:hi]
                codes = pa.concat_arrays([asked.values.slice(lo, hi - lo), ids.values]).dictionary_encode().indices.to_numpy()
                matrix, known = (np.frombuffer(x.as_buffer(), kind).reshape(len(ids.values), dim) for x, kind in ((values, "<f8"), (there, bool)))
                meet(place, codes[: hi - lo], codes[hi - lo :], matrix, known, sums, some, count)
        for names, *sums in held.values():
            for lo in range(0, len(names), 10_000):
                yield from rows_of(names[lo : lo + 10_000], *[x[lo : lo + 10_000] for x in sums]).to_batches()

    def meet(place, left, right, matrix, known, sums, some, count) -> None:
        """Add the vectors with codes ``right`` to the sums of the users at ``place``, in order, whose items have codes ``left``."""
        order = np.argsort(right, kind="stable")
        for a, times, at in expand(left, right[order]):
            if not len(at):
                continue
            who, line = np.repeat(place[a], times), order[at]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            sums[who[first]] += np.add.reduceat(matrix[line], first)
            some[who[first]] |= np.logical_or.reduceat(known[line], first)
            count += np.bincount(who, minlength=len(count))

    def rows_of(names, sums, some, count) -> pa.Table:
        flat = pa.array(sums.ravel(), mask=~some.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * dim, pa.int32()), flat)
        return pa.table([names, lists, pa.array(count)], names=["id", "_v", "_n"])

    def add_given(pairs: pa.Table, given: pa.Table) -> pa.Table:
        names = _joined(pairs["id"]).dictionary_encode("encode")
        place = names.indices.to_numpy()
        codes = pa.concat_arrays([_joined(pairs["item"]), _joined(given["item"])]).dictionary_encode().indices.to_numpy()
        left, right = codes[: len(place)], codes[len(place) :]
        values = _joined(given["_v"]).flatten()
        matrix = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(right), dim)
        known = values.is_valid().to_numpy(zero_copy_only=False).reshape(len(right), dim)
        size, by_user = len(names.dictionary), np.argsort(place, kind="stable")
        sums = np.zeros((size, dim)), np.zeros((size, dim), bool), np.zeros(size, np.int64)
        meet(place[by_user], left[by_user], right, matrix, known, *sums)
        return rows_of(names.dictionary, *sums)

    schema = StructType([StructField("id", kind), StructField("_v", ArrayType(DoubleType())), StructField("_n", LongType())])
    if blocks == 1:
        needed = dealt.select("_u", "_t", "item").distinct().join(vectors.withColumnRenamed(item, "item"), "item")
        own, given = (x.select(*[F.col(c).alias(c) for c in ("_u", "_t", *more)]).groupBy("_u", "_t") for x, more in ((dealt, ("id", "item")), (needed, ("item", "_v"))))
        parts = own.cogroup(given).applyInArrow(add_given, schema)
    else:
        fields = lambda ints, **more: StructType([*[StructField(n, IntegerType()) for n in ints], *[StructField(n, x) for n, x in more.items()]])
        given = vectors.select(block, F.col(item).alias("id"), "_v").filter(F.col("id").isNotNull()).groupBy("b")
        given = given.applyInArrow(pack_vectors, fields(["b"], ids=ArrayType(item_kind), values=BinaryType(), there=BinaryType()))
        asking = dealt.groupBy("_u", "_t").applyInArrow(pack, fields(["_u", "_t"], names=ArrayType(kind), who=BinaryType(), asked=ArrayType(item_kind), opens=BinaryType()))
        asking = asking.repartitionById(chunks, F.pmod(F.col("_u") + F.col("_t"), F.lit(chunks)).cast("int"))
        parts = materialize(given, "vector-blocks").coalesce(1).crossJoin(asking.hint("shuffle_replicate_nl")).mapInArrow(add, schema)
    if whole:  # every user's sum is in one chunk
        return parts.select("id", scale("_v", 1 / F.col("_n")).alias("vector"))
    sums = parts.groupBy("id").agg(sum_vectors("_v", dim).alias("_s"), F.sum("_n").alias("_n"))
    return sums.select("id", scale("_s", 1 / F.col("_n")).alias("vector"))


def content_nearest(history: DataFrame, items: DataFrame, k: int, unseen: bool = True, metric: str = "cosine") -> DataFrame:
    """Items nearest to the mean vector of the user's history; no training."""
    users = mean_vectors(history, items)
    known = history.select(F.col("user").alias("query"), F.col("track").alias("item")) if unseen else None
    found = knn(users, items, k, metric, seen=known)
    return found.select(F.col("query").alias("user"), F.col("item").alias("track"), "score", "rank")


def mean_similarity(items: DataFrame, group: str | None = None) -> DataFrame:
    """Mean pairwise inner product inside each group (or the whole table); groups of one give 0.

    The sum over pairs is (|sum of vectors|^2 - sum of squares) / 2, so no pair is ever formed.
    """
    dim = vector_dim(items)
    keys = [group] if group else []
    sums = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), sum_vectors("vector", dim).alias("_s"), F.sum(dot("vector", "vector")).alias("_own")
    )
    whole = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x)
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.select(*keys, "n", F.when(F.col("n") > 1, (whole - F.col("_own")) / pairs).otherwise(0.0).alias("similarity"))


def similarity_profile(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Sorted inner products of n sampled items with all items: (query, item, score, rank)."""
    sample = sample_weighted(items, n, None, ["id"], seed)
    return knn(sample, items, None, "ip")


def nearest_distance(recs: DataFrame, history: DataFrame, items: DataFrame) -> DataFrame:
    """Per recommended row: smallest cosine distance to an item of the user's history, NULL where no two vectors are known.
    Lists are of fixed length, so the join grows with the history, not with its square."""
    vec = items.select(F.col("id").alias("track"), "vector")
    shown = recs.select("user", "track").join(vec, "track").select("user", "track", F.col("vector").alias("_a"))
    own = history.select("user", "track").distinct().join(vec, "track").select("user", F.col("track").alias("_h"), F.col("vector").alias("_b"))
    near = shown.join(own, "user").groupBy("user", "track").agg(F.min(1 - cosine("_a", "_b")).alias("distance"))
    return recs.select("user", "track").distinct().join(near, ["user", "track"], "left")


def _in_buckets(best, k: int, metric: str, digits: int, exclude_self: bool):
    """``best`` for rows of many buckets: large buckets one by one, the pairs of all small ones at once."""

    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pd.concat([lp["bucket"], rp["bucket"]]))[0]
        left, right = codes[: len(lp)], codes[len(lp) :]
        lp, rp = lp.iloc[np.argsort(left, kind="stable")], rp.iloc[np.argsort(right, kind="stable")]
        left, right = np.sort(left), np.sort(right)
        many = np.bincount(left, minlength=codes.max(initial=-1) + 1) * np.bincount(right, minlength=codes.max(initial=-1) + 1)
        out = [best(lp.iloc[:0], rp.iloc[:0])]
        for code in np.flatnonzero(many > FEW):
            cut = [slice(*np.searchsorted(x, [code, code + 1])) for x in (left, right)]
            out.append(best(lp.iloc[cut[0]], rp.iloc[cut[1]]))
        few = (many > 0) & (many <= FEW)
        if few.any():
            lp, rp, left, right = lp.loc[few[left]], rp.loc[few[right]], left[few[left]], right[few[right]]
            kind = np.int64 if metric == "match" else np.float64
            q, v = (np.stack(x["vector"].to_numpy()).astype(kind) for x in (lp, rp))
            names, ids = lp["id"].to_numpy(), rp["id"].to_numpy()
            if metric == "cosine":
                q, v = unit_vectors(q), unit_vectors(v)
            lines, items, scores = [], [], []
            for a, times, b in expand(left, right):
                line = np.repeat(np.arange(a.start, a.stop), times)
                for at in range(0, len(line), FEW):
                    x, y = q[line[at : at + FEW]], v[b[at : at + FEW]]
                    if metric == "match":
                        s = (x == y).sum(axis=1) / q.shape[1]
                    elif metric == "l2":
                        s = -np.sqrt(((x - y) ** 2).sum(axis=1))
                    else:
                        s = (x * y).sum(axis=1)
                    lines.append(line[at : at + FEW])
                    items.append(ids[b[at : at + FEW]])
                    scores.append(np.round(s, digits))
            line, item, score = (np.concatenate(x) for x in (lines, items, scores))
            if exclude_self:
                other = names[line] != item
                line, item, score = line[other], item[other], score[other]
            order = np.lexsort((item, -score, line))
            line, item, score = line[order], item[order], score[order]
            kept = np.arange(len(line)) - np.searchsorted(line, line, "left") < k
            out.append(pd.DataFrame({"query": names[line[kept]], "item": item[kept], "score": score[kept]}))
        return pd.concat(out)

    return cell


def _bucketed(queries: DataFrame, items: DataFrame, k: int, metric: str, digits: int, exclude_self: bool) -> DataFrame:
    """Top k among (id, vector, bucket) rows that share a bucket. Buckets of any size are cut into blocks first, small ones are
    searched many at a time."""
    sizes = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"))
    plan = materialize(sizes.join(asked, "bucket"), "buckets")
    small = (F.col("_n") <= SMALL) & (F.col("_m") <= SMALL)
    chunks = max(1, math.ceil((plan.filter(small).agg(F.sum(F.col("_n") + F.col("_m"))).first()[0] or 0) / CHUNK))
    plan = plan.select(
        "bucket", F.ceil(F.col("_n") / ITEM_BLOCK).cast("int").alias("_ni"), F.ceil(F.col("_m") / QUERY_BLOCK).cast("int").alias("_nq"),
        F.when(small, F.concat(F.lit("chunk "), F.pmod(F.xxhash64("bucket"), F.lit(chunks)))).otherwise(F.concat(F.lit("bucket "), "bucket")).alias("_g"),
    )
    for n in ("_ni", "_nq"):
        plan = plan.withColumn(n, F.when(F.col("_g").startswith("chunk"), 1).otherwise(F.col(n)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    row = [F.col(c).alias(c) for c in ("_g", "bucket", "id", "vector")]
    left = queries.join(plan, "bucket").select(own("_nq").alias("_q"), spread("_ni").alias("_i"), *row)
    right = items.join(plan, "bucket").select(spread("_nq").alias("_q"), own("_ni").alias("_i"), *row)
    search = _in_buckets(_best(k, metric, digits, exclude_self), k, metric, digits, exclude_self)
    parts = left.groupBy("_g", "_q", "_i").cogroup(right.groupBy("_g", "_q", "_i")).applyInPandas(search, SCHEMA)
    # a pair can meet in several buckets
    once = parts.groupBy("query", "item").agg(F.max("score").alias("score"))
    return top_k_per(once, ["query"], [F.col("score").desc(), "item"], k)


def projection_buckets(items: DataFrame, tables: int, bits: int, seed: int = 0) -> DataFrame:
    """(id, vector, bucket) rows, one per table: the signs of ``bits`` random projections."""
    dim = vector_dim(items)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))

    def side(plane: np.ndarray) -> Column:
        return F.when(dot("vector", F.array(*[F.lit(float(x)) for x in plane])) >= 0, F.lit("1")).otherwise(F.lit("0"))

    keys = [F.concat(F.lit(f"{t}:"), *[side(p) for p in planes[t]]) for t in range(tables)]
    return items.select("id", "vector", F.explode(F.array(*keys)).alias("bucket"))


def lsh_knn(items: DataFrame, k: int, metric: str = "cosine", tables: int = 6, bits: int = 4, seed: int = 0) -> DataFrame:
    """Approximate neighbours: exact search inside random-projection buckets."""
    placed = materialize(projection_buckets(items, tables, bits, seed), "buckets")
    return _bucketed(placed, placed, k, metric, 9, True)


def band_shape(hashes: int, threshold: float) -> tuple[int, int]:
    """(bands, rows per band) out of ``hashes`` whose S-curve rises nearest to ``threshold``: two sets of that similarity share
    a band with a chance of about a half or more, less similar ones seldom."""
    shapes = [(hashes // rows, rows) for rows in range(1, hashes + 1)]
    return min(shapes, key=lambda s: (abs((1 / s[0]) ** (1 / s[1]) - threshold), s[1]))


def minhash_neighbours(
    df: DataFrame, k: int, hashes: int = 16, bands: int = 8, user: str = "user", item: str = "track", seed: int = 0,
    threshold: float | None = None,
) -> DataFrame:
    """Approximate similar users by MinHash: users sharing a band of the signature, scored by the share of equal places
    (an estimate of the Jaccard similarity). With ``threshold`` the bands are chosen for this similarity."""
    pairs = df.select(F.col(user).alias("id"), F.col(item).alias("_t")).distinct()
    signed = pairs.groupBy("id").agg(
        F.array(*[F.min(F.xxhash64("_t", F.lit(seed * 1000 + n))) for n in range(hashes)]).alias("vector")
    )
    signed = materialize(signed, "signatures")
    bands, rows = (bands, hashes // bands) if threshold is None else band_shape(hashes, threshold)
    part = lambda b: F.slice("vector", b * rows + 1, rows)
    keys = [F.concat(F.lit(f"{b}:"), F.md5(F.concat_ws(",", part(b).cast("array<string>")))) for b in range(bands)]
    # a signature travels only for the bands that another user may share, told by a number per band
    numbers = F.array(*[F.xxhash64(part(b), F.lit(b)) for b in range(bands)])
    numbered = signed.select(F.col("id").alias("_id"), F.posexplode(numbers).alias("_b", "_h"))
    shared = numbered.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h")
    needed = numbered.join(materialize(shared, "shared-bands"), "_h", "left_semi").groupBy("_id").agg(F.collect_list("_b").alias("_bands"))
    some = signed.join(needed, F.col("id").eqNullSafe(F.col("_id"))).select("id", "vector", F.transform("_bands", lambda b: F.element_at(F.array(*keys), b + 1)).alias("_keys"))
    placed = materialize(some.select("id", "vector", F.explode("_keys").alias("bucket")), "bands")
    return _bucketed(placed, placed, k, "match", 9, True)
