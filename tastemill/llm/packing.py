"""Packing documents into sequences of a fixed length: best fit, then a swap-based local search.

A document longer than a sequence is cut into full pieces after a first, shorter one. Full pieces are sequences of their
own. The others are dealt by hash to groups of bounded size; a group is packed best-fit, longest piece first, and then
improved: taking the emptiest sequence, its pieces are moved to others, exchanged one for one, or one against two, whenever
that raises the sum of squared fills, until the sequence is empty or no exchange helps. The sequences still poorly filled are
dealt to new groups and improved again, so that pieces of different groups meet; a sequence is never made worse.

Defined results: a NULL text is empty and has the end id only; rows that repeat a doc_id, or lack one, are packed like any
others; ties go to the piece written first; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import slices
from tastemill.llm.encoder import encoder
from tastemill.session import materialize

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
TEXT_BATCH = 4 << 20


def cut_lengths(total: int, size: int) -> list[int]:
    """Lengths of the pieces of a document: a shorter one first, if any, then full ones."""
    if total <= size:
        return [total]
    first = total % size
    return ([first] if first else []) + [size] * (total // size)


def pieces(docs: DataFrame, path: str, split: str | None, end_id: int, size: int = 1024) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in tokens of the vocabulary file ``path``; ``row`` numbers them uniquely."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, split)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in slices([len(t) for t in texts], TEXT_BATCH):
                out: list[tuple] = []
                for key, got in zip(keys[a:b], code.encode(texts[a:b]), strict=True):
                    ids = got + end_id.to_bytes(4, "little")
                    at = 0
                    for i, length in enumerate(cut_lengths(len(ids) // 4, size)):
                        out.append((number, key, i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                        at += length
                        number += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(cut, PIECES), "pieces")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions: each piece, longest first, into the bin it leaves the least room in."""
    rooms: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set where a bin has r left
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        above = open_rooms >> lengths[i]
        if above:
            room = lengths[i] + (above & -above).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = size, len(bins)
            bins.append([i])
        left = room - lengths[i]
        if left:
            rooms.setdefault(left, []).append(at)
            open_rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], size: int, tries: int = 400, passes: int = 4) -> list[list[int]]:
    """Empty poorly filled bins by moves and swaps; every step raises the sum of squared fills.

    Only underfull bins take part. ``tries`` bounds how many partners, fullest first, a bin is offered to in a step, and
    ``passes`` how often the bins are gone through, emptiest first, as long as something changes.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // size)
    count = sum(1 for b in bins if b)
    under = sorted((fill[k], k) for k in range(len(bins)) if 0 < fill[k] < size)

    def refill(k: int, change: int) -> None:
        del under[bisect_left(under, (fill[k], k))]
        fill[k] += change
        if 0 < fill[k] < size:
            insort(under, (fill[k], k))

    def step(k: int) -> bool:
        """One move or swap that takes tokens out of bin k into a bin at least as full."""
        for i in sorted(bins[k], key=lambda i: -lengths[i]):
            at = bisect_left(under, (size - lengths[i] + 1, -1)) - 1  # fullest bin with room for the piece
            while at >= 0 and under[at][1] == k:
                at -= 1
            if at >= 0 and under[at][0] + lengths[i] > fill[k]:
                other = under[at][1]
                bins[k].remove(i)
                bins[other].append(i)
                refill(other, lengths[i])
                fill[k] -= lengths[i]
                return True
        own = sorted(bins[k], key=lambda i: -lengths[i])
        offers = [(lengths[i], (i,)) for i in own] + [
            (lengths[i] + lengths[j], (i, j)) for a, i in enumerate(own[:8]) for j in own[a + 1 : 8]
        ]
        for other_fill, other in reversed(under[-tries:]):
            if other == k or other_fill < fill[k]:
                continue
            room = size - other_fill
            theirs = bins[other][:8]
            wanted = [(lengths[i], (i,)) for i in theirs]
            doubles = [(lengths[i] + lengths[j], (i, j)) for a, i in enumerate(theirs) for j in theirs[a + 1 :]]
            best = None
            for give, mine in offers:
                for take, got in wanted if len(mine) == 2 else wanted + doubles:
                    if 0 < give - take <= room and (best is None or give - take > best[0]):
                        best = (give - take, mine, got)
            if best:
                gain, mine, got = best
                bins[k] = [i for i in bins[k] if i not in mine] + list(got)
                bins[other] = [i for i in bins[other] if i not in got] + list(mine)
                refill(other, gain)
                fill[k] -= gain
                return True
        return False

    for _ in range(passes):
        stuck, changed = 0, False
        while count > least and stuck < len(under):
            _, k = under[stuck]
            del under[stuck]
            while bins[k] and step(k):
                changed = True
            if bins[k]:
                insort(under, (fill[k], k))
                stuck += 1
            else:
                count -= 1
        if not changed:
            break
    return [b for b in bins if b]


def _arranged(frame: pd.DataFrame, bins: list[list[int]]) -> pd.DataFrame:
    """The rows bin by bin, with sequence_id (the bin's least row number) and offset."""
    bins = [sorted(b) for b in bins]
    order = np.fromiter((i for b in bins for i in b), int, len(frame))
    out = frame.iloc[order].copy()
    which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    ends = out["length"].to_numpy().cumsum() - out["length"].to_numpy()
    first = np.searchsorted(which, np.arange(len(bins)))
    out["offset"] = ends - ends[first][which]
    out["sequence_id"] = out["row"].to_numpy()[first][which]
    return out


def pack(rows: DataFrame, size: int = 1024, group_rows: int = 20_000, poor: float = 0.97, rounds: int = 2) -> DataFrame:
    """``rows(row, length, ...)`` with sequence_id and offset. A task holds one group of about ``group_rows`` pieces; bins
    filled below ``poor`` are dealt anew and improved up to ``rounds`` more times."""
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])

    def fresh(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_group").sort_values("row")
        lengths = frame["length"].tolist()
        return _arranged(frame, improve(best_fit(lengths, size), lengths, size))

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_group").sort_values(["sequence_id", "offset"])
        starts = np.flatnonzero(np.concatenate([[True], np.diff(frame["sequence_id"].to_numpy()) != 0]))
        ends = np.append(starts[1:], len(frame))
        bins = [list(range(a, b)) for a, b in zip(starts, ends, strict=True)]
        return _arranged(frame, improve(bins, frame["length"].tolist(), size))

    def dealt(df: DataFrame, key: str, salt: int) -> tuple[DataFrame, int]:
        groups = max(1, -(-df.count() // group_rows))
        return df.withColumn("_group", F.pmod(F.xxhash64(F.lit(salt), key), F.lit(groups))), groups

    full = rows.filter(F.col("length") >= size).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    part, groups = dealt(rows.filter(F.col("length") < size), "row", 0)
    columns = [*rows.columns, "sequence_id", "offset"]
    packed = materialize(part.groupBy("_group").applyInPandas(fresh, schema), "packed")
    done = [full.select(*columns)]
    for turn in range(1, rounds + 1):
        if groups == 1:
            break
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("_fill")).filter(F.col("_fill") < poor * size)
        low = packed.join(fills.select("sequence_id"), "sequence_id", "left_semi")
        done.append(packed.join(fills.select("sequence_id"), "sequence_id", "left_anti").select(*columns))
        low, groups = dealt(low, "sequence_id", turn)
        packed = materialize(low.groupBy("_group").applyInPandas(again, schema), "packed")
    out = packed.select(*columns)
    for rest in done:
        out = out.unionByName(rest)
    return out
