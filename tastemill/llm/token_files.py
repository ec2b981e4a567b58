"""Token-id files: flat unsigned integers with 64-bit document offsets, written and read by tasks.

A folder holds, for each range of documents, three flat little-endian files: ``part-N.ids`` (unsigned ids, 16 bits when the
vocabulary allows it, else 32), ``part-N.off`` (unsigned 64-bit, one more than documents: where each document starts in
the part) and ``part-N.doc`` (signed 64-bit document ids). ``write_tokens`` also returns the manifest: one row per part
with its counts and ``base``, the ids before it in the whole corpus, from prefix sums over the parts.

Defined results: a NULL text is empty (only the end id); a NULL doc_id sorts first and is stored as the smallest signed
64-bit number, which reads back as NULL; rows that repeat a doc_id are separate documents, ordered by their text; equal rows
are kept; an empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import slices
from tastemill.llm.encoder import encoder
from tastemill.session import materialize, scratch_path

MANIFEST = "part int, n_docs long, n_tokens long, width int, folder string"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
NO_ID = np.iinfo(np.int64).min
#: Bytes of text that are cut into pieces at a time.
TEXT_BATCH = 4 << 20


def _where(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@contextmanager
def _writing(folder: str, name: str):
    """A stream to a file that gets its name only when complete, so that a lost or repeated task leaves no half file."""
    store, path = _where(folder)
    store.create_dir(path, recursive=True)
    task = TaskContext.get()
    own = f"{path}/.{name}-{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(own) as out:
        yield out
    store.move(own, f"{path}/{name}")


def _map(folder: str, name: str, kind: str) -> np.ndarray:
    store, path = _where(folder)
    path = f"{path}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def write_tokens(docs: DataFrame, path: str, split: str | None, end_id: int, folder: str | None = None,
                 parts: int | None = None) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending doc_id order; returns the manifest with ``base``.

    One range shuffle of the texts; each task encodes its own range and writes ids as they come. There are as many ranges as
    shuffle partitions or, for a larger table, pieces of input. ``path`` is a vocabulary file that every
    executor can read, ``folder`` (default: below the cluster's checkpoint folder) one that all of them share.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, split)
        kind = "<u2" if code.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        with _writing(folder, f"part-{part}.ids") as out:
            for batch in chain([first], batches):
                keys.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for a, b in slices([len(t) for t in texts], TEXT_BATCH):
                    got, bounds = code.encode_flat(texts[a:b])
                    out.write(np.insert(got, bounds[1:], end_id).astype(kind).tobytes())
                    lengths.append(np.diff(bounds) + 1)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *lengths]))]).astype("<u8")
        for name, data in (("off", offsets), ("doc", np.concatenate(keys))):
            with _writing(folder, f"part-{part}.{name}") as out:
                out.write(data.tobytes())
        rows = [[part], [len(offsets) - 1], [int(offsets[-1])], [int(kind[-1])], [folder]]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(rows, types, strict=True)], ["part", "n_docs", "n_tokens", "width", "folder"]
        )

    # the first characters let rows that share one doc_id lie in several ranges
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("text", F.coalesce("text", F.lit("")))
        .repartitionByRange(parts, "doc_id", F.substring("text", 1, 32))
        .sortWithinPartitions("doc_id", "text")
    )
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files, from memory-mapped parts: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def read(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = _map(row.folder, f"part-{row.part}.ids", f"<u{row.width}")
                off = _map(row.folder, f"part-{row.part}.off", "<u8").astype(np.int64)
                keys = _map(row.folder, f"part-{row.part}.doc", "<i8")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                out = {"doc_id": pa.array(keys, mask=keys == NO_ID), "start": pa.array(off[:-1] + row.base),
                       "n_tokens": pa.array(np.diff(off)), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.table(out)

    def arrow(batches):
        for batch in batches:
            for got in read([batch.to_pandas()]):
                yield from got.to_batches()

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return spread.mapInArrow(arrow, READ)
