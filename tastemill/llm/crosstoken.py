"""Two tokenizers side by side: where their tokens of a text meet, and how often each pair of token ids overlaps in the corpus.

A text is cut before white space that follows other characters, where neither vocabulary can have a token across the cut, so
that the tokens of both end there; each distinct piece is tokenized and aligned once. Texts with white space that a longer token
of B holds (a carriage return) are one piece. A pair of ids is linked as often as a
token of the one and a token of the other overlap by bytes.

The counts come from an inverted index. Documents are numbered within chunks of 65,536. Per pair and chunk the index holds a
compressed bitmap of the documents with that pair, and one bitmap per binary digit (plane) of the number of further links, so
that a document's links are 1 + the sum of its planes' powers of two. A bitmap is a sorted list, a bit field or a list of runs,
whichever is smallest. Partial bitmaps are OR-merged per pair and chunk; their popcounts give the pair's documents and links.
The postings of every bitmap then return the scores of its pair to the documents, added per chunk in flat arrays.

Defined results: a text that is NULL, empty or holds the character that stands for a space in vocabulary B, so that its joined
tokens are not its bytes, has no tokens: zeros and ''. Rows that repeat a doc_id are counted and returned each; an empty table
has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import discard, slices
from tastemill.llm.encoder import LONGEST, Encoder, gather
from tastemill.session import materialize

SPACE = "▁"
TEXT_BATCH = 4 << 20
#: Documents of a chunk, and bytes of a bit field over them.
CHUNK = 1 << 16
FIELD = CHUNK // 8
#: Postings of a task that are held before their bitmaps are written.
HELD = 3_000_000
#: Tasks that return the scores to one chunk.
SALT = 4
LIST, BITS, RUNS = 0, 1, 2
#: The plane of the documents themselves; planes 0, 1, 2 .. are the binary digits of further links.
DOCS = -1

PARTS = (
    "chunk long, off int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "a int, b int, plane int, form int, bits binary"
)
PART_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), *[pa.int32()] * 4, pa.binary()]
PART_NAMES = [p.split()[0] for p in PARTS.split(", ")]


@dataclass
class Units:
    """Aligned pieces: tokens of both vocabularies, groups, links with their pairs in a row, and the groups spelled out."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    good: np.ndarray
    spelled: list[str]
    pairs: np.ndarray

    def take(self, at: np.ndarray) -> Units:
        starts = np.cumsum(self.n_links) - self.n_links
        return Units(self.n_a[at], self.n_b[at], self.n_groups[at], self.n_links[at], self.good[at],
                     [self.spelled[i] for i in at.tolist()], self.pairs[gather(starts[at], self.n_links[at])])

    def and_(self, other: Units) -> Units:
        both = [np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("n_a", "n_b", "n_groups", "n_links", "good")]
        return Units(*both, self.spelled + other.spelled, np.concatenate([self.pairs, other.pairs]))


def no_units() -> Units:
    return Units(*[np.empty(0, np.int64)] * 4, np.empty(0, bool), [], np.empty(0, np.int64))


class Aligner:
    """Both vocabularies in one worker process, with a memory of at most ``limit`` pieces that occur again."""

    def __init__(self, path_a: str, path_b: str, limit: int = 100_000):
        import sentencepiece

        self.code = Encoder(path_a, "leading", plain=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(size)]
        self.bytes_b = [
            bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
        ]
        self.len_b = np.fromiter(map(len, self.bytes_b), np.int64, size)
        vocabulary = self.code.tokenizer.get_vocab()
        self.len_a = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.len_a[i] = len(name)  # one character a byte
        self.str_a = list(map(str, range(len(self.len_a))))
        self.str_b = list(map(str, range(size)))
        # cuts are exact where no token of B goes on with white space; texts with white space that B has in longer tokens
        # are aligned whole
        if any(SPACE in n.lstrip(SPACE) for n in names):
            self.code.split = None
        self.inside = {c.encode() for n in names for c in re.findall(r"[ \t-\r]", n)}
        self.lead = len(self.pieces.encode("a"))
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.known = no_units()

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """Ids of pieces within a text. The library puts a space before what it encodes, so a piece's own is left out, and
        a piece without one follows a letter, whose ids are dropped."""
        spaced = [u[:1] == " " and len(u) > 1 for u in units]
        got = self.pieces.encode([u[1:] if s else "a" + u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        return [ids if s else ids[self.lead :] for ids, s in zip(got, spaced, strict=True)]

    def align(self, names: list[str]) -> Units:
        """Pieces by their keys (see ``Encoder``)."""
        flat_a, count_a = self.code._encode_pieces(names)
        units = [self.code._spelled(n) for n in names]
        ids_b = self._ids_b(units)
        count_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_b = np.array([i for ids in ids_b for i in ids], np.int64)
        flat_a = flat_a.astype(np.int64)
        unit_a, unit_b = np.repeat(np.arange(len(names)), count_a), np.repeat(np.arange(len(names)), count_b)
        good = np.ones(len(names), bool)
        data = [u.encode() for u in units]
        if b"".join([self.bytes_b[i] for i in flat_b.tolist()]) != b"".join(data):
            good = np.array([b"".join([self.bytes_b[i] for i in ids]) == d for ids, d in zip(ids_b, data, strict=True)], bool)
        same = np.bincount(unit_a, self.len_a[flat_a], len(names)) == np.fromiter(map(len, data), np.int64, len(data))
        good &= same
        kept_a, kept_b = good[unit_a], good[unit_b]
        flat_a, unit_a, flat_b, unit_b = flat_a[kept_a], unit_a[kept_a], flat_b[kept_b], unit_b[kept_b]
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        # the tokens of B that a token of A overlaps are neighbours
        first = np.searchsorted(end_b, end_a - self.len_a[flat_a], "right")
        last = np.searchsorted(end_b - self.len_b[flat_b], end_a, "left")
        times = last - first
        pairs = (np.repeat(flat_a, times) << 24) | flat_b[gather(first, times)]
        n = len(names)
        upto_a, upto_b = np.searchsorted(end_a, ends, "right").tolist(), np.searchsorted(end_b, ends, "right").tolist()
        group_unit = unit_a[np.asarray(upto_a, np.int64) - 1] if len(ends) else np.empty(0, np.int64)
        sa, sb = [self.str_a[i] for i in flat_a.tolist()], [self.str_b[i] for i in flat_b.tolist()]
        spelled, a, b = [], 0, 0
        for i, j in zip(upto_a, upto_b, strict=True):
            left = sa[a] if i == a + 1 else ",".join(sa[a:i])
            spelled.append(left + "|" + (sb[b] if j == b + 1 else ",".join(sb[b:j])))
            a, b = i, j
        n_groups = np.bincount(group_unit, minlength=n)
        to = np.cumsum(n_groups)
        texts = [";".join(spelled[i:j]) for i, j in zip((to - n_groups).tolist(), to.tolist(), strict=True)]
        n_links = np.bincount(unit_a, times, n).astype(np.int64)
        return Units(np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), n_groups, n_links, good, texts, pairs)

    def read(self, texts: list[bytes]) -> tuple[Units, np.ndarray, np.ndarray]:
        """(aligned pieces, number of each text's pieces in a row, bounds) of texts that begin with a space."""
        pieces, firsts, counts = self.code.keys(texts)
        counts[[i for i, t in enumerate(texts) if any(c in t for c in self.inside)]] = -1
        whole = np.flatnonzero(counts < 0)
        firsts[whole], counts[whole] = len(pieces) + np.arange(len(whole)), 1
        alone = pa.array(["\0" + texts[i].decode() for i in whole], pa.large_string())
        coded = pa.chunked_array([pieces, alone]).combine_chunks().dictionary_encode()
        names, number = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        found = np.fromiter((self.memory.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        fresh = self.align([names[i] for i in new.tolist()])
        old = np.flatnonzero(found >= 0)
        units = self.known.take(found[old]).and_(fresh)
        place = np.empty(len(names), np.int64)
        place[old], place[new] = np.arange(len(old)), len(old) + np.arange(len(new))
        times = np.bincount(number, minlength=len(names))
        keep = np.array([k for k, i in enumerate(new.tolist()) if times[i] > 1 and len(names[i]) <= LONGEST], np.int64)[: self.limit]
        if len(self.memory) + len(keep) > self.limit:
            self.forget()
        at = len(self.memory)
        self.memory.update((names[i], at + k) for k, i in enumerate(new[keep].tolist()))
        self.known = self.known.and_(fresh.take(keep))
        order = gather(firsts, counts)
        return units, place[number[order]], np.concatenate([[0], np.cumsum(counts)])


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def bitmaps(keys: np.ndarray, docs: np.ndarray) -> list[tuple[np.ndarray, int, pa.Array]]:
    """(keys, form, bitmaps) for each form in use. ``keys`` and, within a key, ``docs`` ascend; no document twice in a key."""
    if not len(keys):
        return []
    opens = np.concatenate([[True], keys[1:] != keys[:-1]])
    run = opens | np.concatenate([[True], docs[1:] != docs[:-1] + 1])
    starts = np.flatnonzero(opens)
    size = np.diff(np.append(starts, len(keys)))
    run_at = np.flatnonzero(run)
    runs = np.add.reduceat(run.astype(np.int64), starts)
    form = np.where(4 * runs < np.minimum(2 * size, FIELD), RUNS, np.where(2 * size > FIELD, BITS, LIST))
    out = []
    for kind in (LIST, RUNS, BITS):
        mine = np.flatnonzero(form == kind)
        if not len(mine):
            continue
        if kind == LIST:
            flat, width = docs[gather(starts[mine], size[mine])].astype("<u2"), 2 * size[mine]
        elif kind == RUNS:
            first = (np.cumsum(runs) - runs)[mine]
            at = gather(first, runs[mine])
            length = np.diff(np.append(run_at, len(keys)))[at]
            flat, width = np.stack([docs[run_at[at]], length - 1], 1).astype("<u2"), 4 * runs[mine]
        else:
            flat = np.zeros((len(mine), CHUNK), bool)
            flat[np.repeat(np.arange(len(mine)), size[mine]), docs[gather(starts[mine], size[mine])]] = True
            flat, width = np.packbits(flat, axis=1), np.full(len(mine), FIELD)
        ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
        out.append((keys[starts[mine]], kind, made))
    return out


def documents_of(form: int, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of documents of each bitmap, their documents in a row) of bitmaps of one form."""
    if form == BITS:
        rows, docs = np.nonzero(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), FIELD), axis=1))
        return np.bincount(rows, minlength=len(bits)), docs
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    data = np.frombuffer(b"".join(bits), "<u2").astype(np.int64)
    if form == LIST:
        return width // 2, data
    first, length = data[::2], data[1::2] + 1
    upto = np.concatenate([[0], np.cumsum(length)])
    ends = np.cumsum(width // 4)
    return upto[ends] - upto[ends - width // 4], gather(first, length)


def _columns(n: int, **given) -> pa.RecordBatch:
    arrays = [
        given[name] if isinstance(given.get(name), pa.Array) else pa.nulls(n, kind) if name not in given else pa.array(given[name], kind)
        for name, kind in zip(PART_NAMES, PART_TYPES, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, PART_NAMES)


def index_parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One written table with a row per document (chunk, off and its own counts) and one per partial bitmap. Both come from
    the same task, so that a task that is run again replaces its numbers and bitmaps together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        chunk, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, offs, links = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((offs, keys))
            keys, offs, links = keys[order], offs[order], links[order] - 1
            yield from _bitmap_rows(chunk, DOCS, keys, offs)
            plane = 0
            while links.any():
                digit = (links & 1) == 1
                yield from _bitmap_rows(chunk, plane, keys[digit], offs[digit])
                links, plane = links >> 1, plane + 1

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, j in slices([len(t) for t in texts], TEXT_BATCH):
                for a in range(i, j, CHUNK):
                    b = min(j, a + CHUNK)
                    if used + b - a > CHUNK:
                        if held:
                            yield from flush()
                        held, n_held, used, chunk = [], 0, 0, chunk + 1
                    rows, postings = _documents(own, texts[a:b], used)
                    yield _columns(b - a, chunk=[chunk] * (b - a), off=np.arange(used, used + b - a), doc_id=ids[a:b], **rows)
                    used += b - a
                    held.append(postings)
                    n_held += len(postings[0])
                    if n_held > HELD:
                        yield from flush()
                        held, n_held = [], 0
        if held:
            yield from flush()

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(given.mapInArrow(read, PARTS), "index-parts")


def _documents(own: Aligner, texts: list[bytes], first: int) -> tuple[dict, tuple]:
    """(columns of the documents, (pairs, offsets, links) of their postings)."""
    mark = SPACE.encode()
    some = [i for i, t in enumerate(texts) if t and mark not in t]
    units, number, bounds = own.read([b" " + texts[i] for i in some])
    text_of = np.repeat(np.arange(len(some)), np.diff(bounds))
    # texts with a piece that B does not give back have no tokens
    bad = np.zeros(len(some), bool)
    bad[text_of[~units.good[number]]] = True
    used = ~bad[text_of] & (units.n_a[number] > 0)
    number, text_of = number[used], text_of[used]
    n = len(texts)
    at = np.asarray(some, np.int64)
    rows = {}
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        rows[name] = np.zeros(n, np.int64)
        rows[name][at] = np.bincount(text_of, getattr(units, name)[number], len(some)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(some)))]).tolist()
    digests = [""] * n
    spelled, listed = units.spelled, number.tolist()
    for i, a, b in zip(some, ends[:-1], ends[1:], strict=True):
        if b > a:
            digests[i] = hashlib.sha256(";".join([spelled[k] for k in listed[a:b]]).encode()).hexdigest()
    rows["groups_sha256"] = digests
    # a text's distinct pieces first, then their pairs
    seen, times = np.unique(text_of * max(len(units.n_a), 1) + number, return_counts=True)
    piece, text = seen % max(len(units.n_a), 1), seen // max(len(units.n_a), 1)
    starts = np.cumsum(units.n_links) - units.n_links
    sizes = units.n_links[piece]
    names, code = np.unique(units.pairs, return_inverse=True)
    key = np.repeat(text, sizes) * max(len(names), 1) + code[gather(starts[piece], sizes)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    links = np.add.reduceat(np.repeat(times, sizes)[order], opens) if len(key) else np.empty(0, np.int64)
    distinct = key[opens]
    offs = first + at[distinct // max(len(names), 1)]
    return rows, (names[distinct % max(len(names), 1)], offs, links)


def _bitmap_rows(chunk: int, plane: int, keys: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for pair, form, made in bitmaps(keys, offs):
        n = len(pair)
        yield _columns(n, chunk=[chunk] * n, a=pair >> 24, b=pair & ((1 << 24) - 1), plane=[plane] * n, form=[form] * n, bits=made)


MERGED = "chunk long, a int, b int, plane int, form int, bits binary, n long"


def merge_bitmaps(parts: DataFrame) -> DataFrame:
    """Bitmaps OR-merged per pair, chunk and plane, with their popcount ``n``; written. A pair of every document is spread by
    its chunks."""
    names = ["chunk", "a", "b", "plane", "form", "bits"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            same = _same_as_next(table)
            whole = np.flatnonzero(~same)
            cut = int(whole[-2]) + 1 if len(whole) > 1 else 0  # the last key may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield from _merged(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from _merged(rest)

    spread = parts.filter("plane IS NOT NULL").select(*names).repartition("a", "b", "chunk")
    ordered = spread.sortWithinPartitions("chunk", "a", "b", "plane")
    return materialize(ordered.mapInArrow(merge, MERGED), "bitmaps")


def _same_as_next(table: pa.Table) -> np.ndarray:
    """Whether a row and the next one are of one bitmap; the last row is not."""
    same = np.ones(max(table.num_rows - 1, 0), bool)
    for name in ("chunk", "a", "b", "plane"):
        values = table[name].to_numpy()
        same &= values[1:] == values[:-1]
    return np.append(same, False) if table.num_rows else same


def _merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
    same = _same_as_next(table)
    number = np.concatenate([[0], np.cumsum(~same)[:-1]])
    several = np.bincount(number)[number] > 1
    single = table.filter(pa.array(~several))
    form = single["form"].to_numpy()
    n = np.zeros(single.num_rows, np.int64)
    for kind in (LIST, BITS, RUNS):
        at = np.flatnonzero(form == kind)
        if len(at):
            bits = single["bits"].take(pa.array(at))
            n[at] = np.asarray(pc.binary_length(bits)) // 2 if kind == LIST else documents_of(kind, bits.to_pylist())[0]
    if single.num_rows:
        yield from single.append_column("n", pa.array(n)).to_batches()
    if not several.any():
        return
    more, keys = table.filter(pa.array(several)), number[several]
    key_parts, doc_parts = [], []
    form = more["form"].to_numpy()
    for kind in (LIST, BITS, RUNS):
        at = np.flatnonzero(form == kind)
        if len(at):
            sizes, docs = documents_of(kind, more["bits"].take(pa.array(at)).to_pylist())
            key_parts.append(np.repeat(keys[at], sizes))
            doc_parts.append(docs)
    both = np.unique(np.concatenate(key_parts) * CHUNK + np.concatenate(doc_parts))
    first = np.searchsorted(keys, np.unique(keys))
    sizes = dict(zip(*np.unique(both // CHUNK, return_counts=True), strict=True))
    of = dict(zip(keys[first].tolist(), first.tolist(), strict=True))
    for key, kind, made in bitmaps(both // CHUNK, both % CHUNK):
        at = pa.array([of[k] for k in key.tolist()])
        kept = more.select(["chunk", "a", "b", "plane"]).take(at)
        kept = kept.append_column("form", pa.array([kind] * len(key), pa.int32())).append_column("bits", made)
        yield from kept.append_column("n", pa.array([int(sizes[k]) for k in key.tolist()], pa.int64())).to_batches()


def pair_counts(merged: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) per linked pair; best: no pair with the same b has more links."""
    weight = F.when(F.col("plane") == DOCS, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.col("plane")).cast("long"))
    counts = merged.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") == DOCS, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links")
    )
    counts = materialize(counts, "pair-counts")
    # one row per id of vocabulary B
    most = F.broadcast(counts.groupBy("b").agg(F.max("n_links").alias("most")))
    return counts.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


SCORES = "chunk long, off int, n_best long, count_sum long"


def returned_scores(merged: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk, off, n_best, count_sum): the scores of its pairs, once per link, added up for every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, CHUNK), np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(sums[1])
            columns = [pa.array([now] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])]
            return pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in SCORES.split(", ")])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            plane, form = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            links, best = batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            weight = np.int64(1) << np.maximum(plane, 0).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)], strict=True):
                if chunk[i] != now:
                    if now is not None:
                        yield done()
                    now, sums = int(chunk[i]), np.zeros((2, CHUNK), np.int64)
                for kind in (LIST, BITS, RUNS):
                    at = i + np.flatnonzero(form[i:j] == kind)
                    if len(at):
                        sizes, docs = documents_of(kind, batch.column(3).take(pa.array(at)).to_pylist())
                        np.add.at(sums[0], docs, np.repeat(weight[at] * best[at], sizes))
                        np.add.at(sums[1], docs, np.repeat(weight[at] * links[at], sizes))
        if now is not None:
            yield done()

    scored = merged.join(pairs.select("a", "b", "n_links", "best"), ["a", "b"])
    salt = F.pmod(F.xxhash64("a", "b"), F.lit(SALT))
    spread = scored.select("chunk", "plane", "form", "bits", "n_links", "best", salt.alias("salt")).repartition("chunk", "salt")
    parts = spread.drop("salt").sortWithinPartitions("chunk").mapInArrow(score, SCORES)
    return parts.groupBy("chunk", "off").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(per document of ``docs(doc_id, text)``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; the table of
    ``pair_counts``)."""
    parts = index_parts(docs, path_a, path_b)
    merged = merge_bitmaps(parts)
    own = materialize(
        parts.filter("plane IS NULL")
        .select("chunk", "off", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), "aligned",
    )
    discard(parts)
    pairs = pair_counts(merged)
    scores = returned_scores(merged, pairs)
    zero = F.lit(0).cast("long")
    out = own.join(scores, ["chunk", "off"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
    return out, pairs
