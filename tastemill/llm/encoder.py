"""Token ids of texts through a vocabulary file: distinct pieces between white space are encoded, ids are gathered by number."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beyond ASCII: texts that hold any of it are encoded in one piece.
OTHER_SPACE = re.compile("[\u0085   -     　]")
LEADING = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space that is more than single spaces and line ends; and 0, which marks pieces below.
MIXED_SPACE = (b"  ", b" \n", b"\n\n", b"\0", b"\t", b"\x0b", b"\x0c", b"\r")
#: Pieces longer than this are encoded, not remembered.
LONGEST = 64
#: Pieces encoded in one call.
TOGETHER = 20_000
#: Pieces that both vocabularies cut alike: at most one space or line end, Latin letters, ASCII signs. No apostrophe, which
#: may begin a contraction.
SIMPLE = re.compile(r"([\0\n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies: itself if printable Latin-1, else the
    next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs of a flat array, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of texts as unsigned 32-bit numbers, equal to the library's own for the whole text.

    ``split``: how the vocabulary treats white space, which decides where a text may be cut without changing its ids.
    "dropped" - white space never becomes a token; "leading" - white space belongs to the word after it; None - encode
    whole texts. Each distinct piece of a call is encoded once; pieces that occur again in a call are remembered, at most
    ``limit`` of at most ``LONGEST`` letters, some tens of megabytes. Texts in which a special token might be spelled out are
    always encoded whole, unless ``plain`` makes those strings ordinary text.
    """

    def __init__(self, path: str, split: str | None = None, limit: int = 150_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.split = split
        self.limit = limit
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(added).encode() if added and not plain else b""
        letters = byte_letters()
        self.spelling = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.forget()

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def _model_ids(self, part: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(part)]

    def _encode_pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has. Simple pieces go to the vocabulary's model at once, which spares
        the library's bookkeeping of offsets; the others through the whole tokenizer."""
        got: list = [None] * len(keys)
        others = []
        tokenize, simple, dropped = self.tokenizer.model.tokenize, SIMPLE.fullmatch, self.split == "dropped"
        space = self.spelling[ord(" ")]
        signs: dict[str, list[int]] = {"": [], "\0": []}
        for i, key in enumerate(keys):
            cut = simple(key)
            if cut is None or (dropped and cut.start(2)):
                others.append(i)
                continue
            lead, word, tail = cut.groups()
            if dropped:
                word = word.lower()
            if not word.isascii():
                word = word.translate(self.spelling)
            ids = [t.id for t in tokenize(word if lead or dropped else space + word)]
            if lead or tail:
                for sign in (lead, tail):
                    if sign not in signs:
                        signs[sign] = self._model_ids(sign.translate(self.spelling))
                ids = signs[lead] + ids + signs[tail]
            got[i] = ids
        for a in range(0, len(others), TOGETHER):
            part = others[a : a + TOGETHER]
            spelled = [self._spelled(keys[i]) for i in part]
            for i, e in zip(part, self.tokenizer.encode_batch_fast(spelled, add_special_tokens=False), strict=True):
                got[i] = e.ids
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths

    def _cut(self, data: bytes) -> list[bytes] | None:
        """Keys of the pieces of a text with unusual white space, none for other texts; None if it has to be encoded whole."""
        if self.split is None or (self.special and self.special in data):
            return None
        if self.split == "dropped":
            return []
        if not data.isascii() and OTHER_SPACE.search(data.decode()):
            return None
        return [self._key(unit) for unit in LEADING.findall(data)] if any(map(data.__contains__, MIXED_SPACE)) else []

    @staticmethod
    def _key(unit: bytes) -> bytes:
        """A piece stands for itself with a space before it; with a 0 in front, for what follows; with a line end, as it is."""
        if unit[:1] == b" " and unit[1:2] not in (b"", b"\0", b"\n"):
            return unit[1:]
        return unit if unit[:1] == b"\n" else b"\0" + unit

    def _spelled(self, key: str) -> str:
        if self.split == "dropped":
            return key
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def keys(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(keys of the pieces of all texts, first piece of each text, number of its pieces); -1 pieces: encode it whole."""
        counts = np.zeros(len(texts), np.int64)
        firsts = np.zeros(len(texts), np.int64)
        plain, odd, mixed = [], [], []
        for i, data in enumerate(texts):
            cut = self._cut(data)
            if cut is None:
                counts[i] = -1
            elif cut:
                counts[i], firsts[i] = len(cut), len(odd)
                odd += cut
                mixed.append(i)
            else:
                plain.append(i)
        arrays = []
        held = 0
        if plain:
            if self.split == "dropped":
                lists = pa.array([texts[i].split() for i in plain], pa.large_list(pa.large_binary())).cast(pa.large_list(pa.large_string()))
            else:
                # a 0 marks the beginning, as in keys of pieces without a space; line ends begin a piece
                marked = pa.array([b"\0" + texts[i].replace(b"\n", b" \n") for i in plain], pa.large_binary())
                lists = pc.split_pattern(marked.cast(pa.large_string()), " ").cast(pa.large_list(pa.large_string()))
            at = np.asarray(plain)
            bounds = np.asarray(lists.offsets)
            firsts[at], counts[at] = bounds[:-1], np.diff(bounds)
            arrays.append(lists.values)
            held = len(lists.values)
        if odd:
            firsts[mixed] += held
            arrays.append(pa.array(odd, pa.large_binary()).cast(pa.large_string()))
        return (pa.chunked_array(arrays).combine_chunks() if arrays else pa.array([], pa.large_string())), firsts, counts

    def _numbers(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each piece, ids, start and length of each number's ids)."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        number = np.asarray(coded.indices)
        known = np.fromiter(map(self.memory.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        ids, lengths = self._encode_pieces([names[i] for i in new.tolist()])
        base = len(self.ids)
        every = np.concatenate([self.ids, ids])
        start, length = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        old = known >= 0
        start[old], length[old] = self.starts[known[old]], self.lengths[known[old]]
        start[new], length[new] = base + np.cumsum(lengths) - lengths, lengths
        self._remember(names, new, np.bincount(number, minlength=len(names)), ids, lengths)
        return number, every, start, length

    def _remember(self, names: list[str], new: np.ndarray, times: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        again = np.flatnonzero(times[new] > 1)
        keep = np.array([k for k, i in zip(again.tolist(), new[again].tolist(), strict=True) if len(names[i]) <= LONGEST], np.int64)
        keep = keep[: self.limit]
        if len(self.memory) + len(keep) > self.limit:
            self.forget()
        first = len(self.memory)
        self.memory.update((names[i], first + k) for k, i in enumerate(new[keep].tolist()))
        starts = np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths[keep]) - lengths[keep]])
        self.lengths = np.concatenate([self.lengths, lengths[keep]])
        self.ids = np.concatenate([self.ids, ids[gather(starts[keep], lengths[keep])]])

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, one more bound than texts)."""
        pieces, firsts, counts = self.keys(texts)
        number, every, start, length = self._numbers(pieces)
        whole = np.flatnonzero(counts < 0)
        spelled = [texts[i].decode() for i in whole]
        alone = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(spelled, add_special_tokens=False)]
        if not len(whole):
            number = number[gather(firsts, counts)]
            sizes = length[number]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            return every[gather(start[number], sizes)], upto[np.concatenate([[0], np.cumsum(counts)])]
        alone_at = dict(zip(whole.tolist(), alone, strict=True))
        parts = []
        for i in range(len(texts)):
            if i in alone_at:
                parts.append(alone_at[i])
            else:
                n = number[firsts[i] : firsts[i] + counts[i]]
                parts.append(every[gather(start[n], length[n])])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        return np.concatenate(parts), bounds

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        ids, bounds = self.encode_flat(texts)
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, split: str | None, plain: bool = False) -> Encoder:
    """The encoder of this worker process; what it remembers serves all tasks that the process runs."""
    key = (path, split, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, split, plain=plain)
    return _ENCODERS[key]
