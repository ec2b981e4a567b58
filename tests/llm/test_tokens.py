"""Token ids, token files and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tastemill.llm.encoder import Encoder
from tastemill.llm.packing import best_fit, cut_lengths, improve, pack, pieces
from tastemill.llm.token_files import read_tokens, write_tokens

PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "é", "É", "İ", "Σ", "\x1c", "\x85", " ", "'s", "'", ".", "!!", "12",
         "3", "日本", "é", "|", "<|endoftext|>", "<|", "\0", "_", "word", "the", "　", "😀", "​"]


@pytest.mark.parametrize("name,split", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", None)])
def test_pieces_give_the_ids_of_whole_texts(name, split):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["x" * 500, "ab " * 300]
    code = Encoder(public_tokenizers.path(name), split, limit=500)
    got = [ids for i in range(0, len(texts), 300) for ids in code.encode([t.encode() for t in texts[i : i + 300]])]
    want = [np.array(e.ids, "<u4").tobytes() for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_files_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    code = Tokenizer.from_file(path)
    rows = [(i * 7 % 50, f"Some words {i} and\nmore" * (i % 5)) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "same"), (62, "same"), (62, "other"), (None, "no id"), (-3, "first " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, part string")
    got = read_tokens(write_tokens(df, path, "dropped", end_id=1, parts=5)).collect()
    got = sorted(got, key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (key, text) in zip(got, order, strict=True):
        ids = [*code.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (key, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(df, public_tokenizers.path("word_bpe_49k.json"), "dropped", 1)).count() == 0
    cut = pieces(df, public_tokenizers.path("byte_bpe_50k.json"), "leading", 2)
    assert pack(cut).count() == 0


def test_cut_lengths():
    assert cut_lengths(1024, 1024) == [1024]
    assert cut_lengths(1025, 1024) == [1, 1024]
    assert cut_lengths(2048, 1024) == [1024, 1024]


@pytest.mark.parametrize("low,high", [(1, 100), (25, 42), (30, 60)])
def test_search_never_loses_and_never_overfills(low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(600)]
    first = best_fit(lengths, 100)
    after = improve([list(b) for b in first], lengths, 100)
    for bins in (first, after):
        assert sorted(i for b in bins for i in b) == list(range(600))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert -(-sum(lengths) // 100) <= len(after) <= len(first)


def test_search_swaps_two_for_one():
    # best fit leaves three bins where a swap of two against one needs only two
    lengths = [50, 30, 20, 45, 35, 20]
    assert len(improve([[0, 3], [1, 4], [2, 5]], lengths, 100)) == 2


def test_packing_is_whole(spark):
    rows = [(i, "word " * (i * 13 % 900)) for i in range(120)] + [(5, "word " * 3000), (7, None), (None, "x"), (8, "y"), (8, "y")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, length int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(pieces(df, path, "leading", 2), group_rows=20).collect()
    code = Tokenizer.from_file(path)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(len(code.encode(t or "").ids) + 1)
    have = {}
    fill = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have == {d: sum(n) for d, n in want.items()}
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
