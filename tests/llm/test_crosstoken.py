"""Alignment, pair bitmaps and scores against tokenizing whole texts and counting pairs one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tastemill.llm import crosstoken

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "B", "é", "Ünder", "\x1c", "\x85", " ", "'s", "'", ".", "!!", "12", "3", "日本", "|",
         "<|endoftext|>", "<s>", "<0x41>", "\0", "_", "word", "the", "　", "😀", "​", "▁", "thereby", " unbelievable", "é"]


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def brute(texts):
    a_code = Tokenizer.from_file(PATHS[0])
    a_code.encode_special_tokens = True
    names = {i: t for t, i in a_code.get_vocab().items()}
    b_code = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte = letters()
    docs, counts, documents = [], Counter(), Counter()
    for text in texts:
        a = a_code.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_code.encode(text) if text else []
        data = (" " + (text or "")).encode()
        tok_a = [bytes(byte[c] for c in names[i]) for i in a]
        tok_b = [bytes([int(b_code.id_to_piece(i)[3:5], 16)]) if b_code.is_byte(i) else b_code.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(tok_a) != data or b"".join(tok_b) != data:
            docs.append(None)
            continue
        at_a, at_b = np.cumsum([0, *map(len, tok_a)]), np.cumsum([0, *map(len, tok_b)])
        groups, i, j = [], 0, 0
        for end in sorted(set(at_a[1:].tolist()) & set(at_b[1:].tolist())):
            ga, gb = [], []
            while i < len(a) and at_a[i + 1] <= end:
                ga.append(str(a[i]))
                i += 1
            while j < len(b) and at_b[j + 1] <= end:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(max(0, np.searchsorted(at_b, at_a[i], "right") - 1), len(b))
                 if at_b[j] < at_a[i + 1] and at_a[i] < at_b[j + 1]]
        counts.update(links)
        documents.update(set(links))
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = [
        (0, 0, 0, 0, 0, 0, "") if d is None
        else (*d[:3], len(d[3]), sum(counts[p] == most[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), d[4])
        for d in docs
    ]
    return rows, {p: (documents[p], n, n == most[p[1]]) for p, n in counts.items()}


@pytest.mark.parametrize("held", [3_000_000, 40])
def test_equal_to_counting(spark, monkeypatch, held):
    monkeypatch.setattr(crosstoken, "HELD", held)
    monkeypatch.setattr(crosstoken, "TEXT_BATCH", 200)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(600)]
    texts += [None, "", " ", "the the the " * 300, "same text"] + ["same text"] * 5 + ["x" * 3000]
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in zip(ids, texts, strict=True)], "doc_id long, text string, chunk int, a string")
    # the settings above reach the tasks because functions travel with their globals only when they are local
    rows, pairs = crosstoken.cross_align(df.repartition(2), *PATHS)
    want, want_pairs = brute(texts)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *r[1:]) for r in rows.collect()))
    assert got == sorted((d is not None, d or 0, *w) for d, w in zip(ids, want, strict=True))
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in pairs.collect()} == want_pairs


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    rows, pairs = crosstoken.cross_align(df, *PATHS)
    assert rows.count() == 0 and pairs.count() == 0
    rows, pairs = crosstoken.cross_align(spark.createDataFrame([(1, None)], "doc_id long, text string"), *PATHS)
    assert [tuple(r) for r in rows.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_bitmap_forms():
    rng = np.random.default_rng(1)
    sets = [np.arange(5), np.arange(0, 65536, 2), rng.choice(65536, 900, replace=False), np.arange(65536), np.r_[0:9000, 9500:30000], np.array([65535])]
    keys = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    made = crosstoken.bitmaps(keys, np.concatenate([np.sort(s) for s in sets]))
    assert {form for _, form, _ in made} == {crosstoken.LIST, crosstoken.RUNS, crosstoken.BITS}
    for key, form, bits in made:
        sizes, docs = crosstoken.documents_of(form, bits.to_pylist())
        for k, part in zip(key.tolist(), np.split(docs, np.cumsum(sizes)[:-1]), strict=True):
            assert np.array_equal(part, np.sort(sets[k]))


def test_merging_is_an_or():
    import pyarrow as pa

    rng = random.Random(2)
    parts, want = [], {}
    for pair in range(30):
        docs = rng.sample(range(300), 90)
        for piece in (docs[:40], docs[40:60], docs[60:])[: pair % 3 + 1]:
            want.setdefault(pair, set()).update(piece)
            for _, form, bits in crosstoken.bitmaps(np.full(len(piece), pair), np.sort(piece)):
                parts.append((0, pair, 1, -1, form, bits[0].as_py()))
    columns = list(zip(*parts, strict=True))
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary()]
    names = ["chunk", "a", "b", "plane", "form", "bits"]
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    got = {}
    for batch in crosstoken._merged(table):
        for r in batch.to_pylist():
            docs = crosstoken.documents_of(r["form"], [r["bits"]])[1]
            assert r["n"] == len(docs) and r["a"] not in got
            got[r["a"]] = set(docs.tolist())
    assert got == want
