"""Segments against all sub-ranges, the null model's equation, learned passages and defined cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import toxicity
from tastemill.llm.toxicity import Detector, _decay, segments


def brute_segments(s):
    """Recursively: the best range (shortest, then leftmost), then the same in what lies left and right of it."""

    def best(i, j):
        ranges = [(-round(sum(s[a:b]), 9), b - a, a) for a in range(i, j) for b in range(a + 1, j + 1)]
        return min(ranges, default=None)

    out, todo = [], [(0, len(s))]
    while todo:
        i, j = todo.pop()
        top = best(i, j)
        if top and top[0] < 0:
            a, b = top[2], top[2] + top[1]
            out.append((-top[0], a, b - 1))
            todo += [(i, a), (b, j)]
    return sorted(out, key=lambda x: x[1])


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.choice([-3.1, -2.03, -1.007, 1.0, 1.6, 2.9]) * rng.random() for _ in range(rng.randrange(14))]
        got = [(round(x, 9), a, b) for x, a, b in segments(np.array(s))]
        assert got == [(round(x, 9), a, b) for x, a, b in brute_segments(s)]


def test_scan_is_linear():
    scores = np.tile([1.0, -0.5, 1.0, -3.0], 200_000)
    assert len(segments(scores)) == 200_000
    assert segments(np.array([])) == [] and segments(np.array([-1.0, 0.0])) == []


def test_lambda_solves_its_equation():
    scores, weights = np.array([-1.0, -0.2, 0.7, 3.0]), np.array([70.0, 20.0, 8.0, 2.0])
    lam = _decay(scores, weights)
    assert lam > 0 and (weights / weights.sum()) @ np.exp(lam * scores) == pytest.approx(1, abs=1e-6)


def test_words_fall_back_to_their_beginnings():
    own = Detector(odds={"scum$": 5.0, "scu": 2.0, "scumm": 3.0}, drift=0.5)
    assert [own.token(w) for w in ("scum", "scums", "scummy", "sc", "other")] == [4.5, 1.5, 2.5, -0.5, -0.5]


def corpus(n, rng):
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti") for c in ("", "lo", "ma", "ne")]
    bad = ["idiot", "scum", "moron", "trash"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(bad) if k % 2 else rng.choice(words) for k in range(9)]
        rows.append((i, " ".join(text).capitalize() + ".", int(toxic)))
    return rows


def test_passages_of_held_out_texts(spark):
    rows = corpus(600, random.Random(8))
    docs = spark.createDataFrame([(d, t, 0.5, "x") for d, t, _ in rows], "doc_id long, text string, score double, first string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    text_of = {d: t for d, t, _ in rows}
    for d, _, y in rows:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.3)
        for p in got[d]["passages"]:
            assert p["text"] == " ".join(text_of[d].lower().strip(".").split()[p["first"] : p["last"] + 1])
            assert 0 < p["expected"] < 0.05
    held = [(got[d], y) for d, _, y in rows if got[d]["held_out"]]
    assert sum(r["predicted"] == y for r, y in held) >= 0.97 * len(held)
    assert all(any("scum" in p["text"] or "idiot" in p["text"] or "moron" in p["text"] or "trash" in p["text"] for p in r["passages"]) for r, y in held if y)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(300, random.Random(9))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.detect(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in toxicity.detect(docs, flipped).collect()}


def test_defined_cases(spark):
    rows = corpus(200, random.Random(10))
    extra = [(1000, None), (1001, ""), (1002, "?! 。"), (None, "idiot scum moron trash idiot scum"), (1, rows[1][1]), (1003, "scum " * 40_000)]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(1, 0), (1003, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    got = [tuple(r)[:4] for r in toxicity.detect(docs, labels).collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= r[2] <= 1 for r in got)
    by_id = {r[0]: r for r in got}
    assert by_id[None][1] and by_id[None][3] == 1 and by_id[1003][3] == 1
    assert {by_id[i][2] for i in (1000, 1001, 1002)} == {by_id[1000][2]} and by_id[1000][3] == 0
    assert by_id[1000][2] == min(r[2] for r in got)
    assert sum(r[0] == 1 for r in got) == 2
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.detect(docs, none).collect()} == {0.0}
    clean = labels.filter("toxic = 0")
    assert {r["score"] for r in toxicity.detect(docs, clean).collect()} == {0.0}
    assert toxicity.detect(docs.limit(0), labels).count() == 0


def test_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.detect(docs, labels).filter("held_out").join(labels, "doc_id")
    n = {(r["predicted"], r["toxic"]): r["count"] for r in found.groupBy("predicted", "toxic").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0)) and n[1, 0] <= 0.03 * (n[1, 0] + n[0, 0]), n
    assert math.isfinite(sum(n.values()))
