"""Toxic passages of whole texts: maximum-scoring segments over the words' log-odds, with the significance of their scores.

A word's log-odds compares how often labelled toxic and clean texts hold it, with a Dirichlet prior centred on its beginning
of one letter less, and that one's on its own, so that a rare or unseen word has about the odds of the longest beginning that
was seen. Less ``drift`` these are the token scores; over clean text their mean is below zero.

One linear scan per text finds all maximal scoring segments (Ruzzo and Tompa): no part of one, and nothing around it, scores
higher. By chance, a clean text of m words holds a segment of score S or more about K m exp(-lambda S) times (Karlin and
Altschul); lambda solves sum p(s) exp(lambda s) = 1 over the token scores of clean texts, and K comes from the median of their
best segments. A passage is significant if it is expected less than ``chance`` times. A text's evidence is the sum of
lambda S - ln(K m) over its significant passages, or of the best one alone, and a logistic curve makes it a score.

Words and odds are learned from most of the labelled sample, lambda, K and the curve from the rest of it. Counting and scanning
is done by tasks; units, a histogram and one small row per text of the rest reach the driver, all bounded by ``per_label``.

Defined results: a NULL or wordless text has the least evidence and its score; without labelled texts of both kinds every
score is the share of toxic ones (0 without any); labels that are NULL or neither 0 nor 1 teach nothing; a doc_id stored or
labelled twice teaches each distinct (text, label) once; rows without doc_id count as held out; equal segments are all kept.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import slices
from tastemill.llm.words import GAP, plain_words
from tastemill.session import materialize

SHORTEST, LONGEST = 3, 8
#: What closes a whole word among its beginnings.
END = "$"
EULER = 0.5772156649015329
LEAST_EVIDENCE, MOST_EVIDENCE = -8.0, 40.0
TEXT_BATCH = 4 << 20
#: Width of a bar of the histogram of token scores.
BAR = 0.01


def is_held_out(key: Column) -> Column:
    """True where nothing may be learned from the row: remainder 2 of four, and rows without a key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last), from left to right, in linear time."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    # runs of positive tokens are one step each
    opens = up[np.concatenate([[True], np.diff(up) > 1])]
    closes = up[np.concatenate([np.diff(up) > 1, [True]])]
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int, int]] = []
    for first, last in zip(opens.tolist(), closes.tolist(), strict=True):
        low, high = float(upto[first]), float(upto[last + 1])
        while True:
            j = len(found) - 1
            # the nearest earlier segment that begins below this one; the ones between can never be joined again
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, last, j))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(high - low, first, last) for low, high, first, last, _ in found]


@dataclass
class Detector:
    """Log-odds of words and beginnings, the null model and the curve."""

    odds: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    chance: float = 0.05
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    share: float = 0.0
    fitted: bool = False

    def token(self, word: str) -> float:
        odds = self.odds
        own = odds.get(word + END)
        if own is None:
            for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
                own = odds.get(word[:n])
                if own is not None:
                    break
            else:
                own = 0.0
        return own - self.drift

    def read(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(token scores, words) of each text."""
        for a, b in slices([len(t) for t in texts], TEXT_BATCH):
            lower = pc.utf8_lower(pa.array(texts[a:b], pa.large_binary()).cast(pa.large_string()))
            lists = pc.split_pattern_regex(lower, GAP)
            coded = lists.values.dictionary_encode()
            names = coded.dictionary.to_pylist()
            value = np.fromiter(map(self.token, names), float, len(names))
            number = np.asarray(coded.indices)
            word = np.fromiter(map(bool, names), bool, len(names))[number] if len(names) else np.empty(0, bool)
            bounds = np.asarray(lists.offsets)
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = i + np.flatnonzero(word[i:j])
                yield value[number[at]], lists.values.take(pa.array(at))

    def surprise(self, found: list[tuple[float, int, int]], n: int) -> list[float]:
        """lambda S - ln(K m) per segment: minus the logarithm of how often it is expected by chance."""
        base = self.log_k + math.log(n)
        return [self.decay * s - base for s, _, _ in found]

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> float:
        if not n:
            return LEAST_EVIDENCE
        got = self.surprise(found, n) or [-self.log_k - math.log(n)]
        passed = [x for x in got if x > -math.log(self.chance)]
        return float(np.clip(sum(passed) if passed else max(got), LEAST_EVIDENCE, MOST_EVIDENCE))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(evidence), self.share)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * _bend(evidence))))


def _bend(evidence: np.ndarray) -> np.ndarray:
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def _odds(counts: pd.DataFrame, prior: float) -> dict[str, float]:
    """Log-odds of units from (unit, clean, toxic) counts, beginnings before what they begin. A unit that says the same as
    what it falls back to is left out."""
    total = counts[counts["unit"].str.endswith(END)][["clean", "toxic"]].sum()
    ratio = total["toxic"] / total["clean"]
    out: dict[str, float] = {}
    rows = sorted(zip(counts["unit"], counts["clean"], counts["toxic"], strict=True), key=lambda r: (r[0].endswith(END), len(r[0]), r[0]))
    for unit, clean, toxic in rows:
        above = unit[:-1][:LONGEST] if unit.endswith(END) else unit[:-1]
        while above and above not in out:
            above = above[:-1]
        known = out.get(above, 0.0)
        value = math.log((toxic + prior * math.exp(known)) / (clean * ratio + prior))
        if abs(value - known) > 0.02:
            out[unit] = value
    return out


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with sum p(s) exp(lambda s) = 1."""
    share = weights / weights.sum()
    if (share @ scores) >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(high * scores) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if share @ np.exp(mid * scores) > 1 else (mid, high)
    return max(low, 1e-3)


def _curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps, with a light pull of the slope to one."""
    x = np.stack([np.ones(len(evidence)), _bend(evidence)], 1)
    pull, at = np.array([1e-3, 1e-2]) * len(evidence) ** 0.5, np.array([0.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - pull * (at - [0.0, 1.0])
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(pull), gradient)
        at = at + np.clip(step, -2, 2)
    return float(at[0]), float(max(at[1], 1e-3))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 6_000, least: int = 2, prior: float = 3.0, drift: float = 0.5,
          chance: float = 0.05) -> Detector:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, on at most ``per_label`` distinct labelled texts of each
    label, drawn by a hash of the row. Units of fewer than ``least`` (text, word) pairs are not kept."""
    known = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    joined = materialize(texts.select("doc_id", "hash").distinct().join(known, "doc_id"), "labelled")
    sizes = {r["label"]: r["count"] for r in joined.groupBy("label").count().collect()}
    model = Detector(drift=drift, chance=chance)
    model.share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return model
    draw = F.xxhash64(F.lit("toxic"), "doc_id", "hash")
    halves = [joined.filter(F.col("label") == v).orderBy(draw, "doc_id", "hash").limit(per_label) for v in (0, 1)]
    # at most per_label rows of each label
    chosen = F.broadcast(materialize(halves[0].union(halves[1]), "chosen"))
    rest = F.pmod(F.xxhash64(F.lit("rest"), "doc_id", "hash"), F.lit(10)) >= 7
    rows = texts.join(chosen, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "label"]).select("label", "text", rest.alias("rest"))
    rows = materialize(rows, "taught")

    words = rows.filter("NOT rest").select("label", F.explode(F.array_distinct(plain_words(F.col("text")))).alias("word"))
    toxic = F.sum(F.col("label").cast("long"))
    words = words.groupBy("word").agg((F.count(F.lit(1)) - toxic).alias("clean"), toxic.alias("toxic"))
    longest = F.least(F.length("word"), F.lit(LONGEST))
    begins = F.when(longest >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), longest), lambda n: F.substring("word", 1, n)))
    units = F.concat(F.coalesce(begins, F.array().cast("array<string>")), F.array(F.concat("word", F.lit(END))))
    counts = words.select(F.explode(units).alias("unit"), "clean", "toxic").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = counts.filter(F.col("clean") + F.col("toxic") >= least).toPandas()
    if not len(held) or not held["clean"].sum() or not held["toxic"].sum():
        return model
    model.odds = _odds(held, prior)

    kept = rows.filter("rest").select("label", "text").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = materialize(kept, "rest")

    def bars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            clean = [t.encode() for t, y in zip(frame["text"], frame["label"], strict=True) if t and y == 0]
            for scores, _ in shared.value.read(clean):
                bar, n = np.unique(np.round(scores / BAR).astype(np.int64), return_counts=True)
                yield pd.DataFrame({"bar": bar, "n": n})

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for scores, _ in shared.value.read([(t or "").encode() for t in frame["text"]]):
                found = segments(scores)
                got.append((max((s for s, _, _ in found), default=0.0), len(scores), shared.value.evidence(found, len(scores))))
            yield pd.DataFrame(got, columns=["best", "n", "evidence"]).assign(label=frame["label"].to_numpy())

    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)
    null = kept.mapInPandas(bars, "bar long, n long").groupBy("bar").agg(F.sum("n").alias("n")).toPandas()
    if not len(null):
        return model
    model.decay = _decay(null["bar"].to_numpy(float) * BAR, null["n"].to_numpy(float))
    shared = context.broadcast(model)
    shape = "best double, n long, evidence double, label int"
    first = kept.filter("label = 0").mapInPandas(measured, shape).filter("n > 0").toPandas()
    # the median of a Gumbel distribution lies -ln(ln 2) above its place, here ln(K m) / lambda
    model.log_k = float(np.median(model.decay * first["best"] - np.log(first["n"]))) + math.log(math.log(2))
    shared = context.broadcast(model)
    every = kept.mapInPandas(measured, shape).toPandas()
    label = every["label"].to_numpy(float)
    drawn = {y: max(min(sizes[y], per_label), 1) for y in (0, 1)}
    weight = np.where(label == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    model.curve = _curve(every["evidence"].to_numpy(float), label, weight / weight.mean())
    model.fitted = True
    return model


FOUND = "score double, predicted int, passages array<struct<first:int,last:int,score:double,expected:double,text:string>>"


def scan(docs: DataFrame, model: Detector, cut: float = 0.3) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, score, predicted and the significant passages: first and last word, score, how often
    such a passage is expected in a clean text of this length, and its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<{', '.join(_struct_fields())}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            evidence, passages = [], []
            for scores, words in own.read([t.encode() if isinstance(t, str) else b"" for t in texts]):
                found = segments(scores)
                evidence.append(own.evidence(found, len(scores)))
                surprise = own.surprise(found, len(scores)) if found else []
                passages.append([
                    {"first": i, "last": j, "score": s, "expected": math.exp(-x), "text": " ".join(words.slice(i, j - i + 1).to_pylist())}
                    for (s, i, j), x in zip(found, surprise, strict=True) if x > -math.log(own.chance)
                ])
            score = np.clip(own.score(np.array(evidence)), 0.0, 1.0)
            yield pd.DataFrame({"score": score, "predicted": (score >= cut).astype(np.int32), "passages": passages})

    found = docs.select(F.col("doc_id").cast("long"), find(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "found.*")


def _struct_fields() -> list[str]:
    score, predicted, passages = FOUND.split(", ")
    return [part.replace(" ", ":", 1) for part in (score, predicted, passages)]


def detect(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Learn from labelled rows that are not held out, scan all: doc_id, held_out, score, predicted, passages."""
    model = train(docs, labels.filter(~is_held_out(F.col("doc_id"))), **settings)
    found = scan(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")
