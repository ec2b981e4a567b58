"""Quality of whole texts: a vote of the nearest labelled texts, weighted by similarity, in latent-semantic space.

The terms of a text are its word shapes (``Abc,`` and ``Xyzt,`` are both ``Aa,``: runs of lower-case letters, capitals,
digits or one sign become one character) and a few terms for repeated words, repeated lines, vocabulary and length. Counts
are weighted by log frequency and inverse document frequency, and projected on the leading singular vectors of the labelled
sample. Every document is compared, block by block, with all labelled vectors by exact cosine; the nearest ones vote. Labelled
rows that repeat doc_id, text and label are one vector, weighted by their number.

Defined results: a text without any term of the model (NULL or empty texts, too) gets the share of label 1 in the sample,
and 0.5 where there are no labelled rows; labels that are NULL teach nothing; a doc_id labelled or stored twice teaches
twice; ties between neighbours at the last place are all counted; rows without doc_id count as held out. Other columns
pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import is_held_out
from tastemill.session import materialize

SHAPE_LENGTH = 12
BLOCK = 512


def _shape_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


SHAPES = _shape_table()


def terms(text: str | None) -> Counter:
    """Term counts of a whole text."""
    data = text.encode("utf-8", "replace") if text else b""
    words = data.lower().split()
    if not words:
        return Counter()
    shape = SHAPES[np.frombuffer(data, np.uint8)]
    turns = np.concatenate([[True], shape[1:] != shape[:-1]])
    out: Counter = Counter()
    for word, n in Counter(shape[turns].tobytes().split()).items():
        out[b"shape " + word[:SHAPE_LENGTH]] += n
    lines = data.split(b"\n")
    out[b"repeats %d" % (10 * sum(map(eq, words, words[1:])) // len(words))] += 3
    out[b"vocabulary %d" % (10 * len(set(words)) // len(words))] += 1
    out[b"lines %d" % (5 * len(set(lines)) // len(lines))] += 1
    out[b"length %d" % len(words).bit_length()] += 1
    return out


@dataclass
class Voters:
    """Terms with their weights, the projection, and the labelled vectors with the number of rows each stands for."""

    columns: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float
    times: np.ndarray

    def weighted(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.columns)), np.float32)
        for i, count in enumerate(counts):
            for term, n in count.items():
                j = self.columns.get(term)
                if j is not None:
                    x[i, j] = (1 + np.log(n)) * self.idf[j]
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: list[Counter]) -> np.ndarray:
        prior = float(np.average(self.labels, weights=self.times)) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.labels):
            return out
        for a in range(0, len(counts), BLOCK):
            z = self.project(self.weighted(counts[a : a + BLOCK]))
            near = np.maximum(z @ self.vectors.T, 0)
            k = min(self.neighbours, near.shape[1])
            top = np.argpartition(near, near.shape[1] - k, 1)[:, near.shape[1] - k :]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1), 1)
            before = np.cumsum(self.times[top], 1) - self.times[top]
            last = (before < self.neighbours).sum(1, keepdims=True) - 1
            least = np.take_along_axis(near, np.take_along_axis(top, last, 1), 1)
            weight = np.where(near >= least, near, 0.0) ** self.sharpness * self.times
            total = weight.sum(1)
            vote = (weight @ self.labels) / np.maximum(total, 1e-30)
            out[a : a + BLOCK] = np.where(total > 1e-12, vote, prior)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000, top_terms: int = 2_048, dimensions: int = 64,
          neighbours: int = 15, sharpness: float = 4.0) -> Voters:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``. The model's size is bounded by its parameters: at most
    ``sample_rows`` distinct labelled rows, drawn by a hash of the row, ``top_terms`` terms and ``dimensions``."""
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("labelled"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    stored = texts.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("stored"))
    joined = stored.join(known, "doc_id").withColumn("times", F.col("stored") * F.col("labelled"))
    draw = F.xxhash64(F.lit("sample"), "doc_id", "hash", "label")
    chosen = joined.select("doc_id", "hash", "label", "times").orderBy(draw, "doc_id", "hash", "label").limit(sample_rows)
    chosen = F.broadcast(materialize(chosen, "chosen"))  # at most sample_rows rows, a parameter
    rows = texts.join(chosen, ["doc_id", "hash"]).select("doc_id", "hash", "label", "times", "text").distinct()
    rows = materialize(rows, "taught")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, times in zip(frame["text"], frame["times"], strict=True):
                found = list(terms(text))
                yield pd.DataFrame({"term": found, "times": [times] * len(found)})

    every = rows.mapInPandas(listed, "term binary, times long").groupBy("term").agg(F.sum("times").alias("seen"))
    seen = {bytes(r["term"]): r["seen"] for r in every.orderBy(F.desc("seen"), "term").limit(top_terms).collect()}
    top = sorted(seen, key=lambda t: (-seen[t], t))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [terms(t) for t in frame["text"]]
            held = [[(t, n) for t, n in g.items() if t in seen] for g in got]
            yield frame[["doc_id", "hash", "label", "times"]].assign(
                any=[bool(g) for g in got], terms=[[t for t, _ in h] for h in held], counts=[[n for _, n in h] for h in held]
            )

    got = rows.mapInPandas(
        count, "doc_id long, hash long, label double, times long, any boolean, terms array<binary>, counts array<long>"
    ).toPandas()
    got = got[got["any"]].sort_values(["doc_id", "hash", "label"])
    counts = [Counter(dict(zip(map(bytes, t), map(int, n), strict=True))) for t, n in zip(got["terms"], got["counts"], strict=True)]
    label, times = got["label"].to_numpy(float), got["times"].to_numpy(float)
    idf = np.log((1 + times.sum()) / (1 + np.array([seen[t] for t in top], float))) + 1
    model = Voters(
        {t: i for i, t in enumerate(top)}, idf, np.zeros((len(top), 0)), np.zeros((0, 0)), label, neighbours, sharpness, times
    )
    if counts:
        x = model.weighted(counts).astype(float)
        values, vectors = np.linalg.eigh(x.T @ (x * times[:, None]))
        model.basis = vectors[:, np.argsort(-values)[:dimensions]].astype(np.float32)
        model.vectors = model.project(x.astype(np.float32))
    return model


def predict(docs: DataFrame, model: Voters, cut: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series(own.score([terms(t if isinstance(t, str) else None) for t in texts]))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, vote(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Learn from labelled rows that are not held out, score all: doc_id, held_out, score, predicted."""
    marked = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    teaching = labels.filter(~is_held_out(F.col("doc_id")))
    model = train(docs, teaching, **bounds)
    return predict(marked.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "score", "predicted")
