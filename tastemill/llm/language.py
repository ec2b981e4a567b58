"""Language of whole texts: known words by their log frequency per language, unseen words by shorter and shorter n-grams.

Training counts words and character n-grams per language with Spark over a bounded sample of labelled rows, which holds rows of
every language, and keeps the most frequent ones, so that the model has a fixed largest size per language. What a language
has not shown scores the same in all languages, however much of each was read. A text's words are scored against every language: a word of
the list by its log frequency; another one by the mean log frequency of its character n-grams, starting with the longest
and backing off to shorter ones until some n-gram is known; a word without any known n-gram says nothing. The sums give the
language and, as a softmax, its score.

Defined results: a NULL text and one without a letter are ``und`` with score 0; without any labelled row every text is;
ties go to the language that sorts first; rows without doc_id count as held out; repeated rows teach once and are scored
each. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import is_held_out, stratified_sample

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "_"


@dataclass
class Backoff(dict):
    """Word -> row of ``rows``; a word that is not there is scored by its n-grams, rows of ``gram_rows``, and remembered for a
    while."""

    langs: list[str]
    words: dict[str, int]
    rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    longest: int
    limit: int = 100_000
    table: np.ndarray = field(init=False)
    used: int = field(init=False, default=0)

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.words)
        self.used = len(self.words)
        self.table = np.zeros((self.used + 4096, len(self.langs)))
        self.table[: self.used] = self.rows

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.score(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def score(self, word: str) -> np.ndarray:
        edged = EDGE + word + EDGE
        for n in range(min(self.longest, len(edged)), 0, -1):
            known = [g for i in range(len(edged) - n + 1) if (g := self.grams.get(edged[i : i + n])) is not None]
            if known:
                return self.gram_rows[known].mean(0)
        return np.zeros(len(self.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            words = LETTERS.findall(text.lower()) if text else []
            if not words or not self.langs or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            if self.used > self.limit + len(self.words):
                self.reset()
            at = [self[w] for w in words]
            total = self.table[at].sum(0)
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def train(docs: DataFrame, sample_rows: int = 4_000, top_words: int = 20_000, top_grams: int = 15_000,
          longest: int = 5, least_rows: int = 200) -> Backoff:
    """Model of ``docs(doc_id, text, lang)``. Bounds of its size, as parameters: about ``sample_rows`` labelled rows are
    read, but at least about ``least_rows`` of every language (all, if it has no more), and ``top_words`` words and
    ``top_grams`` n-grams of each length are kept per language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = stratified_sample(labelled, sample_rows, least_rows, "lang", "doc_id", "text")
    split = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = rows.select("lang", split.alias("item")).filter(F.length("item") > 0).groupBy("lang", "item").count()
    words = words.cache()
    edged = F.concat(F.lit(EDGE), "item", F.lit(EDGE))
    parts = [
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(edged) - (n - 1), F.lit(1))), lambda i, n=n: F.substr(edged, i, F.lit(n))
        )
        for n in range(1, longest + 1)
    ]
    grams = words.select("lang", "count", F.explode(F.concat(*parts)).alias("item"))
    grams = grams.withColumn("n", F.length("item")).groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))
    both = words.withColumn("n", F.lit(0)).unionByName(grams)
    mass = both.groupBy("lang", "n").agg(F.sum("count").alias("mass"))
    order = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "item")
    top = both.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams)
    )
    got, total = top.select("lang", "n", "item", "count").toPandas(), mass.toPandas()
    words.unpersist()

    langs = sorted(total["lang"].unique())
    column = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = []
    for n in range(longest + 1):
        masses = total[total["n"] == n].set_index("lang")["mass"]
        # half a count of the largest language for what a language has not shown: a floor of its own mass would be the higher
        # the less of a language was read
        unseen = np.full(len(langs), math.log(0.5 / (masses.max() + 1)) if len(masses) else 0.0)
        held: dict[str, np.ndarray] = {}
        for lang, item, count in got[got["n"] == n][["lang", "item", "count"]].itertuples(index=False):
            row = held.setdefault(item, unseen.copy())
            row[column[lang]] = math.log((count + 0.5) / (masses[lang] + 1))
        tables.append(held)
    known = tables[0]
    rows_of = np.array(list(known.values())) if known else np.zeros((0, len(langs)))
    grams = {g: row for held in tables[1:] for g, row in held.items()}
    grams_of = np.array(list(grams.values())) if grams else np.zeros((0, len(langs)))
    return Backoff(langs, {w: i for i, w in enumerate(known)}, rows_of, {g: i for i, g in enumerate(grams)}, grams_of, longest)


def predict(docs: DataFrame, model: Backoff) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.words, model.rows, model.grams, model.gram_rows, model.longest)
    )

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Backoff(*shared.value)
        for texts in batches:
            names, scores = own.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, label(F.col("text").cast("string")).alias("_label")).select(
        *kept, "_label.lang_pred", "_label.score"
    )


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    marked = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    model = train(marked.filter(~F.col("held_out")), **bounds)
    return predict(marked.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
