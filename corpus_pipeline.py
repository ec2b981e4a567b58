"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and decides over all rows it is given. All but the last return the columns of
``documents`` unchanged, extra ones included.

* language: rows without a letter, or whose language scores under one half, go.
* quality: rows predicted as label 0 go.
* near_duplicates: of the texts whose sets of five-word shingles link at 0.8, the one with the smallest doc_id stays; texts that
  share a doc_id are decided one by one, rows that repeat both are one. Rows without doc_id stay.
* decontaminate: rows that hold at least 0.8 of a benchmark item's five-word shingles go.
* packing: the remaining documents as pieces of at most 1024 tokens in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import decontaminate as leaks
from tastemill.llm import language as languages
from tastemill.llm import packing as sequences
from tastemill.llm import quality as qualities
from tastemill.llm.common import is_held_out, table
from tastemill.llm.jaccard_join import jaccard_components
from tastemill.operators.ordering import number_rows
from tastemill.session import materialize

LEAST_SCORE = 0.5
SEQUENCE = 1024


def _hidden(docs: DataFrame) -> DataFrame:
    """All columns but ``text`` under names that cannot clash with a model's results."""
    return docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_c{i}") for i, c in enumerate(docs.columns)])


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text" if c == "text" else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.train(docs.filter(~is_held_out(F.col("doc_id"))))
    scored = languages.predict(_hidden(docs), model)
    return _shown(scored.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = qualities.train(docs, labels.filter(~is_held_out(F.col("doc_id"))))
    return _shown(qualities.predict(_hidden(docs), model).filter("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    many = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min(F.xxhash64("text")) < F.max(F.xxhash64("text"))).alias("texts")
    )
    many = materialize(many.filter("n > 1"), "repeated")
    if many.filter("texts").limit(1).count():
        return _near_duplicates_by_text(docs)
    groups = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    others = materialize(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "copies")
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    once = kept.join(many, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(_first_of_equal(kept.join(many, "doc_id", "left_semi").select(docs.columns)))


def _first_of_equal(rows: DataFrame) -> DataFrame:
    """One row per doc_id and text: the one that sorts first as JSON."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = F.min_by(whole, F.to_json(whole)).alias("row")
    return rows.groupBy(F.col("doc_id").alias("_id"), F.md5("text").alias("_text")).agg(best).select("row.*")


def _near_duplicates_by_text(docs: DataFrame) -> DataFrame:
    """The same where texts share doc_ids: decided for every (doc_id, text), so that no text goes with another one's copies."""
    key = [F.col("doc_id").alias("_id"), F.coalesce(F.md5("text"), F.lit("")).alias("_text")]
    named = docs.filter(F.col("doc_id").isNotNull()).select("text", *key).dropDuplicates(["_id", "_text"])
    numbered = number_rows(named, [], ["_id", "_text"], "_n")
    groups = jaccard_components(numbered.select(F.col("_n").alias("doc_id"), "text"), words=5, percent=80)
    first = materialize(groups.filter("component_id = doc_id").select(F.col("doc_id").alias("_n")), "first")
    kept = numbered.join(first, "_n").select(F.col("_id").alias("doc_id"), F.col("_text").alias("_kept"))
    own = docs.withColumn("_kept", F.coalesce(F.md5("text"), F.lit(""))).join(kept, ["doc_id", "_kept"], "left_semi")
    nameless = docs.filter(F.col("doc_id").isNull())
    return _first_of_equal(own.select(docs.columns)).unionByName(nameless)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = sequences.pieces(docs, path, "leading", end_id=2, size=SEQUENCE)
    return sequences.pack(cut, size=SEQUENCE).drop("row")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Models and tokenizers take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
