"""The registered queries of this folder: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import chat, crosstoken, decontaminate, html_text, language, licenses, merkle, packing, quality, toxicity
from tastemill.llm.common import table
from tastemill.llm.jaccard_join import jaccard_components
from tastemill.llm.token_files import read_tokens, write_tokens
from tastemill.llm.vptree import vptree_knn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Pruning factor of the registered search: on clustered vectors it saves a tenth of what exact search computes and loses no
#: neighbour; larger ones depend on the data (4 finds 0.99 on the test vectors, but 0.4 on tight clusters).
VPTREE_FACTOR = 1.1


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_vptree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0)
    return vptree_knn(vectors, asked, "vec_id", "embedding", k=20, factor=VPTREE_FACTOR)


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "dropped", end_id=1)
    return read_tokens(manifest)


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(table(spark, sf_dir, "documents"), path, "leading", end_id=2, size=1024)
    return packing.pack(cut, size=1024).drop("row")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("doc_key")


SQL["op4_decontaminate"] = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
           lambda w: w <> '') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')
    FROM benchmark
), shingles AS (
    SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM words
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, CAST(any_value(n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_common,
       count(*) / any_value(n) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id
HAVING count(*) >= ceil(any_value(n) * 0.8 - 1e-9)
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


SQL["op6_license_scan"] = licenses.comparison_sql()


@query
def op10_chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_ordered(table(spark, sf_dir, "conversations"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_test(table(spark, sf_dir, "documents"))


SQL["op11_merkle_manifest"] = merkle.comparison_sql()


@query
def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstoken.cross_align(table(spark, sf_dir, "documents"), *paths)[0]


@query
def op12_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
