"""Benchmark items inside documents: containment search by size-partitioned MinHash, verified by exact shingles.

An item is contained in a document when at least ``threshold`` of its distinct shingles occur there. Items are partitioned by
size into classes [2^c, 2^(c+1)) shingles. The sketch of an item is its smallest shingle hashes, as many as let any
containment at the threshold show: of n shingles at most floor((1 - threshold) n) may be missing, so one more than that,
taken for the largest size of the class, always holds a shared one. Documents stay as they are, however long: all their shingle
hashes look for sketch values, and each hit of a document large enough for the class is a candidate. Candidates are verified on the shingles' words.

Only DataFrame functions. Shingles take ``size`` words of letters and digits in lower case. Defined results: an item or
document of fewer words has its whole word sequence as one shingle; NULL and word-free texts have none and are never
found; repeated rows are reported each; rows without an id are reported with NULL; empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.words import hash_of, plain_words, shingle_array, text_of
from tastemill.session import materialize


def row_key(*columns: str) -> Column:
    """A number for a row's content, the same for equal rows only, but for chance of 2^-64."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item_key, hash, least): sketch values of each item, and the least shingles a document of its class must have."""
    hashes = F.array_distinct(shingle_array(plain_words(F.col("text")), size, hash_of))
    rows = items.select(row_key("item_id", "text").alias("item_key"), hashes.alias("h")).filter(F.size("h") > 0).distinct()
    low = F.pow(F.lit(2.0), F.floor(F.log2(F.size("h").cast("double")) + 1e-9)).cast("int")
    keep = F.floor((low * 2 - 1) * F.lit(1 - threshold) + 1e-9).cast("int") + 1
    least = F.ceil(low * F.lit(threshold) - 1e-9).cast("int")
    return rows.select("item_key", least.alias("least"), F.explode(F.slice(F.array_sort("h"), F.lit(1), keep)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_key, doc_id, item_id, n_item, n_common, containment of every item that is in a document."""
    sketch = sketches(items, size, threshold)
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("doc_key"))
    hashes = keyed.select("doc_key", shingle_array(plain_words(F.col("text")), size, hash_of).alias("h"))
    probes = hashes.select("doc_key", F.size("h").alias("n"), F.explode("h").alias("hash"))
    hits = probes.join(sketch, "hash").filter(F.col("n") >= F.col("least"))
    candidates = materialize(hits.select("doc_key", "item_key").distinct(), "candidates")

    of_item = items.select(
        "item_id", row_key("item_id", "text").alias("item_key"),
        F.array_distinct(shingle_array(plain_words(F.col("text")), size, text_of)).alias("item"),
    )
    found = keyed.join(candidates, "doc_key").join(of_item, "item_key")
    common = F.size(F.array_intersect(shingle_array(plain_words(F.col("text")), size, text_of), F.col("item")))
    counted = found.select("doc_key", "doc_id", "item_id", F.size("item").alias("n_item"), common.alias("n_common"))
    share = F.col("n_common") / F.col("n_item")
    return counted.withColumn("containment", share).filter(F.col("n_common") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    found = contained(docs, items, size, threshold).select(F.col("doc_key").alias("_found")).distinct()
    return docs.join(found, row_key("doc_id", "text") == found["_found"], "left_anti")
