"""Joins of the domain. None carries a broadcast hint: Spark broadcasts a side by its measured size (statistics first,
adaptive execution later) and otherwise joins by exchange, splitting hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .ordering import number_rows, top_n


def with_catalog(df: DataFrame, catalog: DataFrame, on: str = "track") -> DataFrame:
    return df.join(catalog, on)


def left_fill(df: DataFrame, scores: DataFrame, keys: list[str], score: str = "score", seed: int = 0, small: float = 0.01):
    """Left join of scores; a missing score becomes a small repeatable draw from [0, ``small``)."""
    return df.join(scores, keys, "left").withColumn(
        score, F.coalesce(F.col(score), uniform(*keys, seed=seed) * small)
    )


def join_last(left: DataFrame, right: DataFrame, on: str, key: str, order: Column) -> DataFrame:
    """Left join, then the last row of each ``key`` by ``order``; per column the last value that is not NULL."""
    joined = left.join(right, on, "left")
    rest = [c for c in joined.columns if c != key]
    return joined.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order))).alias(c) for c in rest]
    )


def head_items(df: DataFrame, n: int, item: str = "track") -> DataFrame:
    """Rows of the n items with the most rows."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    return semi(df, top_n(counts, [F.col("_n").desc(), item], n), [item])


def build_catalog(meta: DataFrame, popularity: DataFrame, item: str = "track") -> DataFrame:
    """Metadata with popularity and a dense index in popularity order, most popular first."""
    merged = meta.join(popularity, item)
    ranked = number_rows(merged, [], [F.col("popularity").desc(), item], "_rn")
    return ranked.withColumn("index", F.col("_rn") - 1).drop("_rn")


def missing_meta(popularity: DataFrame, meta: DataFrame, item: str = "track") -> DataFrame:
    """Completeness check: popular items without metadata. Empty when the catalog is whole."""
    return popularity.join(meta, item, "left_anti")


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    return df.join(seen.select(*on), on, "left_anti")


def new_items(recs: DataFrame, consumed: DataFrame, on: tuple = ("user", "track")) -> DataFrame:
    """Recommended minus consumed."""
    return anti(recs, consumed, list(on))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, on: str, alias: str) -> DataFrame:
    """Dictionary lookup: the value of ``dim`` for column ``on``, NULL when unknown."""
    small = dim.select(F.col(key).alias(on), F.col(value).alias(alias))
    return df.join(small, on, "left")


def join_item_features(df: DataFrame, features: DataFrame, on: str = "track") -> DataFrame:
    return df.join(features, on, "left")


def join_training_log(log: DataFrame, metrics: list[str], epoch: str = "epoch") -> DataFrame:
    """Sparse log rows (one metric each) to one row per epoch that has all the metrics."""
    return log.groupBy(epoch).agg(*[F.max(m).alias(m) for m in metrics]).na.drop(subset=metrics)


def merge_last(frames: list[DataFrame], key: str) -> DataFrame:
    """Keyed union in which a later frame overwrites an earlier one."""
    tagged = None
    for priority, frame in enumerate(frames):
        part = frame.withColumn("_p", F.lit(priority))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in frames[0].columns if c != key]
    return tagged.groupBy(key).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(key, "_r.*")
