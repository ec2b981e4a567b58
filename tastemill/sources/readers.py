"""Scans. Every reader takes an explicit schema, so that columns and filters are pruned without a first pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import vector_dim
from ..operators.ordering import dedup
from .schemas import EMBEDDINGS, EVENTS, INTERACTIONS, META, TRACKS, TRIPLETS, USER_DEFAULTS, USERS


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """JSON-lines event log; ``path`` may be a glob over the replicas' folders."""
    return spark.read.schema(schema).json(path)


def read_catalog(spark: SparkSession, path: str, schema: str = TRACKS, order: tuple = ("artist", "title")) -> DataFrame:
    """Track catalog: one row per track, a missing recommendation list becomes empty."""
    raw = spark.read.schema(schema).json(path)
    empty = F.array().cast("array<bigint>")
    return dedup(
        raw.withColumn("recommendations", F.coalesce("recommendations", empty)), ["track"], list(order)
    )


def read_interactions_csv(
    spark: SparkSession, path: str, schema: str = INTERACTIONS, drop: tuple = ("Unnamed: 0",), index: bool = False
) -> DataFrame:
    """CSV with a header; ``index`` says that the file starts with a stray index column, which is dropped."""
    full = f"`{drop[0]}` long, {schema}" if index and drop else schema
    return spark.read.schema(full).option("header", True).csv(path).drop(*drop)


def read_delimited(spark: SparkSession, path: str, sep: str, schema: str) -> DataFrame:
    """Headerless text columns; the separator may have several characters."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_triplets(spark: SparkSession, path: str, schema: str = TRIPLETS) -> DataFrame:
    return read_delimited(spark, path, "\t", schema)


def read_meta(spark: SparkSession, path: str, schema: str = META) -> DataFrame:
    return read_delimited(spark, path, "<SEP>", schema)


def read_embeddings(spark: SparkSession, path: str, schema: str = EMBEDDINGS) -> DataFrame:
    """Vectors as parquet rows; raises when they differ in length."""
    df = spark.read.schema(schema).parquet(path)
    vector_dim(df)
    return df


def read_users(spark: SparkSession, path: str, schema: str = USERS, defaults: dict = USER_DEFAULTS) -> DataFrame:
    return spark.read.schema(schema).json(path).na.fill(defaults)


def pending_keys(new: DataFrame, saved: DataFrame, parent: str, child: str, per_parent: int) -> DataFrame:
    """Incremental load: new (parent, child) keys not saved yet, only for parents with fewer than ``per_parent``
    distinct saved children."""
    done = (
        saved.select(parent, child)
        .distinct()
        .groupBy(parent)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= per_parent)
    )
    return new.join(done, parent, "left_anti").join(saved.select(parent, child), [parent, child], "left_anti")
