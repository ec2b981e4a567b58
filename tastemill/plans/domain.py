"""The given tables seen as the tables of a recommender: log, catalog, interactions, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.experiments import experiment_map
from ..session import tune


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """events -> event log; a purchase ends the session."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("user"),
        F.get_json_object("props", "$.k").cast("long").alias("track"),
        (F.col("value") / (F.col("value") + 50)).alias("time"),
        millis("ts").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", "last").otherwise("next").alias("message"),
        (F.col("value") / 1000).alias("latency"),
        F.when(
            F.col("event_type") != "purchase",
            F.pmod(F.get_json_object("props", "$.k").cast("long") + F.col("event_id"), F.lit(100)),
        ).alias("recommendation"),
    )


def per_user(events: DataFrame, alias: str, value: Column) -> DataFrame:
    """``events`` with a value that depends on the user alone, computed once per user."""
    users = events.select("user").distinct().withColumn(alias, value)
    return events.join(users, "user", "left")


def ab_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with the experiment map of every event."""
    return per_user(log(spark, sf), "experiments", experiment_map("user"))


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem joined to orders -> user, track, time, timestamp; ``row`` orders equal timestamps."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("track"),
        (F.col("l_quantity") / 50).alias("time"),
        millis("o_orderdate").alias("timestamp"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("row"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("track"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"),
        F.col("p_retailprice").alias("pop"),
        F.col("p_size").cast("long").alias("size"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
