"""Projections and filters with a name of their own in the domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interactions(df: DataFrame, user: str, item: str, weight: str, ts: str | None = None) -> DataFrame:
    """Keep and rename the interaction columns; everything else is pruned at the scan."""
    columns = [F.col(user).alias("user"), F.col(item).alias("track"), F.col(weight).alias("time")]
    if ts:
        columns.append(F.col(ts).alias("timestamp"))
    return df.select(*columns)


def positives(df: DataFrame, threshold: float, inclusive: bool = False, value: str = "time") -> DataFrame:
    """Positive feedback: strictly above the threshold for training, ``inclusive`` for metrics."""
    return df.where(F.col(value) >= threshold if inclusive else F.col(value) > threshold)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every listed column has a value."""
    return df.na.drop(subset=columns)


def inspect(df: DataFrame, condition: Column, order: tuple = ("timestamp",)) -> DataFrame:
    """Rows that meet a condition, in time order."""
    return df.where(condition).orderBy(*order)


def inspect_user(df: DataFrame, user, treatment: str, order: tuple = ("timestamp",)) -> DataFrame:
    return inspect(df, (F.col("user") == user) & (F.col("treatment") == treatment), order)


def next_events(df: DataFrame) -> DataFrame:
    return df.where(F.col("message") == "next")


def add_label(df: DataFrame, threshold: float, value: str = "time", alias: str = "label") -> DataFrame:
    return df.withColumn(alias, (F.col(value) > threshold).cast("int"))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name; a column missing in one of them becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def replicate(df: DataFrame, n: int, alias: str = "copy") -> DataFrame:
    """Every row n times, with the number of the copy."""
    return df.withColumn(alias, F.explode(F.sequence(F.lit(1), F.lit(n))))


def symmetrize(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges in both directions."""
    swapped = {src: F.col(dst).alias(src), dst: F.col(src).alias(dst)}
    return edges.unionByName(edges.select(*[swapped.get(c, F.col(c)) for c in edges.columns]))
