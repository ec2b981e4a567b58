"""Sinks. All files are written by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import salted_md5
from ..operators.ordering import number_rows, top_n
from ..session import materialize


def ranked_lists(df: DataFrame, key: str, item: str, rank: str, alias: str) -> DataFrame:
    """Rows (key, item, rank) to one ordered list per key. The lists are recommendation lists of at most k items."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["i"]).alias(alias))


def write_user_recs(df: DataFrame, path: str, user: str = "user", item: str = "track", rank: str = "rank") -> None:
    ranked_lists(df, user, item, rank, "tracks").select(F.col(user).alias("user"), "tracks").write.json(path)


def write_item_recs(df: DataFrame, path: str, key: str = "item_id", item: str = "track", rank: str = "rank") -> None:
    ranked_lists(df, key, item, rank, "recommendations").select(F.col(key).alias("item_id"), "recommendations").write.json(path)


def attach_item_recs(catalog: DataFrame, recs: DataFrame, key: str = "track", item: str = "item", rank: str = "rank"):
    """Catalog rows with their recommendation list, empty where there is none."""
    lists = ranked_lists(recs, key, item, rank, "recommendations")
    return catalog.join(lists, key, "left").withColumn(
        "recommendations", F.coalesce("recommendations", F.array().cast("array<bigint>"))
    )


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.option("header", True).csv(path)


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.json(path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def serving_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a published table, oldest first."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if files.exists(_folder(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def publish_serving_table(df: DataFrame, key: str, path: str, parts: int | None = None, keep: int = 2) -> int:
    """Keyed lists for lookups, parquet clustered and sorted by key, as the next version below ``path``.

    Readers take the newest complete version, so they always find a whole table; the ``keep`` newest versions stay.
    Returns the version written.
    """
    spark = df.sparkSession
    before = serving_versions(spark, path)
    version = (before[-1] if before else 0) + 1
    spread = df.repartition(parts, key) if parts else df.repartition(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/version={version}")
    for old in before[: len(before) + 1 - keep]:
        files, where = _folder(spark, f"{path}/version={old}")
        files.delete(where, True)
    return version


def read_serving_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest complete version of a published table; empty if there is none."""
    versions = serving_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={versions[-1]}")


def upsert_serving_table(updates: DataFrame, key: str, path: str) -> int:
    """Publish a version in which the rows of ``updates`` replace or join those of the current one."""
    old = read_serving_table(updates.sparkSession, path, updates.schema)
    rest = old.join(updates.select(key), key, "left_anti")
    return publish_serving_table(rest.unionByName(updates), key, path)


def write_top_tracks(popularity: DataFrame, path: str, n: int, item: str = "track", score: str = "popularity") -> None:
    """The n most popular items as one JSON array, most popular first."""
    top = top_n(popularity, [F.col(score).desc(), item], n)
    ranked = number_rows(top, [], [F.col(score).desc(), item], "_rn")
    packed = F.array_sort(F.collect_list(F.struct("_rn", F.col(item).alias("i"))))
    ranked.agg(F.to_json(F.transform(packed, lambda x: x["i"])).alias("value")).write.text(path)


def write_embeddings(df: DataFrame, path: str, meta: list[str], vector: str = "vector") -> None:
    """Tab-separated vectors and metadata for a projector. Line n of a vector file belongs to line n of the metadata
    file of the same part number: both are written from one stored table, part by part."""
    text = df.select(
        F.array_join(F.transform(vector, lambda x: x.cast("string")), "\t").alias("v"),
        F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in meta]).alias("m"),
    )
    rows = materialize(text, "projector")
    rows.select(F.col("v").alias("value")).write.text(f"{path}/vectors")
    rows.select(F.col("m").alias("value")).write.text(f"{path}/metadata")


def anonymize(df: DataFrame, column: str, salt: str) -> DataFrame:
    return df.withColumn(column, salted_md5(column, salt))
