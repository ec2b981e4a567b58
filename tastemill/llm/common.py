"""Small helpers that several of these operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo five; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(FOLDS)


def is_held_out(key: Column) -> Column:
    """True where nothing may be learned from the row: fold 0, and rows without a key."""
    return F.coalesce(fold(key) == 0, F.lit(True))


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), chosen by a hash of ``keys``, the same in every run."""
    total = df.count()
    if total <= rows:
        return df
    spread = F.pmod(F.xxhash64(F.lit("sample"), *[F.col(k) for k in keys]), F.lit(1_000_000))
    return df.filter(spread < int(1_000_000 * rows / total))


def stratified_sample(df: DataFrame, rows: int, least: int, by: str, *keys: str) -> DataFrame:
    """About ``rows`` rows, and of every value of ``by`` at least about ``least`` (all, if it has no more), chosen by a hash of
    ``keys``, the same in every run. Rows that repeat ``by`` and ``keys`` count as one."""
    bits = 53
    spread = F.xxhash64(F.lit("sample"), *[F.col(k) for k in keys]).bitwiseAND(F.lit((1 << bits) - 1)) / F.lit(float(1 << bits))
    marked = df.withColumn("_spread", spread)
    sizes = marked.select(by, "_spread").distinct().groupBy(by).count().collect()
    total = sum(r["count"] for r in sizes)
    shares = [(r[by], max(rows / total, least / r["count"])) for r in sizes]
    schema = df.select(by, F.lit(1.0).alias("_share")).schema
    # one row per value of ``by``
    share = F.broadcast(df.sparkSession.createDataFrame(shares, schema))
    kept = marked.join(share, by).filter(F.col("_spread") < F.col("_share"))
    return kept.dropDuplicates([by, "_spread"]).select(df.columns)


def slices(sizes, most: int):
    """Cut positions 0..len(sizes) into runs whose sizes add up to ``most`` or are one item."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def discard(*tables: DataFrame | None) -> None:
    """Delete intermediate tables that ``materialize`` wrote, once everything built on them has been written itself."""
    for table_ in tables:
        files = table_.inputFiles() if table_ is not None else []
        folder = files[0].rsplit("/", 1)[0] if files else ""
        if "/tastemill/" in folder:
            spark = table_.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
