"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the operators count on. Safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's checkpoint folder.

    Only a local master may fall back to a temporary folder, since executors on other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    folder = tempfile.mkdtemp(prefix="tastemill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders that this driver has handed out and not yet dropped.
_STAGES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _STAGES.append(f"{shared_dir(spark).rstrip('/')}/tastemill/{name}-{uuid.uuid4().hex}")
    return _STAGES[-1]


def drop_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far. Call it when the results built on them have been written."""
    conf = spark._jsc.hadoopConfiguration()
    while _STAGES:
        where = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        where.getFileSystem(conf).delete(where, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts the lineage, survives lost executors
    and freezes values (row numbers, partition ids) that a recomputation could change."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
