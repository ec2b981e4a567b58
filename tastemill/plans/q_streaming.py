"""Queries on streams: the log is delivered as files in time order and processed batch by batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import serving as sv
from ..session import scratch_path
from ..sources.rotating import stream_rotating
from ..sources.writers import ranked_lists
from ..streaming import streams as st
from .domain import ab_log, catalog
from .q_basics import joined, top3
from .q_events import EFFECTS_SQL, I2I, SESSION_SQL, plain_effects, rounded
from .q_serving import DENSE, INDEXED, any_sql
from .registry import query
from .sqlparts import CATALOG, INTER, LOG, PAIRS, TREATED, SESSIONS, ctes

PARTS = 4


def delivered(spark, sf, copies: int = 1) -> DataFrame:
    """The log as a stream of four deliveries, each a later part of the time span, written by all tasks."""
    path = scratch_path(spark, "stream")
    events = ab_log(spark, sf)
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    # a log of one instant is one part
    part = F.floor(F.try_divide(F.col("timestamp") - low, F.lit(high) - low) * PARTS)
    events.withColumn("part", F.coalesce(F.least(part, F.lit(PARTS - 1)), F.lit(0))).write.partitionBy("part").parquet(f"{path}/parts")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for number in range(PARTS):
        rows = spark.read.schema(events.schema).parquet(f"{path}/parts").filter(F.col("part") == number).drop("part").repartition(files)
        for _ in range(copies):
            rows.write.mode("append").json(f"{path}/log")
    return st.stream_events(spark, f"{path}/log", schema=f"event_id long, {st.EVENTS}", files_per_batch=files * copies)


@query(
    "s8_stream_events",
    ctes(LOG) + """SELECT event_id, "user", track, "timestamp", message FROM log""",
)
def s8_stream(spark, sf):
    return st.to_table(delivered(spark, sf).select("event_id", "user", "track", "timestamp", "message"), "events")


def grown(spark, sf, select) -> DataFrame:
    """The log as one folder of growing host files: each part of the time span becomes new files after the older ones
    were renamed, and one query reads on from its checkpoint after each of them."""
    path = scratch_path(spark, "rotated")
    events = ab_log(spark, sf)
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    part = F.floor(F.try_divide(F.col("timestamp") - low, F.lit(high) - low) * PARTS)
    events.withColumn("part", F.coalesce(F.least(part, F.lit(PARTS - 1)), F.lit(0))).write.partitionBy("part").parquet(f"{path}/parts")
    files = FolderOf(spark, f"{path}/log")
    for number in range(PARTS):
        rows = spark.read.schema(events.schema).parquet(f"{path}/parts").filter(F.col("part") == number).drop("part")
        rows.write.json(f"{path}/next-{number}")
        files.rotate(f"{path}/next-{number}")
        stream = select(stream_rotating(spark, f"{path}/log", "host", f"event_id long, {st.EVENTS}", 1 << 20))
        st.run_available(stream, f"{path}/data", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


class FolderOf:
    """Renames in a log folder, as loggers do them."""

    def __init__(self, spark, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self.store = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.store.mkdirs(self.path(folder))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.store.listStatus(self.path(folder)))

    def rotate(self, new: str) -> None:
        """``host-n.json`` becomes ``host-n.json.1`` and so on; the files of ``new`` become ``host-n.json``."""
        numbered = [(int(name.partition(".json")[2][1:] or 0), name) for name in self.names(self.folder)]
        for number, name in sorted(numbered, reverse=True):
            later = f"{name.partition('.json')[0]}.json.{number + 1}"
            if not self.store.rename(self.path(f"{self.folder}/{name}"), self.path(f"{self.folder}/{later}")):
                raise OSError(f"could not rename {name}")
        for n, name in enumerate(x for x in self.names(new) if x.startswith("part-")):
            self.store.rename(self.path(f"{new}/{name}"), self.path(f"{self.folder}/host-{n}.json"))


@query("s8_rotating_log", ctes(LOG) + """SELECT event_id, "user", track, "timestamp", message FROM log""")
def s8_rotating(spark, sf):
    return grown(spark, sf, lambda e: e.select("event_id", "user", "track", "timestamp", "message"))


@query("z1_rotating_log", ctes(LOG) + "SELECT message, count(*) AS n, CAST(sum(track) AS BIGINT) AS tracks FROM log GROUP BY 1")
def z1_rotating(spark, sf):
    rows = grown(spark, sf, lambda e: e.select("message", "track"))
    return rows.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.sum("track").alias("tracks"))


@query("z1_stream_source", ctes(LOG) + "SELECT message, count(*) AS n FROM log GROUP BY 1")
def z1_source(spark, sf):
    return st.to_table(delivered(spark, sf).select("message"), "events").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "z2_stream_history",
    ctes(LOG) + """SELECT "user", array_to_string(list(track ORDER BY rn), ',') AS tracks FROM (SELECT "user", track,
  row_number() OVER (PARTITION BY "user" ORDER BY "timestamp" DESC, track DESC) AS rn FROM log) WHERE rn <= 10 GROUP BY 1""",
)
def z2_history(spark, sf):
    updates = st.to_table(st.stream_history(delivered(spark, sf)), "history")
    return st.latest_history(updates).select("user", joined("tracks").alias("tracks"))


def sessions_stream(spark, sf):
    events = delivered(spark, sf).withColumn("treatment", F.col("experiments")["I2I"])
    return st.stream_sessions(events)


@query(
    "z3_stream_sessions",
    SESSION_SQL + """SELECT "user", treatment, "timestamp", tracks, round("time", 6) AS "time", round(latency, 6) AS latency
FROM sessions""",
)
def z3_sessions(spark, sf):
    return rounded(st.to_table(sessions_stream(spark, sf), "sessions").drop("closed"), "time", "latency")


@query(
    "z3_stream_timeouts",
    ctes(LOG, I2I, TREATED) + """, g AS (SELECT *, lag(message) OVER w = 'last' OR "timestamp" - lag("timestamp") OVER w > 1800000 AS opens FROM tlog
  WINDOW w AS (PARTITION BY "user", treatment ORDER BY "timestamp", message, "time", track)),
n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY "user", treatment ORDER BY "timestamp", message, "time", track ROWS UNBOUNDED PRECEDING) AS sid FROM g),
s AS (SELECT "user", treatment, sid, min("timestamp") AS "timestamp", max("timestamp") AS last_at, count(*) AS tracks, sum("time") AS "time", sum(latency * 1000) AS latency,
  max(CASE WHEN message = 'last' THEN 1 ELSE 0 END) = 1 AS closed, sid = max(sid) OVER (PARTITION BY "user", treatment) AS newest FROM n GROUP BY 1, 2, 3)
SELECT "user", treatment, "timestamp", tracks, round("time", 6) AS "time", round(latency, 6) AS latency, closed FROM s
WHERE closed OR NOT newest OR last_at + 1800000 < (SELECT max("timestamp") FROM log) - 600000""",
)
def z3_timeouts(spark, sf):
    """Sessions ended by the marker or by a pause of half an hour; those that may still go on are not emitted."""
    events = delivered(spark, sf).withColumn("treatment", F.col("experiments")["I2I"]).withWatermark("at", "10 minutes")
    return rounded(st.to_table(st.stream_sessions(events, "30 minutes"), "timeouts"), "time", "latency")


SUMS = """stats AS (SELECT treatment, 'tracks' AS metric, count(*) AS n, avg(tracks) AS mean, var_samp(tracks) AS var FROM sessions GROUP BY 1
  UNION ALL SELECT treatment, 'time', count(*), avg("time"), var_samp("time") FROM sessions GROUP BY 1
  UNION ALL SELECT treatment, 'latency', count(*), avg(latency), var_samp(latency) FROM sessions GROUP BY 1)"""


@query(
    "z4_stream_ab_stats",
    ctes(LOG, I2I, TREATED, SESSIONS, SUMS) + "SELECT treatment, metric, n, round(mean, 5) AS mean, round(var, 4) AS var FROM stats",
)
def z4_stats(spark, sf):
    live = st.run_ab_stats(sessions_stream(spark, sf), scratch_path(spark, "ab-stats"))
    return live.stats().select("treatment", "metric", "n", F.round("mean", 5).alias("mean"), F.round("var", 4).alias("var"))


@query("z4_stream_ab_effects", ctes(LOG, I2I, TREATED, SESSIONS, SUMS) + EFFECTS_SQL)
def z4_effects(spark, sf):
    live = st.run_ab_stats(sessions_stream(spark, sf), scratch_path(spark, "ab-stats"))
    return plain_effects(live.effects())


@query(
    "z5_stream_popularity",
    ctes(LOG) + """, w AS (SELECT "timestamp" // 86400000 * 86400000 AS start_, track, "time" FROM log)
SELECT start_ AS start_ms, track, count(*) AS plays, round(sum("time"), 6) AS popularity FROM w
WHERE start_ + 86400000 <= (SELECT max("timestamp") FROM log) - 600000 GROUP BY 1, 2""",
)
def z5_popularity(spark, sf):
    """Daily windows; the last, still open ones are not emitted."""
    out = st.to_table(st.stream_popularity(delivered(spark, sf)), "popularity")
    return rounded(out.select(F.unix_millis("start").alias("start_ms"), "track", "plays", "popularity"), "popularity")


@query(
    "z5_stream_popularity_sliding",
    ctes(LOG) + """, w AS (SELECT ("timestamp" // 86400000 - k) * 86400000 AS start_, track, "time" FROM log, range(0, 7) r(k))
SELECT start_ AS start_ms, track, count(*) AS plays, round(sum("time"), 6) AS popularity FROM w
WHERE start_ + 7 * 86400000 <= (SELECT max("timestamp") FROM log) - 600000 GROUP BY 1, 2""",
)
def z5_sliding(spark, sf):
    out = st.to_table(st.stream_popularity(delivered(spark, sf), "7 days", "1 day"), "popularity")
    return rounded(out.select(F.unix_millis("start").alias("start_ms"), "track", "plays", "popularity"), "popularity")


@query("z6_stream_recommend", ctes(LOG, CATALOG, DENSE, any_sql(), INTER, PAIRS, INDEXED) + "SELECT event_id, own AS next FROM ix")
def z6_recommend(spark, sf):
    listed = ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    dense = sv.dense_catalog(catalog(spark, sf))
    stream = st.stream_recommend(delivered(spark, sf), lambda e: sv.recommend_indexed(e, listed, dense))
    return st.to_table(stream.select("event_id", "next"), "recommended")


@query(
    "z7_deduplicate",
    ctes(LOG) + """SELECT event_id, "user", track, "timestamp" FROM log""",
)
def z7_dedup(spark, sf):
    """Every delivery arrives twice."""
    once = st.deduplicate(delivered(spark, sf, copies=2))
    return st.to_table(once.select("event_id", "user", "track", "timestamp"), "unique-events")


