"""Sessions closed by an end marker, on logs in which one user may hold a large share of all events.

The log of a key is cut at fixed time slices. Inside a slice, sessions are cut by counting end markers. A session that
neither touches the slice's start nor stays open at its end is complete; the other pieces, at most two per (key,
slice), are stitched across slices. So the only window that sees a whole key runs over those few pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import HOUR_MS, join_nullsafe, number_rows

#: Order of a user's events with equal timestamps, in columns that every event log has.
TIES = ("message", "time", "track")
IS_LAST = "message = 'last'"


def _cut(events: DataFrame, keys, order: str, ties, end: str, slice_ms: int) -> DataFrame:
    """Add the slice and the number of the session inside the slice."""
    window = (
        Window.partitionBy(*keys, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    closed = F.expr(f"CASE WHEN {end} THEN 1 ELSE 0 END")
    return (
        events.withColumn("_slice", F.floor(F.col(order) / slice_ms))
        .withColumn("_end", closed)
        .withColumn("_piece", F.coalesce(F.sum("_end").over(window), F.lit(0)))
    )


def _stitch(edges: DataFrame, keys) -> DataFrame:
    """Number the sessions formed by the edge pieces of each key."""
    window = (
        Window.partitionBy(*keys).orderBy("_slice", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    return edges.withColumn("_group", F.coalesce(F.sum("_end").over(window), F.lit(0)))


def sessionize(
    events: DataFrame,
    keys: tuple = ("user", "treatment"),
    order: str = "timestamp",
    ties: tuple = TIES,
    end: str = IS_LAST,
    stamp: str = "first",
    keep_open: bool = False,
    slice_ms: int = HOUR_MS,
) -> DataFrame:
    """One row per session: keys, timestamp (of its first or last event), tracks, time, latency (milliseconds).

    Sessions without an end marker are dropped unless ``keep_open``.
    """
    pieces = (
        _cut(events, keys, order, ties, end, slice_ms)
        .groupBy(*keys, "_slice", "_piece")
        .agg(
            F.min(order).alias("_from"),
            F.max(order).alias("_to"),
            F.count(F.lit(1)).alias("tracks"),
            F.sum("time").alias("time"),
            F.sum(F.col("latency") * 1000).alias("latency"),
            F.max("_end").alias("_end"),
        )
    )
    inner = (F.col("_piece") > 0) & (F.col("_end") == 1)
    stitched = (
        _stitch(pieces.where(~inner), keys)
        .groupBy(*keys, "_group")
        .agg(
            F.min("_from").alias("_from"),
            F.max("_to").alias("_to"),
            F.sum("tracks").alias("tracks"),
            F.sum("time").alias("time"),
            F.sum("latency").alias("latency"),
            F.max("_end").alias("_end"),
        )
    )
    columns = [*keys, "_from", "_to", "tracks", "time", "latency", "_end"]
    sessions = pieces.where(inner).select(*columns).unionByName(stitched.select(*columns))
    if not keep_open:
        sessions = sessions.where(F.col("_end") == 1)
    at = F.col("_from" if stamp == "first" else "_to").alias("timestamp")
    return sessions.select(*keys, at, "tracks", "time", "latency")


def mark_sessions(
    events: DataFrame,
    keys: tuple = ("user",),
    order: str = "timestamp",
    ties: tuple = TIES,
    end: str = IS_LAST,
    item: str = "track",
    slice_ms: int = HOUR_MS,
) -> DataFrame:
    """Events with ``session_start`` (time of the session's first event), ``start_item`` and ``is_start``.

    Open sessions are kept. The first event of a session that began in an earlier slice comes from the stitched edges,
    one row per (key, slice).
    """
    cut = _cut(events, keys, order, ties, end, slice_ms)
    head = F.min(F.struct(F.col(order).alias("at"), *ties, F.col(item).alias("item")))
    pieces = cut.groupBy(*keys, "_slice", "_piece").agg(head.alias("_head"), F.max("_end").alias("_end"))
    edges = _stitch(pieces.where((F.col("_piece") == 0) | (F.col("_end") == 0)), keys)
    # _head starts with the event time, so its minimum over the stitched pieces is the session's first event
    whole = Window.partitionBy(*keys, "_group")
    carried = (
        edges.withColumn("_first", F.min("_head").over(whole))
        .where(F.col("_piece") == 0)
        .select(*keys, "_slice", F.col("_first").alias("_carried"))
    )
    local = cut.withColumn("_local", head.over(Window.partitionBy(*keys, "_slice", "_piece")))
    first = F.when(F.col("_piece") == 0, F.col("_carried")).otherwise(F.col("_local"))
    here = F.struct(F.col(order).alias("at"), *ties, F.col(item).alias("item"))
    return (
        join_nullsafe(local, carried, [*keys, "_slice"], "left")
        .withColumn("_first", first)
        .withColumn("session_start", F.col("_first.at"))
        .withColumn("start_item", F.col("_first.item"))
        .withColumn("is_start", here == F.col("_first"))
        .drop("_slice", "_end", "_piece", "_local", "_carried", "_first")
    )


def session_starts(events: DataFrame, keys: tuple = ("user",), **options) -> DataFrame:
    """First event of every session, open ones included: what the user started on their own."""
    return mark_sessions(events, keys, **options).where("is_start").drop("session_start", "start_item", "is_start")


def start_pairs(events: DataFrame, user: str = "user", **options) -> DataFrame:
    """(user, start, track, time): the session's first track with each later one; open sessions are kept."""
    return (
        mark_sessions(events, (user,), **options)
        .where(~F.col("is_start"))
        .select(user, F.col("start_item").alias("start"), "track", "time")
    )


def user_level_metrics(sessions: DataFrame, keys: tuple = ("user", "treatment")) -> DataFrame:
    """Closed sessions to one row per user with the five experiment metrics."""
    return (
        sessions.groupBy(*keys)
        .agg(
            F.count("timestamp").alias("sessions"),
            F.sum("tracks").alias("tracks"),
            F.sum("time").alias("time"),
            F.sum("latency").alias("latency"),
        )
        .withColumn("mean_request_latency", F.try_divide("latency", "tracks"))
        .withColumn("mean_tracks_per_session", F.try_divide("tracks", "sessions"))
        .withColumn("mean_time_per_session", F.try_divide("time", "sessions"))
    )


def user_metrics_log(events: DataFrame, keys: tuple = ("user", "treatment")) -> DataFrame:
    """The same idea straight from the log: unclosed events count too, users without a closed session get NULL."""
    sessions = F.count(F.when(F.col("message") == "last", F.lit(1)))
    return events.groupBy(*keys).agg(
        sessions.alias("sessions"),
        F.try_divide(F.count(F.lit(1)), sessions).alias("mean_session_length"),
        F.try_divide(F.sum("time"), sessions).alias("mean_session_time"),
        F.try_divide(F.sum("latency"), F.count(F.lit(1))).alias("mean_request_time"),
    )


def session_series(sessions: DataFrame, key: str = "treatment", ties: tuple = ("user",), slice_ms: int = HOUR_MS):
    """Sessions of each treatment in time order, numbered from 0."""
    numbered = number_rows(
        sessions, [key], ["timestamp", *ties], "_rn", slice_by=F.floor(F.col("timestamp") / slice_ms)
    )
    return numbered.withColumn("index", F.col("_rn") - 1).drop("_rn")
