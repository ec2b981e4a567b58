"""The same analyses on Structured Streaming sources.

Events are keyed by user or, for sessions, by a bucket of users; state per user is bounded (ten listens, or one open session). Outputs are append-only tables,
so that a restarted query continues from its checkpoint without double counting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.experiments import ab_effects
from ..operators.ordering import join_nullsafe
from ..operators.sessions import TIES
from ..session import scratch_path
from ..sources.schemas import EVENTS

HISTORY = "user long, version long, at long, tracks array<long>, times array<double>"
HISTORY_STATE = "version long, at array<long>, tracks array<long>, times array<double>"
SESSION = "user long, treatment string, timestamp long, tracks long, time double, latency double, closed boolean"
SESSION_STATE = """user array<long>, known array<boolean>, treatment array<string>, treated array<boolean>,
  timestamp array<long>, last array<long>, tracks array<long>, time array<double>, latency array<double>"""
#: Groups of users whose open sessions make one state.
BUCKETS = 512


def stream_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """Log files appended or rotated by the event logger, as a stream with the event time ``at``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("at", F.timestamp_millis("timestamp"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; files are committed once per batch."""
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to the end of the available input and read the table it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    run_available(stream, f"{path}/data", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Update-mode stream whose batches go to ``merge(batch, batch_id)``; merge must replace what a rerun of the same
    batch wrote before."""
    (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
        .awaitTermination()
    )


def newest(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    return pdf.sort_values(["user", "timestamp", "track"]).groupby("user", sort=False).tail(n)


def stream_history(events: DataFrame, n: int = 10) -> DataFrame:
    """Newest n listens per user: one row per user and batch with the list after the batch, newest first, and its version.

    Each Arrow batch first drops what cannot be among its users' newest n, so a busy user sends n rows per batch to the
    state, not all events.
    """

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield newest(pdf, n)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, *lists = state.get if state.exists else (0, [], [], [])
        at, tracks, times = map(list, lists)
        kept = pd.DataFrame({"user": key[0], "timestamp": at, "track": tracks, "time": times})
        for pdf in batches:
            kept = newest(pd.concat([kept, pdf]) if len(kept) else pdf, n)
        kept = kept.iloc[::-1]
        lists = [kept[c].tolist() for c in ("timestamp", "track", "time")]
        state.update((version + 1, *lists))
        yield pd.DataFrame(
            {"user": [key[0]], "version": [version + 1], "at": [max(lists[0])], "tracks": [lists[1]], "times": [lists[2]]}
        )

    slim = events.select("user", "timestamp", "track", "time")
    trimmed = slim.mapInPandas(trim, "user long, timestamp long, track long, time double")
    return trimmed.groupBy("user").applyInPandasWithState(update, HISTORY, HISTORY_STATE, "append", GroupStateTimeout.NoTimeout)


def latest_history(updates: DataFrame) -> DataFrame:
    """Current list per user out of the update rows."""
    return updates.groupBy("user").agg(F.max_by(F.struct("tracks", "times"), "version").alias("_h")).select("user", "_h.*")


def stream_sessions(events: DataFrame, timeout: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Sessions of each user and treatment, closed by the 'last' marker and emitted as soon as they close.

    ``events`` has user, treatment, timestamp, message, time, latency and, for a timeout, the watermarked ``at``. Events
    of a user must not arrive later than a batch that holds newer ones; inside a batch they are put in time order. With
    ``timeout`` (such as '30 minutes') a pause longer than that of event time ends a session as not closed: when the next
    event shows it, or when the watermark has passed it, whatever batches the events came in.

    Users are dealt into ``buckets``; a bucket's state is its open sessions, and a call works on the rows of all its users at
    once. A stream goes on with the number of buckets it began with. Of a bucket's rows in a micro-batch a few numbers each
    are held while they are sorted; ``files_per_batch`` bounds them.
    """
    idle = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)
    numbers = ["timestamp", "last", "tracks", "time", "latency"]
    keys = ["user", "known", "treatment", "treated"]

    def closed_rows(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["timestamp", "tracks", "time", "latency", "closed"]].astype({"timestamp": "int64", "tracks": "int64", "closed": bool})
        out.insert(0, "user", rows["user"].astype("Int64").where(rows["known"].astype(bool)))
        out.insert(1, "treatment", rows["treatment"].astype(object).where(rows["treated"].astype(bool), None))
        return out

    def keep(held: pd.DataFrame, state: GroupState) -> None:
        if not len(held):
            if state.exists:
                state.remove()
            return
        state.update(tuple(held[c].tolist() for c in (*keys, *numbers)))
        if idle is not None:
            state.setTimeoutTimestamp(max(int(held["last"].min()) + idle, state.getCurrentWatermarkMs() + 1))

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = dict(zip((*keys, *numbers), state.get if state.exists or state.hasTimedOut else [[]] * 9, strict=True))
        held = pd.DataFrame(before).astype({"known": bool, "treated": bool, "time": float, "latency": float} | dict.fromkeys(("user", "timestamp", "last", "tracks"), "int64"))
        out = []
        parts = [] if state.hasTimedOut else list(batches)
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            both = pd.concat([held[keys], rows[keys]], ignore_index=True)
            code = both.groupby(keys, sort=False).ngroup().to_numpy()
            mine, code = code[: len(held)], code[len(held) :]
            order = np.lexsort([*(pd.factorize(rows[t], sort=True)[0] for t in reversed(TIES)), rows["timestamp"].to_numpy(), code])
            rows, code = rows.iloc[order], code[order]
            at, last = rows["timestamp"].to_numpy(), rows["message"].to_numpy() == "last"
            fresh = np.r_[True, code[1:] != code[:-1]]
            pause = np.zeros(len(at), bool) if idle is None else np.r_[False, np.diff(at) > idle]
            begin = np.flatnonzero(fresh | np.r_[True, last[:-1]] | pause)
            ends = np.r_[begin[1:], len(at)] - 1
            found = rows[keys].iloc[begin].reset_index(drop=True)
            found["timestamp"], found["last"], found["tracks"] = at[begin], at[ends], np.diff(np.r_[begin, len(at)])
            found["time"] = np.add.reduceat(rows["time"].to_numpy(), begin)
            found["latency"] = np.add.reduceat(rows["latency"].to_numpy(), begin) * 1000
            found["closed"] = last[ends]
            # an open session goes on in the first one of its key, unless the pause between them was too long
            first = np.full(max(mine.max(initial=-1), code.max()) + 1, -1)
            first[code[np.flatnonzero(fresh)]] = np.searchsorted(begin, np.flatnonzero(fresh))
            to = first[mine]
            met = to >= 0
            over = met & False if idle is None else met & (found["timestamp"].to_numpy()[to] - held["last"].to_numpy() > idle)
            out.append(held[over].assign(closed=False))
            goes = met & ~over
            found.loc[to[goes], "timestamp"] = held["timestamp"].to_numpy()[goes]
            for name in ("tracks", "time", "latency"):
                found.loc[to[goes], name] += held[name].to_numpy()[goes]
            # the newest session of a key stays open unless the marker ended it
            newest = np.r_[code[begin][1:] != code[begin][:-1], True] & ~found["closed"].to_numpy()
            out.append(found[~newest])
            held = pd.concat([held[~met], found.loc[newest, [*keys, *numbers]]], ignore_index=True)
            untouched = np.arange(len(held)) < (~met).sum()
        else:
            untouched = np.ones(len(held), bool)
        if idle is not None:
            late = untouched & (held["last"].to_numpy() + idle < state.getCurrentWatermarkMs())
            out.append(held[late].assign(closed=False))
            held = held[~late]
        keep(held, state)
        out = [x for x in out if len(x)]
        if out:
            yield closed_rows(pd.concat(out, ignore_index=True))

    mode = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.EventTimeTimeout
    given = events.select(
        F.pmod(F.xxhash64("user", "treatment"), F.lit(buckets)).cast("int").alias("bucket"),
        F.coalesce("user", F.lit(0)).cast("long").alias("user"), F.col("user").isNotNull().alias("known"),
        F.coalesce("treatment", F.lit("")).alias("treatment"), F.col("treatment").isNotNull().alias("treated"),
        "timestamp", "message", "track", "time", "latency", *(["at"] if timeout is not None else []),
    )
    return given.groupBy("bucket").applyInPandasWithState(update, SESSION, SESSION_STATE, "append", mode)


class StreamABStats:
    """Running moments per treatment and metric, for a live effects table.

    Every batch adds one small file of counts, means and squared deviations (M2) under its batch number and replaces it
    when the batch is run again.
    """

    METRICS = ("tracks", "time", "latency")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, sessions: DataFrame, batch_id: int) -> None:
        values = F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in self.METRICS])
        )
        moments = (
            sessions.select("treatment", values.alias("v"))
            .groupBy("treatment", F.col("v.metric").alias("metric"))
            .agg(F.count("v.x").alias("n"), F.avg("v.x").alias("mean"), (F.var_pop("v.x") * F.count("v.x")).alias("m2"))
        )
        moments.write.mode("overwrite").parquet(f"{self.path}/moments/batch={batch_id}")

    def stats(self) -> DataFrame:
        """(treatment, metric, n, mean, var) over all batches so far. Deviations of the batches' means are added to those
        inside the batches, so that nothing large is subtracted."""
        key = ["treatment", "metric"]
        rows = self.spark.read.parquet(f"{self.path}/moments").filter("n > 0")
        total = rows.groupBy(*key).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
        apart = F.col("mean") - F.col("_mean")
        joined = join_nullsafe(rows, total, key, "inner").groupBy(*key)
        sums = joined.agg(
            F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("_m2")
        )
        return sums.select(*key, "n", "mean", F.try_divide(F.col("_m2"), F.col("n") - 1).alias("var"))

    def effects(self, alpha: float = 0.05) -> DataFrame:
        return ab_effects(self.stats(), alpha)


def run_ab_stats(sessions: DataFrame, path: str) -> StreamABStats:
    live = StreamABStats(sessions.sparkSession, path)
    (
        sessions.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(live.add)
        .start()
        .awaitTermination()
    )
    return live


def stream_popularity(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Plays and played time per track and window; a window is emitted once the watermark has passed it."""
    span = F.window("at", window, slide) if slide else F.window("at", window)
    return (
        events.withWatermark("at", delay)
        .groupBy(span.alias("w"), "track")
        .agg(F.count(F.lit(1)).alias("plays"), F.sum("time").alias("popularity"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "track", "plays", "popularity")
    )


def stream_recommend(events: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any serving rule made of joins with static tables works on a stream of events unchanged."""
    return rule(events)


def deduplicate(events: DataFrame, delay: str = "10 minutes", keys: tuple = ("user", "timestamp", "message", "track")) -> DataFrame:
    """Drop events delivered twice within the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(list(keys))
