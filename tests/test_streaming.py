from pyspark.sql import functions as F

from tastemill.operators import sessions as ss
from tastemill.session import scratch_path
from tastemill.streaming import streams as st

from test_sessions import LOG, random_log


def deliver(spark, rows, parts):
    path = scratch_path(spark, "delivery")
    rows = sorted(rows, key=lambda r: r[3])
    cuts = [rows[0][3] + (rows[-1][3] + 1 - rows[0][3]) * n // parts for n in range(parts + 1)]
    for low, high in zip(cuts, cuts[1:]):
        part = [r for r in rows if low <= r[3] < high]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").json(path)
    return st.stream_events(spark, path, schema=LOG, files_per_batch=1)


def test_stream_sessions_equal_batch_sessions(spark):
    rows = [(r[0], r[1], r[2], r[3] * 1000 + r[0], *r[4:]) for r in random_log(200, seed=7)]
    batch = ss.sessionize(spark.createDataFrame(rows, LOG)).select("user", "treatment", "timestamp", "tracks", F.round("time", 6))
    stream = st.to_table(st.stream_sessions(deliver(spark, rows, 3)), "sessions").where("closed")
    got = stream.select("user", "treatment", "timestamp", "tracks", F.round("time", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_open_session_is_emitted_after_the_timeout(spark):
    hour = 3_600_000
    rows = [
        (0, 1, "C", 10 * hour, "next", 1, 0.5, 0.1), (1, 2, "C", 20 * hour, "next", 1, 0.5, 0.1),
        (2, 3, "C", 30 * hour, "last", 1, 0.5, 0.1),
    ]
    stream = deliver(spark, rows, 3).withWatermark("at", "1 minute")
    got = st.to_table(st.stream_sessions(stream, "30 minutes"), "sessions").collect()
    closed = {(r["user"], r["closed"]) for r in got}
    assert (3, True) in closed and (1, False) in closed and (1, True) not in closed


def test_stream_history_is_the_newest_listens(spark):
    rows = [(r[0], r[1], r[2], r[3] * 1000 + r[0], *r[4:]) for r in random_log(150, seed=8)]
    updates = st.to_table(st.stream_history(deliver(spark, rows, 3), 4), "history")
    got = {r["user"]: r["tracks"] for r in st.latest_history(updates).collect()}
    for user in {r[1] for r in rows}:
        newest = sorted((r for r in rows if r[1] == user), key=lambda r: -r[3])[:4]
        assert got[user] == [r[5] for r in newest]


def test_a_rerun_batch_counts_once(spark):
    sessions = spark.createDataFrame([("C", 2, 1.0, 5.0), ("T1", 4, 2.0, 7.0)], "treatment string, tracks long, time double, latency double")
    live = st.StreamABStats(spark, scratch_path(spark, "live"))
    for batch in (0, 0, 1):
        live.add(sessions, batch)
    got = {(r["treatment"], r["metric"]): (r["n"], r["mean"], r["var"]) for r in live.stats().collect()}
    assert got["C", "tracks"] == (2, 2.0, 0.0) and got["T1", "time"] == (2, 2.0, 0.0)


def test_a_late_listen_gives_the_newer_list(spark):
    def row(e, at, track):
        return (e, 1, "C", at, "next", track, 0.5, 0.1)

    path = scratch_path(spark, "late")
    for batch in ([row(0, 1000, 3), row(1, 5000, 9), row(2, 3000, 5)], [row(3, 4000, 4)]):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").json(path)
    events = st.stream_events(spark, path, schema=LOG, files_per_batch=1)
    got = st.latest_history(st.to_table(st.stream_history(events, 3), "history")).first()
    assert got["tracks"] == [9, 4, 5]


def test_variance_of_large_close_values(spark):
    live = st.StreamABStats(spark, scratch_path(spark, "live"))
    values = [1e9 + x / 10 for x in range(10)]
    for batch, part in enumerate((values[:3], values[3:4], values[4:])):
        rows = [("C", 1, x, 0.0) for x in part]
        live.add(spark.createDataFrame(rows, "treatment string, tracks long, time double, latency double"), batch)
    got = {r["metric"]: r for r in live.stats().collect()}
    assert abs(got["time"]["var"] - 0.0916667) < 1e-5 and got["time"]["n"] == 10


def test_next_and_last_of_one_moment_are_two_events(spark):
    rows = [(0, 1, "C", 1000, "next", 2, 0.5, 0.1), (1, 1, "C", 1000, "last", 2, 0.5, 0.1), (2, 1, "C", 1000, "last", 2, 0.5, 0.1)]
    once = st.deduplicate(deliver(spark, rows, 1))
    assert st.to_table(once.select("user", "message"), "once").count() == 2


def test_treatments_of_one_user_are_kept_apart(spark):
    rows = [(0, 1, "C", 10_000, "next", 1, 0.5, 0.1), (1, 1, "T1", 11_000, "next", 2, 0.25, 0.1), (2, 1, None, 11_500, "next", 2, 1.0, 0.1),
            (3, 1, "C", 12_000, "last", 1, 0.5, 0.1), (4, 1, "T1", 90_000, "last", 3, 0.25, 0.1), (5, 1, None, 95_000, "last", 3, 1.0, 0.1)]
    got = st.to_table(st.stream_sessions(deliver(spark, rows, 2)), "sessions").collect()
    assert sorted((r["treatment"] or "", r["timestamp"], r["tracks"], r["time"], r["closed"]) for r in got) == [
        ("", 11_500, 2, 2.0, True), ("C", 10_000, 2, 1.0, True), ("T1", 11_000, 2, 0.5, True)]


def test_a_pause_ends_a_session_whatever_the_batches(spark):
    minute = 60_000
    at = [0, 10, 50, 55, 120, 121]
    rows = [(n, 7, "C", 600 * minute + m * minute, "last" if m == 55 else "next", 1, 0.5, 0.0) for n, m in enumerate(at)]
    rows.append((99, 8, "C", 5000 * minute, "last", 1, 0.5, 0.0))
    for parts in (1, 2, 400):
        stream = deliver_each(spark, rows, parts).withWatermark("at", "1 minute")
        got = st.to_table(st.stream_sessions(stream, "30 minutes"), "sessions").collect()
        found = sorted((r["timestamp"] // minute - 600, r["tracks"], r["closed"]) for r in got if r["user"] == 7)
        assert found == [(0, 2, False), (50, 2, True), (120, 2, False)], parts


def deliver_each(spark, rows, parts):
    """At most ``parts`` files with rows in time order, then one with the newest row alone."""
    path = scratch_path(spark, "delivery")
    rows = sorted(rows, key=lambda r: r[3])
    early, size = rows[:-1], -(-(len(rows) - 1) // parts)
    for part in [early[i : i + size] for i in range(0, len(early), size)] + [rows[-1:]]:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").json(path)
    return st.stream_events(spark, path, schema=LOG, files_per_batch=1)


def test_users_of_a_bucket_share_a_call_and_keep_their_sessions(spark):
    rows = [(r[0], r[1], r[2], r[3] * 1000 + r[0], *r[4:]) for r in random_log(300, seed=9)]
    rows += [(1000 + n, user, arm, 10 * 3_600_000 + n, "next", 1, 0.5, 0.1) for n, (user, arm) in enumerate([(None, "C"), (0, ""), (0, None), ((1 << 62) + 1, "C")])]

    def found(buckets):
        stream = deliver(spark, rows, 3).withWatermark("at", "1 minute")
        got = st.to_table(st.stream_sessions(stream, "30 minutes", buckets), f"sessions-{buckets}").collect()
        return sorted(((r["user"], r["treatment"], r["timestamp"], r["tracks"], round(r["time"], 6), round(r["latency"], 6), r["closed"]) for r in got), key=str)

    assert found(2) == found(1000) and found(2)
