import random

import pytest
from pyspark.sql import functions as F

from tastemill.operators import experiments as ex
from tastemill.operators import ordering as od
from tastemill.operators import sessions as ss

LOG = "event_id long, user long, treatment string, timestamp long, message string, track long, time double, latency double"


def random_log(n=400, hot=0.4, span=2000, seed=1):
    rng = random.Random(seed)
    rows = []
    for e in range(n):
        user = 0 if rng.random() < hot else rng.randint(1, 12)
        message = "last" if rng.random() < (0.03 if user == 0 else 0.3) else "next"
        rows.append((e, user, "C" if user % 2 else "T1", rng.randrange(span), message, rng.randrange(9), rng.randrange(100) / 100, rng.randrange(50) / 1000))
    return rows


def walk(rows, keep_open=False):
    """The definition, one event at a time."""
    out, by_user = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[4], r[6], r[5])):
        by_user.setdefault((r[1], r[2]), []).append(r)
    for (user, treatment), events in by_user.items():
        open_ = []
        for r in events:
            open_.append(r)
            if r[4] == "last":
                out.append((user, treatment, open_))
                open_ = []
        if open_ and keep_open:
            out.append((user, treatment, open_))
    return out


@pytest.mark.parametrize("slice_ms", [1, 7, 100, 10_000])
@pytest.mark.parametrize("keep_open", [False, True])
def test_sessions_equal_a_plain_walk_at_any_slice_width(spark, slice_ms, keep_open):
    rows = random_log()
    got = ss.sessionize(spark.createDataFrame(rows, LOG), slice_ms=slice_ms, keep_open=keep_open)
    want = sorted((u, t, s[0][3], len(s), round(sum(r[6] for r in s), 6), round(sum(r[7] * 1000 for r in s), 6)) for u, t, s in walk(rows, keep_open))
    assert sorted((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 6)) for r in got.collect()) == want


@pytest.mark.parametrize("slice_ms", [1, 50, 10_000])
def test_starts_and_pairs_equal_a_plain_walk(spark, slice_ms):
    rows = [(*r[:2], "C", *r[3:]) for r in random_log(seed=2)]
    df = spark.createDataFrame(rows, LOG)
    sessions = walk(rows, keep_open=True)
    starts = ss.session_starts(df, slice_ms=slice_ms).select("event_id").collect()
    assert sorted(r[0] for r in starts) == sorted(s[0][0] for _, _, s in sessions)
    pairs = ss.start_pairs(df, slice_ms=slice_ms).collect()
    assert sorted(tuple(r) for r in pairs) == sorted((u, s[0][5], r[5], r[6]) for u, _, s in sessions for r in s[1:])


def test_hand_cases(spark):
    rows = [
        (0, 1, "C", 10, "last", 1, 0.5, 0.1), (1, 1, "C", 20, "last", 2, 1.0, 0.2),  # two sessions of one event
        (2, 2, "C", 10, "next", 1, 0.5, 0.1),  # never closed
        (3, 3, None, 10, "next", 1, 0.5, 0.1), (4, 3, None, 10, "last", 1, 0.25, 0.1),  # no treatment; of equal times 'last' comes first
    ]
    df = spark.createDataFrame(rows, LOG)
    got = sorted(ss.sessionize(df).collect(), key=lambda r: (r["user"], r["timestamp"]))
    assert [(r["user"], r["treatment"], r["tracks"]) for r in got] == [(1, "C", 1), (1, "C", 1), (3, None, 1)]
    users = {r["user"]: r for r in ss.user_metrics_log(df).collect()}
    assert users[2]["sessions"] == 0 and users[2]["mean_session_length"] is None


def test_session_totals_equal_event_totals(spark):
    rows = random_log(seed=3)
    total = ss.sessionize(spark.createDataFrame(rows, LOG), keep_open=True, slice_ms=20).agg(F.sum("tracks"), F.sum("time")).first()
    assert total[0] == len(rows) and total[1] == pytest.approx(sum(r[6] for r in rows))


def test_welch_effect_by_hand(spark):
    users = [("C", float(x)) for x in (1, 2, 3, 4)] + [("T1", float(x)) for x in (3, 4, 5, 9)]
    stats = ex.treatment_stats(spark.createDataFrame(users, "treatment string, m double"), ["m"])
    r = ex.ab_effects(stats).first()
    a = (5 / 3) / 4
    b = (((3 - 5.25) ** 2 + (4 - 5.25) ** 2 + (5 - 5.25) ** 2 + (9 - 5.25) ** 2) / 3) / 4
    dof = (a + b) ** 2 / (a * a / 3 + b * b / 3)
    assert r["effect"] == pytest.approx((5.25 - 2.5) / 2.5 * 100)
    assert r["se"] == pytest.approx((a + b) ** 0.5) and r["dof"] == pytest.approx(dof)
    half = (r["upper"] - r["lower"]) / 2 / 100 * 2.5
    assert half > 2 * r["se"]
    assert r["significant"] == (r["lower"] > 0 or r["upper"] < 0)


def test_one_user_per_arm_has_no_interval(spark):
    stats = ex.treatment_stats(spark.createDataFrame([("C", 1.0), ("T1", 2.0)], "treatment string, m double"), ["m"])
    r = ex.ab_effects(stats).first()
    assert r["effect"] == 100.0 and r["lower"] is None and r["significant"] is None


def test_aa_split_finds_few_effects(spark):
    """About alpha of the comparisons of equal groups are significant."""
    users = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("m"))

    parts = None
    for n in range(40):
        arm = users.select(ex.assign("id", f"AA{n}", 2).alias("treatment"), "m")
        stats = ex.treatment_stats(arm, ["m"]).withColumn("metric", F.lit(str(n)))
        parts = stats if parts is None else parts.unionByName(stats)
    found = ex.ab_effects(parts).where("significant").count()
    assert found <= 6


def test_row_numbers_both_ways(spark):
    rows = random_log(seed=4)
    df = spark.createDataFrame(rows, LOG).select("event_id", "user", "timestamp")
    want = {}
    for user in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0])), 1):
            want[r[0]] = n
    for slices in (None, F.floor(F.col("timestamp") / 13)):
        got = od.number_rows(df, ["user"], ["timestamp", "event_id"], slice_by=slices)
        assert {r["event_id"]: r["rn"] for r in got.collect()} == want
    whole = od.number_rows(df, [], ["timestamp", "event_id"]).orderBy("rn").collect()
    assert [r["rn"] for r in whole] == list(range(1, len(rows) + 1))
    assert [(r["timestamp"], r["event_id"]) for r in whole] == sorted((r[3], r[0]) for r in rows)


def test_history_across_blocks(spark):
    rows = random_log(seed=5)
    df = spark.createDataFrame(rows, LOG)
    got = {r["event_id"]: [(h[0], h[1]) for h in r["history"]] for r in od.recent_history(df, 4, ties=("event_id",), block=6).collect()}
    for user in {r[1] for r in rows}:
        events = sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0]))
        for n, r in enumerate(events):
            assert got[r[0]] == [(x[5], x[6]) for x in reversed(events[max(0, n - 3) : n + 1])]


def test_early_stop_and_rolling(spark):
    curve = spark.createDataFrame([(n, v) for n, v in enumerate([0.1, 0.3, 0.5, 0.6, 0.6, 0.59, 0.6, 0.7])], "epoch long, value double")
    assert od.early_stop_epoch(curve, 3, 1e-6).first()[0] == 6
    rolled = {r["epoch"]: r["rolling"] for r in od.rolling_mean(curve, ["epoch"], "value", 3).collect()}
    assert rolled[0] is None and rolled[7] is None and rolled[1] == pytest.approx(0.3)


def test_cuped_lowers_the_variance(spark):
    users = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), F.pmod(F.xxhash64("id"), F.lit(10)).cast("double").alias("e"))
    users = users.withColumn("y", F.col("x") * 2 + F.col("e"))
    before, after = ex.cuped(users, "y", "x").agg(F.var_samp("y"), F.var_samp("adjusted")).first()
    assert after < before / 20
