"""Queries over the event log: sessions, experiments, history."""

from pyspark.sql import functions as F

from ..functions.hashing import murmur3_32
from ..operators import experiments as ex
from ..operators import ordering as od
from ..operators import sessions as ss
from ..session import scratch_path
from ..sources import readers as rd
from .domain import ab_log, catalog, interactions, log, per_user
from .registry import query
from .sqlparts import (
    CATALOG, INTER, LOG, SESSIONS, TREATED, USERS, arms, ctes, murmur_sql, assign_sql,
)

I2I = arms("I2I", 3)
AA = arms("AA", 2)


def treated(spark, sf, experiment="I2I", ways=3):
    return per_user(log(spark, sf), "treatment", ex.assign("user", experiment, ways))


def rounded(df, *columns, digits=6):
    return df.select(
        *[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


SESSION_SQL = ctes(LOG, I2I, TREATED, SESSIONS)


@query(
    "x1_sessionize",
    SESSION_SQL + """SELECT "user", treatment, "timestamp", tracks, round("time", 6) AS "time", round(latency, 6) AS latency
FROM sessions""",
)
def x1_sessionize(spark, sf):
    return rounded(ss.sessionize(treated(spark, sf)), "time", "latency")


@query(
    "x1_sessionize_last_stamp",
    SESSION_SQL + """SELECT "user", treatment, last_ts AS "timestamp", tracks, round("time", 6) AS "time",
  round(latency, 6) AS latency FROM sessions""",
)
def x1_last(spark, sf):
    return rounded(ss.sessionize(treated(spark, sf), stamp="last"), "time", "latency")


@query(
    "x2_user_metrics",
    ctes(LOG, I2I, TREATED, SESSIONS, USERS) + """SELECT "user", treatment, sessions, tracks, round("time", 6) AS "time",
  round(latency, 6) AS latency, round(mean_request_latency, 6) AS mean_request_latency,
  round(mean_tracks_per_session, 6) AS mean_tracks_per_session, round(mean_time_per_session, 6) AS mean_time_per_session
FROM users""",
)
def x2_user_metrics(spark, sf):
    users = ss.user_level_metrics(ss.sessionize(treated(spark, sf)))
    return rounded(
        users, "time", "latency", "mean_request_latency", "mean_tracks_per_session", "mean_time_per_session"
    )


@query(
    "x3_assign",
    f"""SELECT user_id AS "user", CAST({murmur_sql("CAST(user_id AS VARCHAR)", 0)} AS BIGINT) AS hash0,
  {assign_sql("user_id", "I2I", 3)} AS i2i, {assign_sql("user_id", "STICKY_ARTIST", 2)} AS sticky
FROM (SELECT DISTINCT user_id FROM events)""",
)
def x3_assign(spark, sf):
    users = log(spark, sf).select("user").distinct()
    return users.select(
        "user",
        murmur3_32("user").alias("hash0"),
        ex.assign("user", "I2I", 3).alias("i2i"),
        ex.assign("user", "STICKY_ARTIST", 2).alias("sticky"),
    )


STATS_SQL = """stats AS (
  SELECT treatment, 'time' AS metric, count("time") AS n, avg("time") AS mean, var_samp("time") AS var FROM users GROUP BY 1
  UNION ALL SELECT treatment, 'sessions', count(sessions), avg(sessions), var_samp(sessions) FROM users GROUP BY 1
  UNION ALL SELECT treatment, 'mean_request_latency', count(mean_request_latency), avg(mean_request_latency),
    var_samp(mean_request_latency) FROM users GROUP BY 1
  UNION ALL SELECT treatment, 'mean_tracks_per_session', count(mean_tracks_per_session), avg(mean_tracks_per_session),
    var_samp(mean_tracks_per_session) FROM users GROUP BY 1
  UNION ALL SELECT treatment, 'mean_time_per_session', count(mean_time_per_session), avg(mean_time_per_session),
    var_samp(mean_time_per_session) FROM users GROUP BY 1)"""


#: 0.975 quantile of Student's t: the normal quantile and five terms of the series in 1 / dof; below, one Newton step with the
#: density integrated by Simpson's rule makes it exact.
T975 = "+".join(
    ["z", "(z**3+z)/(4*dof)", "(5*z**5+16*z**3+3*z)/(96*dof**2)", "(3*z**7+19*z**5+17*z**3-15*z)/(384*dof**3)",
     "(79*z**9+776*z**7+1482*z**5-1920*z**3-945*z)/(92160*dof**4)",
     "(27*z**11+339*z**9+930*z**7-1782*z**5-765*z**3+17955*z)/(368640*dof**5)"]
)
EFFECTS_SQL = f""", pieces AS (
  SELECT 1.959963984540054::DOUBLE AS z, t.treatment, t.metric, c.mean AS control_mean, t.mean AS treatment_mean, t.mean - c.mean AS d, sqrt(c.var / c.n + t.var / t.n) AS se,
    (c.var / c.n + t.var / t.n) ** 2 / ((c.var / c.n) ** 2 / (c.n - 1) + (t.var / t.n) ** 2 / (t.n - 1)) AS dof
  FROM stats t JOIN stats c ON t.metric = c.metric WHERE c.treatment = 'C' AND t.treatment <> 'C'),
start_ AS (SELECT *, {T975} AS t, exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi() * dof) AS c FROM pieces),
area AS (SELECT *, c * t / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1
  WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 + (t * i / 2000) ** 2 / dof) ** (-(dof + 1) / 2))) AS below FROM start_),
halves AS (SELECT *, (t - (below - 0.475) / (c * (1 + t * t / dof) ** (-(dof + 1) / 2))) * se AS half FROM area)
SELECT treatment, metric, round(control_mean, 6) AS control_mean, round(treatment_mean, 6) AS treatment_mean,
  round(d / control_mean * 100, 6) AS effect, round((d - half) / control_mean * 100, 3) AS lower,
  round((d + half) / control_mean * 100, 3) AS upper, round(se, 6) AS se, round(dof, 4) AS dof, abs(d) > half AS significant FROM halves"""


def effects_sql(*views: str) -> str:
    return ctes(*views, STATS_SQL) + EFFECTS_SQL


def user_stats(spark, sf, experiment, ways):
    return ex.treatment_stats(ss.user_level_metrics(ss.sessionize(treated(spark, sf, experiment, ways))))


def plain_effects(effects):
    cols = rounded(effects, "control_mean", "treatment_mean", "effect", "se")
    return rounded(rounded(cols, "lower", "upper", digits=3), "dof", digits=4)


@query("x4_ab_effects", effects_sql(LOG, I2I, TREATED, SESSIONS, USERS))
def x4_ab_effects(spark, sf):
    return plain_effects(ex.ab_effects(user_stats(spark, sf, "I2I", 3)))


@query("x5_aa_effects", effects_sql(LOG, AA, TREATED, SESSIONS, USERS))
def x5_aa(spark, sf):
    return plain_effects(ex.ab_effects(user_stats(spark, sf, "AA", 2)))


@query(
    "x6_same_artist_share",
    ctes(LOG, I2I, TREATED, CATALOG) + """SELECT round(avg(CASE WHEN p.artist = r.artist THEN 1.0 ELSE 0.0 END), 6) AS share
FROM tlog LEFT JOIN catalog p ON tlog.track = p.track LEFT JOIN catalog r ON tlog.recommendation = r.track
WHERE message = 'next' AND treatment <> 'C'""",
)
def x6_same_artist(spark, sf):
    return rounded(ex.same_attr_share(treated(spark, sf), catalog(spark, sf)), "share")


@query(
    "x7_repeat_plays",
    ctes(LOG) + """SELECT "user", count(*) - count(DISTINCT track) AS repeats FROM log WHERE message = 'next' GROUP BY 1""",
)
def x7_repeats(spark, sf):
    return ex.repeat_plays(log(spark, sf))


@query(
    "x7_mean_repeats",
    ctes(LOG) + """SELECT round(avg(repeats), 6) AS mean_repeats FROM (
  SELECT "user", count(*) - count(DISTINCT track) AS repeats FROM log WHERE message = 'next' GROUP BY 1)""",
)
def x7_mean(spark, sf):
    return rounded(ex.mean_repeats(log(spark, sf)), "mean_repeats")


@query(
    "x8_session_series",
    SESSION_SQL + """SELECT treatment, "user", "timestamp", tracks,
  row_number() OVER (PARTITION BY treatment ORDER BY "timestamp", "user") - 1 AS index FROM sessions""",
)
def x8_series(spark, sf):
    return ss.session_series(ss.sessionize(treated(spark, sf))).select(
        "treatment", "user", "timestamp", "tracks", "index"
    )


STARTS = """marked AS (
  SELECT *, lag(message) OVER (PARTITION BY "user" ORDER BY "timestamp", message, "time", track) AS before,
    coalesce(sum(CASE WHEN message = 'last' THEN 1 ELSE 0 END) OVER (PARTITION BY "user"
      ORDER BY "timestamp", message, "time", track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM log)"""


@query(
    "x9_session_starts",
    ctes(LOG, STARTS) + """SELECT event_id, "user", track, "timestamp" FROM marked WHERE before IS NULL OR before = 'last'""",
)
def x9_starts(spark, sf):
    return ss.session_starts(log(spark, sf)).select("event_id", "user", "track", "timestamp")


PAIRS_SQL = """start_pairs AS (
  SELECT "user", start, track, "time" FROM (
    SELECT *, first_value(track) OVER w AS start, row_number() OVER w AS place FROM marked
    WINDOW w AS (PARTITION BY "user", sid ORDER BY "timestamp", message, "time", track)) WHERE place > 1)"""


@query(
    "x10_start_pairs",
    ctes(LOG, STARTS, PAIRS_SQL) + """SELECT "user", start, track, round("time", 6) AS "time" FROM start_pairs""",
)
def x10_pairs(spark, sf):
    return rounded(ss.start_pairs(log(spark, sf)), "time")


@query("x11_effects_report", effects_sql(LOG, I2I, TREATED, SESSIONS, USERS))
def x11_report(spark, sf):
    """The whole analysis: JSON log, treatment out of the log's map, sessions, user metrics, effects, ranked report."""
    path = scratch_path(spark, "ab-log")
    ab_log(spark, sf).drop("event_id").write.json(path)
    events = ex.treatment_of(rd.read_events(spark, path), "I2I")
    users = ss.user_level_metrics(ss.sessionize(events))
    return ex.effects_report(plain_effects(ex.ab_effects(ex.treatment_stats(users))))


@query(
    "a4_user_metrics_log",
    ctes(LOG, I2I, TREATED) + """SELECT "user", treatment, count(CASE WHEN message = 'last' THEN 1 END) AS sessions,
  round(count(*) / nullif(count(CASE WHEN message = 'last' THEN 1 END), 0), 6) AS mean_session_length,
  round(sum("time") / nullif(count(CASE WHEN message = 'last' THEN 1 END), 0), 6) AS mean_session_time,
  round(sum(latency) / count(*), 6) AS mean_request_time FROM tlog GROUP BY 1, 2""",
)
def a4_log(spark, sf):
    return rounded(
        ss.user_metrics_log(treated(spark, sf)), "mean_session_length", "mean_session_time", "mean_request_time"
    )


@query(
    "a5_treatment_stats",
    ctes(LOG, I2I, TREATED, SESSIONS, USERS, STATS_SQL)
    + """SELECT treatment, metric, n, round(mean, 6) AS mean, round(var, 6) AS var FROM stats""",
)
def a5_stats(spark, sf):
    return rounded(user_stats(spark, sf, "I2I", 3), "mean", "var")


@query(
    "p5_treatment_counts",
    ctes(LOG, AA, TREATED) + """SELECT treatment, count(*) AS events FROM tlog GROUP BY 1""",
)
def p5_treatment(spark, sf):
    return ex.treatment_of(ab_log(spark, sf), "AA").groupBy("treatment").agg(F.count(F.lit(1)).alias("events"))


@query(
    "l19_cuped",
    ctes(LOG, I2I, TREATED) + """, cut AS (SELECT (min("timestamp") + max("timestamp")) / 2 AS cut_at FROM log), halves AS (
  SELECT "user", treatment, coalesce(sum("time") FILTER ("timestamp" >= cut_at), 0) AS after,
    coalesce(sum("time") FILTER ("timestamp" < cut_at), 0) AS before FROM tlog, cut GROUP BY 1, 2),
fit AS (SELECT covar_samp(after, before) / var_samp(before) AS theta, avg(before) AS mean FROM halves)
SELECT treatment, count(*) AS n, round(avg(after - theta * (before - mean)), 6) AS mean,
  round(var_samp(after - theta * (before - mean)), 6) AS var FROM halves, fit GROUP BY 1""",
)
def l19_cuped(spark, sf):
    events = treated(spark, sf)
    middle = events.agg(((F.min("timestamp") + F.max("timestamp")) / 2).alias("at")).scalar()
    halves = (
        events.withColumn("_late", F.col("timestamp") >= middle)
        .groupBy("user", "treatment")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_late"), F.col("time"))), F.lit(0.0)).alias("after"),
            F.coalesce(F.sum(F.when(~F.col("_late"), F.col("time"))), F.lit(0.0)).alias("before"),
        )
    )
    adjusted = ex.cuped(halves, "after", "before")
    return adjusted.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("adjusted"), 6).alias("mean"),
        F.round(F.var_samp("adjusted"), 6).alias("var"),
    )


@query(
    "l19_diff_in_diff",
    ctes(LOG, I2I, TREATED) + """, cut AS (SELECT (min("timestamp") + max("timestamp")) / 2 AS cut_at FROM log), halves AS (
  SELECT "user", treatment, coalesce(sum("time") FILTER ("timestamp" >= cut_at), 0)
    - coalesce(sum("time") FILTER ("timestamp" < cut_at), 0) AS change FROM tlog, cut GROUP BY 1, 2)
SELECT treatment, 'change' AS metric, count(*) AS n, round(avg(change), 6) AS mean, round(var_samp(change), 6) AS var
FROM halves GROUP BY 1""",
)
def l19_did(spark, sf):
    events = treated(spark, sf)
    middle = events.agg(((F.min("timestamp") + F.max("timestamp")) / 2).alias("at")).scalar()
    late = F.col("timestamp") >= middle
    halves = events.groupBy("user", "treatment").agg(
        F.coalesce(F.sum(F.when(late, F.col("time"))), F.lit(0.0)).alias("after"),
        F.coalesce(F.sum(F.when(~late, F.col("time"))), F.lit(0.0)).alias("before"),
    )
    return rounded(ex.diff_in_diff(halves, "before", "after"), "mean", "var")


@query(
    "p6_inspect_users",
    ctes(LOG, I2I, TREATED) + """SELECT "user", event_id, track, message FROM tlog WHERE treatment = 'T1' AND "time" > 0.75""",
)
def p6_inspect(spark, sf):
    from ..operators.selects import inspect

    return inspect(treated(spark, sf), (F.col("treatment") == "T1") & (F.col("time") > 0.75)).select(
        "user", "event_id", "track", "message"
    )


@query("p8_next_events", ctes(LOG) + "SELECT event_id, track, recommendation FROM log WHERE message = 'next'")
def p8_next(spark, sf):
    from ..operators.selects import next_events

    return next_events(log(spark, sf)).select("event_id", "track", "recommendation")


@query(
    "w1_rank_latest",
    ctes(INTER) + """SELECT "user", track, "timestamp",
  row_number() OVER (PARTITION BY "user" ORDER BY "timestamp" DESC, "row") AS rank_latest FROM inter""",
)
def w1_rank(spark, sf):
    return od.rank_latest(interactions(spark, sf), ties=("row",)).select("user", "track", "timestamp", "rank_latest")


LOO = """SELECT "user", track, "timestamp" FROM (SELECT *,
  row_number() OVER (PARTITION BY "user" ORDER BY "timestamp" DESC, "row") AS rn FROM inter) WHERE rn"""


@query("w2_leave_last_out_test", ctes(INTER) + LOO + " <= 1")
def w2_test(spark, sf):
    return od.leave_last_out(interactions(spark, sf), 1, ties=("row",))[1].select("user", "track", "timestamp")


@query("w2_leave_last_out_train", ctes(INTER) + LOO + " > 1")
def w2_train(spark, sf):
    return od.leave_last_out(interactions(spark, sf), 1, ties=("row",))[0].select("user", "track", "timestamp")


@query(
    "w3_normalize_l2",
    ctes(INTER) + """, pairs AS (SELECT "user", track, avg("time") AS t FROM inter GROUP BY 1, 2)
SELECT "user", track, round(t / sqrt(sum(t * t) OVER (PARTITION BY "user")), 6) AS norm FROM pairs""",
)
def w3_l2(spark, sf):
    from ..operators.aggregates import aggregate_interactions

    pairs = aggregate_interactions(interactions(spark, sf))
    return rounded(od.normalize_by(pairs, "user", "time", "l2", "norm").select("user", "track", "norm"), "norm")


@query(
    "w3_normalize_center",
    ctes(INTER) + """SELECT "row", round("time" - avg("time") OVER (PARTITION BY "user"), 8) AS centred FROM inter""",
)
def w3_center(spark, sf):
    return rounded(
        od.normalize_by(interactions(spark, sf), "user", "time", "center", "centred").select("row", "centred"), "centred", digits=8
    )


DAILY = """daily AS (SELECT "timestamp" // 86400000 AS "day", count(*) AS value FROM inter GROUP BY 1)"""


def daily(spark, sf):
    return (
        interactions(spark, sf)
        .groupBy(F.floor(F.col("timestamp") / 86_400_000).alias("day"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


@query(
    "w4_rolling_mean",
    ctes(INTER, DAILY) + """SELECT "day", value, CASE WHEN count(*) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS rolling
FROM daily WINDOW w AS (ORDER BY "day" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def w4_rolling(spark, sf):
    return rounded(od.rolling_mean(daily(spark, sf), ["day"], "value", 3), "rolling")


@query(
    "w5_running_count",
    ctes(LOG, CATALOG) + """SELECT event_id, count(*) OVER (PARTITION BY "user", artist ORDER BY "timestamp", event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log JOIN catalog USING (track)""",
)
def w5_running(spark, sf):
    played = log(spark, sf).join(catalog(spark, sf).select("track", "artist"), "track")
    return od.running_count(
        played, ["user", "artist"], ["timestamp", "event_id"], slice_by=F.floor(F.col("timestamp") / od.HOUR_MS)
    ).select("event_id", "seen")


@query(
    "w6_seen_before",
    ctes(LOG) + """SELECT event_id, row_number() OVER (PARTITION BY "user", track ORDER BY "timestamp", event_id) > 1
  AS seen_before FROM log""",
)
def w6_seen(spark, sf):
    return od.seen_before(log(spark, sf), ["user", "track"], ["timestamp", "event_id"]).select("event_id", "seen_before")


@query(
    "w7_recent_history",
    ctes(LOG) + """SELECT event_id, array_to_string(list(track) OVER w, ',') AS tracks,
  round(sum("time") OVER w, 6) AS total FROM log
WINDOW w AS (PARTITION BY "user" ORDER BY "timestamp", event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def w7_history(spark, sf):
    events = od.recent_history(log(spark, sf), 10, ties=("event_id",))
    return events.select(
        "event_id",
        F.array_join(F.reverse(F.transform("history", lambda h: h["track"].cast("string"))), ",").alias("tracks"),
        F.round(F.aggregate("history", F.lit(0.0), lambda acc, h: acc + h["time"]), 6).alias("total"),
    )


@query(
    "w8_early_stop",
    ctes(INTER, DAILY) + """, curve AS (SELECT "day" - (SELECT min("day") FROM daily) AS epoch, value / 100.0 AS value FROM daily)
SELECT min(epoch) AS stop_epoch FROM (SELECT epoch, value, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2,
  lag(value, 3) OVER w AS v3, lag(epoch, 3) OVER w AS e3 FROM curve WINDOW w AS (ORDER BY epoch))
WHERE e3 = epoch - 3 AND epoch > 3 AND value - v3 < 1e-6 AND v1 - v3 < 1e-6 AND v2 - v3 < 1e-6""",
)
def w8_stop(spark, sf):
    days = daily(spark, sf)
    first = days.agg(F.min("day").alias("d")).scalar()
    curve = days.select((F.col("day") - first).alias("epoch"), (F.col("value") / 100).alias("value"))
    return od.early_stop_epoch(curve, 3, 1e-6)
