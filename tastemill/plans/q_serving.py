"""Queries: serving rules, factor models, bias correction, graph propagation, text profiles."""

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.vectors import vector_dim
from ..operators import bias as bi
from ..operators import experiments as ex
from ..operators import factors as fa
from ..operators import graph as gr
from ..operators import interactions as it
from ..operators import metrics as me
from ..operators import ordering as od
from ..operators import retrieval as rt
from ..operators import serving as sv
from ..operators import sessions as ss
from ..operators import text as tx
from ..operators.aggregates import aggregate_interactions, value_counts
from ..session import materialize
from ..sources.writers import ranked_lists
from .domain import catalog, interactions, log, table, vectors
from .q_basics import top3
from .q_events import rounded, treated
from .q_metrics import RECS, lists
from .registry import query
from .sqlparts import (
    CATALOG, INTER, LOG, PAIRS, TREATED, VEC, arms, ctes, uniform_sql,
)

DENSE = """dense AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS at_, count(*) OVER () AS n FROM catalog)"""


def any_sql(seed: int = 0, key: str = "event_id") -> str:
    return f"""anyt AS (SELECT event_id, dense.track AS any_ FROM (SELECT event_id, CAST(floor({uniform_sql(key, seed=seed)} * (SELECT max(n) FROM dense)) AS BIGINT) AS at_ FROM log) JOIN dense USING (at_))"""


STICKY = f"""ai AS (SELECT track, artist, row_number() OVER (PARTITION BY artist ORDER BY track) - 1 AS place, count(*) OVER (PARTITION BY artist) AS size FROM catalog),
dr AS (SELECT event_id, log.track, artist, place, size, CAST(floor({uniform_sql('event_id')} * greatest(size - 1, 1)) AS BIGINT) AS d FROM log LEFT JOIN ai USING (track)),
st AS (SELECT dr.event_id, coalesce(o.track, any_) AS sticky FROM dr JOIN anyt USING (event_id) LEFT JOIN ai o ON o.artist = dr.artist AND o.place = CASE WHEN dr.size = 1 THEN 0 WHEN d >= dr.place THEN d + 1 ELSE d END)"""


@query("v2_random", ctes(LOG, CATALOG, DENSE, any_sql()) + "SELECT event_id, any_ AS next FROM anyt")
def v2_random(spark, sf):
    return sv.recommend_random(log(spark, sf), sv.dense_catalog(catalog(spark, sf))).select("event_id", "next")


@query("v3_sticky", ctes(LOG, CATALOG, DENSE, any_sql(), STICKY) + "SELECT event_id, sticky AS next FROM st")
def v3_sticky(spark, sf):
    items = catalog(spark, sf)
    return sv.recommend_sticky(log(spark, sf), sv.artist_index(items), sv.dense_catalog(items)).select("event_id", "next")


@query(
    "v4_sticky_mixed",
    ctes(LOG, CATALOG, DENSE, any_sql(), STICKY) + """SELECT event_id, CASE WHEN "time" < 0.3 THEN any_ ELSE sticky END AS next FROM log JOIN st USING (event_id) JOIN anyt USING (event_id)""",
)
def v4_mixed(spark, sf):
    items = catalog(spark, sf)
    out = sv.recommend_sticky_mixed(log(spark, sf), sv.artist_index(items), sv.dense_catalog(items))
    return out.select("event_id", "next")


INDEXED = f"""l AS (SELECT "user", list(track ORDER BY rank) AS t FROM (SELECT "user", track, row_number() OVER (PARTITION BY "user" ORDER BY "time" DESC, track) AS rank FROM pairs) WHERE rank <= 3 GROUP BY 1),
ix AS (SELECT event_id, coalesce(t[CAST(floor({uniform_sql('event_id')} * greatest(len(t), 1)) AS BIGINT) + 1], any_) AS own FROM log JOIN anyt USING (event_id) LEFT JOIN l USING ("user"))"""


@query("v5_indexed", ctes(LOG, CATALOG, DENSE, any_sql(), INTER, PAIRS, INDEXED) + "SELECT event_id, own AS next FROM ix")
def v5_indexed(spark, sf):
    listed = ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    out = sv.recommend_indexed(log(spark, sf), listed, sv.dense_catalog(catalog(spark, sf)))
    return out.select("event_id", "next")


def item_neighbours(spark, sf):
    """(track, item, rank, score): nearest vectors, for the tracks that have one."""
    found = rt.item_to_item(vectors(spark, sf), 10)
    return found.select(F.col("query").alias("track"), "item", "rank", "score")


I2I_SQL = f"""nn AS (SELECT track, item, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, item) AS rank FROM
  (SELECT a.id AS track, b.id AS item, round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS score FROM vec a, vec b WHERE a.id <> b.id)) WHERE rank <= 10),
hist AS (SELECT event_id, list({{'t': track, 'w': "time"}}) OVER (PARTITION BY "user" ORDER BY "timestamp", event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM log),
fl AS (SELECT event_id, unnest(h) AS x, list_transform(h, lambda y: y.t) AS seen FROM hist),
an AS (SELECT event_id, x.t AS track, sum(x.w) AS w, any_value(seen) AS seen FROM fl GROUP BY 1, 2),
dw AS (SELECT *, -ln(greatest({uniform_sql('event_id', 'track')}, 1e-18)) / greatest(w, 1e-12) AS d FROM an),
pick AS (SELECT event_id, anchor, item FROM (SELECT event_id, dw.track AS anchor, item, row_number() OVER (PARTITION BY event_id ORDER BY d, dw.track, rank) AS rn
  FROM dw JOIN nn USING (track) WHERE NOT list_contains(seen, item)) WHERE rn = 1)"""


def i2i_events(spark, sf):
    events = od.recent_history(log(spark, sf), 10, ties=("event_id",))
    return sv.recommend_i2i(events, item_neighbours(spark, sf), sv.dense_catalog(catalog(spark, sf)))


@query(
    "v6_item_to_item",
    ctes(LOG, CATALOG, DENSE, any_sql(), VEC, I2I_SQL) + """SELECT event_id, anchor, coalesce(item, any_) AS next FROM log JOIN anyt USING (event_id) LEFT JOIN pick USING (event_id)""",
)
def v6_i2i(spark, sf):
    return i2i_events(spark, sf).select("event_id", "anchor", "next")


@query(
    "l20_explain",
    ctes(LOG, CATALOG, VEC, I2I_SQL) + """SELECT event_id, 'because you played ' || title AS because FROM log LEFT JOIN pick USING (event_id) LEFT JOIN catalog ON catalog.track = anchor""",
)
def l20_explain(spark, sf):
    return sv.explain_i2i(i2i_events(spark, sf), catalog(spark, sf)).select("event_id", "because")


@query(
    "v7_route",
    ctes(LOG, CATALOG, DENSE, any_sql(), STICKY, INTER, PAIRS, INDEXED, arms("I2I", 3), TREATED) + """SELECT event_id, treatment,
  CASE treatment WHEN 'C' THEN any_ WHEN 'T1' THEN sticky ELSE own END AS next FROM tlog JOIN anyt USING (event_id) JOIN st USING (event_id) JOIN ix USING (event_id)""",
)
def v7_route(spark, sf):
    items = catalog(spark, sf)
    dense, index = sv.dense_catalog(items), sv.artist_index(items)
    listed = ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    rules = {
        "C": lambda e: sv.recommend_random(e, dense),
        "T1": lambda e: sv.recommend_sticky(e, index, dense),
        "T2": lambda e: sv.recommend_indexed(e, listed, dense),
    }
    return sv.route(treated(spark, sf), rules).select("event_id", "treatment", "next")


@query(
    "v8_to_log",
    ctes(LOG, arms("AA", 2), TREATED) + """SELECT message, "timestamp", "user", track, round(latency, 6) AS latency, recommendation, treatment AS aa
FROM tlog""",
)
def v8_log(spark, sf):
    events = log(spark, sf).withColumn("started", F.col("timestamp") - F.col("latency") * 1000)
    out = sv.to_log(events, ex.experiment_map("user"), "started", "timestamp")
    return out.select("message", "timestamp", "user", "track", F.round("latency", 6).alias("latency"), "recommendation", F.col("experiments")["AA"].alias("aa"))


@query(
    "c1_toppop_draw",
    ctes(LOG) + f""", top AS (SELECT track, row_number() OVER (ORDER BY n DESC, track) - 1 AS at_ FROM (SELECT track, count(*) AS n FROM log GROUP BY 1) ORDER BY at_ LIMIT 10)
SELECT event_id, top.track AS next FROM (SELECT event_id, CAST(floor({uniform_sql('event_id')} * 10) AS BIGINT) AS at_ FROM log) JOIN top USING (at_)""",
)
def c1_draw(spark, sf):
    events = log(spark, sf)
    ranked = od.number_rows(value_counts(events, "track"), [], [F.col("n").desc(), "track"], "rank")
    return sv.toppop_draw(events, ranked, 10).select("event_id", "next")


@query(
    "v1_expected_time",
    ctes(INTER, PAIRS, RECS, CATALOG, VEC) + """, u AS (SELECT "user", list(v ORDER BY i) AS v FROM (SELECT "user", i, avg(vector[i]::DOUBLE) AS v FROM (SELECT DISTINCT "user", track FROM pairs) JOIN vec ON id = track, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT r."user", r.track, r.rank, artist, 1 / (1 + exp(-(list_dot_product(u.v, vector::DOUBLE[]) - 0.1) * 5)) AS raw FROM recs r LEFT JOIN u ON u."user" = r."user" LEFT JOIN vec ON id = r.track JOIN catalog c ON c.track = r.track)
SELECT "user", track, rank, round(raw * power(0.8, row_number() OVER (PARTITION BY "user", artist ORDER BY rank) - 1), 2) AS "time" FROM l""",
)
def v1_expected(spark, sf):
    recs, _ = lists(spark, sf)
    vec = vectors(spark, sf)
    users = rt.mean_vectors(interactions(spark, sf), vec).select(
        F.col("id").alias("user"), "vector", F.lit(0.1).alias("consume_bias"), F.lit(5.0).alias("consume_sharpness")
    )
    return sv.expected_time(recs, users, vec, catalog(spark, sf)).select("user", "track", "rank", "time")


@query(
    "l21_candidates_u2i2i",
    ctes(INTER, PAIRS, VEC) + """, nn AS (SELECT track, item, score FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, item) AS rank FROM
  (SELECT a.id AS track, b.id AS item, round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS score FROM vec a, vec b WHERE a.id <> b.id)) WHERE rank <= 10),
s AS (SELECT "user", item AS track, max(score) AS score FROM pairs JOIN nn USING (track) GROUP BY 1, 2)
SELECT "user", track, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM s) WHERE rank <= 20""",
)
def l21_candidates(spark, sf):
    return sv.candidates_u2i2i(interactions(spark, sf), item_neighbours(spark, sf), 20)


@query(
    "l22_hard_negatives",
    ctes(INTER, PAIRS, RECS) + """SELECT "user", track FROM pairs WHERE ("user", track) NOT IN (SELECT ("user", track) FROM recs WHERE rank <= 5)""",
)
def l22_hard(spark, sf):
    recs, _ = lists(spark, sf)
    candidates = interactions(spark, sf).select("user", "track").distinct()
    return sv.hard_negatives(candidates, recs, 5)


# ---------------------------------------------------------------- factor models


def rated(spark, sf):
    return aggregate_interactions(interactions(spark, sf))


@query("c4_als_recommend")
def c4_als(spark, sf):
    """ALS, then the top 100 of every user from the factors."""
    return fa.recommend_all(fa.fit_als(rated(spark, sf), rank=16, max_iter=5), 100)


@query("c4_als_rmse")
def c4_rmse(spark, sf):
    parts = it.random_split(rated(spark, sf), [0.8, 0.2], ["user", "track"], seed=1)
    train, test = parts.where("part = 0"), parts.where("part = 1")
    model = fa.fit_als(train, rank=16, max_iter=5)
    return me.rmse(fa.predictions(model, test), "time", "prediction")


@query("c5_implicit_mf")
def c5_implicit(spark, sf):
    model = fa.fit_implicit_mf(rated(spark, sf), rank=16, max_iter=5, alpha=4.0)
    return fa.recommend_all(model, 20, interactions(spark, sf).select("user", "track"))


@query("c6_contextual")
def c6_contextual(spark, sf):
    """RMSE of the start -> next model beside the train-mean and random baselines."""
    pairs = ss.start_pairs(log(spark, sf))
    parts = it.random_split(pairs, [0.8, 0.2], ["user", "start", "track", "time"], seed=1)
    train, test = parts.where("part = 0"), parts.where("part = 1")
    model = fa.fit_contextual(train, rank=8)
    return (
        me.rmse(fa.predictions(model, test), "time", "prediction")
        .select(F.lit("model").alias("name"), "rmse")
        .unionByName(me.baseline_rmse(train, test).select(F.lit("mean").alias("name"), "rmse"))
        .unionByName(me.rmse(test, "time", fa.random_prediction("user", "start", "track", "time")).select(F.lit("random").alias("name"), "rmse"))
    )


@query("c7_tune_als")
def c7_tune(spark, sf):
    _, results = fa.tune(rated(spark, sf), {"rank": [4, 8], "regParam": [0.05, 0.2]}, maxIter=3)
    return results


BASELINE = """mu AS (SELECT avg("time") AS mu FROM pairs),
ib AS (SELECT track, sum("time" - mu) / (10 + count(*)) AS ib FROM pairs, mu GROUP BY 1),
ub AS (SELECT "user", sum("time" - mu - ib) / (10 + count(*)) AS ub FROM pairs JOIN ib USING (track), mu GROUP BY 1)"""


@query(
    "l10_bias_baseline",
    ctes(INTER, PAIRS, BASELINE) + """SELECT "user", track, round(mu + ib + ub, 6) AS prediction FROM pairs JOIN ib USING (track) JOIN ub USING ("user"), mu""",
)
def l10_baseline(spark, sf):
    rows = rated(spark, sf)
    out = fa.predict_baseline(rows.select("user", "track"), *fa.bias_baseline(rows))
    return rounded(out, "prediction").select("user", "track", "prediction")


PROF = """prof AS (SELECT "user", list(v ORDER BY i) AS v FROM (SELECT "user", i, avg(vector[i]::DOUBLE) AS v FROM pairs JOIN vec ON id = track, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"""


def profile_factors(spark, sf):
    """(users, items) with biases: mean vectors of the history and the baseline's biases."""
    # written once: the mean, both biases and the profiles read the ratings, which are an aggregate of a join
    rows, vec = materialize(rated(spark, sf), "profile-ratings"), vectors(spark, sf)
    _, items, users = fa.bias_baseline(rows)
    u = rt.mean_vectors(rows, vec).join(users.withColumnRenamed("user", "id"), "id")
    i = vec.join(items.withColumnRenamed("track", "id"), "id")
    # written once: both sides are read for the rows, the features and the scores
    return (
        materialize(u.select("id", "vector", F.col("user_bias").alias("bias")), "user-profiles"),
        materialize(i.select("id", "vector", F.col("item_bias").alias("bias")), "item-profiles"),
    )


@query(
    "c9_augment_bias",
    ctes(INTER, PAIRS, VEC, BASELINE, PROF) + """SELECT "user", track, round(ib + ub + list_dot_product(v, vector::DOUBLE[]), 6) AS score
FROM pairs JOIN prof USING ("user") JOIN vec ON id = track JOIN ib USING (track) JOIN ub USING ("user")""",
)
def c9_augment(spark, sf):
    users, items = profile_factors(spark, sf)
    pairs = rated(spark, sf).select("user", "track")
    out = rt.score_pairs(pairs, fa.augment_bias(users, "user"), fa.augment_bias(items, "item"))
    return rounded(out, "score").select("user", "track", "score")


@query(
    "r6_score_submission",
    ctes(INTER, PAIRS, VEC, PROF) + f"""SELECT "row", round(coalesce(exp(list_dot_product(v, vector::DOUBLE[])), {uniform_sql('inter."user"', 'track')} * 0.01), 6) AS score
FROM inter LEFT JOIN prof ON prof."user" = inter."user" LEFT JOIN vec ON id = track""",
)
def r6_submission(spark, sf):
    users, items = profile_factors(spark, sf)
    rows = interactions(spark, sf).select("row", "user", "track")
    return rounded(fa.score_submission(rows, users, items), "score").select("row", "score")


# ---------------------------------------------------------------- exposure bias


@query(
    "b1_propensity_rows",
    ctes(LOG, INTER, PAIRS, VEC, BASELINE, PROF) + f""", marked AS (SELECT *, lag(message) OVER (PARTITION BY "user" ORDER BY "timestamp", event_id) AS before FROM log),
known AS (SELECT event_id, marked."user", marked.track FROM marked JOIN prof USING ("user") JOIN vec ON id = marked.track WHERE before IS NULL OR before = 'last'),
dom AS (SELECT id AS track, row_number() OVER (ORDER BY id) - 1 AS at_, count(*) OVER () AS n FROM vec JOIN ib ON ib.track = id),
dr AS (SELECT "user", CAST(floor({uniform_sql('event_id', '"user"', 'track', 'd')} * (SELECT max(n) FROM dom)) AS BIGINT) AS at_ FROM known, range(1, 21) r(d)),
lab AS (SELECT "user", track, 1 AS label FROM known UNION ALL SELECT "user", dom.track, 0 FROM dr JOIN dom USING (at_))
SELECT "user", track, lab.label, round(ub, 6) AS user_bias, round(ib, 6) AS item_bias, round(list_dot_product(v, vector::DOUBLE[]), 6) AS product
FROM lab JOIN prof USING ("user") JOIN vec ON id = track JOIN ib USING (track) JOIN ub USING ("user")""",
)
def b1_rows(spark, sf):
    users, items = profile_factors(spark, sf)
    rows = bi.propensity_rows(ss.session_starts(log(spark, sf)), users, items)
    return rounded(rows, *bi.FEATURES).select("user", "track", "label", *bi.FEATURES)


def propensity(spark, sf):
    users, items = profile_factors(spark, sf)
    rows = bi.propensity_rows(ss.session_starts(log(spark, sf)), users, items)
    return bi.fit_propensity(rows), rows, users, items


@query("b2_propensity_auc")
def b2_auc(spark, sf):
    """Exact AUC of the propensity model on its training rows."""
    from pyspark.ml.functions import vector_to_array

    model, rows, _, _ = propensity(spark, sf)
    scored = model.transform(rows).select("label", vector_to_array("probability")[1].alias("score"))
    return rounded(me.auc(scored), "auc")


@query("b3_log_propensity")
def b3_log(spark, sf):
    model, _, users, items = propensity(spark, sf)
    pairs = interactions(spark, sf).select("user", "track").distinct()
    return bi.log_propensity(pairs, model, users, items)


CHANCE = """c AS (SELECT track, ln(count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM inter GROUP BY track))) AS lp FROM inter GROUP BY 1)"""


def popularity_propensity(rows):
    counts = value_counts(rows, "track")
    top = counts.agg(F.max("n").alias("m")).scalar()
    return counts.select("track", F.log(F.col("n") / top).alias("log_proba"))


@query(
    "b4_ips_weights",
    ctes(INTER, CHANCE) + """SELECT "row", round(least(exp(-lp), 2.0), 6) AS weight FROM inter JOIN c USING (track)""",
)
def b4_weights(spark, sf):
    rows = interactions(spark, sf)
    return rounded(bi.ips_weights(rows.join(popularity_propensity(rows), "track"), 2.0).select("row", "weight"), "weight")


@query(
    "l13_ips_risk",
    ctes(INTER, CHANCE) + """, w AS (SELECT power("time" - 0.5, 2) AS loss, least(exp(-lp), 2.0) AS w FROM inter JOIN c USING (track))
SELECT round(avg(loss), 6) AS naive, round(sum(loss * w) / 1000000, 6) AS ips, round(sum(loss * w) / sum(w), 6) AS snips FROM w""",
)
def l13_risk(spark, sf):
    rows = interactions(spark, sf)
    weighted = bi.ips_weights(rows.join(popularity_propensity(rows), "track"), 2.0)
    loss = weighted.withColumn("loss", (F.col("time") - 0.5) * (F.col("time") - 0.5))
    return rounded(bi.ips_risk(loss, "loss", "weight", 1_000_000.0), "naive", "ips", "snips")


@query(
    "l14_logq",
    ctes(INTER) + """, q AS (SELECT track, ln(count(*) / (SELECT count(*) FROM inter)) AS q FROM inter GROUP BY 1) SELECT "row", round("time" - q, 6) AS corrected FROM inter JOIN q USING (track)""",
)
def l14_logq(spark, sf):
    rows = interactions(spark, sf)
    return rounded(bi.logq(rows, rows.select("row", "track", F.col("time").alias("score"))).select("row", "corrected"), "corrected")


@query(
    "l14_mixed_negatives",
    ctes(INTER) + f""", items AS (SELECT p_partkey AS track, row_number() OVER (ORDER BY p_partkey) - 1 AS at_, count(*) OVER () AS n FROM part),
byrow AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS at_, count(*) OVER () AS n FROM inter),
d AS (SELECT "row", CAST(d AS INTEGER) AS draw, CAST(floor({uniform_sql('"row"', 'd', seed=2)} * (SELECT max(n) FROM items)) AS BIGINT) AS a, CAST(floor({uniform_sql('"row"', 'd', seed=3)} * (SELECT max(n) FROM byrow)) AS BIGINT) AS b FROM inter, range(1, 3) r(d))
SELECT "row", draw, items.track AS negative, 'uniform' AS kind FROM d JOIN items ON at_ = a UNION ALL SELECT "row", draw, byrow.track, 'popular' FROM d JOIN byrow ON at_ = b""",
)
def l14_mixed(spark, sf):
    rows = interactions(spark, sf).select("row", "user", "track")
    out = bi.mixed_negatives(rows, catalog(spark, sf), 2, 2, ("row",), seed=2)
    return out.select("row", "draw", "negative", "kind")


ARMS = """st AS (SELECT event_type AS arm, count(*) AS pulls, avg(value) AS mean, sum(value) AS total, stddev_samp(value) AS std FROM events GROUP BY 1)"""


def arm_table(spark, sf):
    return bi.arm_stats(table(spark, sf, "events").withColumnRenamed("event_type", "arm"), "arm", "value")


@query(
    "l15_ucb",
    ctes(ARMS) + """SELECT arm, pulls, round(mean, 6) AS mean, round(mean + 2.0 * sqrt(ln((SELECT sum(pulls) FROM st)::DOUBLE) / pulls), 6) AS ucb FROM st""",
)
def l15_ucb(spark, sf):
    return rounded(bi.ucb_choice(arm_table(spark, sf), "arm").select("arm", "pulls", "mean", "ucb"), "mean", "ucb")


@query(
    "l15_epsilon_greedy",
    ctes(ARMS) + """, e AS (SELECT 1 / (1 + (SELECT sum(pulls) FROM st) * 0.001::DOUBLE) AS e)
SELECT arm, round(0.1 / (SELECT count(*) FROM st) + CASE WHEN mean = (SELECT max(mean) FROM st) THEN 0.9 ELSE 0 END, 6)::DOUBLE AS fixed,
  round(e / (SELECT count(*) FROM st) + CASE WHEN mean = (SELECT max(mean) FROM st) THEN 1 - e ELSE 0 END, 6) AS decayed FROM st, e""",
)
def l15_epsilon(spark, sf):
    stats = arm_table(spark, sf)
    fixed = bi.epsilon_greedy(stats, "arm", 0.1).select("arm", F.col("chance").alias("fixed"))
    shrinking = bi.epsilon_greedy(stats, "arm", bi.decayed(0.001)).select("arm", F.col("chance").alias("decayed"))
    return rounded(fixed.join(shrinking, "arm"), "fixed", "decayed")


@query(
    "l15_gradient",
    """WITH RECURSIVE arms AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS arms FROM events),
ev AS (SELECT user_id AS "user", list_position(arms, event_type) AS a, value / (value + 50) AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events, arms),
walk("user", t, h, mean) AS (
  SELECT DISTINCT "user", 0::BIGINT, list_transform(arms, lambda x: 0.0::DOUBLE), 0.0::DOUBLE FROM ev, arms
  UNION ALL
  SELECT "user", e.t, list_transform(range(1, len(h) + 1), lambda i: CASE WHEN i = a
      THEN h[i] + 0.1 * (r - mean) * (1 - exp(h[i]) / list_sum(list_transform(h, lambda x: exp(x))))
      ELSE h[i] - 0.1 * (r - mean) * exp(h[i]) / list_sum(list_transform(h, lambda x: exp(x))) END), mean + (r - mean) / e.t
  FROM walk w JOIN ev e USING ("user") WHERE e.t = w.t + 1),
ends AS (SELECT "user", max(t) AS steps, arg_max(h, t) AS h FROM walk GROUP BY 1)
SELECT "user", arms[i] AS arm, steps, round(h[i], 6) + 0.0 AS preference, round(exp(h[i]) / list_sum(list_transform(h, lambda x: exp(x))), 6) AS chance
FROM ends, arms, range(1, 1000) s(i) WHERE i <= len(h)""",
)
def l15_gradient(spark, sf):
    """One gradient bandit per user, walked through the user's log."""
    reward = F.col("value") / (F.col("value") + 50)
    events = table(spark, sf, "events").select(F.col("user_id").alias("user"), "event_type", "ts", "event_id", reward.alias("reward"))
    out = bi.gradient_bandit(events, "event_type", "reward", ["ts", "event_id"], ["user"])
    return out.select("user", "arm", "steps", (F.round("preference", 6) + 0.0).alias("preference"), F.round("chance", 6).alias("chance"))


@query(
    "l15_thompson",
    ctes(ARMS) + f"""SELECT arm, round(mean + std / sqrt(pulls) * sqrt(-2 * ln(greatest({uniform_sql('arm', seed=4)}, 1e-12))) * cos(2 * pi() * {uniform_sql('arm', seed=5)}), 6) AS draw FROM st""",
)
def l15_thompson(spark, sf):
    return rounded(bi.thompson_draws(arm_table(spark, sf), "arm", 4).select("arm", "draw"), "draw")


# ---------------------------------------------------------------- graph

EDGES = """pr AS (SELECT DISTINCT 'u' || "user" AS a, 'i' || track AS b FROM inter),
ed AS (SELECT a AS src, b AS dst FROM pr UNION ALL SELECT b, a FROM pr),
dg AS (SELECT src, count(*) AS d FROM ed GROUP BY 1)"""


@query(
    "c8_propagate",
    ctes(INTER, EDGES) + ", l0 AS (SELECT src AS id, s, "
    + "CASE s WHEN 0 THEN " + uniform_sql("src", seed=0) + " WHEN 1 THEN " + uniform_sql("src", seed=1)
    + " WHEN 2 THEN " + uniform_sql("src", seed=2) + " ELSE " + uniform_sql("src", seed=3) + """ END - 0.5 AS v
  FROM (SELECT DISTINCT src FROM ed), range(0, 4) r(s)),
w AS (SELECT ed.src, ed.dst, 1 / sqrt(a.d * b.d) AS w FROM ed JOIN dg a ON a.src = ed.src JOIN dg b ON b.src = ed.dst),
l1 AS (SELECT dst AS id, s, sum(w * v) AS v FROM w JOIN l0 ON l0.id = w.src GROUP BY 1, 2),
l2 AS (SELECT dst AS id, s, sum(w * v) AS v FROM w JOIN l1 ON l1.id = w.src GROUP BY 1, 2),
t AS (SELECT id, s, sum(v) / 3 AS v FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2)
SELECT id, round(max(v) FILTER (s = 0), 6) + 0.0 AS v0, round(max(v) FILTER (s = 3), 6) + 0.0 AS v3 FROM t GROUP BY 1""",
)
def c8_propagate(spark, sf):
    plays = interactions(spark, sf)

    def start(column: str, letter: str):
        """A small repeatable vector per node, from hashes of its name."""
        ids = plays.select(F.col(column).alias("id")).dropna().distinct().withColumn("name", F.concat(F.lit(letter), "id"))
        return ids.select("id", F.array(*[uniform("name", seed=s) - 0.5 for s in range(4)]).alias("vector"))

    users, items = gr.propagate_pairs(plays, start("user", "u"), start("track", "i"), 2)
    named = [v.select(F.concat(F.lit(n), "id").alias("id"), "vector") for v, n in ((users, "u"), (items, "i"))]
    out = named[0].unionByName(named[1])
    return out.select("id", (F.round(F.col("vector")[0], 6) + 0.0).alias("v0"), (F.round(F.col("vector")[3], 6) + 0.0).alias("v3"))


RING = """ed AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT DISTINCT 'n' || c_nationkey, 's' || c_mktsegment FROM customer UNION SELECT DISTINCT 's' || c_mktsegment, 'n' || c_nationkey FROM customer),
dg AS (SELECT src, count(*) AS d FROM ed GROUP BY 1), st AS (SELECT ed.src, ed.dst, 1.0::DOUBLE / d AS w FROM ed JOIN dg USING (src))"""


def ppr_sql(rounds: int) -> str:
    parts = [RING, "s0 AS (SELECT DISTINCT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS id, 1.0::DOUBLE AS p FROM region)"]
    for n in range(1, rounds + 1):
        parts.append(
            f"s{n} AS (SELECT seed, id, sum(p) AS p FROM (SELECT seed, dst AS id, p * w * 0.85 AS p FROM s{n - 1} JOIN st ON st.src = s{n - 1}.id "
            f"UNION ALL SELECT seed, seed, 0.15 FROM (SELECT DISTINCT seed FROM s0)) GROUP BY 1, 2)"
        )
    return ctes(*parts) + f"SELECT seed, id, round(p, 6) AS score FROM s{rounds}"


@query("l16_personalised_pagerank", ppr_sql(8))
def l16_ppr(spark, sf):
    """Region, nation and market-segment graph, one restart per region."""
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")
    )
    segments = table(spark, sf, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("s"), "c_mktsegment").alias("dst")
    )
    one_way = nation.unionByName(segments).distinct()
    edges = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("seed"))
    start = seeds.select("seed", F.col("seed").alias("id"), F.lit(1.0).alias("weight"))
    return rounded(gr.ppr(edges, start, 0.85, 8), "score")


def user_ppr_sql(rounds: int, seeds: int, k: int) -> str:
    parts = [
        INTER, """pairs_ AS (SELECT DISTINCT 'u' || "user" AS a, 'i' || track AS b FROM inter)""",
        "e AS (SELECT a AS src, b AS dst FROM pairs_ UNION ALL SELECT b, a FROM pairs_)",
        "st AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)",
        f"""s0 AS (SELECT 'u' || "user" AS seed, 'u' || "user" AS id, 1.0::DOUBLE AS p FROM
  (SELECT "user", count(*) AS n FROM inter GROUP BY 1 ORDER BY n DESC, "user" LIMIT {seeds}))""",
    ]
    for n in range(1, rounds + 1):
        parts.append(
            f"s{n} AS (SELECT seed, id, sum(p) AS p FROM (SELECT seed, dst AS id, p * w * 0.85 AS p FROM s{n - 1} JOIN st ON st.src = s{n - 1}.id "
            f"UNION ALL SELECT seed, seed, 0.15 FROM (SELECT DISTINCT seed FROM s0)) GROUP BY 1, 2)"
        )
    return ctes(*parts) + f"""SELECT seed, id, round(p, 6) AS score, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(p, 9) DESC, id) AS rank FROM s{rounds}) WHERE rank <= {k}"""


@query("l16_user_pagerank", user_ppr_sql(4, 5, 100))
def l16_users(spark, sf):
    """PageRank over the user-item graph from each of the five heaviest players: their hundred best nodes."""
    plays = interactions(spark, sf)
    edges = gr.bipartite_edges(plays)
    top = od.top_n(value_counts(plays, "user"), [F.col("n").desc(), "user"], 5)
    start = top.select(F.concat(F.lit("u"), "user").alias("seed"), F.concat(F.lit("u"), "user").alias("id"), F.lit(1.0).alias("weight"))
    ranks = gr.ppr(edges, start, 0.85, 4).withColumn("_p", F.round("score", 9))
    best = od.top_k_per(ranks, ["seed"], [F.col("_p").desc(), "id"], 100)
    return rounded(best.select("seed", "id", "score", "rank"), "score")


# ---------------------------------------------------------------- text

WORDS = r"""tk AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1, 2),
ln_ AS (SELECT doc_id, sum(n) AS len FROM tk GROUP BY 1), df_ AS (SELECT token, count(*) AS df FROM tk GROUP BY 1)"""


@query(
    "l17_tf_idf",
    ctes(WORDS) + """SELECT doc_id, md5(token) AS token, n, round(n / len * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS weight FROM tk JOIN ln_ USING (doc_id) JOIN df_ USING (token)""",
)
def l17_tfidf(spark, sf):
    out = tx.tf_idf(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rounded(out, "weight").withColumn("token", F.md5("token")).withColumn("n", F.col("n").cast("long"))


@query(
    "l17_bm25",
    ctes(WORDS) + """SELECT doc_id, md5(token) AS token, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM ln_))), 6) AS weight
FROM tk JOIN ln_ USING (doc_id) JOIN df_ USING (token)""",
)
def l17_bm25(spark, sf):
    out = tx.bm25(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rounded(out, "weight").withColumn("token", F.md5("token"))


@query(
    "l17_content_profile",
    ctes(WORDS) + """, c AS (SELECT token, sum(CASE WHEN quality = 1 THEN n ELSE 0 END) AS p, sum(CASE WHEN quality = 0 THEN n ELSE 0 END) AS q FROM tk JOIN labels USING (doc_id) GROUP BY 1),
t AS (SELECT sum(p) AS p, sum(q) AS q, count(*) AS v FROM c),
o AS (SELECT token, ln((c.p + 1) / (t.p + t.v)) - ln((c.q + 1) / (t.q + t.v)) AS w FROM c, t),
pr AS (SELECT ln(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)) AS lp FROM documents JOIN labels USING (doc_id))
SELECT d.doc_id, round(lp + coalesce(s, 0), 5) AS score FROM documents d LEFT JOIN (SELECT doc_id, sum(n * w) AS s FROM tk JOIN o USING (token) GROUP BY 1) x USING (doc_id), pr""",
)
def l17_profile(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    profile = tx.content_profile(labelled, "doc_id", "quality")
    prior = tx.class_log_prior(labelled, "quality")
    return rounded(tx.profile_score(docs, profile, prior, "doc_id"), "score", digits=5)


@query("s6_vector_length", "SELECT count(*) AS n, 64 AS dim FROM embeddings")
def s6_length(spark, sf):
    vec = vectors(spark, sf)
    return vec.agg(F.count(F.lit(1)).alias("n")).withColumn("dim", F.lit(vector_dim(vec)))


