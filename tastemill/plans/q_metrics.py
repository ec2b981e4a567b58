"""Queries: offline metrics."""

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators import aggregates as ag
from ..operators import metrics as me
from ..operators import ordering as od
from ..operators import selects as se
from .domain import catalog, interactions, log, table, vectors
from .q_events import rounded
from .registry import query
from .sqlparts import CATALOG, INTER, LOG, PAIRS, VEC, ctes, uniform_sql

# lists of ten: each user's played items in a repeatable random order; truth: the items they played long
RECS = f"""recs AS (SELECT "user", track, CAST(rank AS INTEGER) AS rank FROM (SELECT "user", track,
  row_number() OVER (PARTITION BY "user" ORDER BY {uniform_sql('"user"', 'track', seed=11)}, track) AS rank FROM pairs) WHERE rank <= 10)"""
TRUTH = """truth AS (SELECT "user", track FROM pairs WHERE "time" >= 0.6)"""
SIZES = """sizes AS (SELECT "user", count(*) AS n_truth FROM truth GROUP BY 1),
hits AS (SELECT "user", track, rank FROM recs JOIN truth USING ("user", track))"""
BASE = ctes(INTER, PAIRS, RECS, TRUTH, SIZES)


def lists(spark, sf):
    pairs = ag.aggregate_interactions(interactions(spark, sf))
    drawn = pairs.select("user", "track", "time", uniform("user", "track", seed=11).alias("_u"))
    recs = od.top_k_per(drawn, ["user"], ["_u", "track"], 10).select("user", "track", "rank")
    return recs, se.positives(pairs, 0.6, inclusive=True).select("user", "track")


POP = f"""split AS (SELECT *, {uniform_sql('event_id', seed=42)} AS rnd FROM log),
ranked AS (SELECT track, row_number() OVER (ORDER BY pop DESC, track) AS rank FROM (SELECT track, round(sum("time"), 6) AS pop FROM split WHERE rnd > 0.5 GROUP BY 1)),
ev AS (SELECT event_id, track FROM split WHERE rnd <= 0.5 AND "time" >= 0.75)"""


def popular_split(spark, sf):
    events = log(spark, sf).withColumn("rnd", uniform("event_id", seed=42))
    pop = rounded(ag.track_popularity(events.where("rnd > 0.5")), "popularity")
    ranked = od.number_rows(pop, [], [F.col("popularity").desc(), "track"], "rank").select("track", "rank")
    return ranked, se.positives(events.where("rnd <= 0.5"), 0.75, inclusive=True).select("event_id", "track")


@query(
    "m1_precision_at_10",
    ctes(LOG, POP) + """SELECT event_id, CASE WHEN rank <= 10 THEN 0.1 ELSE 0.0 END::DOUBLE AS precision FROM ev LEFT JOIN ranked USING (track)""",
)
def m1_precision(spark, sf):
    ranked, events = popular_split(spark, sf)
    return me.precision_at_k(events, ranked, 10).select("event_id", "precision")


@query(
    "m1_shuffled_precision",
    ctes(LOG, POP) + """SELECT event_id, round(CASE WHEN rank <= 50 THEN 0.1 * 10 / least(50, (SELECT count(*) FROM ranked)) ELSE 0.0 END, 6)::DOUBLE AS precision FROM ev LEFT JOIN ranked USING (track)""",
)
def m1_shuffled(spark, sf):
    ranked, events = popular_split(spark, sf)
    return rounded(me.shuffled_precision_at_k(events, ranked, 50, 10).select("event_id", "precision"), "precision")


@query("m2_mrr", ctes(LOG, POP) + """SELECT event_id, round(coalesce(1.0 / rank, 0)::DOUBLE, 6) AS mrr FROM ev LEFT JOIN ranked USING (track)""")
def m2_mrr(spark, sf):
    ranked, events = popular_split(spark, sf)
    return rounded(me.mrr(events, ranked).select("event_id", "mrr"), "mrr")


@query(
    "m2_shuffled_mrr",
    ctes(LOG, POP) + """SELECT event_id, round(CASE WHEN rank <= 10 THEN (SELECT avg(1.0 / rank) FROM ranked WHERE rank <= 10) ELSE 0.0 END::DOUBLE, 6) AS mrr FROM ev LEFT JOIN ranked USING (track)""",
)
def m2_shuffled(spark, sf):
    ranked, events = popular_split(spark, sf)
    return rounded(me.shuffled_mrr(events, ranked, 10).select("event_id", "mrr"), "mrr")


@query(
    "m3_recall_at_k",
    BASE + """SELECT k, round(avg(coalesce(h, 0) / n_truth), 6) AS recall FROM sizes, (VALUES (5), (10)) t(k)
LEFT JOIN LATERAL (SELECT count(*) AS h FROM hits WHERE hits."user" = sizes."user" AND rank <= k) x ON true GROUP BY 1""",
)
def m3_recall(spark, sf):
    recs, truth = lists(spark, sf)
    parts = [
        me.recall_at_k(recs, truth, k).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(k).alias("k"), "recall")
        for k in (5, 10)
    ]
    return se.union_all(*parts)


def ndcg_sql(log_base: float, ideal: str) -> str:
    return BASE + f"""SELECT s."user", round(coalesce(dcg, 0) / list_sum(list_transform(range(1, {ideal} + 1), lambda r: ln({log_base}) / ln(r + 1))), 6) AS ndcg
FROM sizes s LEFT JOIN (SELECT "user", sum(ln({log_base}) / ln(rank + 1)) AS dcg FROM hits GROUP BY 1) d USING ("user")"""


@query("m4_ndcg_log3", ndcg_sql(3.0, "10"))
def m4_ndcg(spark, sf):
    return rounded(me.ndcg_at_k(*lists(spark, sf), 10, log_base=3.0), "ndcg")


@query("m4_ndcg_achievable", ndcg_sql(2.0, "least(n_truth, 10)"))
def m4_achievable(spark, sf):
    return rounded(me.ndcg_at_k(*lists(spark, sf), 10, achievable=True), "ndcg")


@query(
    "m5_hit_rate",
    BASE + """SELECT round(avg(CASE WHEN "user" IN (SELECT "user" FROM hits WHERE rank <= 3) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_rate FROM sizes""",
)
def m5_hit(spark, sf):
    return me.hit_rate(*lists(spark, sf), 3).agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


@query(
    "m6_avg_rec_popularity",
    BASE + """, c AS (SELECT track, count(*) / (SELECT count(*) FROM inter) AS p FROM inter GROUP BY 1)
SELECT "user", round(avg(p), 9) AS arp FROM recs JOIN c USING (track) GROUP BY 1""",
)
def m6_arp(spark, sf):
    recs, _ = lists(spark, sf)
    return rounded(me.avg_rec_popularity(recs, interactions(spark, sf), 10), "arp", digits=9)


@query(
    "m7_catalog_coverage",
    BASE + "SELECT round(count(DISTINCT track) / (SELECT count(*) FROM part), 6) AS coverage FROM recs",
)
def m7_coverage(spark, sf):
    recs, _ = lists(spark, sf)
    return rounded(me.catalog_coverage(recs, catalog(spark, sf), 10), "coverage")


@query(
    "m8_user_coverage",
    BASE + """SELECT round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS covered, round(avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS sufficient
FROM (SELECT c_custkey, count(r.track) AS n FROM customer LEFT JOIN recs r ON r."user" = c_custkey GROUP BY 1)""",
)
def m8_users(spark, sf):
    recs, _ = lists(spark, sf)
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))
    return rounded(me.user_coverage(recs, users, 10), "covered", "sufficient")


@query(
    "m9_serendipity",
    BASE + """, c AS (SELECT track, row_number() OVER (ORDER BY count(*) DESC, track) AS pr, count(*) OVER () AS n FROM inter GROUP BY 1)
SELECT s."user", round(coalesce(x, 0), 6) AS serendipity FROM sizes s LEFT JOIN (SELECT "user",
  sum(greatest((n + 1 - rank) / n - (n + 1 - pr) / n, 0)) / 10 AS x FROM hits JOIN c USING (track) GROUP BY 1) USING ("user")""",
)
def m9_serendipity(spark, sf):
    recs, truth = lists(spark, sf)
    return rounded(me.serendipity(recs, interactions(spark, sf), truth, 10), "serendipity")


@query(
    "m10_rmse_of_mean",
    ctes(INTER) + """, parts AS (SELECT *, """ + uniform_sql('"row"', seed=1) + """ AS u FROM inter)
SELECT round(sqrt(avg(power("time" - (SELECT avg("time") FROM parts WHERE u < 0.8), 2))), 6) AS rmse FROM parts WHERE u >= 0.8""",
)
def m10_rmse(spark, sf):
    from ..operators.interactions import random_split

    parts = random_split(interactions(spark, sf), [0.8, 0.2], ["row"], seed=1)
    return rounded(me.baseline_rmse(parts.where("part = 0"), parts.where("part = 1")), "rmse")


@query(
    "m11_precision_ci",
    BASE + """SELECT round(avg(p), 6) AS mean, round(1.96 * stddev_samp(p) / sqrt(count(p)), 6) AS half_width FROM (
  SELECT s."user", coalesce(h, 0) / 10 AS p FROM sizes s LEFT JOIN (SELECT "user", count(*) AS h FROM hits GROUP BY 1) USING ("user"))""",
)
def m11_ci(spark, sf):
    per_user = me.user_precision_at_k(*lists(spark, sf), 10)
    return rounded(me.precision_ci(per_user), "mean", "half_width")


CV = ctes(INTER) + """, folded AS (SELECT *, CAST(('0x' || substr(md5("user" || '|' || track), 1, 13)) AS BIGINT) % 3 AS fold FROM inter),
f AS (SELECT fold FROM range(0, 3) r(fold)),
pop AS (SELECT f.fold, track, row_number() OVER (PARTITION BY f.fold ORDER BY count(*) DESC, track) AS rank FROM folded x, f WHERE x.fold <> f.fold GROUP BY 1, 2),
best AS (SELECT f.fold, track, row_number() OVER (PARTITION BY f.fold ORDER BY round(sum("time"), 6) DESC, track) AS rank FROM folded x, f WHERE x.fold <> f.fold GROUP BY 1, 2),
recs AS (SELECT 'count' AS model, * FROM pop WHERE rank <= 10 UNION ALL SELECT 'time', * FROM best WHERE rank <= 10),
truth AS (SELECT DISTINCT fold, "user", track FROM folded),
h AS (SELECT m.model, t.fold, t."user", count(r.track) FILTER (r.track IS NOT NULL) AS h, count(*) AS n FROM truth t CROSS JOIN (VALUES ('count'), ('time')) m(model)
  LEFT JOIN recs r ON r.fold = t.fold AND r.track = t.track AND r.model = m.model GROUP BY 1, 2, 3),
by_fold AS (SELECT model, fold, avg(h / n) AS recall, avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM h GROUP BY 1, 2)
SELECT model, round(avg(recall), 6) AS recall, round(avg(hit), 6)::DOUBLE AS hit FROM by_fold GROUP BY 1"""


@query("m12_cross_validate", CV)
def m12_cv(spark, sf):
    from ..operators.interactions import pair_folds

    rows = pair_folds(interactions(spark, sf), 3)
    folds = [(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)) for f in range(3)]

    def popular(score):
        def fit(train):
            counts = train.groupBy("track").agg(score.alias("_s"))
            top = od.top_n(counts, [F.col("_s").desc(), "track"], 10)
            ranked = top.withColumn("rank", F.row_number().over(od.Window.orderBy(F.col("_s").desc(), "track")))
            return ranked.select("track", "rank")

        return fit

    def listed(recs, test):
        # one list for everybody: only a test user's own items can be hits
        return test.select("user", "track").distinct().join(recs, "track")

    models = {"count": popular(F.count(F.lit(1))), "time": popular(F.round(F.sum("time"), 6))}
    metrics = {
        "recall": lambda r, test, train: me.recall_at_k(listed(r, test), test, 10).agg(F.avg("recall").alias("v")),
        "hit": lambda r, test, train: me.hit_rate(listed(r, test), test, 10).agg(F.avg("hit").alias("v")),
    }
    results = me.cross_validate(models, folds, metrics)
    per_fold = results.groupBy("model", "fold").pivot("metric", ["recall", "hit"]).agg(F.first("value"))
    return rounded(ag.cv_mean(per_fold), "recall", "hit")


@query(
    "m13_auc",
    """WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, floor(o_totalprice / 100) AS score FROM orders),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(rk) FILTER (label = 1) - (sum(label) * (sum(label) + 1)) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 6)::DOUBLE AS auc FROM r""",
)
def m13_auc(spark, sf):
    rows = table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.floor(F.col("o_totalprice") / 100).alias("score")
    )
    return rounded(me.auc(rows), "auc")


@query(
    "l1_map_at_k",
    BASE + """, p AS (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY rank) / rank AS p FROM hits)
SELECT s."user", round(coalesce(x, 0) / least(n_truth, 10), 6) AS ap FROM sizes s LEFT JOIN (SELECT "user", sum(p) AS x FROM p GROUP BY 1) USING ("user")""",
)
def l1_map(spark, sf):
    return rounded(me.map_at_k(*lists(spark, sf), 10), "ap")


@query(
    "l1_area_under_pr",
    BASE + """, cuts AS (SELECT r.rank, coalesce(h, 0) AS h, coalesce(q, 0) AS q FROM (SELECT DISTINCT rank FROM recs) r LEFT JOIN (SELECT rank, count(*) AS h, sum(1 / n_truth) AS q
  FROM hits JOIN sizes USING ("user") GROUP BY 1) x ON r.rank = x.rank),
curve AS (SELECT rank, sum(h) OVER w / rank / (SELECT count(*) FROM sizes) AS p, sum(q) OVER w / (SELECT count(*) FROM sizes) AS r FROM cuts WINDOW w AS (ORDER BY rank))
SELECT round(sum((r - coalesce(r0, 0)) * p), 6) AS area FROM (SELECT *, lag(r) OVER (ORDER BY rank) AS r0 FROM curve)""",
)
def l1_area(spark, sf):
    return rounded(me.area_under(me.pr_curve(*lists(spark, sf), 10)), "area")


@query(
    "l2_gini",
    BASE + """, c AS (SELECT p_partkey AS track, count(r.track) AS n FROM part LEFT JOIN recs r ON r.track = p_partkey GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n, track) AS j, count(*) OVER () AS items, sum(n) OVER () AS total FROM c)
SELECT round(sum((2 * j - items - 1) * (n / total)) / (max(items) - 1), 6) AS gini FROM o""",
)
def l2_gini(spark, sf):
    recs, _ = lists(spark, sf)
    return rounded(me.gini(ag.value_counts(recs, "track"), catalog(spark, sf)), "gini")


@query(
    "l3_intra_list_diversity",
    ctes(INTER, PAIRS, RECS, VEC) + """, l AS (SELECT "user", track, vector::DOUBLE[] AS v FROM recs JOIN vec ON vec.id = track)
SELECT u."user", round(x, 6) AS diversity, coalesce(known, 0) AS known FROM (SELECT DISTINCT "user" FROM recs) u LEFT JOIN (SELECT "user", count(*) AS known FROM l GROUP BY 1) USING ("user") LEFT JOIN (SELECT a."user", avg(1 - list_cosine_similarity(a.v, b.v)) AS x
  FROM l a JOIN l b ON a."user" = b."user" AND a.track < b.track GROUP BY 1) q USING ("user")""",
)
def l3_ild(spark, sf):
    recs, _ = lists(spark, sf)
    return rounded(me.intra_list_diversity(recs, vectors(spark, sf)), "diversity")


@query(
    "l4_popularity_novelty",
    BASE + """, k AS (SELECT track, count(DISTINCT "user") AS u FROM inter GROUP BY 1)
SELECT "user", track, round(1 - u / (SELECT count(DISTINCT "user") FROM inter), 6) AS novelty FROM recs JOIN k USING (track)""",
)
def l4_novelty(spark, sf):
    recs, _ = lists(spark, sf)
    return rounded(me.popularity_novelty(recs, interactions(spark, sf)).select("user", "track", "novelty"), "novelty")


@query(
    "l7_calibration_gap",
    ctes(INTER, PAIRS, RECS, CATALOG) + """, p AS (SELECT "user", genre, count(*) AS c, sum(count(*)) OVER (PARTITION BY "user") AS t FROM pairs JOIN catalog USING (track) GROUP BY 1, 2),
q AS (SELECT "user", genre, count(*) AS c, sum(count(*)) OVER (PARTITION BY "user") AS t FROM recs JOIN catalog USING (track) GROUP BY 1, 2),
b AS (SELECT "user", coalesce(p.c / p.t, 0) AS p, coalesce(q.c / q.t, 0) AS q FROM p FULL JOIN q USING ("user", genre))
SELECT "user", round(sum(abs(p - q)), 6) AS l1, round(sum(CASE WHEN p > 0 THEN p * ln(p / (0.99 * q + 0.01 * p)) ELSE 0 END), 6) AS kl FROM b GROUP BY 1""",
)
def l7_calibration(spark, sf):
    recs, _ = lists(spark, sf)
    history = interactions(spark, sf).select("user", "track").distinct()
    return rounded(me.calibration_gap(recs, history, catalog(spark, sf)), "l1", "kl")
