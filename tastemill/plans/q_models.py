"""Queries: neighbours, retrieval, re-ranking."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import inverted as iv
from ..operators import linear as li
from ..operators import metrics as me
from ..operators import neighbours as nb
from ..operators import ordering as od
from ..operators import rerank as rr
from ..operators import retrieval as rt
from .domain import catalog, interactions, log, vectors
from .q_events import rounded
from .q_metrics import RECS, lists
from .registry import query
from .sqlparts import CATALOG, INTER, LOG, PAIRS, VEC, ctes

NORM_L2 = """rows_ AS (SELECT "user", track, coalesce(t / nullif(sqrt(sum(t * t) OVER (PARTITION BY "user")), 0), 0) AS r FROM
  (SELECT "user", track, avg("time") AS t FROM inter GROUP BY 1, 2)), q AS (SELECT "user", track, r, r AS q FROM rows_)"""
NORM_CENTER = """cent AS (SELECT "user", track, "time" - avg("time") OVER (PARTITION BY "user") AS c FROM inter),
rows_ AS (SELECT "user", track, avg(c) AS r FROM cent GROUP BY 1, 2),
q AS (SELECT "user", track, r, coalesce(r / nullif(sqrt(sum(r * r) OVER (PARTITION BY "user")), 0), 0) AS q FROM rows_)"""


def user_cf_sql(norm: str) -> str:
    return ctes(INTER, norm) + """, sim AS (SELECT a."user" AS u, b."user" AS v, sum(a.q * b.q) AS w FROM q a JOIN q b ON a.track = b.track AND a."user" <> b."user" GROUP BY 1, 2),
found AS (SELECT u AS "user", track, round(sum(w * r), 9) AS score FROM sim JOIN q ON v = "user" GROUP BY 1, 2),
scores AS (SELECT "user", track, coalesce(score, 0) + 0.0 AS score FROM (SELECT DISTINCT "user" FROM q) CROSS JOIN (SELECT DISTINCT track FROM q) LEFT JOIN found USING ("user", track)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM scores)
SELECT "user", track, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20"""


@query("c1_toppop", ctes(INTER) + """SELECT track, round(sum("time"), 6) AS popularity FROM inter GROUP BY 1 ORDER BY popularity DESC, track LIMIT 100""")
def c1_toppop(spark, sf):
    pop = rounded(ag.track_popularity(interactions(spark, sf)), "popularity")
    return od.top_n(pop, [F.col("popularity").desc(), "track"], 100)


@query("c2_user_cf", user_cf_sql(NORM_L2))
def c2_user_cf(spark, sf):
    return nb.user_cf(interactions(spark, sf), "l2", 20)


@query("c2_user_cf_centered", user_cf_sql(NORM_CENTER))
def c2_centered(spark, sf):
    return nb.user_cf(interactions(spark, sf), "center", 20)


@query(
    "c3_neighbour_stats",
    ctes(INTER, NORM_CENTER) + """, sim AS (SELECT a."user" AS u, b."user" AS v, round(sum(a.q * b.q), 12) AS w FROM q a JOIN q b ON a.track = b.track AND a."user" <> b."user" GROUP BY 1, 2)
SELECT round(count(*) FILTER (w > 0) / (SELECT count(DISTINCT "user") FROM q), 6) AS mean_positive,
  round(count(*) FILTER (w < 0) / (SELECT count(DISTINCT "user") FROM q), 6) AS mean_negative FROM sim""",
)
def c3_neighbours(spark, sf):
    return rounded(nb.neighbour_stats(interactions(spark, sf), "center"), "mean_positive", "mean_negative")


COSINE = """x AS (SELECT "user", track, coalesce(t / nullif(sqrt(sum(t * t) OVER (PARTITION BY track)), 0), 0) AS x, t FROM (SELECT "user", track, "time" AS t FROM pairs)),
w AS (SELECT a.track AS j, b.track AS i, sum(a.x * b.x) AS w FROM x a JOIN x b ON a."user" = b."user" AND a.track <> b.track GROUP BY 1, 2)"""


@query(
    "l8_similar_items",
    ctes(INTER, PAIRS, COSINE) + """SELECT j, i, round(w, 9) AS w, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(w, 9) DESC, i) AS rank FROM w) WHERE rank <= 10""",
)
def l8_similar(spark, sf):
    weights = nb.item_weights(interactions(spark, sf), best=10)
    return nb.similar_items(weights, 10)


@query(
    "l8_item_cf",
    ctes(INTER, PAIRS, COSINE) + """, found AS (SELECT "user", i AS track, round(sum(w * "time"), 9) AS score FROM pairs JOIN w ON track = j GROUP BY 1, 2),
s AS (SELECT "user", track, coalesce(score, 0) + 0.0 AS score FROM (SELECT DISTINCT "user" FROM pairs) CROSS JOIN (SELECT DISTINCT track FROM pairs) LEFT JOIN found USING ("user", track))
SELECT "user", track, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM s) WHERE rank <= 20""",
)
def l8_item_cf(spark, sf):
    return nb.item_cf(interactions(spark, sf), 20)


@query(
    "l8_pearson",
    ctes(INTER, PAIRS) + """, p AS (SELECT a.track AS j, b.track AS i, count(*) AS n, sum(a."time") AS x, sum(b."time") AS y, sum(a."time" * b."time") AS xy,
  sum(a."time" * a."time") AS xx, sum(b."time" * b."time") AS yy FROM pairs a JOIN pairs b ON a."user" = b."user" AND a.track <> b.track GROUP BY 1, 2 HAVING count(*) >= 2),
w AS (SELECT j, i, n, (n * xy - x * y) / sqrt(round(n * xx - x * x, 9) * round(n * yy - y * y, 9)) AS w FROM p WHERE round(n * xx - x * x, 9) > 0 AND round(n * yy - y * y, 9) > 0)
SELECT j, i, round(w, 6) AS w FROM w""",
)
def l8_pearson(spark, sf):
    return rounded(nb.item_weights(interactions(spark, sf), "pearson"), "w")


NPMI = """one AS (SELECT "user", track FROM pairs), nu AS (SELECT count(DISTINCT "user") AS n FROM one),
p1 AS (SELECT track, count(*) / (SELECT n FROM nu) AS p FROM one GROUP BY 1),
pij AS (SELECT a.track AS i, b.track AS j, count(*) / (SELECT n FROM nu) AS p FROM one a JOIN one b ON a."user" = b."user" AND a.track <> b.track GROUP BY 1, 2),
npmi AS (SELECT i, j, ln(pij.p / (x.p * y.p)) / -ln(pij.p) AS npmi FROM pij JOIN p1 x ON x.track = i JOIN p1 y ON y.track = j)"""


@query("l5_npmi", ctes(INTER, PAIRS, NPMI) + "SELECT i, j, round(npmi, 6) AS npmi FROM npmi")
def l5_npmi(spark, sf):
    return rounded(nb.npmi(interactions(spark, sf)), "npmi")


@query(
    "l5_unexpectedness",
    ctes(INTER, PAIRS, LOG, NPMI) + """, recs AS (SELECT DISTINCT "user", recommendation AS track FROM log WHERE recommendation IS NOT NULL),
x AS (SELECT r."user", r.track, o.track AS h, coalesce(-n.npmi, 1) AS u FROM recs r JOIN one o ON o."user" = r."user" AND o.track <> r.track
  LEFT JOIN npmi n ON n.i = r.track AND n.j = o.track)
SELECT "user", track, round(max(u), 6) AS unexpectedness FROM x GROUP BY 1, 2""",
)
def l5_unexpected(spark, sf):
    recs = log(spark, sf).where("recommendation IS NOT NULL").select("user", F.col("recommendation").alias("track")).distinct()
    history = interactions(spark, sf)
    return rounded(me.unexpectedness(recs, history, nb.npmi(history, of=recs.select("track"))), "unexpectedness")


@query("l12_item_linear")
def l12_linear(spark, sf):
    """The 20 largest weights of every item, each from a fit on all other items."""
    parts, weights, _ = li.item_linear(interactions(spark, sf))
    return rounded(li.weight_rows(parts, weights, 20), "w")


@query(
    "l12_normal_equations",
    ctes(INTER, PAIRS) + """, n AS (SELECT count(DISTINCT track) AS n FROM pairs) SELECT DISTINCT track AS i, n - 1 AS n_weights, TRUE AS solved FROM pairs, n""",
)
def l12_equations(spark, sf):
    """Whether an item's weights solve the normal equations of its ridge fit on all other items."""
    found = li.normal_residuals(*li.item_linear(interactions(spark, sf), 10.0), 10.0)
    return found.select("i", "n_weights", (F.col("residual") < 1e-6).alias("solved"))


@query(
    "l12_linear_recommend",
    ctes(INTER, PAIRS) + """SELECT DISTINCT "user", 20::BIGINT AS items, TRUE AS falling FROM pairs""",
)
def l12_recommend(spark, sf):
    """Lists of the item linear model: every user gets 20 items in falling order of predicted rating."""
    top = li.linear_recommend(interactions(spark, sf), 20)
    falls = F.col("score") <= F.coalesce(F.lag("score").over(Window.partitionBy("user").orderBy("rank")), F.col("score"))
    return top.withColumn("falls", falls).groupBy("user").agg(F.count_distinct("track").alias("items"), F.every("falls").alias("falling"))


def knn_sql(score: str, k: int, extra: str = "") -> str:
    return ctes(VEC) + f""", s AS (SELECT a.id AS query, b.id AS item, round({score}, 9) AS score FROM vec a, vec b {extra})
SELECT query, item, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= {k}"""


IP = "list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[])"


@query("r1_knn_inner_product", knn_sql(IP, 50))
def r1_knn(spark, sf):
    vec = vectors(spark, sf)
    return rt.knn(vec, vec, 50)


@query("r2_knn_l2", knn_sql("-list_distance(a.vector::DOUBLE[], b.vector::DOUBLE[])", 20, "WHERE a.id <> b.id"))
def r2_knn(spark, sf):
    vec = vectors(spark, sf)
    return rt.knn(vec, vec, 20, "l2", exclude_self=True)


PROFILES = """known AS (SELECT DISTINCT "user", track FROM inter WHERE track IN (SELECT id FROM vec)),
prof AS (SELECT "user", list(v ORDER BY i) AS v FROM (SELECT "user", i, avg(vector[i]::DOUBLE) AS v FROM known JOIN vec ON id = track, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"""


def profile_sql(score: str, k: int) -> str:
    return ctes(INTER, VEC, PROFILES) + f""", s AS (SELECT "user", id AS track, round({score}, 9) AS score FROM prof, vec WHERE ("user", id) NOT IN (SELECT ("user", track) FROM known))
SELECT "user", track, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM s) WHERE rank <= {k}"""


@query("r3_recommend_unseen", profile_sql("list_dot_product(v, vector::DOUBLE[])", 10))
def r3_recommend(spark, sf):
    vec, plays = vectors(spark, sf), interactions(spark, sf)
    return rt.recommend(rt.mean_vectors(plays, vec), vec, 10, plays.select("user", "track"))


@query("r4_item_to_item", knn_sql(IP, 10, "WHERE a.id <> b.id"))
def r4_i2i(spark, sf):
    return rt.item_to_item(vectors(spark, sf), 10)


@query(
    "r5_score_pairs",
    ctes(INTER, VEC, PROFILES) + """SELECT DISTINCT "user", track, round(list_dot_product(v, vector::DOUBLE[]), 6) AS score FROM inter JOIN prof USING ("user") JOIN vec ON id = track""",
)
def r5_pairs(spark, sf):
    vec, plays = vectors(spark, sf), interactions(spark, sf)
    pairs = plays.select("user", "track").distinct()
    return rounded(rt.score_pairs(pairs, rt.mean_vectors(plays, vec), vec), "score").select("user", "track", "score")


@query("l24_content_nearest", profile_sql("list_cosine_similarity(v, vector::DOUBLE[])", 10))
def l24_content(spark, sf):
    return rt.content_nearest(interactions(spark, sf), vectors(spark, sf), 10)


@query(
    "l4_history_distance",
    ctes(INTER, PAIRS, RECS, VEC) + """, near AS (SELECT r."user", r.track, round(min(1 - list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[])), 6) + 0.0 AS distance
FROM recs r JOIN vec a ON a.id = r.track JOIN pairs p ON p."user" = r."user" JOIN vec b ON b.id = p.track GROUP BY 1, 2)
SELECT "user", track, distance FROM recs LEFT JOIN near USING ("user", track)""",
)
def l4_distance(spark, sf):
    recs, _ = lists(spark, sf)
    out = rt.nearest_distance(recs, interactions(spark, sf), vectors(spark, sf))
    return out.select("user", "track", (F.round("distance", 6) + 0.0).alias("distance"))


@query("r4_inverted_file_exact", knn_sql(IP, 10, "WHERE a.id <> b.id"))
def r4_inverted_exact(spark, sf):
    """Through the inverted file: a few cells first, then only those that could still hold a better neighbour."""
    vec = vectors(spark, sf)
    return iv.ivf_knn(iv.build(vec), vec, 10, probes=8, exact=True, exclude_self=True)


@query("r2_inverted_file_l2", knn_sql("-list_distance(a.vector::DOUBLE[], b.vector::DOUBLE[])", 20, "WHERE a.id <> b.id"))
def r2_inverted_exact(spark, sf):
    vec = vectors(spark, sf)
    return iv.ivf_knn(iv.build(vec, metric="l2"), vec, 20, probes=8, exact=True, exclude_self=True)


RECALL = """near AS (SELECT query, item FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank
  FROM (SELECT a.id AS query, b.id AS item, round(""" + IP + """, 9) AS score FROM vec a, vec b WHERE a.id <> b.id)) WHERE rank <= 10)
SELECT 10 AS wanted, count(DISTINCT query) AS queries, count(*) AS neighbours, TRUE AS enough FROM near"""


@query("l9_inverted_file_recall", ctes(VEC, RECALL))
def l9_inverted_recall(spark, sf):
    """The approximate search with as many probes as a sample needs for a recall of 0.92, held against exact search of all:
    whether 0.9 of all true neighbours were found."""
    vec = vectors(spark, sf)
    index = iv.build(vec)
    probes = iv.probes_for(index, vec, 10, 0.92, exclude_self=True)
    found = iv.recall(iv.ivf_knn(index, vec, 10, probes, exclude_self=True), rt.item_to_item(vec, 10))
    return found.agg(F.max("wanted").cast("int").alias("wanted"), F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("neighbours"),
                     (F.sum("hits") >= F.sum("wanted") * 0.9).alias("enough"))


@query("l9_lsh_vectors")
def l9_lsh(spark, sf):
    return rt.lsh_knn(vectors(spark, sf), 10)


@query("l9_minhash_users")
def l9_minhash(spark, sf):
    """Bands of two hashes: the shape for a similarity of 0.15."""
    return rt.minhash_neighbours(interactions(spark, sf), 10, hashes=96, threshold=0.15)


@query(
    "d4_mean_similarity",
    ctes(VEC) + f"""SELECT label, count(*) AS n, round(coalesce(x, 0), 6) AS similarity FROM vec LEFT JOIN (SELECT a.label, avg({IP}) AS x FROM vec a JOIN vec b ON a.label = b.label AND a.id < b.id GROUP BY 1) q USING (label) GROUP BY 1, x""",
)
def d4_similarity(spark, sf):
    return rounded(rt.mean_similarity(vectors(spark, sf), "label"), "similarity")


@query("d4_catalog_similarity", ctes(VEC) + f"SELECT (SELECT count(*) FROM vec) AS n, round(avg({IP}), 6) AS similarity FROM vec a JOIN vec b ON a.id < b.id")
def d4_catalog(spark, sf):
    return rounded(rt.mean_similarity(vectors(spark, sf)), "similarity")


def sample_sql(n: int) -> str:
    from .sqlparts import uniform_sql

    return f"s AS (SELECT * FROM vec ORDER BY -ln(greatest({uniform_sql('id', seed=0)}, 1e-18)), id LIMIT {n})"


@query(
    "d5_similarity_profile",
    ctes(VEC, sample_sql(5)) + f""", x AS (SELECT a.id AS query, b.id AS item, round({IP}, 9) AS score FROM s a, vec b)
SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM x""",
)
def d5_profile(spark, sf):
    return rt.similarity_profile(vectors(spark, sf), 5)


def candidates(spark, sf, k):
    vec = vectors(spark, sf)
    return rt.content_nearest(interactions(spark, sf), vec, k, unseen=False), vec


@query("d2_dpp_rerank")
def d2_dpp(spark, sf):
    recs, vec = candidates(spark, sf, 50)
    return rr.dpp_rerank(recs, vec, 10)


@query(
    "d3_cap_per_artist",
    ctes(INTER, PAIRS, RECS, CATALOG) + """, c AS (SELECT "user", track, rank, row_number() OVER (PARTITION BY "user", coalesce('=' || artist, CAST(track AS VARCHAR)) ORDER BY rank) AS n FROM recs LEFT JOIN catalog USING (track))
SELECT "user", track, CAST(row_number() OVER (PARTITION BY "user" ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 2""",
)
def d3_cap(spark, sf):
    recs, _ = lists(spark, sf)
    return rr.cap_per_group(recs, catalog(spark, sf), "artist", 2, 50)


NEAR20 = ctes(INTER, VEC, PROFILES, CATALOG).replace("WITH ", "WITH RECURSIVE ", 1) + """, sc AS (SELECT "user", id AS track, round(list_cosine_similarity(v, vector::DOUBLE[]), 9) AS score, vector::DOUBLE[] AS w FROM prof, vec),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM sc) WHERE rank <= 20)"""


def walk_sql(state: str, start: str, value: str, after: str) -> str:
    """A greedy walk over all lists at once: the best row of each list is done, the others go on with a new ``state``."""
    return f"""{NEAR20}, walk AS (
  SELECT "user", track, score, rank, w, genre, {start} AS {state}, 0 AS step, FALSE AS done FROM near LEFT JOIN catalog USING (track)
  UNION ALL
  SELECT "user", track, score, rank, w, genre, {after} AS {state}, step + 1, track = best FROM (
    SELECT *, first_value(track) OVER o AS best, first_value(w) OVER o AS best_w, first_value(genre) OVER o AS best_genre
    FROM walk WHERE NOT done WINDOW o AS (PARTITION BY "user" ORDER BY round({value}, 9) DESC, rank)))
SELECT "user", track, step AS rank FROM walk WHERE done"""


@query(
    "l6_mmr_rerank",
    walk_sql("close", "NULL::DOUBLE", "0.7 * score - 0.3 * coalesce(close, 0)", "greatest(coalesce(close, -2), list_cosine_similarity(w, best_w))"),
)
def l6_mmr(spark, sf):
    recs, vec = candidates(spark, sf, 20)
    return rr.mmr_rerank(recs, vec, 0.3)


@query(
    "l6_greedy_feature_gain",
    walk_sql("gain", "1.0::DOUBLE", "0.5 * score + 0.5 * gain", "CASE WHEN genre = best_genre THEN gain / 2 ELSE gain END"),
)
def l6_gain(spark, sf):
    recs, _ = candidates(spark, sf, 20)
    return rr.greedy_feature_gain(recs, catalog(spark, sf), 0.5)


@query(
    "l6_listing_relevance",
    NEAR20.replace("WITH RECURSIVE ", "WITH ", 1) + """, apart AS (SELECT a."user", a.rank, sum(1 - list_cosine_similarity(a.w, b.w)) AS d FROM near a JOIN near b ON a."user" = b."user" AND b.rank < a.rank GROUP BY 1, 2)
SELECT "user", round(sum(0.5 * score / log2(rank + 1) + 0.5 * coalesce(d, 0) / rank), 6) AS mlr FROM near LEFT JOIN apart USING ("user", rank) GROUP BY 1""",
)
def l6_mlr(spark, sf):
    recs, vec = candidates(spark, sf, 20)
    return rounded(rr.mean_listing_relevance(recs, vec, 0.5), "mlr")


@query(
    "jn8_score_all",
    ctes(INTER, VEC, PROFILES) + """, s AS (SELECT "user", id AS track, round(list_dot_product(v, vector::DOUBLE[]), 9) AS score FROM prof, vec)
SELECT "user", track, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, track) AS rank FROM s) WHERE rank <= 100""",
)
def jn8_score_all(spark, sf):
    """All users against all items by blocks, top 100 kept."""
    vec = vectors(spark, sf)
    return rt.recommend(rt.mean_vectors(interactions(spark, sf), vec), vec, 100)


@query(
    "c1_toppop_unseen",
    ctes(INTER, PAIRS) + """, top AS (SELECT track, count(*) AS n FROM inter GROUP BY 1)
SELECT "user", track, CAST(rank AS INTEGER) AS rank FROM (SELECT u."user", t.track, row_number() OVER (PARTITION BY u."user" ORDER BY n DESC, t.track) AS rank
  FROM (SELECT DISTINCT "user" FROM inter) u, top t WHERE (u."user", t.track) NOT IN (SELECT ("user", track) FROM pairs)) WHERE rank <= 10""",
)
def c1_unseen(spark, sf):
    from ..operators.serving import toppop_unseen

    return toppop_unseen(interactions(spark, sf), 10)


@query(
    "jn9_user_overlap",
    ctes(INTER, PAIRS) + """, o AS (SELECT a.track AS j, b.track AS i, count(*)::DOUBLE AS n FROM pairs a JOIN pairs b ON a."user" = b."user" AND a.track <> b.track GROUP BY 1, 2) SELECT * FROM o""",
)
def jn9_overlap(spark, sf):
    """Number of common users of any two items, by blocks instead of a self-join."""
    rows = interactions(spark, sf).select("user", "track").distinct().withColumn("one", F.lit(1.0))
    return nb.column_products(rows, {"n": ("one", "one")}).where("j <> i")


