"""Queries: scans, sinks, projections, joins, aggregates, sorts, set operations, scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as h
from ..functions import scalars as sc
from ..functions import vectors as ve
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import ordering as od
from ..operators import selects as se
from ..operators import text as tx
from ..session import scratch_path
from ..sources import readers as rd
from ..sources import schemas
from ..sources import writers as wr
from .domain import ab_log, catalog, interactions, log, table, vectors
from .q_events import rounded
from .registry import query
from .sqlparts import CATALOG, INTER, LOG, PAIRS, VEC, arms, assign_sql, ctes, uniform_sql

# ---------------------------------------------------------------- scans


@query(
    "s1_read_events",
    ctes(LOG, arms("I2I", 3)) + """SELECT log."user", "timestamp", track, message, round("time", 6) AS "time", recommendation,
  treatment AS i2i FROM log JOIN arms USING ("user")""",
)
def s1_events(spark, sf):
    """The log written by two replicas as JSON lines and read through a glob."""
    path = scratch_path(spark, "log")
    events = ab_log(spark, sf).drop("event_id")
    split = h.hash_split("user", 2)
    for replica in (0, 1):
        events.where(split == replica).write.json(f"{path}/log-{replica}")
    back = rd.read_events(spark, f"{path}/log-*")
    return rounded(
        back.select("user", "timestamp", "track", "message", "time", "recommendation", F.col("experiments")["I2I"].alias("i2i")),
        "time",
    )


@query(
    "s2_read_catalog",
    ctes(CATALOG) + "SELECT track, artist, title, pop, 0 AS n_recs FROM catalog",
)
def s2_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    items = catalog(spark, sf).select("track", "artist", "title", "pop")
    items.unionByName(items).write.json(path)
    return rd.read_catalog(spark, path).select("track", "artist", "title", "pop", F.size("recommendations").alias("n_recs"))


@query("s3_read_csv", ctes(INTER) + """SELECT "user", track, "time", "timestamp" FROM inter""")
def s3_csv(spark, sf):
    path = scratch_path(spark, "csv")
    rows = interactions(spark, sf).select("user", "track", "time", "timestamp")
    wr.write_csv(rows.withColumn("Unnamed: 0", F.monotonically_increasing_id()), path, ["Unnamed: 0", *rows.columns])
    return rd.read_interactions_csv(spark, path, index=True)


PLAYS = """SELECT CAST("user" AS VARCHAR) AS user_id, 'S' || track AS song_id, CAST(count(*) AS INTEGER) AS play_count
FROM inter GROUP BY 1, 2"""


@query("s4_read_triplets", ctes(INTER) + PLAYS)
def s4_triplets(spark, sf):
    path = scratch_path(spark, "triplets")
    plays = interactions(spark, sf).groupBy("user", "track").agg(F.count(F.lit(1)).alias("n"))
    plays.select("user", F.concat(F.lit("S"), "track"), "n").write.option("sep", "\t").csv(path)
    return rd.read_triplets(spark, path)


@query("s5_read_delimited", ctes(CATALOG) + "SELECT 'T' || track AS track_id, 'S' || track AS song_id, artist, title FROM catalog")
def s5_meta(spark, sf):
    path = scratch_path(spark, "meta")
    items = catalog(spark, sf)
    items.select(
        F.concat(F.lit("T"), "track").alias("track_id"), F.concat(F.lit("S"), "track").alias("song_id"), "artist", "title"
    ).write.option("sep", "<SEP>").csv(path)
    return rd.read_meta(spark, path)


@query("s6_read_embeddings", "SELECT vec_id AS id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def s6_embeddings(spark, sf):
    path = scratch_path(spark, "embeddings")
    vectors(spark, sf).select("id", "vector", F.lit(0.0).cast("float").alias("bias")).write.parquet(path)
    return rd.read_embeddings(spark, path).select(
        "id", F.size("vector").cast("long").alias("dim"), F.round(F.col("vector")[0].cast("double"), 6).alias("first")
    )


@query(
    "s7_read_users",
    """SELECT c_custkey AS "user", CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 5.0 END AS consume_bias,
  1.0::DOUBLE AS consume_sharpness, 5::BIGINT AS session_budget, 0.8::DOUBLE AS artist_discount_gamma FROM customer""",
)
def s7_users(spark, sf):
    path = scratch_path(spark, "users")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("consume_bias")
    ).write.json(path)
    return rd.read_users(spark, path).select(
        "user", "consume_bias", "consume_sharpness", "session_budget", "artist_discount_gamma"
    )


@query(
    "s9_pending_keys",
    ctes(INTER, CATALOG) + """, saved AS (SELECT DISTINCT artist, track FROM inter JOIN catalog USING (track) WHERE "time" > 0.9),
full_artists AS (SELECT artist FROM saved GROUP BY 1 HAVING count(*) >= 60)
SELECT artist, track FROM catalog WHERE artist NOT IN (SELECT artist FROM full_artists)
  AND (artist, track) NOT IN (SELECT (artist, track) FROM saved)""",
)
def s9_pending(spark, sf):
    items = catalog(spark, sf).select("artist", "track")
    saved = se.positives(interactions(spark, sf), 0.9).join(items, "track").select("artist", "track")
    return rd.pending_keys(items, saved, "artist", "track", 60).select("artist", "track")


# ---------------------------------------------------------------- sinks

TOP3 = """top3 AS (SELECT "user", track, rank FROM (SELECT "user", track, row_number() OVER (PARTITION BY "user"
  ORDER BY "time" DESC, track) AS rank FROM pairs) WHERE rank <= 3)"""


def top3(spark, sf):
    pairs = ag.aggregate_interactions(interactions(spark, sf))
    return od.top_k_per(pairs, ["user"], [F.col("time").desc(), "track"], 3)


LISTS = """SELECT "user", array_to_string(list(track ORDER BY rank), ',') AS tracks FROM top3 GROUP BY 1"""


def joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


@query("k1_write_user_recs", ctes(INTER, PAIRS, TOP3) + LISTS)
def k1_user_recs(spark, sf):
    path = scratch_path(spark, "user-recs")
    wr.write_user_recs(top3(spark, sf), path)
    return spark.read.schema("user long, tracks array<long>").json(path).select("user", joined("tracks").alias("tracks"))


@query(
    "k2_write_item_recs",
    ctes(INTER, PAIRS) + """, best AS (SELECT track, "user", row_number() OVER (PARTITION BY track ORDER BY "time" DESC, "user") AS rank
  FROM pairs)
SELECT track AS item_id, array_to_string(list("user" ORDER BY rank), ',') AS recommendations FROM best WHERE rank <= 5 GROUP BY 1""",
)
def k2_item_recs(spark, sf):
    path = scratch_path(spark, "item-recs")
    pairs = ag.aggregate_interactions(interactions(spark, sf))
    best = od.top_k_per(pairs, ["track"], [F.col("time").desc(), "user"], 5)
    wr.write_item_recs(best.select(F.col("track").alias("item_id"), F.col("user").alias("track"), "rank"), path)
    return spark.read.schema("item_id long, recommendations array<long>").json(path).select(
        "item_id", joined("recommendations").alias("recommendations")
    )




@query(
    "k3_attach_item_recs",
    ctes(CATALOG) + """, heads AS (SELECT artist, track AS item, row_number() OVER (PARTITION BY artist ORDER BY pop DESC, track) AS rank
  FROM catalog)
SELECT c.track, coalesce(array_to_string(list(h.item ORDER BY h.rank) FILTER (h.item IS NOT NULL), ','), '') AS recommendations
FROM catalog c LEFT JOIN heads h ON c.artist = h.artist AND h.rank <= 4 AND h.item <> c.track GROUP BY 1""",
)
def k3_attach(spark, sf):
    items = catalog(spark, sf)
    heads = od.top_k_per(items, ["artist"], [F.col("pop").desc(), "track"], 4).select(
        "artist", F.col("track").alias("item"), "rank"
    )
    recs = items.select("track", "artist").join(heads, "artist").where("item <> track").select("track", "item", "rank")
    path = scratch_path(spark, "catalog-recs")
    wr.write_catalog(wr.attach_item_recs(items.select("track", "title"), recs), path)
    return spark.read.schema("track long, title string, recommendations array<long>").json(path).select(
        "track", joined("recommendations").alias("recommendations")
    )


@query(
    "k4_write_csv",
    ctes(INTER, PAIRS) + """SELECT md5('salt' || "user") AS "user", track, round("time", 6) AS "time" FROM pairs""",
)
def k4_csv(spark, sf):
    path = scratch_path(spark, "submission")
    pairs = ag.aggregate_interactions(interactions(spark, sf))
    wr.write_csv(rounded(wr.anonymize(pairs, "user", "salt"), "time"), path, ["user", "track", "time"])
    return rd.read_interactions_csv(spark, path, "user string, track long, time double")


@query("k5_write_catalog", ctes(CATALOG) + "SELECT track, title, artist, genre, pop FROM catalog")
def k5_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    wr.write_catalog(catalog(spark, sf), path)
    return spark.read.schema("track long, title string, artist string, genre string, pop double").json(path)


@query("k6_publish_serving_table", ctes(INTER, PAIRS, TOP3) + LISTS)
def k6_publish(spark, sf):
    path = scratch_path(spark, "serving")
    lists = wr.ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    for _ in range(2):  # publishing twice leaves one row per key
        wr.publish_serving_table(lists, "user", path)
    return wr.read_serving_table(spark, path, lists.schema).select("user", joined("tracks").alias("tracks"))


@query(
    "k6_upsert_serving_table",
    ctes(INTER, PAIRS, TOP3) + f"""SELECT "user", CASE WHEN "user" % 3 = 0 THEN '0' ELSE tracks END AS tracks FROM ({LISTS})""",
)
def k6_upsert(spark, sf):
    """A third of the users gets a new list."""
    path = scratch_path(spark, "serving")
    lists = wr.ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    wr.publish_serving_table(lists, "user", path)
    fresh = lists.where(F.col("user") % 3 == 0).withColumn("tracks", F.array(F.lit(0).cast("long")))
    wr.upsert_serving_table(fresh, "user", path)
    return wr.read_serving_table(spark, path, lists.schema).select("user", joined("tracks").alias("tracks"))


@query(
    "k7_write_top_tracks",
    ctes(INTER) + """, pop AS (SELECT track, count(*) AS n FROM inter GROUP BY 1)
SELECT '[' || array_to_string(list(track ORDER BY n DESC, track), ',') || ']' AS value
FROM (SELECT * FROM pop ORDER BY n DESC, track LIMIT 100)""",
)
def k7_top(spark, sf):
    path = scratch_path(spark, "top-tracks")
    wr.write_top_tracks(ag.value_counts(interactions(spark, sf), "track"), path, 100, score="n")
    return spark.read.text(path)


@query(
    "k8_write_embeddings",
    "SELECT label || chr(9) || vec_id AS metadata, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings",
)
def k8_embeddings(spark, sf):
    """Line n of the vectors beside line n of the metadata."""
    path = scratch_path(spark, "projector")
    wr.write_embeddings(vectors(spark, sf), path, ["label", "id"])

    def lines(name, alias):
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).alias("part")
        rows = spark.read.option("wholetext", False).text(f"{path}/{name}")
        return rows.select(part, F.monotonically_increasing_id().alias("at"), F.col("value").alias(alias)).withColumn(
            "line", F.row_number().over(Window.partitionBy("part").orderBy("at"))
        ).drop("at")

    numbers = F.transform(F.split("vector", "\t"), lambda x: x.cast("float").cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    both = lines("metadata", "metadata").join(lines("vectors", "vector"), ["part", "line"])
    return both.select("metadata", (F.round(total, 4) + 0.0).alias("total"))


@query("k9_anonymize", """SELECT md5('pepper' || user_id) AS "user", count(*) AS n FROM events GROUP BY 1""")
def k9_anonymize(spark, sf):
    return ag.value_counts(wr.anonymize(log(spark, sf), "user", "pepper"), "user")


# ---------------------------------------------------------------- projections and filters


@query("p1_interactions", 'SELECT o_custkey AS "user", o_orderkey AS track, o_totalprice AS "time" FROM orders')
def p1_interactions(spark, sf):
    return se.interactions(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query(
    "p2_positives",
    ctes(INTER) + """SELECT 'train' AS kind, count(*) AS n, round(sum("time"), 4) AS total FROM inter WHERE "time" > 0.8
UNION ALL SELECT 'metric', count(*), round(sum("time"), 4) FROM inter WHERE "time" >= 0.8""",
)
def p2_positives(spark, sf):
    rows = interactions(spark, sf)
    parts = [
        se.positives(rows, 0.8, inclusive).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("time"), 4).alias("total")).select(
            F.lit(kind).alias("kind"), "n", "total"
        )
        for kind, inclusive in (("train", False), ("metric", True))
    ]
    return se.union_all(*parts)


@query("p3_not_null", ctes(LOG) + "SELECT event_id, recommendation FROM log WHERE recommendation IS NOT NULL")
def p3_not_null(spark, sf):
    return se.not_null(log(spark, sf), "recommendation").select("event_id", "recommendation")


@query(
    "p4_drop_incomplete",
    """SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
)
def p4_complete(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return se.drop_incomplete(docs, ["quality", "toxic"])


@query("p9_add_label", ctes(INTER) + """SELECT "row", CAST("time" > 0.6 AS INTEGER) AS label FROM inter""")
def p9_label(spark, sf):
    return se.add_label(interactions(spark, sf), 0.6).select("row", "label")


# ---------------------------------------------------------------- joins


@query(
    "jn1_popularity_catalog",
    ctes(LOG, CATALOG) + """SELECT track, title, artist, round(sum("time"), 6) AS popularity FROM log JOIN catalog USING (track) GROUP BY 1, 2, 3""",
)
def jn1_catalog(spark, sf):
    pop = ag.track_popularity(log(spark, sf))
    return rounded(jn.with_catalog(pop, catalog(spark, sf)).select("track", "title", "artist", "popularity"), "popularity")


@query(
    "jn2_left_fill",
    ctes(INTER, PAIRS) + f""", scores AS (SELECT "user", track, "time" AS score FROM pairs WHERE "time" > 0.5)
SELECT "user", track, round(coalesce(score, {uniform_sql('"user"', 'track')} * 0.01), 6) AS score
FROM pairs LEFT JOIN scores USING ("user", track)""",
)
def jn2_fill(spark, sf):
    pairs = ag.aggregate_interactions(interactions(spark, sf))
    scores = se.positives(pairs, 0.5).withColumnRenamed("time", "score")
    return rounded(jn.left_fill(pairs.select("user", "track"), scores, ["user", "track"]), "score")


@query(
    "jn3_join_last",
    ctes(INTER, CATALOG) + """SELECT "user", last(track ORDER BY "timestamp", "row") AS track,
  last(genre ORDER BY "timestamp", "row") AS genre FROM inter LEFT JOIN catalog USING (track) GROUP BY 1""",
)
def jn3_last(spark, sf):
    plays = interactions(spark, sf).select("user", "track", "timestamp", "row")
    genres = catalog(spark, sf).select("track", "genre")
    return jn.join_last(plays, genres, "track", "user", F.struct("timestamp", "row")).select("user", "track", "genre")


@query(
    "jn4_build_catalog",
    ctes(INTER, CATALOG) + """, pop AS (SELECT track, count(*) AS popularity FROM inter GROUP BY 1)
SELECT track, title, popularity, row_number() OVER (ORDER BY popularity DESC, track) - 1 AS index FROM catalog JOIN pop USING (track)""",
)
def jn4_catalog(spark, sf):
    pop = ag.value_counts(interactions(spark, sf), "track", alias="popularity")
    return jn.build_catalog(catalog(spark, sf).select("track", "title"), pop).select("track", "title", "popularity", "index")


@query(
    "jn4_missing_meta",
    ctes(INTER) + """SELECT track, count(*) AS popularity FROM inter WHERE track NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1""",
)
def jn4_missing(spark, sf):
    pop = ag.value_counts(interactions(spark, sf), "track", alias="popularity")
    return jn.missing_meta(pop, vectors(spark, sf).select(F.col("id").alias("track")))


@query("jn5_semi", ctes(INTER) + """SELECT "row" FROM inter WHERE track IN (SELECT vec_id FROM embeddings)""")
def jn5_semi(spark, sf):
    keys = vectors(spark, sf).select(F.col("id").alias("track"))
    return jn.semi(interactions(spark, sf), keys, ["track"]).select("row")


@query("jn6_anti", ctes(INTER) + """SELECT "row" FROM inter WHERE track NOT IN (SELECT vec_id FROM embeddings)""")
def jn6_anti(spark, sf):
    keys = vectors(spark, sf).select(F.col("id").alias("track"))
    return jn.anti(interactions(spark, sf), keys, ["track"]).select("row")


@query(
    "jn7_lookup_twice",
    ctes(LOG, CATALOG) + """SELECT event_id, p.artist AS prev_artist, r.artist AS rec_artist FROM log
LEFT JOIN catalog p ON log.track = p.track LEFT JOIN catalog r ON log.recommendation = r.track""",
)
def jn7_lookup(spark, sf):
    items = catalog(spark, sf)
    once = jn.lookup(log(spark, sf), items, "track", "artist", "track", "prev_artist")
    return jn.lookup(once, items, "track", "artist", "recommendation", "rec_artist").select(
        "event_id", "prev_artist", "rec_artist"
    )


@query(
    "jn10_item_features",
    ctes(LOG, CATALOG) + "SELECT event_id, genre, pop, size FROM log LEFT JOIN catalog USING (track)",
)
def jn10_features(spark, sf):
    feats = catalog(spark, sf).select("track", "genre", "pop", "size")
    return jn.join_item_features(log(spark, sf), feats).select("event_id", "genre", "pop", "size")


@query(
    "jn11_training_log",
    """WITH byday AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT CAST(d AS VARCHAR) AS epoch, round(max(CASE WHEN s = 'F' THEN v END), 4) AS train_loss,
  round(max(CASE WHEN s = 'O' THEN v END), 4) AS val_loss
FROM byday GROUP BY 1 HAVING train_loss IS NOT NULL AND val_loss IS NOT NULL""",
)
def jn11_log(spark, sf):
    """Order prices by day as a sparse two-metric log."""
    day = F.col("o_orderdate").cast("date").cast("string")
    rows = table(spark, sf, "orders").groupBy(day.alias("epoch"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    sparse = rows.select(
        "epoch",
        F.when(F.col("o_orderstatus") == "F", F.col("v")).alias("train_loss"),
        F.when(F.col("o_orderstatus") == "O", F.col("v")).alias("val_loss"),
    )
    return rounded(jn.join_training_log(sparse, ["train_loss", "val_loss"]), "train_loss", "val_loss", digits=4)


# ---------------------------------------------------------------- aggregates


@query("a1_mean_time", ctes(INTER, PAIRS) + """SELECT "user", track, round("time", 6) AS "time" FROM pairs""")
def a1_mean(spark, sf):
    return rounded(ag.aggregate_interactions(interactions(spark, sf)), "time")


@query("a2_popularity", ctes(INTER) + """SELECT track, round(sum("time"), 6) AS popularity FROM inter GROUP BY 1""")
def a2_pop(spark, sf):
    return rounded(ag.track_popularity(interactions(spark, sf)), "popularity")


@query("a3_value_counts", ctes(LOG) + "SELECT message, track, count(*) AS n FROM log GROUP BY 1, 2")
def a3_counts(spark, sf):
    return ag.value_counts(log(spark, sf), "message", "track")


@query(
    "a6_count_by",
    ctes(LOG, arms("AA", 2)) + """SELECT treatment, count("user") AS "user", count(track) AS track, count(recommendation) AS recommendation
FROM log JOIN arms USING ("user") GROUP BY 1""",
)
def a6_count_by(spark, sf):
    from .q_events import treated

    return ag.count_by(treated(spark, sf, "AA", 2).select("treatment", "user", "track", "recommendation"), "treatment")


def summary_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean,
  round(stddev_samp({column}), 6) AS std, round(min({column})::DOUBLE, 6) AS min,
  round(quantile_cont({column}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({column}::DOUBLE, 0.5), 6) AS q50,
  round(quantile_cont({column}::DOUBLE, 0.75), 6) AS q75, round(max({column})::DOUBLE, 6) AS max FROM {source}"""


@query("a7_summarize", f"{summary_sql('o_totalprice', 'orders')} UNION ALL {summary_sql('o_custkey', 'orders')}")
def a7_summary(spark, sf):
    df = ag.summarize(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(df, "mean", "std", "min", "q25", "q50", "q75", "max")


@query(
    "a8_episode_summary",
    ctes(LOG) + """SELECT "timestamp" // 86400000 AS "day", count("time") AS n, round(avg("time"), 6) AS mean,
  round(stddev_samp("time") / sqrt(count("time")), 6) AS sem FROM log GROUP BY 1""",
)
def a8_episodes(spark, sf):
    events = log(spark, sf).withColumn("day", F.floor(F.col("timestamp") / 86_400_000))
    return rounded(ag.episode_summary(events), "mean", "sem")


@query("a9_distinct_values", ctes(INTER) + "SELECT DISTINCT track FROM inter")
def a9_distinct(spark, sf):
    return ag.distinct_values(interactions(spark, sf), "track")


@query(
    "a9_count_distinct",
    ctes(INTER) + """SELECT 'user' AS "column", count(DISTINCT "user") AS n FROM inter UNION ALL SELECT 'track', count(DISTINCT track) FROM inter""",
)
def a9_count(spark, sf):
    return ag.count_distinct(interactions(spark, sf), ["user", "track"])


@query(
    "a10_dedup",
    """SELECT p_name AS title, p_brand AS artist, min(p_partkey) AS track FROM part GROUP BY 1, 2""",
)
def a10_dedup(spark, sf):
    return od.dedup(catalog(spark, sf), ["title", "artist"], ["track"]).select("title", "artist", "track")


@query(
    "a11_group_list",
    ctes(LOG) + """SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY "timestamp", event_id) AS place, track AS item FROM log""",
)
def a11_list(spark, sf):
    return ag.group_list(log(spark, sf), "user", "track", ["timestamp", "event_id"])


@query(
    "a11_group_last_max",
    ctes(LOG) + """SELECT "user", arg_max(track, event_id) AS track, round(max("time"), 6) AS best FROM log GROUP BY 1""",
)
def a11_last(spark, sf):
    events = log(spark, sf)
    last = ag.group_last(events, "user", ["track"], "event_id")
    best = ag.group_max(events, "user", "time").withColumnRenamed("time", "best")
    return rounded(last.join(best, "user"), "best")


@query(
    "a12_artist_tracks",
    ctes(CATALOG) + "SELECT artist, row_number() OVER (PARTITION BY artist ORDER BY track) AS place, track AS item FROM catalog",
)
def a12_artists(spark, sf):
    return ag.artist_tracks(catalog(spark, sf))


@query(
    "a13_histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""",
)
def a13_histogram(spark, sf):
    return ag.histogram(table(spark, sf, "orders"), "o_totalprice", 20).select("bin", "n")


@query(
    "a14_profile",
    ctes(LOG) + """SELECT 'recommendation' AS "column", CAST(sum(CASE WHEN recommendation IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  count(*) AS rows FROM log UNION ALL SELECT 'track', CAST(sum(CASE WHEN track IS NULL THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM log""",
)
def a14_profile(spark, sf):
    return ag.profile(log(spark, sf).select("recommendation", "track"))


@query(
    "a14_density",
    ctes(INTER) + """SELECT count(DISTINCT ("user", track)) AS cells, count(DISTINCT "user") AS users, count(DISTINCT track) AS items,
  round(count(DISTINCT ("user", track)) / (count(DISTINCT "user") * count(DISTINCT track)), 9) AS density FROM inter""",
)
def a14_density(spark, sf):
    return rounded(ag.density(interactions(spark, sf)), "density", digits=9)


FOLDS = """folds AS (SELECT p_type AS model, p_size % 5 AS fold, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1, 2)"""


def folds(spark, sf):
    return (
        catalog(spark, sf)
        .groupBy(F.col("genre").alias("model"), (F.col("size") % 5).alias("fold"))
        .agg(F.avg("pop").alias("price"), F.avg("size").alias("size"))
    )


@query(
    "a15_cv_mean",
    ctes(FOLDS) + "SELECT model, round(avg(price), 6) AS price, round(avg(size), 6) AS size FROM folds GROUP BY 1",
)
def a15_cv(spark, sf):
    return rounded(ag.cv_mean(folds(spark, sf)), "price", "size")


@query(
    "a16_metrics_table",
    ctes(FOLDS) + """SELECT model, round(avg(price), 6) AS price, round(avg(size), 6) AS size FROM folds GROUP BY 1""",
)
def a16_pivot(spark, sf):
    means = ag.cv_mean(folds(spark, sf))
    long = means.select(
        "model", F.explode(F.create_map(F.lit("price"), F.col("price"), F.lit("size"), F.col("size"))).alias("metric", "value")
    )
    return rounded(ag.metrics_table(long, ["price", "size"]), "price", "size")


@query(
    "a17_trim_categories",
    ctes(CATALOG) + """, head AS (SELECT artist FROM catalog GROUP BY 1 ORDER BY count(*) DESC, artist LIMIT 10)
SELECT CASE WHEN artist IN (SELECT artist FROM head) THEN artist ELSE 'other' END AS artist, count(*) AS n FROM catalog GROUP BY 1""",
)
def a17_trim(spark, sf):
    return ag.value_counts(ag.trim_categories(catalog(spark, sf), "artist", 10), "artist")


@query(
    "a18_array_profile",
    ctes(INTER, PAIRS, TOP3) + """, l AS (SELECT "user", list(track) AS t FROM top3 GROUP BY 1)
SELECT CAST(max(len(t)) AS INTEGER) AS longest, max(list_max(t)) AS max_value, min(list_min(t)) AS min_value FROM l""",
)
def a18_arrays(spark, sf):
    lists = wr.ranked_lists(top3(spark, sf), "user", "track", "rank", "tracks")
    return ag.array_profile(lists, "tracks")


@query(
    "a19_interest_stats",
    ctes(INTER, PAIRS, TOP3, CATALOG) + """SELECT artist, count(*) AS n, max(pop) AS max_pop FROM top3 JOIN catalog USING (track) GROUP BY 1""",
)
def a19_interests(spark, sf):
    users = wr.ranked_lists(top3(spark, sf), "user", "track", "rank", "interests")
    return ag.interest_stats(users, catalog(spark, sf))


# ---------------------------------------------------------------- sorts, samples, sets


@query(
    "o1_top_n",
    ctes(INTER) + "SELECT track, count(*) AS n FROM inter GROUP BY 1 ORDER BY n DESC, track LIMIT 20",
)
def o1_top(spark, sf):
    return od.top_n(ag.value_counts(interactions(spark, sf), "track"), [F.col("n").desc(), "track"], 20)


@query("o2_top_k_per", ctes(INTER, PAIRS, TOP3) + """SELECT "user", track, CAST(rank AS INTEGER) AS rank FROM top3""")
def o2_top_k(spark, sf):
    return top3(spark, sf).select("user", "track", "rank")


@query(
    "o3_head_items",
    ctes(INTER) + """, head AS (SELECT track FROM inter GROUP BY 1 ORDER BY count(*) DESC, track LIMIT 100)
SELECT "row" FROM inter WHERE track IN (SELECT track FROM head)""",
)
def o3_head(spark, sf):
    return jn.head_items(interactions(spark, sf), 100).select("row")


@query(
    "o4_sample_weighted",
    ctes(CATALOG) + f"""SELECT track FROM catalog ORDER BY -ln(greatest({uniform_sql('track', seed=7)}, 1e-18)) / greatest(pop, 1e-12), track LIMIT 100""",
)
def o4_sample(spark, sf):
    return od.sample_weighted(catalog(spark, sf), 100, "pop", ["track"], seed=7).select("track")


@query(
    "e1_union_all",
    """SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier""",
)
def e1_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return se.union_all(c, s)


@query(
    "e2_new_items",
    ctes(INTER, PAIRS, LOG) + """, recs AS (SELECT DISTINCT "user", recommendation AS track FROM log WHERE recommendation IS NOT NULL)
SELECT "user", track FROM recs WHERE ("user", track) NOT IN (SELECT ("user", track) FROM pairs)""",
)
def e2_new(spark, sf):
    recs = log(spark, sf).where("recommendation IS NOT NULL").select("user", F.col("recommendation").alias("track")).distinct()
    return jn.new_items(recs, interactions(spark, sf))


@query(
    "e3_symmetrize",
    """SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem""",
)
def e3_sym(spark, sf):
    return se.symmetrize(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query(
    "e4_merge_last",
    """WITH t AS (SELECT p_brand AS artist, 'cheap' AS tag, 0 AS p FROM part WHERE p_retailprice < 1000
  UNION SELECT p_brand, 'large', 1 FROM part WHERE p_size > 45 UNION SELECT p_brand, 'economy', 2 FROM part WHERE p_type = 'ECONOMY' AND p_size > 48)
SELECT artist, arg_max(tag, p) AS tag FROM t GROUP BY 1""",
)
def e4_merge(spark, sf):
    items = catalog(spark, sf)
    tags = [
        items.where(c).select("artist", F.lit(t).alias("tag")).distinct()
        for c, t in (("pop < 1000", "cheap"), ("size > 45", "large"), ("genre = 'ECONOMY' AND size > 48", "economy"))
    ]
    return jn.merge_last(tags, "artist")


@query("e5_replicate", "SELECT p_partkey AS track, CAST(i AS INTEGER) AS copy FROM part, range(1, 5) r(i)")
def e5_replicate(spark, sf):
    return se.replicate(catalog(spark, sf).select("track"), 4)


# ---------------------------------------------------------------- scalar functions


@query(
    "f1_normalize_text",
    """SELECT doc_id, md5(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS digest FROM documents""",
)
def f1_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(sc.normalize_text("text")).alias("digest"))


@query(
    "f2_parse_bounded_number",
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 1.0
  ELSE least(greatest(CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) * 1.0, 1.0), 100.0) END AS fans FROM orders""",
)
def f2_number(spark, sf):
    raw = F.when(F.col("o_custkey") % 10 == 0, "unknown").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", sc.parse_bounded_number(raw).alias("fans"))


@query(
    "f3_parse_numbered_list",
    """WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line FROM t)
SELECT doc_id, CAST(regexp_extract(line, '^([0-9]+)', 1) AS BIGINT) AS id, md5(trim(regexp_replace(line, '^[0-9]+[.]', ''), E' \\t\\r')) AS item
FROM lines WHERE trim(regexp_replace(line, '^[0-9]+[.]', ''), E' \\t\\r') <> ''""",
)
def f3_list(spark, sf):
    """Every document becomes a numbered list of its lines and is parsed back."""
    docs = table(spark, sf, "documents")
    numbered = F.array_join(
        F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )
    rows = tx.parse_numbered_list(docs.select("doc_id", numbered.alias("text")), "text")
    return rows.select("doc_id", "id", F.md5("item").alias("item"))


@query(
    "f4_reconcile",
    """SELECT p_partkey AS track, p_brand AS artist, CASE WHEN p_size % 3 = 0 THEN 'none'
  WHEN p_size % 3 = 1 THEN NULL ELSE lower(p_brand) END AS alternative_artist FROM part""",
)
def f4_reconcile(spark, sf):
    answer = F.when(F.col("size") % 3 == 1, F.col("artist")).when(F.col("size") % 3 == 2, F.lower("artist"))
    items = catalog(spark, sf).withColumn("answer", answer)
    return tx.reconcile(items, "artist", "answer").select("track", "artist", "alternative_artist")


@query(
    "f5_describe_item",
    """SELECT p_partkey AS track, 'Track ''' || p_name || ''' by ''' || p_brand || ''', genres: '
  || array_to_string([p_type, p_brand], ', ') AS text FROM part""",
)
def f5_describe(spark, sf):
    text = tx.describe_item(
        "Track '{title}' by '{artist}', genres: {genres}",
        title="title", artist="artist", genres=F.array_join(F.array("genre", "artist"), ", "),
    )
    return catalog(spark, sf).select("track", text.alias("text"))


@query(
    "f6_json",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS record
FROM events""",
)
def f6_json(spark, sf):
    events = table(spark, sf, "events").withColumnsRenamed({"user_id": "user", "event_type": "type"})
    return events.select("event_id", sc.from_json_field("props", "k", "int").alias("k"), sc.to_json_record("user", "type").alias("record"))


@query(
    "f7_math",
    """SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sig, round(ln(value + 1), 6) AS lg, round(sqrt(value), 6) AS sq,
  round(pow(0.8, value / 100), 6) AS pw, least(greatest(value, 1.0), 100.0) AS clipped FROM events""",
)
def f7_math(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(sc.sigmoid((v - 50) / 10), 6).alias("sig"), F.round(F.log(v + 1), 6).alias("lg"),
        F.round(F.sqrt(v), 6).alias("sq"), F.round(F.pow(F.lit(0.8), v / 100), 6).alias("pw"), sc.clip(v, 1.0, 100.0).alias("clipped"),
    )


@query(
    "f8_arrays",
    ctes(INTER, PAIRS, TOP3) + """, l AS (SELECT "user", list(track ORDER BY rank) AS t FROM top3 GROUP BY 1)
SELECT "user", t[1] AS first, array_to_string(list_concat(t, [-1, -1, -1, -1, -1])[1:5], ',') AS padded,
  array_to_string(list_transform(t, lambda x: CASE WHEN x = t[1] THEN -1 ELSE x END), ',') AS masked,
  CAST(coalesce(list_position(t, t[2]), 0) AS BIGINT) AS place FROM l""",
)
def f8_arrays(spark, sf):
    lists = wr.ranked_lists(top3(spark, sf), "user", "track", "rank", "t")
    t = F.col("t")
    return lists.select(
        "user", sc.first_element("t").alias("first"), joined(sc.pad_array("t", 5, -1)).alias("padded"),
        joined(sc.mask_array("t", [F.get(t, F.lit(0))], -1)).alias("masked"),
        F.coalesce(F.array_position(t, F.get(t, F.lit(1))), F.lit(0)).alias("place"),
    )


@query(
    "f9_vectors",
    ctes(VEC) + """, m AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(vector[i]::DOUBLE) AS v FROM vec, range(1, 65) r(i)
  GROUP BY 1, 2) GROUP BY 1)
SELECT id, round(list_dot_product(vector::DOUBLE[], c), 6) AS dot, round(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 6) AS norm,
  round(list_cosine_similarity(vector::DOUBLE[], c), 6) AS cosine, round(list_distance(vector::DOUBLE[], c), 6) AS l2 FROM vec JOIN m USING (label)""",
)
def f9_vectors(spark, sf):
    vec = vectors(spark, sf)
    dim = ve.vector_dim(vec)
    mean = vec.groupBy("label").agg(ve.sum_vectors("vector", dim).alias("s"), F.count(F.lit(1)).alias("n"))
    centres = mean.select("label", ve.scale("s", 1 / F.col("n")).alias("c"))
    return vec.join(centres, "label").select(
        "id", F.round(ve.dot("vector", "c"), 6).alias("dot"), F.round(ve.norm("vector"), 6).alias("norm"),
        F.round(ve.cosine("vector", "c"), 6).alias("cosine"), F.round(ve.l2("vector", "c"), 6).alias("l2"),
    )


@query(
    "f9_center_normalize",
    ctes(VEC) + """, m AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(vector[i]::DOUBLE) AS v FROM vec, range(1, 65) r(i) GROUP BY 1)),
d AS (SELECT id, list_transform(range(1, 65), lambda i: vector[i]::DOUBLE - c[i]) AS x FROM vec, m)
SELECT id, round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first, round(x[64] / sqrt(list_dot_product(x, x)), 6) AS last FROM d""",
)
def f9_center(spark, sf):
    out = ve.center_and_normalize(vectors(spark, sf))
    return out.select("id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


@query(
    "f10_hashes",
    f"""SELECT p_partkey AS track, md5('s' || p_partkey) AS salted, {assign_sql('p_partkey', 'HSTU', 2)} AS arm FROM part""",
)
def f10_hash(spark, sf):
    from ..operators.experiments import assign

    return catalog(spark, sf).select("track", h.salted_md5("track", "s").alias("salted"), assign("track", "HSTU", 2).alias("arm"))


@query(
    "f11_hash_split",
    """SELECT c_custkey AS "user", CAST(('0x' || substr(md5(c_custkey::VARCHAR), 1, 13)) AS BIGINT) % 2 = 0 AS public FROM customer""",
)
def f11_split(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), (h.hash_split("c_custkey") == 0).alias("public"))


@query("f12_event_time", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, (epoch_us(ts) // 1000) AS ms FROM events")
def f12_time(spark, sf):
    at = sc.event_time("timestamp")
    return log(spark, sf).select("event_id", F.year(at).alias("year"), F.unix_millis(at).alias("ms"))


@query(
    "f13_reaction",
    ctes(LOG) + """SELECT CASE WHEN "time" > 0.8 THEN 'good' WHEN "time" < 0.2 THEN 'bad' ELSE 'neutral' END AS reaction, count(*) AS n FROM log GROUP BY 1""",
)
def f13_reaction(spark, sf):
    return ag.value_counts(log(spark, sf).select(sc.reaction("time").alias("reaction")), "reaction")


@query(
    "l18_head_share",
    ctes(INTER) + """, c AS (SELECT track, count(*) AS n FROM inter GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, track) AS rn, count(*) OVER () AS items, sum(n) OVER () AS total FROM c)
SELECT count(*) AS head_items, CAST(sum(n) AS BIGINT) AS head_sum, round(sum(n) / max(total), 6) AS share FROM r WHERE rn <= ceil(items * 0.2)""",
)
def l18_head(spark, sf):
    return rounded(ag.head_share(ag.value_counts(interactions(spark, sf), "track"), 0.2), "share")
