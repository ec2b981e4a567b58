"""Queries: interaction preparation and feature rows."""

from pyspark.sql import functions as F

from ..operators import interactions as it
from ..operators import selects as se
from ..operators.ordering import top_k_per
from .domain import catalog, interactions, table
from .q_basics import joined
from .q_events import rounded
from .registry import query
from .sqlparts import CATALOG, INTER, PAIRS, ctes, uniform_sql


def pairs_of(spark, sf):
    return interactions(spark, sf).select("user", "track").distinct()


SUPPORT = ctes(INTER) + """, pos AS (SELECT "user", track, "row" FROM inter WHERE "time" > 0.7),
goodi AS (SELECT track FROM pos GROUP BY 1 HAVING count(*) >= 9)"""


@query(
    "i1_support_filter",
    SUPPORT + """, goodu AS (SELECT "user" FROM pos GROUP BY 1 HAVING count(*) >= 12)
SELECT "row" FROM pos WHERE "user" IN (SELECT "user" FROM goodu) AND track IN (SELECT track FROM goodi)""",
)
def i1_support(spark, sf):
    pos = se.positives(interactions(spark, sf), 0.7)
    return it.support_filter(pos, 12, 9).select("row")


@query(
    "i1_support_items_first",
    SUPPORT + """, kept AS (SELECT * FROM pos WHERE track IN (SELECT track FROM goodi)),
goodu AS (SELECT "user" FROM kept GROUP BY 1 HAVING count(*) >= 12) SELECT "row" FROM kept WHERE "user" IN (SELECT "user" FROM goodu)""",
)
def i1_items_first(spark, sf):
    pos = se.positives(interactions(spark, sf), 0.7)
    return it.support_filter(pos, 12, 9, order="items_first").select("row")


CUT = 946684800000  # 2000-01-01, about the middle of the order dates


@query(
    "i2_warm_test",
    ctes(INTER) + f"""SELECT "row" FROM inter WHERE "timestamp" >= {CUT} AND "user" IN (SELECT "user" FROM inter WHERE "timestamp" < {CUT})
  AND track IN (SELECT track FROM inter WHERE "timestamp" < {CUT})""",
)
def i2_warm(spark, sf):
    train, test = it.time_split(interactions(spark, sf), CUT)
    return it.warm_test(test, train).select("row")


@query(
    "i3_random_split",
    ctes(INTER) + f"""SELECT "row", CASE WHEN u < 0.8 THEN 0 WHEN u < 0.9 THEN 1 ELSE 2 END AS part
FROM (SELECT "row", {uniform_sql('"row"', seed=42)} AS u FROM inter)""",
)
def i3_split(spark, sf):
    return it.random_split(interactions(spark, sf), [80, 10, 10], ["row"], seed=42).select("row", "part")


@query(
    "i4_split_by_source",
    """SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'
  AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O') AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')""",
)
def i4_sources(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus")
    _, test = it.split_by_source(
        lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), user="l_suppkey", item="l_partkey"
    )
    return test.select("l_orderkey", "l_partkey")


@query("i5_dense_index_sorted", ctes(INTER) + """SELECT track, row_number() OVER (ORDER BY track) - 1 AS index FROM (SELECT DISTINCT track FROM inter)""")
def i5_sorted(spark, sf):
    return it.dense_index(interactions(spark, sf), "track")


@query(
    "i5_dense_index_first",
    ctes(INTER) + """SELECT track, row_number() OVER (ORDER BY at_, track) - 1 AS index FROM (SELECT track, min("timestamp") AS at_ FROM inter GROUP BY 1)""",
)
def i5_first(spark, sf):
    return it.dense_index(interactions(spark, sf), "track", "first", ts="timestamp")


@query(
    "i5_dense_index_popularity",
    ctes(INTER) + """SELECT track, row_number() OVER (ORDER BY n DESC, track) - 1 AS index FROM (SELECT track, count(*) AS n FROM inter GROUP BY 1)""",
)
def i5_pop(spark, sf):
    return it.dense_index(interactions(spark, sf), "track", "popularity")


@query("i6_inverse_index", ctes(INTER) + """SELECT "row", track FROM inter""")
def i6_inverse(spark, sf):
    rows = interactions(spark, sf).select("row", "track")
    index = it.dense_index(rows, "track")
    coded = it.to_index(rows, index, "track", "i").drop("track")
    return it.from_index(coded, index, "track", "i").select("row", "track")


ITEMS = """items AS (SELECT p_partkey AS track, row_number() OVER (ORDER BY p_partkey) - 1 AS at_, count(*) OVER () AS n FROM part)"""


def draws_sql(n: int, seed: int) -> str:
    u = uniform_sql('"user"', "track", "d", seed=seed)
    return f"""draws AS (SELECT "user", track, CAST(d AS INTEGER) AS draw, CAST(floor({u} * (SELECT max(n) FROM items)) AS BIGINT) AS at_
  FROM (SELECT DISTINCT "user", track FROM inter), range(1, {n + 1}) r(d))"""


@query(
    "i7_negatives",
    ctes(INTER, ITEMS, draws_sql(4, 0)) + """SELECT "user", draws.track, draw, items.track AS negative FROM draws JOIN items USING (at_)""",
)
def i7_negatives(spark, sf):
    return it.sample_negatives(pairs_of(spark, sf), catalog(spark, sf), 4).select("user", "track", "draw", "negative")


@query(
    "i8_unseen_negatives",
    ctes(INTER, ITEMS) + f""", p AS (SELECT DISTINCT "user", track FROM inter),
unseen AS (SELECT u."user", i.track, row_number() OVER (PARTITION BY u."user" ORDER BY i.track) - 1 AS rk, count(*) OVER (PARTITION BY u."user") AS free
  FROM (SELECT DISTINCT "user" FROM p) u, items i WHERE (u."user", i.track) NOT IN (SELECT ("user", track) FROM p)),
sizes AS (SELECT DISTINCT "user", free FROM unseen),
d AS (SELECT p."user", p.track, CAST(d AS INTEGER) AS draw, CAST(floor({uniform_sql('p."user"', 'p.track', 'd', seed=3)} * free) AS BIGINT) AS rk
  FROM p JOIN sizes USING ("user"), range(1, 3) r(d))
SELECT d."user", d.track, d.draw, u.track AS negative FROM d JOIN unseen u ON d."user" = u."user" AND d.rk = u.rk""",
)
def i8_unseen(spark, sf):
    out = it.sample_negatives(pairs_of(spark, sf), catalog(spark, sf), 2, exclude_seen=True, seed=3)
    return out.select("user", "track", "draw", "negative")


@query(
    "i9_eval_negatives",
    ctes(INTER, ITEMS) + f""", last_ AS (SELECT "user", track FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY "timestamp" DESC, "row") AS rn FROM inter) WHERE rn = 1),
d AS (SELECT "user", track, CAST(d AS INTEGER) AS draw, CAST(floor({uniform_sql('"user"', 'track', 'd', seed=1)} * (SELECT max(n) FROM items)) AS BIGINT) AS at_
  FROM last_, range(1, 11) r(d))
SELECT "user", d.track, draw, items.track AS negative FROM d JOIN items USING (at_)""",
)
def i9_eval(spark, sf):
    held = top_k_per(interactions(spark, sf), ["user"], [F.col("timestamp").desc(), "row"], 1).select("user", "track")
    return it.eval_negatives(held, catalog(spark, sf), 10).select("user", "track", "draw", "negative")


HISTORY = f"""ranked AS (SELECT "user", track, row_number() OVER (PARTITION BY "user" ORDER BY {uniform_sql('"user"', 'track', seed=0)}, track) AS r
  FROM (SELECT DISTINCT "user", track FROM inter)),
hist AS (SELECT c_custkey AS "user", list_concat(coalesce(l, []), list_transform(range(30), lambda x: 50000))[1:30] AS h FROM customer
  LEFT JOIN (SELECT "user", list(track ORDER BY r) AS l FROM ranked WHERE r <= 30 GROUP BY 1) q ON c_custkey = q."user")"""


def histories(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))
    return it.play_history(interactions(spark, sf), 30, 50_000, users)


@query("i10_play_history", ctes(INTER, HISTORY) + """SELECT "user", array_to_string(h, ',') AS history FROM hist""")
def i10_history(spark, sf):
    return histories(spark, sf).select("user", joined("history").alias("history"))


@query(
    "i11_mask_history",
    ctes(INTER, HISTORY) + """SELECT DISTINCT i."user", i.track, md5(array_to_string(list_transform(h, lambda x: CASE WHEN x = i.track THEN 50000 ELSE x END), ',')) AS history
FROM inter i JOIN hist USING ("user")""",
)
def i11_mask(spark, sf):
    rows = pairs_of(spark, sf).join(histories(spark, sf), "user")
    return it.mask_history(rows, ["track"]).select("user", "track", F.md5(joined("history")).alias("history"))


TYPES = ["ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL"]


@query(
    "i12_multi_hot",
    ctes(CATALOG) + "SELECT artist, " + ", ".join(f"CAST(max(CASE WHEN genre = '{t}' THEN 1 ELSE 0 END) AS INTEGER) AS genre_{t}" for t in TYPES) + " FROM catalog GROUP BY 1",
)
def i12_multi_hot(spark, sf):
    return it.multi_hot(catalog(spark, sf), "artist", "genre", TYPES)


@query(
    "i13_item_features_long",
    ctes(CATALOG) + """SELECT track AS id, 'artist' AS feature, artist AS value FROM catalog UNION ALL
SELECT track, 'word', unnest(string_split(title, ' ')) FROM catalog""",
)
def i13_features(spark, sf):
    items = catalog(spark, sf).withColumn("words", F.split("title", " "))
    return it.item_features_long(items, {"artist": "artist", "word": "words"})


@query(
    "i14_fill_missing",
    "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def i14_fill(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return it.fill_missing(docs, {"quality": -1, "toxic": 0})


@query(
    "i15_standardize",
    ctes(CATALOG) + """SELECT track, round((pop - avg(pop) OVER ()) / stddev_pop(pop) OVER (), 6) AS pop,
  round((size - avg(size) OVER ()) / stddev_pop(size) OVER (), 6) AS size FROM catalog""",
)
def i15_standardize(spark, sf):
    return rounded(it.standardize(catalog(spark, sf).select("track", "pop", "size"), ["pop", "size"]), "pop", "size")


@query(
    "i16_label_encode",
    ctes(CATALOG) + """SELECT track, dense_rank() OVER (ORDER BY CASE WHEN size % 7 <> 0 THEN artist END NULLS FIRST) - 1 AS artist,
  dense_rank() OVER (ORDER BY genre) - 1 AS genre FROM catalog""",
)
def i16_encode(spark, sf):
    """Some artists are unknown."""
    known = F.when(F.col("size") % 7 != 0, F.col("artist")).alias("artist")
    return it.label_encode(catalog(spark, sf).select("track", known, "genre"), ["artist", "genre"])


@query(
    "i17_training_rows",
    ctes(INTER, ITEMS, CATALOG, draws_sql(3, 5)) + """, rows_ AS (SELECT DISTINCT "user", track, 1 AS label FROM inter UNION ALL
  SELECT "user", items.track, 0 FROM draws JOIN items USING (at_))
SELECT "user", track, label, genre, pop FROM rows_ LEFT JOIN catalog USING (track)""",
)
def i17_training(spark, sf):
    feats = catalog(spark, sf).select("track", "genre", "pop")
    return it.training_rows(pairs_of(spark, sf), catalog(spark, sf), 3, feats, seed=5).select("user", "track", "label", "genre", "pop")


@query(
    "i18_triplets",
    ctes(INTER, ITEMS, draws_sql(4, 9)) + f""", t AS (SELECT "user", draws.track AS positive, items.track AS negative,
  {uniform_sql('"user"', 'draws.track', 'draw', seed=10)} AS u FROM draws JOIN items USING (at_))
SELECT "user", positive, negative, CASE WHEN u < 0.9 THEN 0 WHEN u < 0.95 THEN 1 ELSE 2 END AS part FROM t""",
)
def i18_triplets(spark, sf):
    rows = it.triplets(interactions(spark, sf), catalog(spark, sf), 4, [90, 5, 5], seed=9)
    return rows.select("user", "positive", "negative", "part")


@query(
    "l23_time_split",
    ctes(INTER) + f"""SELECT CASE WHEN "timestamp" < {CUT} THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM inter GROUP BY 1""",
)
def l23_time(spark, sf):
    train, test = it.time_split(interactions(spark, sf), CUT)
    return se.union_all(*[d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p, d in (("train", train), ("test", test))])


@query(
    "l23_pair_folds",
    ctes(INTER, PAIRS) + """SELECT "user", track, CAST(('0x' || substr(md5("user" || '|' || track), 1, 13)) AS BIGINT) % 5 AS fold FROM pairs""",
)
def l23_folds(spark, sf):
    return it.pair_folds(pairs_of(spark, sf), 5)
