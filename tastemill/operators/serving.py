"""Serving rules as joins: the next item for every event of a batch or micro-batch.

Random choices are hash draws of the event id, so a rerun of a batch gives the same answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_index
from ..functions.scalars import sigmoid, weighted_draw_key
from ..functions.vectors import dot
from ..session import materialize
from .interactions import nth_unseen
from .ordering import number_rows, seen_before, top_k_per


def dense_catalog(catalog: DataFrame) -> DataFrame:
    """(track, at): positions 0..n-1 in id order, written once for the lookups of all rules."""
    numbered = number_rows(catalog.select("track").distinct(), [], ["track"], "_rn")
    return materialize(numbered.select("track", (F.col("_rn") - 1).alias("at")), "dense-catalog")


def recommend_random(events: DataFrame, dense: DataFrame, key: str = "event_id", seed: int = 0, alias: str = "next") -> DataFrame:
    """Any track of the catalog."""
    # the catalog as it is when the rule is set up, for tables and streams alike
    size = F.lit(dense.count())
    drawn = events.withColumn("_n", size).withColumn("at", uniform_index(F.col("_n"), key, seed=seed)).drop("_n")
    return drawn.join(dense.withColumnRenamed("track", alias), "at", "left").drop("at")


def artist_index(catalog: DataFrame) -> DataFrame:
    """(track, artist, place, size): position of every track among its artist's tracks."""
    numbered = number_rows(catalog.select("artist", "track").distinct(), ["artist"], ["track"], "_rn")
    numbered = materialize(numbered.select("artist", "track", (F.col("_rn") - 1).alias("place")), "artist-index")
    sizes = numbered.groupBy("artist").agg(F.count(F.lit(1)).alias("size"))
    return numbered.join(sizes, "artist")


def recommend_sticky(
    events: DataFrame, index: DataFrame, dense: DataFrame, key: str = "event_id", seed: int = 0, alias: str = "next"
) -> DataFrame:
    """Another track of the artist just played; the same track when it is the artist's only one; a random track when the
    track is unknown. Tracks are addressed by position, so an artist's track list is never gathered."""
    own = index.select("track", F.col("artist").alias("_artist"), F.col("place").alias("_place"), F.col("size").alias("_size"))
    placed = events.join(own, "track", "left")
    draw = uniform_index(F.greatest(F.col("_size") - 1, F.lit(1)), key, seed=seed)
    # skip the own position: draws at or behind it move one up
    target = F.when(F.col("_size") == 1, F.lit(0)).otherwise(F.when(draw >= F.col("_place"), draw + 1).otherwise(draw))
    placed = placed.withColumn("_target", target)
    others = index.select(F.col("artist").alias("_artist"), F.col("place").alias("_target"), F.col("track").alias("_sticky"))
    chosen = placed.join(others, ["_artist", "_target"], "left").drop("_artist", "_target", "_place", "_size")
    filled = recommend_random(chosen, dense, key, seed, "_any")
    return filled.withColumn(alias, F.coalesce("_sticky", "_any")).drop("_sticky", "_any")


def recommend_sticky_mixed(
    events: DataFrame, index: DataFrame, dense: DataFrame, threshold: float = 0.3, key: str = "event_id", seed: int = 0, alias: str = "next"
) -> DataFrame:
    """Random when less than ``threshold`` of the track was played, else sticky."""
    sticky = recommend_sticky(events, index, dense, key, seed, "_s")
    both = recommend_random(sticky, dense, key, seed, "_r")
    return both.withColumn(alias, F.when(F.col("time") < threshold, F.col("_r")).otherwise(F.col("_s"))).drop("_s", "_r")


def recommend_indexed(
    events: DataFrame, lists: DataFrame, dense: DataFrame, key: str = "event_id", seed: int = 0, alias: str = "next"
) -> DataFrame:
    """A random element of the user's list (user, tracks); random track for users without one."""
    listed = events.join(lists.select("user", F.col("tracks").alias("_list")), "user", "left")
    place = uniform_index(F.greatest(F.size("_list"), F.lit(1)), key, seed=seed)
    picked = listed.withColumn("_own", F.get("_list", place.cast("int"))).drop("_list")
    return recommend_random(picked, dense, key, seed, "_any").withColumn(alias, F.coalesce("_own", "_any")).drop("_own", "_any")


def recommend_i2i(
    events: DataFrame, i2i: DataFrame, dense: DataFrame, key: str = "event_id", seed: int = 0, history: str = "history", alias: str = "next"
) -> DataFrame:
    """Item-to-item from the last listens: anchors are drawn by listened time without replacement; the first anchor with
    an unseen candidate gives the first such candidate of its list (track, item, rank); else a random track.

    ``history`` is the event's array of (track, time), at most ten long. The result keeps the anchor, which explains
    the recommendation ('because you played A').
    """
    heard = F.transform(history, lambda x: x["track"])
    # one row per track, so that an anchor meets its whole list at once; a list is as long as the neighbours asked for
    lists = i2i.where(F.col("track").isNotNull()).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_list"))
    weighed = F.transform(
        F.array_distinct(heard),
        lambda t: F.struct(
            t.alias("track"),
            F.aggregate(F.filter(history, lambda x: x["track"] == t), F.lit(0.0), lambda a, x: a + x["time"]).alias("w"),
        ),
    )
    anchors = events.select(key, F.array_distinct(heard).alias("_seen"), F.explode(weighed).alias("_a")).select(key, "_seen", "_a.track", "_a.w")
    anchors = anchors.withColumn("_draw", weighted_draw_key(uniform(key, "track", seed=seed), F.col("w")))
    # best = smallest (draw, anchor, list rank): the first unseen item of each anchor's list, then the first anchor
    unseen = F.get(F.filter("_list", lambda x: ~F.array_contains("_seen", x["item"])), F.lit(0))
    best = (
        anchors.join(lists, "track")
        .select(key, "_draw", "track", unseen.alias("_first"))
        .where(F.col("_first").isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct("_draw", "track", "_first")).alias("_b"))
        .select(key, F.col("_b._first.item").alias("_item"), F.col("_b.track").alias("anchor"))
    )
    joined = events.join(best, key, "left")
    return recommend_random(joined, dense, key, seed, "_any").withColumn(alias, F.coalesce("_item", "_any")).drop("_item", "_any")


def route(events: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]], column: str = "treatment") -> DataFrame:
    """Apply to each event the rule of its treatment; events of other treatments are left out."""
    out = None
    for treatment, rule in rules.items():
        part = rule(events.where(F.col(column) == treatment))
        out = part if out is None else out.unionByName(part)
    return out


def to_log(events: DataFrame, experiments: Column, started: str, finished: str) -> DataFrame:
    """Log records: message, timestamp, user, track, time, latency in seconds, recommendation (only on 'next'),
    experiment map."""
    return events.select(
        "message",
        F.col(finished).alias("timestamp"),
        "user",
        "track",
        "time",
        ((F.col(finished) - F.col(started)) / 1000).alias("latency"),
        F.when(F.col("message") == "next", F.col("recommendation")).alias("recommendation"),
        experiments.alias("experiments"),
    )


def toppop_draw(events: DataFrame, ranked: DataFrame, k: int, key: str = "event_id", seed: int = 0, alias: str = "next") -> DataFrame:
    """A random one of the k most popular items; ``ranked`` has (track, rank)."""
    top = ranked.where(F.col("rank") <= k).select(F.col("track").alias(alias), (F.col("rank") - 1).alias("at"))
    size = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = events.withColumn("_n", size).withColumn("at", uniform_index(F.col("_n"), key, seed=seed)).drop("_n")
    return drawn.join(top, "at", "left").drop("at")


def toppop_unseen(df: DataFrame, k: int) -> DataFrame:
    """The k most popular items each user has not played, straight from popularity positions: no user x item rows."""
    counts = df.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))
    order = materialize(
        number_rows(counts, [], [F.col("_n").desc(), "track"], "_rn").select("track", (F.col("_rn") - 1).alias("_at")), "popular"
    )
    known = df.select("user", "track").distinct().join(order, "track").select("user", "_at")
    size = order.agg(F.count(F.lit(1)).alias("n")).scalar()
    free = known.groupBy("user").agg((size - F.count(F.lit(1))).alias("_free"))
    ranks = free.withColumn("_rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("_rank < _free").withColumn(
        "rank", F.col("_rank") + 1
    )
    placed = nth_unseen(ranks.select("user", "rank", F.col("_rank").cast("long").alias("_rank")), known)
    return placed.join(order, "_at").select("user", "track", "rank")


def expected_time(
    recs: DataFrame,
    users: DataFrame,
    items: DataFrame,
    catalog: DataFrame,
    gamma: float = 0.8,
    order: tuple = ("rank",),
) -> DataFrame:
    """Expected played share per list row: logistic response to the user-item score, times gamma per earlier track of
    the same artist, 0 on a repeated track, rounded to two digits; NULL where the user's or the track's vector is unknown.
    Tracks of unknown artist are of an artist of their own.

    ``users`` has (user, vector, consume_bias, consume_sharpness); ``items`` (id, vector).
    """
    listed = (
        recs.join(users.withColumnRenamed("vector", "_u"), "user", "left")
        .join(items.select(F.col("id").alias("track"), F.col("vector").alias("_v")), "track", "left")
        .join(catalog.select("track", "artist"), "track", "left")
        .withColumn("artist", F.coalesce(F.concat(F.lit("="), "artist"), F.col("track").cast("string")))
        .withColumn("_raw", sigmoid((dot("_u", "_v") - F.col("consume_bias")) * F.col("consume_sharpness")))
        .select("user", "track", *order, "artist", "_raw")
    )
    flagged = seen_before(listed, ["user", "track"], list(order), "_again")
    # repeats do not count as plays of the artist
    place = Window.partitionBy("user", "artist").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = flagged.withColumn("_played", F.coalesce(F.sum((~F.col("_again")).cast("int")).over(place), F.lit(0)))
    value = F.when(F.col("_again"), F.lit(0.0)).otherwise(F.round(F.col("_raw") * F.pow(F.lit(gamma), F.col("_played")), 2))
    return counted.select("user", "track", *order, value.alias("time"))


def candidates_u2i2i(history: DataFrame, i2i: DataFrame, k: int, how: str = "max") -> DataFrame:
    """Two-step candidates: the user's items, then the items similar to them; best or summed score per (user, item)."""
    agg = F.max if how == "max" else F.sum
    merged = (
        history.select("user", "track")
        .distinct()
        .join(i2i.select("track", "item", "score"), "track")
        .groupBy("user", "item")
        .agg(F.round(agg("score"), 9).alias("score"))
    )
    ranked = top_k_per(merged, ["user"], [F.col("score").desc(), "item"], k)
    return ranked.select("user", F.col("item").alias("track"), "score", "rank")


def hard_negatives(candidates: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Candidates that passed the first stage but are not among the ranker's top k."""
    top = ranked.where(F.col("rank") <= k).select("user", "track")
    return candidates.join(top, ["user", "track"], "left_anti")


def explain_i2i(recommended: DataFrame, catalog: DataFrame) -> DataFrame:
    """'because you played A' for recommendations that came from an anchor."""
    titles = catalog.select(F.col("track").alias("anchor"), F.col("title").alias("_title"))
    named = recommended.join(titles, "anchor", "left")
    return named.withColumn(
        "because", F.when(F.col("_title").isNotNull(), F.concat(F.lit("because you played "), "_title"))
    ).drop("_title")

