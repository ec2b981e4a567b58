"""Offline metrics on (user, track, rank) recommendation rows and (user, track) truth rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sum_vectors, vector_dim
from ..session import materialize
from .ordering import number_rows, sum_before


def _hits(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user, rank) of recommended items that are in the truth."""
    pairs = truth.select("user", "track").distinct()
    return recs.where(F.col("rank") <= k).select("user", "track", "rank").join(pairs, ["user", "track"])


def _truth_sizes(truth: DataFrame) -> DataFrame:
    return truth.select("user", "track").distinct().groupBy("user").agg(F.count(F.lit(1)).alias("n_truth"))


def precision_at_k(events: DataFrame, ranked: DataFrame, k: int, alias: str = "precision") -> DataFrame:
    """Per event: 1/k when the track is among the first k of one ranked list, else 0."""
    head = ranked.where(F.col("rank") <= k).select("track", F.lit(1.0 / k).alias(alias))
    return events.join(head, "track", "left").withColumn(alias, F.coalesce(alias, F.lit(0.0)))


def shuffled_precision_at_k(events: DataFrame, ranked: DataFrame, top: int, k: int, alias: str = "precision") -> DataFrame:
    """Expected precision when the first ``top`` items are shuffled before the cut at k: a hit within the top is among
    the first k with chance min(k, top) / top."""
    size = F.count(F.lit(1))
    head = ranked.where(F.col("rank") <= top)
    chance = head.agg(F.try_divide(F.least(size, F.lit(k)), size).alias("c")).scalar()
    hit = head.select("track", F.lit(1.0 / k).alias(alias)).withColumn(alias, F.col(alias) * chance)
    return events.join(hit, "track", "left").withColumn(alias, F.coalesce(alias, F.lit(0.0)))


def mrr(events: DataFrame, ranked: DataFrame, alias: str = "mrr") -> DataFrame:
    """Per event: 1 / rank of the track in one ranked list, 0 when it is absent."""
    places = ranked.select("track", (1.0 / F.col("rank")).alias(alias))
    return events.join(places, "track", "left").withColumn(alias, F.coalesce(alias, F.lit(0.0)))


def shuffled_mrr(events: DataFrame, ranked: DataFrame, top: int, alias: str = "mrr") -> DataFrame:
    """Expected reciprocal rank after a shuffle of the first ``top`` items: the mean of 1/1 .. 1/top for members."""
    head = ranked.where(F.col("rank") <= top)
    mean = head.agg(F.avg(1.0 / F.col("rank")).alias("m")).scalar()
    hit = head.select("track").withColumn(alias, mean)
    return events.join(hit, "track", "left").withColumn(alias, F.coalesce(alias, F.lit(0.0)))


def recall_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per user of the truth: hits / size of the truth."""
    found = _hits(recs, truth, k).groupBy("user").agg(F.count(F.lit(1)).alias("_h"))
    return (
        _truth_sizes(truth)
        .join(found, "user", "left")
        .select("user", (F.coalesce("_h", F.lit(0)) / F.col("n_truth")).alias("recall"))
    )


def user_precision_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    found = _hits(recs, truth, k).groupBy("user").agg(F.count(F.lit(1)).alias("_h"))
    return _truth_sizes(truth).join(found, "user", "left").select("user", (F.coalesce("_h", F.lit(0)) / k).alias("precision"))


def _discount(rank: Column, base: float) -> Column:
    return F.log(F.lit(float(base))) / F.log(rank + 1)


def ndcg_at_k(recs: DataFrame, truth: DataFrame, k: int, log_base: float = 2.0, achievable: bool = False) -> DataFrame:
    """Per user of the truth. The ideal list has k hits, or with ``achievable`` min(k, size of the truth)."""
    found = _hits(recs, truth, k).groupBy("user").agg(F.sum(_discount(F.col("rank"), log_base)).alias("_dcg"))
    depth = F.least(F.col("n_truth"), F.lit(k)) if achievable else F.lit(k)
    ideal = F.aggregate(
        F.sequence(F.lit(1), depth.cast("int")),
        F.lit(0.0),
        lambda acc, r: acc + _discount(r, log_base),
    )
    return (
        _truth_sizes(truth)
        .join(found, "user", "left")
        .select("user", (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"))
    )


def hit_rate(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    found = _hits(recs, truth, k).select("user").distinct().withColumn("_h", F.lit(1.0))
    return truth.select("user").distinct().join(found, "user", "left").select("user", F.coalesce("_h", F.lit(0.0)).alias("hit"))


def map_at_k(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Average precision per user: precision at every hit, divided by min(k, size of the truth)."""
    place = Window.partitionBy("user").orderBy("rank")  # at most k rows per user
    at_hit = _hits(recs, truth, k).withColumn("_p", F.row_number().over(place) / F.col("rank"))
    total = at_hit.groupBy("user").agg(F.sum("_p").alias("_s"))
    return (
        _truth_sizes(truth)
        .join(total, "user", "left")
        .select("user", (F.coalesce("_s", F.lit(0.0)) / F.least(F.col("n_truth"), F.lit(k))).alias("ap"))
    )


def pr_curve(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean precision and recall at every cut 1..k over the users of the truth, for the area under the curve."""
    sizes = _truth_sizes(truth)
    n = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_rank = (
        _hits(recs, truth, k).join(sizes, "user").groupBy("rank").agg(F.count(F.lit(1)).alias("_h"), F.sum(1 / F.col("n_truth")).alias("_r"))
    )
    cuts = recs.where(F.col("rank") <= k).select("rank").distinct()
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most k rows
    return (
        cuts.join(by_rank, "rank", "left")
        .withColumn("_h", F.sum(F.coalesce("_h", F.lit(0))).over(upto))
        .withColumn("_r", F.sum(F.coalesce("_r", F.lit(0.0))).over(upto))
        .withColumn("_n", n)
        .select("rank", (F.col("_h") / F.col("rank") / F.col("_n")).alias("precision"), (F.col("_r") / F.col("_n")).alias("recall"))
    )


def area_under(curve: DataFrame, x: str = "recall", y: str = "precision", order: str = "rank") -> DataFrame:
    """Step area under a curve of at most k points."""
    before = Window.orderBy(order)
    step = F.col(x) - F.coalesce(F.lag(x).over(before), F.lit(0.0))
    return curve.withColumn("_a", step * F.col(y)).agg(F.sum("_a").alias("area"))


def avg_rec_popularity(recs: DataFrame, train: DataFrame, k: int, normalize: bool = True) -> DataFrame:
    """Mean popularity of each user's list; normalised popularity is the item's share of all train rows."""
    counts = train.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))
    if normalize:
        total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
        counts = counts.withColumn("_n", F.col("_n") / total)
    listed = recs.where(F.col("rank") <= k).select("user", "track")
    return listed.join(counts, "track", "left").groupBy("user").agg(F.avg(F.coalesce(F.col("_n").cast("double"), F.lit(0.0))).alias("arp"))


def catalog_coverage(recs: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Share of the catalog that appears in some list."""
    size = catalog.select("track").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = recs.where(F.col("rank") <= k).select("track").distinct()
    return shown.agg(F.count(F.lit(1)).alias("_n")).select(F.try_divide(F.col("_n"), size).alias("coverage"))


def user_coverage(recs: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Share of users with any list, and with a full list of k."""
    sizes = recs.where(F.col("rank") <= k).groupBy("user").agg(F.count(F.lit(1)).alias("_n"))
    return (
        users.select("user")
        .distinct()
        .join(sizes, "user", "left")
        .agg(
            F.avg((F.coalesce("_n", F.lit(0)) > 0).cast("double")).alias("covered"),
            F.avg((F.coalesce("_n", F.lit(0)) >= k).cast("double")).alias("sufficient"),
        )
    )


def serendipity(recs: DataFrame, train: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per user: mean over k slots of relevance x max(p_user - p_popular, 0).

    Both chances come from ranks: (items + 1 - rank) / items, with the list rank for the user and the popularity rank
    in train for the item (unknown items count as the least popular).
    """
    counts = train.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(counts, [], [F.col("_n").desc(), "track"], "_pop_rank").select("track", "_pop_rank")
    size = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = (
        _hits(recs, truth, k)
        .join(ranked, "track", "left")
        .withColumn("_size", size)
        .withColumn("_p_user", (F.col("_size") + 1 - F.col("rank")) / F.col("_size"))
        .withColumn("_p_pop", (F.col("_size") + 1 - F.coalesce("_pop_rank", "_size")) / F.col("_size"))
        .groupBy("user")
        .agg((F.sum(F.greatest(F.col("_p_user") - F.col("_p_pop"), F.lit(0.0))) / k).alias("_s"))
    )
    return truth.select("user").distinct().join(scored, "user", "left").select("user", F.coalesce("_s", F.lit(0.0)).alias("serendipity"))


def rmse(df: DataFrame, label: str, prediction) -> DataFrame:
    guess = F.col(prediction) if isinstance(prediction, str) else prediction
    return df.agg(F.sqrt(F.avg((F.col(label) - guess) * (F.col(label) - guess))).alias("rmse"))


def baseline_rmse(train: DataFrame, test: DataFrame, label: str = "time") -> DataFrame:
    """RMSE on test of always predicting the train mean."""
    mean = train.agg(F.avg(label).alias("m")).scalar()
    return rmse(test.withColumn("_mean", mean), label, "_mean")


def precision_ci(per_user: DataFrame, value: str = "precision") -> DataFrame:
    """Mean and 1.96 standard errors."""
    return per_user.agg(
        F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width")
    )


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC by ranks with ties at half weight. Scores are first counted per value; positives below each value
    come from running counts over the sorted values, so no task holds all scores."""
    levels = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_q")
    )
    below = sum_before(levels, ["_s"], "_q", "_below")
    wins = F.col("_p") * (F.col("_below") + F.col("_q") * 0.5)
    return below.agg(F.try_divide(F.sum(wins), F.sum("_p").cast("double") * F.sum("_q")).alias("auc"))


def gini(counts: DataFrame, items: DataFrame | None = None, value: str = "n") -> DataFrame:
    """Gini index of exposure, items without exposure included.

    Items with equal counts take a run of ranks, so the index only needs how many items have each count: a run of c
    items after b others adds c * (2b + c - |I|) * p. The table of distinct counts stays small at any data size.
    """
    filled = counts
    if items is not None:
        filled = items.select("track").distinct().join(counts, "track", "left").withColumn(value, F.coalesce(value, F.lit(0)))
    levels = filled.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    totals = levels.agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.col("_v")).alias("t"))
    n, total = totals.select("n").scalar(), totals.select("t").scalar()
    before = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    runs = levels.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", n).withColumn("_t", total)
    share = F.coalesce(F.try_divide(F.col("_v"), F.col("_t")), F.lit(0.0))
    part = F.col("_c") * (2 * F.col("_b") + F.col("_c") - F.col("_n")) * share
    # one item, or no exposure at all, is spread evenly
    return runs.agg(F.when(F.max("_n") == 1, F.lit(0.0)).otherwise(F.try_divide(F.sum(part), F.max("_n") - 1)).alias("gini"))


def intra_list_diversity(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user: mean of 1 - cosine over the unordered pairs of the list, from the sum of the unit vectors (no pairs), and the
    number of list items whose vector is known; NULL for fewer than two of these. A zero vector has cosine 0 with every other."""
    dim = vector_dim(vectors)
    unit = vectors.select(F.col("id").alias("track"), _unit("vector").alias("vector"))
    long = F.exists("vector", lambda x: x != 0)
    sums = recs.select("user", "track").join(unit, "track").groupBy("user").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(long, 1)).alias("_long"), sum_vectors("vector", dim).alias("_s")
    )
    square = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x)
    mean = F.try_divide(square - F.col("_long"), F.col("_n") * (F.col("_n") - 1))
    known = sums.select("user", F.when(F.col("_n") > 1, 1 - mean).alias("diversity"), F.col("_n").alias("known"))
    users = recs.select("user").distinct().join(known, "user", "left")
    return users.withColumn("known", F.coalesce("known", F.lit(0)))


def _unit(vector: str) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def popularity_novelty(recs: DataFrame, train: DataFrame) -> DataFrame:
    """Per recommended row: 1 - share of the users who know the item; 1 where there are no users."""
    users = train.select("user").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    known = train.select("user", "track").distinct().groupBy("track").agg(F.count(F.lit(1)).alias("_u"))
    return (
        recs.join(known, "track", "left")
        .withColumn("novelty", 1 - F.coalesce(F.try_divide(F.coalesce("_u", F.lit(0)), users), F.lit(0.0)))
        .drop("_u")
    )


def unexpectedness(recs: DataFrame, history: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per recommended row: the largest -nPMI between the item and the items of the user's history.

    ``pairs`` (i, j, npmi) holds co-played pairs only, so the history items are counted first: when some of them never
    met the item, the largest -nPMI is 1 (npmi = -1); else it is the largest among the listed pairs.
    """
    own = history.select("user", F.col("track").alias("j")).distinct()
    sizes = own.groupBy("user").agg(F.count(F.lit(1)).alias("_all"))
    # pairs of items that nobody was recommended go first; written, the items' size is known to the join
    asked = materialize(recs.select(F.col("track").alias("i")).distinct(), "asked")
    met = (
        recs.select("user", F.col("track").alias("i"))
        .join(own, "user")
        .join(pairs.join(asked, "i", "left_semi"), ["i", "j"])
        .groupBy("user", "i")
        .agg(F.max(-F.col("npmi")).alias("_u"), F.count(F.lit(1)).alias("_met"))
    )
    # the item itself, when it is in the history, is no pair
    self_known = own.select("user", F.col("j").alias("i"), F.lit(1).alias("_self"))
    return (
        recs.select("user", F.col("track").alias("i"))
        .join(sizes, "user")
        .join(met, ["user", "i"], "left")
        .join(self_known, ["user", "i"], "left")
        .withColumn("_others", F.col("_all") - F.coalesce("_self", F.lit(0)))
        .select(
            "user",
            F.col("i").alias("track"),
            F.when(F.coalesce("_met", F.lit(0)) < F.col("_others"), F.lit(1.0)).otherwise(F.col("_u")).alias("unexpectedness"),
        )
    )


def calibration_gap(recs: DataFrame, history: DataFrame, catalog: DataFrame, by: str = "genre", smooth: float = 0.01) -> DataFrame:
    """Per user: L1 and smoothed KL distance between the feature shares of the history, p, and of the list, q."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        per = rows.select("user", "track").join(catalog.select("track", by), "track").groupBy("user", by).agg(F.count(F.lit(1)).alias("_c"))
        totals = per.groupBy("user").agg(F.sum("_c").alias("_t"))
        return per.join(totals, "user").select("user", by, (F.col("_c") / F.col("_t")).alias(name))

    both = shares(history, "_p").join(shares(recs, "_q"), ["user", by], "full")
    p, q = F.coalesce("_p", F.lit(0.0)), F.coalesce("_q", F.lit(0.0))
    mixed = (1 - smooth) * q + smooth * p
    kl = F.when(p > 0, p * F.log(p / mixed)).otherwise(0.0)
    listed = recs.select("user").distinct()
    return both.join(listed, "user", "left_semi").groupBy("user").agg(F.sum(F.abs(p - q)).alias("l1"), F.sum(kl).alias("kl"))


def cross_validate(models: dict, folds: list, metrics: dict) -> DataFrame:
    """Model x metric rows per fold. ``models`` maps a name to fit(train) -> recommendations, ``folds`` lists
    (train, test), ``metrics`` maps a name to f(recs, test, train) -> one-row frame. Each cell is a Spark job; the
    table of results is a union, evaluated as one query."""
    out = None
    for number, (train, test) in enumerate(folds):
        for model, fit in models.items():
            recs = fit(train)
            for metric, measure in metrics.items():
                one = measure(recs, test, train)
                row = one.select(
                    F.lit(model).alias("model"), F.lit(number).alias("fold"), F.lit(metric).alias("metric"), F.col(one.columns[0]).alias("value")
                )
                out = row if out is None else out.unionByName(row)
    return out
