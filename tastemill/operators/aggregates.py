"""Aggregations: counts, summaries, histograms, pivots. All combine map-side; no group is collected whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_rows, sum_before, top_n


def aggregate_interactions(df: DataFrame, agg: str = "avg", keys: tuple = ("user", "track"), value: str = "time"):
    """One row per (user, item): mean, sum, max or count of the value."""
    how = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[agg]
    return df.groupBy(*keys).agg(how(value).alias(value))


def track_popularity(df: DataFrame, item: str = "track", value: str = "time", alias: str = "popularity") -> DataFrame:
    return df.groupBy(item).agg(F.sum(value).alias(alias))


def value_counts(df: DataFrame, *columns: str, alias: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(alias))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Non-null count of every other column per key."""
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in df.columns if c != key])


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> DataFrame:
    """(p, value) with linear interpolation. Values are counted, range-sorted and addressed by position, so no task
    holds the column."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _quantiles_of_counts(values, probabilities)


def _quantiles_of_counts(values: DataFrame, probabilities: list[float]) -> DataFrame:
    cumulated = sum_before(values, ["value"], "n", "_upto").withColumn("_upto", F.col("_upto") + F.col("n"))
    total = values.agg(F.sum("n").alias("t")).scalar()
    found = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
    marked = cumulated.withColumn("_total", total)
    low, high = F.col("_upto") - F.col("n"), F.col("_upto") - 1
    picks = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                (s - F.floor(s)).alias("share"),
                ((F.floor(s) >= low) & (F.floor(s) <= high)).alias("is_low"),
                ((F.ceil(s) >= low) & (F.ceil(s) <= high)).alias("is_high"),
            )
            for p, s in zip(probabilities, found)
        ]
    )
    hit = F.filter(picks, lambda x: x["is_low"] | x["is_high"])
    return (
        marked.select("value", F.explode(hit).alias("h"))
        .groupBy(F.col("h.p").alias("p"))
        .agg(
            F.max(F.when(F.col("h.is_low"), F.col("value"))).alias("_a"),
            F.max(F.when(F.col("h.is_high"), F.col("value"))).alias("_b"),
            F.max("h.share").alias("_w"),
        )
        .select("p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("value"))
    )


#: One part in this many: how far from its place a bracket's end may lie.
ACCURACY = 2_000
#: Distinct values of a bracket that are put in order by one task.
ORDERED = 2_000_000


def quantiles_by_refinement(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(column, p, value): exact quantiles of several columns with linear interpolation, without sorting any of them.

    A sketch of all columns brackets every quantile; one pass then counts the rows below each bracket and the distinct values in
    it, a few thousandths of the rows, in which the quantile's place is looked up. A bracket with more than ``ORDERED``
    distinct values is bracketed again inside, as long as that halves it, and one that the sketch missed by more than it promises is widened, so that
    the result never depends on the sketch. NULLs are left out; NaN is larger than all numbers, as in Spark's order.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    sizes = wide.agg(*[F.count(f"_{i}").alias(f"_{i}") for i in range(len(columns))]).first()
    goals = {(i, p): p * (sizes[i] - 1) for i in range(len(columns)) for p in probabilities if sizes[i]}
    if not goals:
        return wide.sparkSession.createDataFrame([], "column string, p double, value double")
    brackets: dict[tuple, tuple] = dict.fromkeys(goals, (None, None))  # None: open
    spread = {key: 2.0 / ACCURACY for key in goals}

    def inside(key: tuple) -> Column:
        low, high = brackets[key]
        value = F.col(f"_{key[0]}")
        within = value.isNotNull()
        within = within if low is None else within & (value >= low)
        return within if high is None else within & (value <= high)

    pending = list(goals)
    first = True
    while pending:
        # ends of the brackets, from a sketch of what is in them
        asked = []
        for key in pending:
            value = F.when(inside(key) & ~F.isnan(f"_{key[0]}"), F.col(f"_{key[0]}"))
            share = key[1] if first else spread[key, "at"]
            ends = [max(0.0, share - spread[key]), min(1.0, share + spread[key])]
            asked.append(F.percentile_approx(value, ends, ACCURACY))
        for key, ends, share in zip(pending, wide.agg(*asked).first(), [key[1] for key in pending], strict=True):
            low, high = ends or (None, None)
            edge = spread[key]
            old = brackets[key]
            brackets[key] = (old[0] if first and share - edge <= 0 else low, old[1] if first and share + edge >= 1 else high)
        below = [F.sum((F.col(f"_{k[0]}") < brackets[k][0]).cast("long")) if brackets[k][0] is not None else F.lit(0) for k in pending]
        within = [F.sum(inside(k).cast("long")) for k in pending]
        some = [F.approx_count_distinct(F.when(inside(k), F.col(f"_{k[0]}"))) for k in pending]
        got = list(wide.agg(*below, *within, *some).first())
        n = len(pending)
        later = []
        for at, key in enumerate(pending):
            before, held, distinct = got[at] or 0, got[n + at] or 0, got[2 * n + at] or 0
            spread[key, "before"] = before
            low, high = int(np.floor(goals[key])), int(np.ceil(goals[key]))
            if not before <= low or not high < before + held:  # missed: the whole column, in order
                brackets[key], spread[key, "before"] = (None, None), 0
            elif distinct > ORDERED and 2 * held < spread.get((key, "held"), np.inf):
                spread[key, "at"], spread[key, "held"] = (goals[key] - before) / (held - 1), held
                later.append(key)
        pending, first = later, False

    places = [
        F.when(inside(k), F.struct(F.lit(columns[k[0]]).alias("column"), F.lit(float(k[1])).alias("p"), F.col(f"_{k[0]}").alias("value"),
                                   F.lit(float(goals[k])).alias("goal"), F.lit(int(spread[k, "before"])).alias("before")))
        for k in goals
    ]
    found = wide.select(F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counts = found.groupBy("column", "p", "goal", "before", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n").over(order)
    low, high = F.floor("goal"), F.ceil("goal")
    marked = counts.withColumn("upto", upto).filter((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    ends = marked.groupBy("column", "p", "goal").agg(
        F.max(F.when((F.col("upto") - F.col("n") <= low) & (low < F.col("upto")), F.col("value"))).alias("a"),
        F.max(F.when((F.col("upto") - F.col("n") <= high) & (high < F.col("upto")), F.col("value"))).alias("b"),
    )
    part = F.col("goal") - low
    return ends.select("column", "p", F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part).alias("value"))


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """describe(): one row per column with count, mean, std, min, exact quartiles and max. All columns share the passes."""
    numbers = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    basic = df.agg(F.array(*numbers).alias("rows")).select(F.explode("rows").alias("row")).select("row.*")
    quart = quantiles_by_refinement(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return basic.join(quart, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def mean_sem(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and standard error per key."""
    return df.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"),
    )


def episode_summary(df: DataFrame, day: str = "day", value: str = "time") -> DataFrame:
    return mean_sem(df, day, value)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values per column; each column is de-duplicated on its own exchange."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    out = None
    for c in columns:
        one = df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def group_list(df: DataFrame, key: str, item: str, order: list) -> DataFrame:
    """Ordered items per key as rows (key, place from 1, item): one shape for keys of any size."""
    return number_rows(df.select("*", F.col(item).alias("_item")), [key], order, "place").select(
        key, "place", F.col("_item").alias("item")
    )


def group_last(df: DataFrame, key: str, columns: list[str], order) -> DataFrame:
    """Last row per key by ``order``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def group_max(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(column).alias(column))


def artist_tracks(catalog: DataFrame, artist: str = "artist", item: str = "track") -> DataFrame:
    """Sorted distinct tracks per artist as rows (artist, place, item)."""
    return group_list(catalog.select(artist, item).distinct(), artist, item, [item])


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the column's minimum and maximum; the maximum falls into the last bin."""
    value = F.col(column).cast("double")
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    spot = F.floor(F.try_divide(value - lo, hi - lo) * bins)
    placed = df.where(F.col(column).isNotNull()).select(
        F.coalesce(F.least(spot, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"), lo.alias("_lo"), hi.alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    return placed.groupBy("bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("_lo") + width * F.col("bin")).alias("low"), (F.col("_lo") + width * (F.col("bin") + 1)).alias("high"), "n"
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count and null count per column, long form, one pass."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]
    )
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_rows").alias("rows")) for c in df.columns])).alias("_s")
    ).select("_s.*")


def density(df: DataFrame, user: str = "user", item: str = "track") -> DataFrame:
    """Users, items, filled cells and their share of the user x item matrix."""
    pairs = df.select(user, item).distinct()
    n_users = df.select(user).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_items = df.select(item).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        pairs.agg(F.count(F.lit(1)).alias("cells"))
        .withColumn("users", n_users)
        .withColumn("items", n_items)
        .withColumn("density", F.try_divide(F.col("cells"), F.col("users") * F.col("items")))
    )


def cv_mean(df: DataFrame, model: str = "model", skip: tuple = ("fold",)) -> DataFrame:
    """Mean of every metric column per model."""
    metrics = [c for c in df.columns if c not in (model, *skip)]
    return df.groupBy(model).agg(*[F.avg(c).alias(c) for c in metrics])


def metrics_table(df: DataFrame, metrics: list[str], model: str = "model", metric: str = "metric", value: str = "value"):
    """Long metric rows to one row per model; naming the metrics saves the distinct pass."""
    return df.groupBy(model).pivot(metric, metrics).agg(F.first(value))


def trim_categories(df: DataFrame, column: str, k: int = 20, other: str = "other") -> DataFrame:
    """Keep the k most frequent values, everything else becomes ``other``."""
    head = top_n(value_counts(df.where(F.col(column).isNotNull()), column, alias="_n"), [F.col("_n").desc(), column], k)
    kept = F.broadcast(head.select(F.col(column).alias("_head")))  # k rows by construction
    joined = df.join(kept, F.col(column) == F.col("_head"), "left")
    return joined.withColumn(column, F.when(F.col("_head").isNotNull(), F.col(column)).otherwise(other)).drop("_head")


def array_profile(df: DataFrame, column: str) -> DataFrame:
    """Longest array and the extreme values over all arrays."""
    return df.agg(
        F.max(F.size(column)).alias("longest"),
        F.max(F.array_max(column)).alias("max_value"),
        F.min(F.array_min(column)).alias("min_value"),
    )


def interest_stats(users: DataFrame, catalog: DataFrame, interests: str = "interests", by: str = "artist", value: str = "pop"):
    """How often each artist appears among the users' interests, with the artist's largest value."""
    chosen = users.select(F.explode(interests).alias("track")).join(catalog.select("track", by, value), "track")
    return chosen.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias(f"max_{value}"))


def head_share(counts: DataFrame, share: float = 0.2, value: str = "n") -> DataFrame:
    """Share of the total that the top ``share`` of items holds (the 80/20 check).

    Works on (value, how many items have it), which is small whatever the catalog: the items of one value are equal,
    so the cut through a value takes the right number of them.
    """
    levels = counts.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    items = levels.agg(F.sum("c").alias("s")).scalar()
    total = levels.agg(F.sum(F.col("c") * F.col("v")).alias("s")).scalar()
    ranked = levels.withColumn("_before", F.coalesce(F.sum("c").over(running), F.lit(0))).withColumn(
        "_head", F.ceil(items * share)
    )
    taken = F.greatest(F.least(F.col("_head") - F.col("_before"), F.col("c")), F.lit(0))
    return ranked.agg(F.sum(taken).alias("head_items"), F.sum(taken * F.col("v")).alias("head_sum")).withColumn(
        "share", F.try_divide(F.col("head_sum"), total)
    )

