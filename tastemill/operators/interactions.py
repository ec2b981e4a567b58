"""Interaction preparation: support filters, splits, dense ids, negative samples, histories, feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_split, uniform, uniform_index
from ..functions.scalars import mask_array, pad_array
from .joins import semi
from .ordering import join_nullsafe, number_rows, top_k_per
from .selects import replicate, union_all

#: Catalog positions that one task numbers together.
SEEN_SLICE = 100_000
RANK_SLICE = 64


def support_filter(
    df: DataFrame, min_user: int, min_item: int, order: str = "both", user: str = "user", item: str = "track", basis: DataFrame | None = None
) -> DataFrame:
    """One-pass support filter. 'both' counts users and items on the same rows (``basis``, the train rows, if given);
    'items_first' counts users after the items were filtered. Not repeated until stable."""

    def frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)

    counted = df if basis is None else basis
    items = frequent(counted, item, min_item)
    if order == "items_first":
        kept = semi(df, items, [item])
        return semi(kept, frequent(semi(counted, items, [item]), user, min_user), [user])
    return semi(semi(df, items, [item]), frequent(counted, user, min_user), [user])


def warm_test(test: DataFrame, train: DataFrame, user: str = "user", item: str = "track") -> DataFrame:
    """Test rows whose user and item both occur in train."""
    return semi(semi(test, train.select(user).distinct(), [user]), train.select(item).distinct(), [item])


def random_split(df: DataFrame, weights: list[float], keys: list[str], seed: int = 0, alias: str = "part") -> DataFrame:
    """Part number 0.. per row by a hash-uniform draw of the key columns: the same in every run and plan."""
    total, upto, cuts = sum(weights), 0.0, []
    for w in weights[:-1]:
        upto += w / total
        cuts.append(upto)
    draw = uniform(*keys, seed=seed)
    part = F.lit(len(weights) - 1)
    for number in reversed(range(len(cuts))):
        part = F.when(draw < cuts[number], F.lit(number)).otherwise(part)
    return df.withColumn(alias, part)


def split_by_source(first: DataFrame, later: DataFrame, user: str = "user", item: str = "track"):
    """(train, test) from two periods: the test keeps known users and items only."""
    return first, warm_test(later, first, user, item)


def time_split(df: DataFrame, cutoff, ts: str = "timestamp"):
    """(train, test) by time."""
    return df.where(F.col(ts) < cutoff), df.where(F.col(ts) >= cutoff)


def pair_folds(df: DataFrame, n: int, user: str = "user", item: str = "track", alias: str = "fold") -> DataFrame:
    """Fold number of each (user, item) pair."""
    return df.withColumn(alias, hash_split(F.concat_ws("|", user, item), n))


def dense_index(df: DataFrame, column: str, order: str = "sorted", alias: str = "index", ts: str | None = None) -> DataFrame:
    """(value, index 0..n-1): sorted, by first appearance (``ts``), or by popularity."""
    if order == "sorted":
        domain, by = df.select(column).distinct(), [F.col(column)]
    elif order == "first":
        domain, by = df.groupBy(column).agg(F.min(ts).alias("_at")), [F.col("_at"), F.col(column)]
    else:
        domain, by = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), [F.col("_n").desc(), F.col(column)]
    return number_rows(domain, [], by, "_rn").select(column, (F.col("_rn") - 1).alias(alias))


def to_index(df: DataFrame, index: DataFrame, column: str, alias: str = "index") -> DataFrame:
    return df.join(index.withColumnRenamed("index", alias), column)


def from_index(df: DataFrame, index: DataFrame, column: str, alias: str = "index") -> DataFrame:
    """Inverse mapping: dense index back to the id."""
    return df.join(index.withColumnRenamed("index", alias), alias).drop(alias)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each categorical column by its sorted dense code; an unknown value (NULL) is a category, the first one."""
    for column in columns:
        codes = dense_index(df, column, alias="_code")
        df = join_nullsafe(df, codes, [column]).drop(column).withColumnRenamed("_code", column)
    return df


def sample_negatives(
    df: DataFrame,
    items: DataFrame,
    n: int,
    exclude_seen: bool = False,
    seen: DataFrame | None = None,
    keys: tuple = ("user", "track"),
    seed: int = 0,
    user: str = "user",
    item: str = "track",
    alias: str = "negative",
) -> DataFrame:
    """n uniform negatives per row of ``df`` (``keys`` identify the row), drawn with replacement from ``items``.

    With ``exclude_seen`` each draw is a rank among the items the user has not seen, turned into an item by counting the
    seen positions up to it. No draw is ever rejected, so the count is always exactly n; users who have seen everything
    get none. Ranks are handled in slices with at most ``RANK_SLICE`` marks, so a user's draws never meet in one task.
    """
    index = number_rows(items.select(item).distinct(), [], [item], "_rn").select(
        F.col(item).alias(alias), (F.col("_rn") - 1).alias("_at")
    )
    size = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    if not exclude_seen:
        drawn = replicate(df, n, "draw").withColumn("_size", size).withColumn("_at", uniform_index(F.col("_size"), *keys, "draw", seed=seed))
        return drawn.drop("_size").join(index, "_at").drop("_at")
    known = (
        (df if seen is None else seen)
        .select(user, F.col(item).alias(alias))
        .distinct()
        .join(index, alias)
        .select(user, "_at")
    )
    counted = known.groupBy(user).agg(F.count(F.lit(1)).alias("_seen"))
    open_rows = (
        df.join(counted, user, "left")
        .withColumn("_free", size - F.coalesce("_seen", F.lit(0)))
        .where(F.col("_free") > 0)
    )
    ranks = (
        replicate(open_rows, n, "draw")
        .withColumn("_rank", uniform_index(F.col("_free"), *keys, "draw", seed=seed))
        .select(*df.columns, "draw", "_rank")
    )
    return nth_unseen(ranks, known, user).join(index, "_at").drop("_at")


def nth_unseen(ranks: DataFrame, known: DataFrame, user: str = "user") -> DataFrame:
    """Turn ``_rank`` (0-based, counted among the positions the user has not seen) into the position ``_at``.

    The j-th seen position s_j pushes every rank >= s_j - j up by one; runs of seen positions share one such value.
    ``known`` has distinct (user, _at) rows.
    """
    # numbered in slices of positions, so that a user who has seen most of the catalog is several tasks
    numbered = number_rows(known, [user], ["_at"], "_j", slice_by=F.floor(F.col("_at") / SEEN_SLICE))
    numbered = numbered.withColumn("_j", F.col("_j") - 1)
    marks = (
        numbered.groupBy(user, (F.col("_at") - F.col("_j")).alias("_t"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(user, F.floor(F.col("_t") / RANK_SLICE).alias("_slice"))
        .agg(F.collect_list(F.struct("_t", "_c")).alias("_marks"), F.sum("_c").alias("_pushed"))
    )
    sliced = ranks.withColumn("_slice", F.floor(F.col("_rank") / RANK_SLICE))
    before = Window.partitionBy(user).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        sliced.select(user, "_slice")
        .distinct()
        .join(marks, [user, "_slice"], "full")
        .withColumn("_before", F.coalesce(F.sum("_pushed").over(before), F.lit(0)))
        .select(user, "_slice", "_before", "_marks")
    )
    inside = F.aggregate(
        F.filter("_marks", lambda m: m["_t"] <= F.col("_rank")), F.lit(0).cast("long"), lambda a, m: a + m["_c"]
    )
    placed = sliced.join(slices, [user, "_slice"]).withColumn(
        "_at", F.col("_rank") + F.col("_before") + F.coalesce(inside, F.lit(0))
    )
    return placed.select(*[c for c in ranks.columns if c != "_rank"], "_at")


def eval_negatives(df: DataFrame, items: DataFrame, n: int = 10, seed: int = 1, **names) -> DataFrame:
    """Negatives for each held-out positive."""
    return sample_negatives(df, items, n, seed=seed, **names)


def play_history(
    df: DataFrame, n: int = 30, pad: int = 50_000, users: DataFrame | None = None, user: str = "user", item: str = "track", seed: int = 0
) -> DataFrame:
    """(user, history): n distinct items in a repeatable shuffled order, padded; users without plays get only padding.
    Only the n items with the smallest draw reach the list, so a heavy user costs no more than others."""
    pairs = df.select(user, item).distinct().withColumn("_u", uniform(user, item, seed=seed))
    first = top_k_per(pairs, [user], ["_u", item], n, "_r")
    lists = first.groupBy(user).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(item).alias("i")))), lambda x: x["i"]).alias("history")
    )
    if users is not None:
        lists = users.select(user).distinct().join(lists, user, "left")
    return lists.withColumn("history", pad_array("history", n, pad))


def mask_history(df: DataFrame, columns: list[str], pad: int = 50_000, history: str = "history") -> DataFrame:
    """Blank the row's own positive and negative in its history."""
    return df.withColumn(history, mask_array(history, columns, pad))


def multi_hot(df: DataFrame, key: str, column: str, vocabulary: list) -> DataFrame:
    """0/1 column per value of a small vocabulary, one row per key."""
    return df.groupBy(key).agg(
        *[F.max((F.col(column) == v).cast("int")).alias(f"{column}_{v}") for v in vocabulary]
    )


def item_features_long(catalog: DataFrame, features: dict[str, str], item: str = "track") -> DataFrame:
    """(id, feature, value) rows; array columns give one row per element."""
    parts = []
    types = dict(catalog.dtypes)
    for name, column in features.items():
        values = F.col(column) if types[column].startswith("array") else F.array(column)
        part = catalog.select(
            F.col(item).alias("id"), F.lit(name).alias("feature"), F.explode(values.cast("array<string>")).alias("value")
        )
        parts.append(part.where(F.col("value").isNotNull()))
    return union_all(*parts)


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("_st")
    )
    out = df.withColumn("_st", stats.scalar())
    for c in columns:
        spread = F.when(F.col(f"_st.{c}.s") == 0, F.lit(1.0)).otherwise(F.col(f"_st.{c}.s"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_st.{c}.m")) / spread)
    return out.drop("_st")


def training_rows(
    positives: DataFrame, items: DataFrame, n: int, features: DataFrame | None = None, seed: int = 0, item: str = "track"
) -> DataFrame:
    """Pointwise rows: each positive with label 1 and n draws with label 0, plus item features."""
    ones = positives.select("user", item, F.lit(1).alias("label"))
    draws = sample_negatives(positives.select("user", item), items, n, seed=seed, item=item)
    zeros = draws.select("user", F.col("negative").alias(item), F.lit(0).alias("label"))
    rows = ones.unionByName(zeros)
    return rows if features is None else rows.join(features, item, "left")


def triplets(df: DataFrame, items: DataFrame, n: int, weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """(user, positive, negative), optionally with a split number."""
    pairs = df.select("user", "track").distinct()
    rows = sample_negatives(pairs, items, n, seed=seed).select("user", F.col("track").alias("positive"), "negative", "draw")
    if weights:
        rows = random_split(rows, weights, ["user", "positive", "draw"], seed + 1)
    return rows.drop("draw")

