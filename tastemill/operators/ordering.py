"""Row numbers, running counts, top-k and rolling windows that never need a whole key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import as_column, uniform
from ..functions.scalars import weighted_draw_key
from ..session import materialize

HOUR_MS = 3_600_000


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def number_rows(
    df: DataFrame, keys: list[str], order: list, alias: str = "rn", slice_by: Column | None = None
) -> DataFrame:
    """Exact ``row_number`` per key (1-based) for keys of any size.

    With ``slice_by`` (a value that does not decrease along ``order``, such as the hour of the event) rows are
    numbered inside (key, slice) and shifted by the sizes of the key's earlier slices: one exchange of the data and
    a small table of slice sizes. Without it the table is range-sorted, which cuts large keys over many partitions,
    written once, and numbered from the partition sizes.
    """
    if slice_by is None:
        return _number_by_sort(df, keys, order, alias)
    tagged = df.withColumn("_slice", slice_by)
    local = tagged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    )
    sizes = tagged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        join_nullsafe(local, offsets, [*keys, "_slice"], "inner")
        .withColumn(alias, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_slice", "_local", "_offset")
    )


def _number_by_sort(df: DataFrame, keys: list[str], order: list, alias: str) -> DataFrame:
    stored = materialize(
        df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftright("_at", 33)
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = stored.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # one row per partition of the sorted table: the broadcast is bounded by the number of shuffle partitions
    numbered = (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_global", F.col("_offset") + place)
        .drop("_part", "_offset", "_at")
    )
    if not keys:
        return numbered.withColumn(alias, (F.col("_global") + 1).cast("long")).drop("_global")
    starts = numbered.groupBy(*keys).agg(F.min("_global").alias("_start"))
    return (
        join_nullsafe(numbered, starts, keys, "inner")
        .withColumn(alias, (F.col("_global") - F.col("_start") + 1).cast("long"))
        .drop("_global", "_start")
    )


def sum_before(df: DataFrame, order: list, value: str, alias: str = "before", chunk: int = 1_000_000) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the whole table: inside chunks of the sorted table, plus the sums of the
    earlier chunks (one row per chunk)."""
    numbered = number_rows(df, [], order, "_rn").withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk))
    chunks = numbered.groupBy("_chunk").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    local = numbered.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        local.join(offsets, "_chunk")
        .withColumn(alias, F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_rn", "_local", "_offset")
    )


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """Global sort and head; Spark keeps only n rows per task."""
    return df.orderBy(*order).limit(n)


def top_k_per(df: DataFrame, keys: list[str], order: list, k: int, alias: str = "rank") -> DataFrame:
    """First k rows per key with their rank. Spark plans a group limit before the exchange, so that a task sends at
    most k rows per key however large the key is (for k up to 1000)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(alias, F.row_number().over(window)).where(F.col(alias) <= k)


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k_per(df, keys, order, 1, "_first").drop("_first")


def rank_latest(df: DataFrame, user: str = "user", ts: str = "timestamp", ties: tuple = (), alias="rank_latest"):
    """1 = the user's newest row. The hour of the event slices busy users."""
    order = [F.col(ts).desc(), *ties]
    return number_rows(df, [user], order, alias, slice_by=-F.floor(F.col(ts) / HOUR_MS))


def leave_last_out(df: DataFrame, n: int = 1, user="user", ts="timestamp", ties: tuple = ()):
    """(train, test): test holds the newest n rows of every user."""
    ranked = rank_latest(df, user, ts, ties, "_rank")
    return ranked.where(F.col("_rank") > n).drop("_rank"), ranked.where(F.col("_rank") <= n).drop("_rank")


def normalize_by(df: DataFrame, key: str, value: str, how: str = "l2", alias: str | None = None) -> DataFrame:
    """Divide by the key's Euclidean norm ('l2'; a norm of zero gives zeros) or subtract the key's mean ('center')."""
    stat = F.sqrt(F.sum(F.col(value) * F.col(value))) if how == "l2" else F.avg(value)
    stats = df.groupBy(key).agg(stat.alias("_stat"))
    unit = F.when(F.col("_stat") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value), F.col("_stat")))
    out = unit if how == "l2" else F.col(value) - F.col("_stat")
    return df.join(stats, key).withColumn(alias or value, out).drop("_stat")


def rolling_mean(df: DataFrame, order: list, value: str, window: int = 3, alias: str = "rolling") -> DataFrame:
    """Centred rolling mean over the whole table; NULL where the window is not full.

    Every row adds its value to the windows it belongs to, so no task walks the whole series.
    """
    numbered = number_rows(df, [], order, "_n")
    half = window // 2
    parts = numbered.select(
        F.explode(F.sequence(F.col("_n") - half, F.col("_n") + (window - 1 - half))).alias("_n"),
        F.col(value).alias("_v"),
    )
    sums = parts.groupBy("_n").agg(F.avg("_v").alias("_mean"), F.count("_v").alias("_count"))
    return (
        numbered.join(sums, "_n", "left")
        .withColumn(alias, F.when(F.col("_count") == window, F.col("_mean")))
        .drop("_n", "_mean", "_count")
    )


def running_count(df: DataFrame, keys: list[str], order: list, alias: str = "seen", slice_by=None) -> DataFrame:
    """How many earlier rows of the key there are."""
    numbered = number_rows(df, keys, order, "_rn", slice_by)
    return numbered.withColumn(alias, F.col("_rn") - 1).drop("_rn")


def seen_before(df: DataFrame, keys: list[str], order: list[str], alias: str = "seen_before") -> DataFrame:
    """True for every row of a key but the first: one pre-aggregated minimum per key, joined back."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        join_nullsafe(df, first, keys, "inner")
        .withColumn(alias, F.struct(*order) > F.col("_first"))
        .drop("_first")
    )


def recent_history(
    df: DataFrame,
    n: int = 10,
    user: str = "user",
    ts: str = "timestamp",
    ties: tuple = (),
    item: str = "track",
    value: str = "time",
    block: int = 100_000,
    alias: str = "history",
) -> DataFrame:
    """The newest n (item, value) pairs at each event, newest first, the event itself included.

    Rows are numbered per user and cut into blocks; each block also gets the n-1 rows before it, so that a window
    never spans more than ``block + n`` rows.
    """
    numbered = number_rows(df, [user], [ts, *ties], "_rn", slice_by=F.floor(F.col(ts) / HOUR_MS))
    home = F.floor((F.col("_rn") - 1) / block)
    spill = F.pmod(F.col("_rn") - 1, F.lit(block)) >= block - (n - 1)
    blocks = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    window = Window.partitionBy(user, "_block").orderBy("_rn").rowsBetween(-(n - 1), 0)
    return (
        numbered.withColumn("_block", F.explode(blocks))
        .withColumn(alias, F.reverse(F.collect_list(F.struct(item, value)).over(window)))
        .where(F.col("_block") == home)
        .drop("_block", "_rn")
    )


def early_stop_epoch(curve: DataFrame, patience: int = 3, eps: float = 1e-6, epoch="epoch", value="value") -> DataFrame:
    """First epoch after ``patience`` at which each of the newest ``patience`` values beats the one before them by
    less than eps. Epochs are dense, so earlier values come from equi-joins on epoch - j."""
    rows = curve.select(F.col(epoch).alias("epoch"), F.col(value).alias("value"))
    joined = rows
    for back in range(1, patience + 1):
        past = rows.select((F.col("epoch") + back).alias("epoch"), F.col("value").alias(f"_v{back}"))
        joined = joined.join(past, "epoch")
    anchor = F.col(f"_v{patience}")
    newest = [F.col("value"), *[F.col(f"_v{b}") for b in range(1, patience)]]
    flat = reduce(lambda a, b: a & b, [(v - anchor) < eps for v in newest])
    return joined.where(flat & (F.col("epoch") > patience)).agg(F.min("epoch").alias("stop_epoch"))


def sample_weighted(df: DataFrame, n: int, weight, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows without replacement, with chances by weight (all equal when ``weight`` is None)."""
    w = F.lit(1.0) if weight is None else as_column(weight)
    return (
        df.withColumn("_key", weighted_draw_key(uniform(*keys, seed=seed), w))
        .orderBy("_key", *keys)
        .limit(n)
        .drop("_key")
    )
