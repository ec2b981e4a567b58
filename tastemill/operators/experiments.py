"""A/B analysis: assignment, statistics per treatment, Welch effects, variance reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import as_column, murmur3_32, murmur3_seed
from ..functions.student import t_quantile_column

# Names of the user metrics.
METRICS = ("time", "sessions", "mean_request_latency", "mean_tracks_per_session", "mean_time_per_session")
# Experiment names (they seed the assignment hash) and their number of arms.
EXPERIMENTS = {"STICKY_ARTIST": 2, "AA": 2, "I2I": 3, "HSTU": 2}


def assign(user, experiment: str, ways: int) -> Column:
    """Treatment of a user: seeded murmur3 of the decimal id, modulo the number of arms; arm 0 is the control."""
    arm = F.pmod(murmur3_32(as_column(user).cast("string"), murmur3_seed(experiment)), F.lit(ways))
    return F.when(arm == 0, F.lit("C")).otherwise(F.concat(F.lit("T"), arm.cast("string")))


def experiment_map(user, experiments: dict[str, int] = EXPERIMENTS) -> Column:
    """name -> treatment, the map that every log line carries."""
    parts = []
    for name, ways in experiments.items():
        parts += [F.lit(name), assign(user, name, ways)]
    return F.create_map(*parts)


def treatment_of(df: DataFrame, experiment: str, alias: str = "treatment") -> DataFrame:
    """Treatment of one experiment out of the map; NULL where the event took no part in it."""
    return df.withColumn(alias, F.col("experiments")[experiment])


def treatment_stats(users: DataFrame, metrics=METRICS, key: str = "treatment") -> DataFrame:
    """Long form: one row per (treatment, metric) with n, mean and sample variance. One pass over the users."""
    wide = users.groupBy(key).agg(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.count(m).alias("n"),
                F.avg(F.col(m)).alias("mean"),
                F.var_samp(F.col(m)).alias("var"),
            ).alias(m)
            for m in metrics
        ]
    )
    return wide.select(key, F.explode(F.array(*[F.col(m) for m in metrics])).alias("_s")).select(key, "_s.*")


def ab_effects(stats: DataFrame, alpha: float = 0.05, control: str = "C", key: str = "treatment") -> DataFrame:
    """Welch comparison of every treatment with the control: effect, standard error, degrees of freedom, the interval
    in percent of the control mean, and a significance flag. ``stats`` has one row per treatment and metric."""
    base = stats.where(F.col(key) == control).select(
        "metric", F.col("n").alias("_n0"), F.col("mean").alias("control_mean"), F.col("var").alias("_v0")
    )
    a = F.col("_v0") / F.col("_n0")
    b = F.col("var") / F.col("n")
    spread = F.try_divide(a * a, F.col("_n0") - 1) + F.try_divide(b * b, F.col("n") - 1)
    raw = (
        stats.where(F.col(key) != control)
        .join(base, "metric")
        .withColumn("treatment_mean", F.col("mean"))
        .withColumn("_d", F.col("mean") - F.col("control_mean"))
        .withColumn("se", F.sqrt(a + b))
        .withColumn("dof", F.try_divide((a + b) * (a + b), spread))
        .withColumn("_half", t_quantile_column(F.lit(1.0 - alpha / 2), F.col("dof")) * F.col("se"))
    )

    def percent(value: Column) -> Column:
        return F.try_divide(value, F.col("control_mean")) * 100

    return raw.select(
        key,
        "metric",
        "control_mean",
        "treatment_mean",
        percent(F.col("_d")).alias("effect"),
        percent(F.col("_d") - F.col("_half")).alias("lower"),
        percent(F.col("_d") + F.col("_half")).alias("upper"),
        "se",
        "dof",
        (F.abs("_d") > F.col("_half")).alias("significant"),
    )


def effects_report(effects: DataFrame, by: str = "effect", key: str = "treatment") -> DataFrame:
    """Ranked report: by effect, or by metric and then treatment, both descending."""
    order = [F.col("effect").desc(), "metric", key] if by == "effect" else [F.col("metric").desc(), F.col(key).desc()]
    return effects.orderBy(*order)


def same_attr_share(events: DataFrame, catalog: DataFrame, attr: str = "artist", control: str = "C") -> DataFrame:
    """Share of non-control requests whose recommendation has the same attribute as the track just played."""
    dim = catalog.select("track", attr)
    requests = events.where((F.col("message") == "next") & (F.col("treatment") != control))
    played = dim.select("track", F.col(attr).alias("_played"))
    offered = dim.select(F.col("track").alias("recommendation"), F.col(attr).alias("_offered"))
    same = F.coalesce(F.col("_played") == F.col("_offered"), F.lit(False))
    return (
        requests.select("track", "recommendation")
        .join(played, "track", "left")
        .join(offered, "recommendation", "left")
        .agg(F.avg(same.cast("double")).alias("share"))
    )


def repeat_plays(events: DataFrame, user: str = "user", item: str = "track") -> DataFrame:
    """Repeated plays per user. Plays are first counted per (user, item), so a busy user arrives pre-aggregated."""
    plays = events.where(F.col("message") == "next").groupBy(user, item).agg(F.count(F.lit(1)).alias("_n"))
    return plays.groupBy(user).agg((F.sum("_n") - F.count(F.lit(1))).alias("repeats"))


def mean_repeats(events: DataFrame, **names) -> DataFrame:
    return repeat_plays(events, **names).agg(F.avg("repeats").alias("mean_repeats"))


def cuped(users: DataFrame, metric: str, covariate: str, alias: str = "adjusted") -> DataFrame:
    """Remove the part of the metric that a pre-experiment covariate explains: y - theta * (x - mean x)."""
    stats = users.agg(
        F.try_divide(F.covar_samp(metric, covariate), F.var_samp(covariate)).alias("theta"),
        F.avg(covariate).alias("mean"),
    )
    theta = stats.select("theta").scalar()
    mean = stats.select("mean").scalar()
    return users.withColumn(
        alias, F.col(metric) - F.coalesce(theta, F.lit(0.0)) * (F.col(covariate) - mean)
    )


def diff_in_diff(users: DataFrame, before: str, after: str, key: str = "treatment") -> DataFrame:
    """Statistics of the change per user, in the long form that ``ab_effects`` reads."""
    return treatment_stats(users.withColumn("change", F.col(after) - F.col(before)), ["change"], key)
