"""Latent-factor models on Spark ML, the bias baseline, and scoring of given pairs."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import materialize, shared_dir
from .interactions import dense_index, random_split
from .joins import left_fill, semi
from .retrieval import recommend, score_pairs


#: ALS numbers its users and items with 32-bit integers.
MOST_IDS = (1 << 31) - 1
#: Ratings that one block of users or items holds in memory, on average; least number of blocks, which small tables keep, and most, as
#: ALS buffers ratings by pair of blocks.
BLOCK_RATINGS, LEAST_BLOCKS, MOST_BLOCKS = 4_000_000, 10, 100


@dataclass
class Factors:
    """A fitted model with the numbers it knows users and items by: tables (id, index)."""

    model: ALSModel
    users: DataFrame
    items: DataFrame
    user: str
    item: str

    def encode(self, rows: DataFrame) -> DataFrame:
        """Rows of known users and items, with the numbers ``_u`` and ``_i``."""
        u = self.users.select(F.col("id").alias(self.user), F.col("index").cast("int").alias("_u"))
        i = self.items.select(F.col("id").alias(self.item), F.col("index").cast("int").alias("_i"))
        return rows.join(u, self.user).join(i, self.item)


def _numbers(df: DataFrame, column: str) -> DataFrame:
    """(id, index) of the column's values, whatever their size or type."""
    index = dense_index(df.where(F.col(column).isNotNull()), column).select(F.col(column).alias("id"), "index")
    index = materialize(index, "ids")
    if index.count() > MOST_IDS:
        raise ValueError(f"{column} has more than {MOST_IDS} values")
    return index


def _numbered(df: DataFrame, user: str = "user", item: str = "track", value: str = "time") -> tuple[Factors, DataFrame]:
    """(a model yet to be fitted, its ratings), which serve the fits of any settings on ``df``."""
    shared_dir(df.sparkSession)  # ALS cuts its lineage through the checkpoint folder
    factors = Factors(None, _numbers(df, user), _numbers(df, item), user, item)
    return factors, materialize(factors.encode(df).select("_u", "_i", value), "ratings")


def _blocks(ratings: int) -> int:
    """Blocks of users and of items: a task builds, sorts and solves one in memory, so their number follows the ratings."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-ratings // BLOCK_RATINGS)))


def _fitted(factors: Factors, ratings: DataFrame, value: str = "time", **params) -> Factors:
    blocks = _blocks(ratings.count())
    settings = {"coldStartStrategy": "drop", "checkpointInterval": 5, "seed": 31337, "numUserBlocks": blocks, "numItemBlocks": blocks, **params}
    als = ALS(userCol="_u", itemCol="_i", ratingCol=value, **settings)
    return replace(factors, model=als.fit(ratings))


def _fit(df: DataFrame, user: str = "user", item: str = "track", value: str = "time", **params) -> Factors:
    return _fitted(*_numbered(df, user, item, value), value, **params)


def fit_als(df: DataFrame, rank: int = 50, max_iter: int = 25, reg: float = 0.1, **params) -> Factors:
    """Explicit ALS on (user, track, time) rows."""
    return _fit(df, rank=rank, maxIter=max_iter, regParam=reg, **params)


def fit_implicit_mf(df: DataFrame, rank: int = 50, reg: float = 0.1, alpha: float = 1.0, max_iter: int = 10, **params) -> Factors:
    """Implicit-feedback ALS: the value is the confidence that the pair is a positive."""
    return _fit(df, rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True, nonnegative=False, **params)


def _vectors(factors: DataFrame, index: DataFrame) -> DataFrame:
    named = factors.select(F.col("id").cast("long").alias("index"), F.col("features").alias("vector"))
    return named.join(index, "index").select("id", "vector")


def user_factors(factors: Factors) -> DataFrame:
    return _vectors(factors.model.userFactors, factors.users)


def item_factors(factors: Factors) -> DataFrame:
    return _vectors(factors.model.itemFactors, factors.items)


def recommend_all(factors: Factors, k: int = 100, seen: DataFrame | None = None) -> DataFrame:
    """Top k items of every user, optionally without those already seen."""
    return recommend(user_factors(factors), item_factors(factors), k, seen)


def predictions(factors: Factors, pairs: DataFrame) -> DataFrame:
    """``pairs`` of known users and items with ``prediction``."""
    return factors.model.transform(factors.encode(pairs)).drop("_u", "_i")


def model_rmse(factors: Factors, test: DataFrame, label: str = "time") -> float:
    return _encoded_rmse(factors, factors.encode(test), label)


def _encoded_rmse(factors: Factors, encoded: DataFrame, label: str = "time") -> float:
    evaluator = RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol="prediction")
    return evaluator.evaluate(factors.model.transform(encoded))


def fit_contextual(pairs: DataFrame, rank: int = 100, reg: float = 0.05, max_iter: int = 10) -> Factors:
    """Start -> next model: the share played is fit by the product of the start's and the track's vector."""
    mean = pairs.groupBy("start", "track").agg(F.avg("time").alias("time"))
    return _fit(mean, user="start", rank=rank, regParam=reg, maxIter=max_iter)


def tune(df: DataFrame, grid: dict[str, list], train_ratio: float = 0.8, keys: tuple = ("user", "track"), **params):
    """Search ALS settings on a train/validation split by a hash of the keys, the same however the table is stored.
    Returns (best setting fitted on all rows, frame of setting and RMSE)."""
    parts = random_split(df, [train_ratio, 1 - train_ratio], list(keys), seed=42)
    train, test = (materialize(parts.where(F.col("part") == n).drop("part"), "fold") for n in (0, 1))
    names = sorted(grid)
    settings = [dict(zip(names, values, strict=True)) for values in itertools.product(*[grid[n] for n in names])]
    # users, items and ratings are numbered once for all settings
    factors, ratings = _numbered(train)
    known = materialize(factors.encode(test).select("_u", "_i", "time"), "known")
    scores = [_encoded_rmse(_fitted(factors, ratings, **params, **setting), known) for setting in settings]
    best = settings[min(range(len(settings)), key=scores.__getitem__)]
    rows = [(", ".join(f"{n}={v}" for n, v in setting.items()), float(x)) for setting, x in zip(settings, scores, strict=True)]
    return _fit(df, **params, **best), df.sparkSession.createDataFrame(rows, "setting string, rmse double")


def augment_bias(factors: DataFrame, side: str) -> DataFrame:
    """Fold biases into the vectors, so that the plain product is b_i + b_u + v . q: items become [b, 1, v], users
    [1, b, q]. ``factors`` has (id, vector, bias)."""
    one, bias = F.lit(1.0), F.col("bias").cast("double")
    head = F.array(bias, one) if side == "item" else F.array(one, bias)
    return factors.select("id", F.concat(head, F.col("vector").cast("array<double>")).alias("vector"))


def bias_baseline(df: DataFrame, reg_user: float = 10.0, reg_item: float = 10.0, value: str = "time"):
    """mu + b_u + b_i with shrunken means: item biases first, then user biases on what is left.
    Returns (mu frame, item biases, user biases)."""
    mu = df.agg(F.avg(value).alias("mu"))
    centred = df.select("user", "track", (F.col(value) - mu.scalar()).alias("_d"))
    items = centred.groupBy("track").agg((F.sum("_d") / (reg_item + F.count(F.lit(1)))).alias("item_bias"))
    users = (
        centred.join(items, "track")
        .groupBy("user")
        .agg((F.sum(F.col("_d") - F.col("item_bias")) / (reg_user + F.count(F.lit(1)))).alias("user_bias"))
    )
    return mu, items, users


def predict_baseline(pairs: DataFrame, mu: DataFrame, items: DataFrame, users: DataFrame, alias: str = "prediction"):
    """Unknown users and items get no bias."""
    joined = pairs.join(items, "track", "left").join(users, "user", "left").withColumn("_mu", mu.scalar())
    total = F.col("_mu") + F.coalesce("item_bias", F.lit(0.0)) + F.coalesce("user_bias", F.lit(0.0))
    return joined.withColumn(alias, total).drop("_mu", "item_bias", "user_bias")


def score_submission(test: DataFrame, users: DataFrame, items: DataFrame, seed: int = 0) -> DataFrame:
    """Score every test row: exp(score) for known pairs, a small repeatable draw for the rest. Test rows keep their
    number even when a pair repeats."""
    known = semi(semi(test.select("user", "track"), users.select(F.col("id").alias("user")), ["user"]), items.select(F.col("id").alias("track")), ["track"])
    scored = score_pairs(known.distinct(), users, items).withColumn("score", F.exp("score"))
    return left_fill(test, scored, ["user", "track"], "score", seed)


def biased_factors(df: DataFrame, model: Factors, value: str = "time"):
    """(users, items) as (id, vector, bias): the model's factors with the baseline's biases."""
    _, items, users = bias_baseline(df, value=value)
    u = user_factors(model).join(users.withColumnRenamed("user", "id"), "id", "left")
    i = item_factors(model).join(items.withColumnRenamed("track", "id"), "id", "left")
    return (
        materialize(u.select("id", "vector", F.coalesce("user_bias", F.lit(0.0)).alias("bias")), "user-factors"),
        materialize(i.select("id", "vector", F.coalesce("item_bias", F.lit(0.0)).alias("bias")), "item-factors"),
    )


def random_prediction(*keys: str, seed: int = 0) -> Column:
    """Uniform guesses, the weakest baseline of a share-played model."""
    return uniform(*keys, seed=seed)
