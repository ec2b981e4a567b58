"""Text jobs: numbered lists, record reconciliation, item descriptions, token features, naive Bayes profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import as_column
from ..session import materialize


def parse_numbered_list(df: DataFrame, text: str = "text", tag: str | None = None) -> DataFrame:
    """One row per line of the form 'number. item'. Lines that start with no digit, whose part before the first dot is
    no whole number, or that hold no item are skipped."""
    keep = [c for c in df.columns if c != text]
    line = F.regexp_replace(F.col("_line"), r"^\s+|\s+$", "")
    rows = df.withColumn("_line", F.explode(F.split(text, "\n"))).withColumn("_line", line)
    return (
        rows.where(F.col("_line").rlike(r"^[0-9][0-9]*\s*\."))
        .withColumn("id", F.regexp_extract("_line", r"^([0-9]+)", 1).try_cast("long"))
        .withColumn("item", F.regexp_replace(F.regexp_replace("_line", r"^[0-9]+\s*\.", ""), r"^\s+", ""))
        .where((F.col("item") != "") & F.col("id").isNotNull())
        .select(*keep, "id", "item", F.lit(tag).cast("string").alias("tag"))
    )


def reconcile(df: DataFrame, expected: str, actual: str, default: str = "none") -> DataFrame:
    """Keep the expected value; a differing one moves to ``alternative_<expected>``."""
    given = F.coalesce(F.col(actual), F.lit(default))
    return df.withColumn(f"alternative_{expected}", F.when(~given.eqNullSafe(F.col(expected)), given)).withColumn(
        actual, F.col(expected)
    )


def describe_item(template: str, **columns) -> Column:
    """Fill a text template such as 'track {title} by {artist}'; arrays are joined with ', '."""
    names = list(columns)
    text = template
    for name in names:
        text = text.replace("{" + name + "}", "%s")
    order = sorted(names, key=lambda n: template.index("{" + n + "}"))
    return F.format_string(text, *[as_column(columns[n]).cast("string") for n in order])


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n) over whole lower-cased texts."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    return df.select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n, _len) with ``_len`` tokens of the whole key, written once for all that is counted from it. Texts travel to
    the task of their key before they are cut, so texts are shuffled and not tokens."""
    counts = tokens(df.select(key, text).repartition(F.col(key)), key, text)
    return materialize(counts.withColumn("_len", F.sum("n").over(Window.partitionBy(key))), "token-counts")


def tf_idf(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Token weights n / len * ln((docs + 1) / (df + 1)); the document frequency is an aggregate joined back."""
    counts = token_counts(df, key, text)
    freq = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    docs = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where(F.col(key).isNotNull()).join(freq, "token").select(
        key, "token", "n", (F.col("n") / F.col("_len") * F.log((docs + 1) / (F.col("_df") + 1))).alias("weight")
    )


def bm25(df: DataFrame, key: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 token weights per document."""
    counts = token_counts(df, key, text)
    freq = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    docs = df.select(key).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    mean = counts.groupBy(key).agg(F.max("_len").alias("_len")).agg(F.avg("_len").alias("m")).scalar()
    idf = F.log((docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    return (
        counts.where(F.col(key).isNotNull())
        .join(freq, "token")
        .withColumn("_mean", mean)
        .select(
            key,
            "token",
            (idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))).alias("weight"),
        )
    )


def content_profile(labelled: DataFrame, key: str, label: str, text: str = "text", smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes trained on labelled texts: log odds of label 1 against 0 per token."""
    counts = tokens(labelled, key, text).join(labelled.select(key, label), key)
    per = counts.groupBy("token").agg(
        F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("_neg"),
    )
    sums = per.agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("q"), F.count(F.lit(1)).alias("v"))
    pos, neg, vocab = (sums.select(c).scalar() for c in "pqv")
    return per.select(
        "token",
        (
            F.log((F.col("_pos") + smoothing) / (pos + smoothing * vocab))
            - F.log((F.col("_neg") + smoothing) / (neg + smoothing * vocab))
        ).alias("log_odds"),
    )


def profile_score(texts: DataFrame, profile: DataFrame, prior: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sum of token log odds per text plus the class log odds (a one-row frame with ``log_prior``)."""
    base = prior.select("log_prior").scalar()
    scored = tokens(texts, key, text).join(profile, "token").groupBy(key).agg(F.sum(F.col("n") * F.col("log_odds")).alias("_s"))
    return texts.select(key).join(scored, key, "left").select(key, (F.coalesce("_s", F.lit(0.0)) + base).alias("score"))


def class_log_prior(labelled: DataFrame, label: str) -> DataFrame:
    """Log odds of label 1. While one class has no rows, one row is added to each."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    neg = F.sum((F.col(label) == 0).cast("long"))
    none = F.when((pos > 0) & (neg > 0), F.lit(0)).otherwise(F.lit(1))
    counts = labelled.agg(F.coalesce(pos, F.lit(0)).alias("p"), F.coalesce(neg, F.lit(0)).alias("q"), none.alias("more"))
    return counts.select(F.log((F.col("p") + F.col("more")) / (F.col("q") + F.col("more"))).alias("log_prior"))
