"""User- and item-based neighbours from a sparse interaction table.

Nothing here joins the table with itself row by row: an item that a third of all users played would square into as many
pairs. The products are taken strip by strip instead (``strips``): strips of columns meet where they are written, each two are
multiplied in NumPy and return one number per pair of columns, so no interaction is shuffled per strip.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import normalize_by, top_k_per
from .strips import column_pairs, top_scores
from .tiles import SLAB, expand
from .tiles import best_columns as top_columns

BLOCK = 2048  # columns per block
CHUNK = 1_000_000  # interactions of a strip, on average
SCORE_CHUNK = 4_000_000  # interactions per chunk of scored rows: every chunk gets a copy of the weights
MAX_TASKS = 20_000


def cogroup_by(left: DataFrame, right: DataFrame, keys: list[str], groups: int):
    """Cogroup with about one group per task: without a stated number, small inputs are merged into few tasks although
    their products are large."""
    parts = min(max(groups, 1), MAX_TASKS)
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys))


def column_products(entries: DataFrame, products: dict[str, tuple[str, str]], row: str = "user", col: str = "track", best: tuple[str, int] | None = None) -> DataFrame:
    """(j, i, name...) for every pair of columns that share a row: name = sum over rows of left_j * right_i, NULL where one of
    them has no value. ``best``: see ``strips.column_pairs``.

    ``products`` maps an output name to the (left, right) value columns of ``entries``; (row, col) is unique.
    """
    names = list(products)

    def rows(j: np.ndarray, i: np.ndarray, sums: dict, *_) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), *[pa.array(sums[n], from_pandas=True) for n in names]], ["j", "i", *names])

    schema = "j long, i long, " + ", ".join(f"{n} double" for n in names)
    return column_pairs(entries, row, col, sorted({v for p in products.values() for v in p}), rows, schema, products, CHUNK, best=best)


def score_by_columns(
    queries: DataFrame,
    weights: DataFrame,
    k: int,
    minus: str | None = None,
    row: str = "user",
    col: str = "track",
    value: str = "q",
    digits: int = 9,
) -> DataFrame:
    """Top k columns per row of (queries x weights): score_ui = sum over j of q_uj * w_ji, minus the row's own value in
    column ``minus``. Every column of ``queries`` is a candidate, one without any weight with score 0, so each row gets k
    columns where there are as many; ties go to the smaller id. ``weights`` has (j, i, w).

    Groups are (row chunk, column block); a group holds the chunk's entries and the weights into one block of columns.
    """
    n_entries = queries.count()
    n_cols = queries.agg(F.count_distinct(col)).first()[0]
    chunks = max(1, math.ceil(n_entries / SCORE_CHUNK))
    blocks = max(1, math.ceil(n_cols / (BLOCK // 4)))
    own = F.lit(0.0) if minus is None else F.col(minus)
    left = queries.select(
        F.pmod(F.xxhash64(row), F.lit(chunks)).cast("int").alias("_u"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_i"),
        F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).alias("q"), own.alias("own"),
    )
    # a weight of zero makes every column known to its block
    every = queries.select(F.col(col).alias("j"), F.col(col).alias("i"), F.lit(0.0).alias("w")).distinct()
    right = weights.select("j", "i", "w").unionByName(every).select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_u"),
        F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("_i"), "j", "i", "w",
    )

    def score(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = {"r": [], "i": [], "score": []}
        if len(lp) and len(rp):
            rp = rp.sort_values("j", kind="stable")
            j, w = rp["j"].to_numpy(), rp["w"].to_numpy(dtype=float)
            i_ids, i = np.unique(rp["i"].to_numpy(), return_inverse=True)
            width = len(i_ids)
            lp = lp.sort_values("r", kind="stable")
            r_ids, r = np.unique(lp["r"].to_numpy(), return_inverse=True)
            q, c, mine = (lp[x].to_numpy() for x in ("q", "c", "own"))
            step = max(1, SLAB // width)
            for first in range(0, len(r_ids), step):
                lo, hi = np.searchsorted(r, [first, first + step])
                size = min(step, len(r_ids) - first)
                scores = np.zeros(size * width)
                base = (r[lo:hi] - first) * width
                for a, times, b in expand(c[lo:hi], j):
                    cells = np.repeat(base[a], times) + i[b]
                    scores += np.bincount(cells, weights=np.repeat(q[lo:hi][a], times) * w[b], minlength=size * width)
                scores = scores.reshape(size, width)
                at = np.searchsorted(i_ids, c[lo:hi])
                known = (at < width) & (i_ids[np.minimum(at, width - 1)] == c[lo:hi])
                scores[r[lo:hi][known] - first, at[known]] -= mine[lo:hi][known]
                scores = np.round(scores, digits) + 0.0
                if not np.isfinite(scores).all():
                    raise ValueError("values and weights must be finite numbers")
                line, best = top_columns(scores, k)
                out["r"].append(r_ids[first + line])
                out["i"].append(i_ids[best])
                out["score"].append(scores[line, best])
        return pd.DataFrame({n: np.concatenate(v) if v else [] for n, v in out.items()}).astype(
            {"r": "int64", "i": "int64", "score": "float64"}
        )

    grouped = cogroup_by(left, right, ["_u", "_i"], chunks * blocks)
    parts = grouped.applyInPandas(score, "r long, i long, score double")
    ranked = top_k_per(parts, ["r"], [F.col("score").desc(), "i"], k)
    return ranked.select(F.col("r").alias(row), F.col("i").alias(col), "score", "rank")


def user_rows(df: DataFrame, norm: str = "l2", user: str = "user", item: str = "track", value: str = "time") -> DataFrame:
    """(user, track, r, q): normalised ratings r and the user's unit vector q.

    Duplicates of a pair are averaged after normalising by the mean ('center') and before scaling to unit length ('l2').
    """
    if norm == "center":
        rows = normalize_by(df, user, value, "center").groupBy(user, item).agg(F.avg(value).alias("r"))
    else:
        pairs = df.groupBy(user, item).agg(F.avg(value).alias(value))
        rows = normalize_by(pairs, user, value, "l2").withColumnRenamed(value, "r")
    return normalize_by(rows.select(F.col(user).alias("user"), F.col(item).alias("track"), "r"), "user", "r", "l2", "q")


def rated(df: DataFrame, user: str = "user", item: str = "track", value: str = "time") -> DataFrame:
    """The rows that say something: with a user, an item and a value that is a number."""
    known = F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.filter(known)


def user_cf(df: DataFrame, norm: str = "l2", k: int = 100, user: str = "user", item: str = "track", value: str = "time") -> DataFrame:
    """User-based top k with all users as neighbours: score_ui = sum over v != u of cos(u, v) * r_vi.

    With q the unit rows, sum_v (q_u . q_v) r_vi = q_u . (Q^T R)_i, so the user x user matrix is never formed; the
    user's own term, r_ui, is subtracted. Items already played are not removed. Rows without user, item or value teach
    nothing; every item of ``df`` is a candidate.
    """
    rows = user_rows(rated(df, user, item, value), norm, user, item, value)
    top = top_scores(materialize(rows, "user-rows"), k, "q", "r", "q", minus="r", columns=df.select(item), size=CHUNK)
    return top.select(F.col("row").alias("user"), F.col("col").alias("track"), "score", "rank")


def neighbour_stats(df: DataFrame, norm: str = "l2", **names) -> DataFrame:
    """Mean number of positive and of negative similarities per user; users without any count as zero."""
    rows = materialize(user_rows(df, norm, **names), "user-rows")
    n_users = rows.agg(F.count_distinct("user")).first()[0]

    def signs(j: np.ndarray, i: np.ndarray, sums: dict, *_) -> pa.RecordBatch:
        sims = np.where(j == i, 0.0, np.round(sums["w"], 12))
        return pa.RecordBatch.from_arrays([pa.array([int((sims > 0).sum())]), pa.array([int((sims < 0).sum())])], ["positive", "negative"])

    counts = column_pairs(rows, "track", "user", ["q"], signs, "positive long, negative long", {"w": ("q", "q")}, CHUNK)
    return counts.agg(
        (F.sum("positive") / n_users).alias("mean_positive"), (F.sum("negative") / n_users).alias("mean_negative")
    )


def item_weights(df: DataFrame, how: str = "cosine", user: str = "user", item: str = "track", value: str = "time", best: int | None = None) -> DataFrame:
    """(j, i, w): similarity of two different items over the users. 'cosine' uses whole columns; 'pearson' uses the
    users who rated both and needs at least two of them. With ``best`` at least the cosines that are among an item's ``best`` largest
    by 9 digits: no task passes on the others."""
    pairs = df.groupBy(user, item).agg(F.avg(value).alias("r")).select(F.col(user).alias("user"), F.col(item).alias("track"), "r")
    if how == "cosine":
        rows = materialize(normalize_by(pairs, "track", "r", "l2", "x"), "item-columns")
        return column_products(rows, {"w": ("x", "x")}, best=best and ("w", best)).where("j <> i")
    rows = materialize(pairs.withColumn("one", F.lit(1.0)).withColumn("rr", F.col("r") * F.col("r")), "item-columns")
    sums = column_products(
        rows,
        {"n": ("one", "one"), "x": ("r", "one"), "y": ("one", "r"), "xy": ("r", "r"), "xx": ("rr", "one"), "yy": ("one", "rr")},
    ).where("j <> i AND n >= 2")
    # rounding keeps a constant column's variance at zero instead of rounding noise
    vx = F.round(F.col("n") * F.col("xx") - F.col("x") * F.col("x"), 9)
    vy = F.round(F.col("n") * F.col("yy") - F.col("y") * F.col("y"), 9)
    w = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(vx * vy))
    return sums.select("j", "i", w.alias("w")).where("w IS NOT NULL")


def similar_items(weights: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """k most similar items per item."""
    return top_k_per(weights.withColumn("w", F.round("w", digits)), ["j"], [F.col("w").desc(), "i"], k)


def item_cf(df: DataFrame, k: int = 100, how: str = "cosine", user: str = "user", item: str = "track", value: str = "time") -> DataFrame:
    """Item-based top k: score_ui = sum over the user's items j != i of sim(j, i) * r_uj. Rows without user, item or value
    teach nothing; every item of ``df`` is a candidate."""
    known = rated(df, user, item, value)
    pairs = known.groupBy(user, item).agg(F.avg(value).alias("q")).select(F.col(user).alias("user"), F.col(item).alias("track"), "q")
    if how != "cosine":
        return score_by_columns(pairs, materialize(item_weights(known, how, user, item, value), "item-weights"), k)
    rows = materialize(normalize_by(pairs, "track", "q", "l2", "x"), "item-columns")
    top = top_scores(rows, k, "x", "x", "q", diagonal=False, columns=df.select(item), size=CHUNK)
    return top.select(F.col("row").alias("user"), F.col("col").alias("track"), "score", "rank")


def npmi(df: DataFrame, user: str = "user", item: str = "track", of: DataFrame | None = None) -> DataFrame:
    """(i, j, npmi) for items played by a common user; chances are shares of users. ``of``, a table of items: only those pairs whose i
    is in it."""
    rows = df.select(F.col(user).alias("user"), F.col(item).alias("track")).distinct().withColumn("one", F.lit(1.0))
    rows = materialize(rows, "item-sets")
    users = rows.select("user").distinct().count()

    def values(j: np.ndarray, i: np.ndarray, sums: dict, n_j: np.ndarray, n_i: np.ndarray) -> pa.RecordBatch:
        apart = j != i
        j, i, n_j, n_i = j[apart], i[apart], n_j[apart], n_i[apart]
        both = sums["n"][apart] / users
        # a pair that every user has: both chances are 1 and the limit is 1
        value = np.divide(np.log(both / ((n_i / users) * (n_j / users))), -np.log(both), out=np.ones(len(both)), where=both != 1)
        return pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), pa.array(value)], ["i", "j", "npmi"])  # both ways are there

    return column_pairs(rows, "user", "track", ["one"], values, "i long, j long, npmi double", {"n": ("one", "one")}, CHUNK, of)


def item_linear(df: DataFrame, neighbours: int = 50, ridge: float = 10.0, user: str = "user", item: str = "track", value: str = "time") -> DataFrame:
    """Linear item-item weights (j, i, w), each target item i fit by ridge regression on the items that co-occur with it
    most. A target needs only the Gram entries among its own neighbours, a table of at most neighbours squared. The fit on
    all items is ``linear.item_linear``."""
    pairs = df.groupBy(user, item).agg(F.avg(value).alias("r")).select(F.col(user).alias("user"), F.col(item).alias("track"), "r")
    rows = materialize(pairs, "ratings")
    gram = materialize(column_products(rows, {"w": ("r", "r")}), "gram")
    near = materialize(
        top_k_per(gram.where("j <> i").withColumn("_w", F.round("w", 9)), ["i"], [F.col("_w").desc(), "j"], neighbours, "_r")
        .select("i", "j", F.col("w").alias("b")), "neighbours",
    )
    lists = near.groupBy("i").agg(F.collect_set("j").alias("_near"))  # at most ``neighbours`` ids
    inner = (
        near.select("i", F.col("j").alias("a"))
        .join(lists, "i")
        .select("i", "a", F.explode("_near").alias("c"))
        .join(gram.select(F.col("j").alias("a"), F.col("i").alias("c"), "w"), ["a", "c"])
    )

    def solve(key, ip: pd.DataFrame, bp: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(bp["j"].to_numpy())
        b = bp.set_index("j")["b"].reindex(ids).to_numpy(dtype=float)
        g = np.zeros((len(ids), len(ids)))
        g[np.searchsorted(ids, ip["a"].to_numpy()), np.searchsorted(ids, ip["c"].to_numpy())] = ip["w"].to_numpy()
        w = np.linalg.solve(g + ridge * np.eye(len(ids)), b)
        return pd.DataFrame({"j": ids, "i": np.full(len(ids), key[0]), "w": w})

    target = near.select(*[F.col(c).alias(c) for c in ("i", "j", "b")])
    return inner.groupBy("i").cogroup(target.groupBy("i")).applyInPandas(solve, "j long, i long, w double")

