"""Quantiles by refinement against NumPy: ties, NULLs, skew, few rows, and brackets that have to be cut again."""

import numpy as np
import pytest

from tastemill.operators import aggregates as ag

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns(n, seed=0):
    rng = np.random.default_rng(seed)
    return {
        "plain": rng.standard_normal(n),
        "ties": rng.integers(0, 3, n).astype(float),
        "one": np.full(n, 4.5),
        "skew": np.exp(rng.standard_normal(n) * 8),
        "mostly": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)),
    }


def check(spark, data, missing=()):
    names = list(data)
    n = len(data[names[0]])
    rows = [tuple(None if (i, c) in missing else float(data[c][i]) for c in names) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r["column"], r["p"]): r["value"] for r in ag.quantiles_by_refinement(df, names, SHARES).collect()}
    for c in names:
        known = [data[c][i] for i in range(n) if (i, c) not in missing]
        for p in SHARES:
            if known:
                assert got.pop((c, p)) == pytest.approx(np.quantile(known, p), rel=1e-12)
    assert not got
    return df


def test_quantiles_of_all_columns(spark):
    data = columns(20_000)
    check(spark, data, {(i, "ties") for i in range(0, 20_000, 3)})


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_rows(spark, n):
    check(spark, columns(n), {(0, "ties")} if n > 1 else {(0, "one")})


def test_brackets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(ag, "ORDERED", 5)
    monkeypatch.setattr(ag, "ACCURACY", 50)
    check(spark, columns(5_000, 3))


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    real = ag.F.percentile_approx
    monkeypatch.setattr(ag.F, "percentile_approx", lambda c, ends, accuracy: real(c, [min(1.0, e + 0.2) for e in ends], accuracy))
    check(spark, {k: v for k, v in columns(3_000, 4).items() if k in ("plain", "ties")})


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (2.0,), (None,)], "x double")
    got = {r["p"]: r["value"] for r in ag.quantiles_by_refinement(df, ["x"], [0.0, 1 / 3, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[1 / 3] == 2.0 and np.isnan(got[1.0])


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    got = {r["column"]: r for r in ag.summarize(df, ["x", "y"]).collect()}
    assert got["x"]["count"] == 0 and got["x"]["q50"] is None and got["y"]["q50"] == 1.0
    assert {r["count"] for r in ag.summarize(df.limit(0), ["x", "y"]).collect()} == {0}
