import math

import pytest
from pyspark.sql import functions as F

from tastemill.functions import scalars as sc
from tastemill.functions import vectors as ve
from tastemill.functions.hashing import murmur3_32, murmur3_seed, salted_md5, uniform
from tastemill.functions.student import t_quantile
from tastemill.operators import text as tx
from tastemill.operators.experiments import assign


def test_murmur_published_vectors(spark):
    rows = spark.createDataFrame([("",), ("1234",), ("12345678",), (None,)], "s string")
    got = [r[0] for r in rows.select(murmur3_32("s", 42)).collect()]
    assert got[1:] == [3403470381, 2036199019, None]
    assert rows.select(murmur3_32("s", 0)).first()[0] == 0
    assert murmur3_seed("") == 0


def test_murmur_equals_the_plain_algorithm_on_every_length(spark):
    words = ["".join(chr(97 + (i * 7 + n) % 26) for i in range(n)) for n in range(20)] + ["né", "日本語x"]
    rows = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r[0]: r[1] for r in rows.select("s", murmur3_32("s", 0)).collect()}
    assert got == {w: murmur3_seed(w) for w in words}


def test_assignment_is_balanced(spark):
    counts = spark.range(20000).groupBy(assign("id", "I2I", 3).alias("t")).count().collect()
    assert {r["t"] for r in counts} == {"C", "T1", "T2"}
    assert all(abs(r["count"] - 20000 / 3) < 300 for r in counts)


def test_uniform_is_uniform_and_repeatable(spark):
    df = spark.range(20000).select(uniform("id", seed=1).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.001 and 0.999 < high < 1 and abs(mean - 0.5) < 0.01
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_t_quantile_table():
    # t(0.975, v) for v = 1, 5, 10, 30, 120
    for dof, value in ((1, 12.706), (5, 2.571), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert t_quantile(0.975, dof) == pytest.approx(value, abs=5e-4)
    assert math.isnan(t_quantile(0.975, float("nan")))


def test_bounded_numbers(spark):
    rows = spark.createDataFrame([("unknown",), ("5-10",), ("0",), ("500",), ("x",), ("7.5",)], "s string")
    assert [r[0] for r in rows.select(sc.parse_bounded_number("s")).collect()] == [1.0, 5.0, 1.0, 100.0, None, 7.5]


def test_texts(spark):
    row = spark.createDataFrame([("a\r\n\nb", None, "x\n   y\n  z")], "a string, b string, c string")
    assert row.select(sc.normalize_text("a"), sc.normalize_text("b"), sc.unindent("c")).first()[:] == ("a b", "unknown", "x y z")


def test_numbered_list(spark):
    rows = spark.createDataFrame([(1, "1. A\n2.B\nx\n3.\n 4 . D. E\n5a. F\n.6 G")], "k int, text string")
    got = tx.parse_numbered_list(rows, "text", "tag").collect()
    assert [(r["id"], r["item"], r["tag"]) for r in got] == [(1, "A", "tag"), (2, "B", "tag"), (4, "D. E", "tag")]


def test_reaction_and_arrays(spark):
    df = spark.createDataFrame([(0.9, [1, 2, 3]), (0.1, []), (0.5, None)], "t double, a array<long>")
    assert [r[0] for r in df.select(sc.reaction("t")).collect()] == ["good", "bad", "neutral"]
    assert [r[0] for r in df.select(sc.pad_array("a", 2, -1)).collect()] == [[1, 2], [-1, -1], [-1, -1]]
    assert df.select(sc.mask_array("a", [F.lit(2)], 0)).first()[0] == [1, 0, 3]


def test_cosine_example(spark):
    row = spark.createDataFrame([([1.0, 4.0, 5.0], [4.0, 1.0, 5.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    value, none = row.select(ve.cosine("a", "b"), ve.cosine("a", "z")).first()
    assert value == pytest.approx(33 / 42) and none is None


def test_anonymise(spark):
    assert spark.range(1).select(salted_md5("id", "s")).first()[0] == __import__("hashlib").md5(b"s0").hexdigest()
