"""The hash trees, their proofs and the butterfly against trees built node by node."""

import hashlib

import pytest
from pyspark.sql import functions as F

from check import compare
from tastemill.llm import merkle
from tastemill.llm.queries import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, row string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """(root, proof of every leaf as (left, right) per level)."""
    level, spots, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, at in enumerate(spots):
            run, own = runs[at // fanout], at % fanout
            proofs[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
        level, spots = [h("".join(run)) for run in runs], [at // fanout for at in spots]
    return level[0], proofs


@pytest.mark.parametrize("fanout,largest", [(2, 2), (2, 8), (3, 3), (5, 30), (2, 4096)])
def test_proofs_are_those_of_plain_trees(spark, monkeypatch, fanout, largest):
    monkeypatch.setattr(merkle, "LARGEST", largest)
    sizes = {None: 3, "": 1, "a": 2, "b": 37, "é": 64, "z": 65}
    rows = [(f"{t}{i}", t, i) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(h(x), t, i, "kept") for x, t, i in reversed(rows)], "leaf string, t string, k int, root string")
    got = {(r["t"], r["k"]): r for r in merkle.manifest(df.repartition(3), "t", "k", fanout=fanout).collect()}
    order = sorted(sizes, key=lambda t: (t is not None, (t or "").encode()))
    below = {t: tree([h(f"{t}{i}") for i in range(sizes[t])], fanout) for t in order}
    root, above = tree([below[t][0] for t in order], fanout)
    assert len(got) == len(rows)
    for place, t in enumerate(order):
        for i in range(sizes[t]):
            r = got[t, i]
            assert (r["subroot"], r["root"]) == (below[t][0], root)
            assert list(zip(r["left"], r["right"], strict=True)) == below[t][1][i] + above[place]


def test_defined_cases(spark):
    rows = [(1, "x", "en", "s", 1, "r", "w")] * 3 + [(1, "y", "en", "s", 1, None, None), (None, None, None, None, None, None, None),
            (7, "", "de", None, 2**63 - 1, "", ""), (8, "long " * 50_000, "en", "s", None, "q", "w")]
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.tamper_test(df).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    assert {r["leaf"] for r in got if r["doc_id"] is None} == {h("-----")}
    assert {r["leaf"] for r in got if r["doc_id"] == 7} == {h(f"1:7-2:de19:{2**63 - 1}0:")}
    assert merkle.tamper_test(df.limit(0)).count() == 0
    one = merkle.tamper_test(df.filter("doc_id = 7")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")
    with pytest.raises(ValueError):
        merkle.manifest(df, "lang", "doc_id", fanout=1)


def test_tampered_rows_fail(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", None, i if i % 2 else None, "", "") for i in range(200)], DOCS)
    marked = df.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).alias("hit"))
    got = {r["doc_id"]: r["verified"] for r in merkle.tamper_test(df).collect()}
    want = {r["doc_id"]: not (r["hit"] and r["doc_id"] % 2) for r in marked.collect()}
    assert got == want and not all(got.values())


def test_sql_agrees(spark):
    import duckdb

    rows = [(i * 3 % 101, f"täxt {i}", ("en", "de", None, "fr", "")[i * i % 5], "s" if i % 3 else None, i if i % 4 else None, "", "") for i in range(70)]
    df = spark.createDataFrame(rows, DOCS).drop("root", "row")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert compare(con, merkle.tamper_test(df), SQL["op11_merkle_manifest"]) == ""
