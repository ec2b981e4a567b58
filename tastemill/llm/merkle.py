"""Merkle manifest of a table: one hash tree per value of a column, a tree of their roots above them, and every row's proof.

Rows are numbered within their tree and dealt to blocks of ``fanout`` to a power of them, so that a block is an aligned
subtree, hashed by one task. Between blocks the upper levels are a butterfly: in round r, the blocks that differ in digit r
of their number (written in base ``fanout``) swap the roots of the subtrees they know, and every one of them hashes the common
ancestor itself. After the last round each block holds the root and all upper siblings, and no pass leads downward. Blocks that
the last, shorter subtree lacks are stood in for by its last block, which knows the same root. Rounds are exchanges of one
small row per block; a large tree is cut into as many blocks as its rows need.

A node is H, the lower-case hexadecimal sha256 of its children's digests as text; in each level every ``fanout`` consecutive
nodes have one parent, the last run fewer, even one; a tree of one row is that row's leaf.

Defined results: NULL in the tree's column is a tree of its own, before all others; in ``key``, it sorts first; rows of one
tree that share a key follow their digest, and equal rows are equal leaves; an empty table has no rows. A field that is NULL
is ``-`` in a leaf, so that it differs from an empty text (``0:``). Other columns pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.ordering import number_rows
from tastemill.session import materialize

#: Most rows of a block.
LARGEST = 4096
#: Rounds of the butterfly between two written tables.
ROUNDS = 8


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each ``-`` if NULL, else its length in UTF-8 bytes, ``:`` and itself."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """Nodes level by level: ``height`` levels above the leaves, or up to the single root."""
    levels = [leaves]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        below = levels[-1]
        levels.append([_h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def _siblings(levels: list[list[str]], fanout: int) -> tuple[list[list[str]], list[list[str]]]:
    """Per leaf and level, the digests left and right of its ancestor within the run, joined."""
    before, after = [], []
    for nodes in levels[:-1]:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        before.append(["".join(run[:j]) for run in runs for j in range(len(run))])
        after.append(["".join(run[j + 1 :]) for run in runs for j in range(len(run))])
    places = range(len(levels[0]))
    powers = [fanout**n for n in range(len(levels) - 1)]
    return ([[row[i // p] for row, p in zip(side, powers, strict=True)] for i in places] for side in (before, after))


def _height(fanout: int) -> int:
    height = 1
    while fanout ** (height + 1) <= LARGEST:
        height += 1
    return height


def _block_roots(numbered: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, block, alone, among): the block's root if it is the whole tree, and if it is one of several."""

    def roots(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        leaves = rows.sort_by("place")["leaf"].to_pylist()
        alone, among = (_levels(leaves, fanout, h)[-1][0] for h in (None, height))
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "alone": [alone], "among": [among]})

    rows = numbered.select("tree", "block", "place", "leaf")
    return rows.groupBy("tree", "block").applyInArrow(roots, "tree string, block long, alone string, among string")


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, several, node, left, right): of every block the root of its tree, and its siblings from the block
    up to it. ``blocks``: (tree, block, alone, among), written."""
    counts = blocks.groupBy("tree").agg(F.count(F.lit(1)).alias("blocks"))
    none = F.array().cast("array<string>")
    several = F.col("blocks") > 1
    now = blocks.join(counts, "tree").select(
        "tree", "block", "blocks", F.when(several, F.col("among")).otherwise(F.col("alone")).alias("node"),
        none.alias("left"), none.alias("right"),
    )
    most = counts.agg(F.max("blocks")).first()[0] or 0
    width, rounds = 1, 0
    while width < most:
        if rounds % ROUNDS == 0:
            now = materialize(now, "butterfly")
        now = _swap(now, fanout, width)
        width, rounds = width * fanout, rounds + 1
    return materialize(now.withColumn("several", several), "butterfly")


def _swap(now: DataFrame, fanout: int, width: int) -> DataFrame:
    """One round: groups of at most ``fanout`` blocks whose numbers differ in one digit swap what they know."""
    block, size = F.col("block"), F.lit(width)
    digit = F.floor(block / size) % fanout
    low = block % size
    # the last block also speaks for the blocks that its subtree of this round lacks
    stands_in = (block == F.col("blocks") - 1) & (digit > 0)
    places = F.when(stands_in, F.sequence(low, size - 1)).otherwise(F.array(low))
    member = F.struct(
        F.col("digit"), F.col("node"), F.when(F.col("place") == F.col("low"), F.col("block")).alias("block"),
        F.when(F.col("place") == F.col("low"), F.col("left")).alias("left"),
        F.when(F.col("place") == F.col("low"), F.col("right")).alias("right"),
    )
    group = now.select("*", digit.alias("digit"), low.alias("low"), F.floor(block / (size * fanout)).alias("high"),
                       F.explode(places).alias("place"))
    group = group.groupBy("tree", "blocks", "high", "place").agg(F.sort_array(F.collect_list(member)).alias("members"))
    one = group.select("tree", "blocks", "members", F.explode("members").alias("own")).filter("own.block IS NOT NULL")

    def nodes(which) -> Column:
        kept = F.filter("members", lambda m: which(m["digit"], F.col("own.digit")))
        return F.array_join(F.transform(kept, lambda m: m["node"]), "")

    grows = size < F.col("blocks")
    parent = F.sha2(nodes(lambda d, own: F.lit(True)), 256)

    def side(name: str, which) -> Column:
        old = F.col(f"own.{name}")
        return F.when(grows, F.array_append(old, nodes(which))).otherwise(old).alias(name)

    return one.select(
        "tree", F.col("own.block").alias("block"), "blocks", F.when(grows, parent).otherwise(F.col("own.node")).alias("node"),
        side("left", lambda d, own: d < own), side("right", lambda d, own: d > own),
    )


def _numbered(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """``leaves(tree, order struct, leaf, row struct)`` with place and block within the tree, written."""
    placed = number_rows(leaves, ["tree"], ["order", "leaf"], "place")
    place = (F.col("place") - 1).alias("place")
    block = F.floor((F.col("place") - 1) / fanout**height).alias("block")
    return materialize(placed.select("tree", place, block, "leaf", "row"), "leaves")


def _proofs(numbered: DataFrame, upper: DataFrame, fanout: int, height: int) -> DataFrame:
    """(row, leaf, node, root, left, right) of every leaf; ``upper``: one row per block."""
    fields = numbered.select("row", "leaf").schema.simpleString()[len("struct<") : -1]
    texts = pa.list_(pa.string())

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        top = {name: above[name][0].as_py() for name in ("several", "node", "root", "left", "right")}
        levels = _levels(rows["leaf"].to_pylist(), fanout, height if top["several"] else None)
        left, right = _siblings(levels, fanout)
        n = rows.num_rows
        out = rows.select(["row", "leaf"])
        for name in ("node", "root"):
            out = out.append_column(name, pa.array([top[name]] * n, pa.string()))
        out = out.append_column("left", pa.array([own + top["left"] for own in left], texts))
        return out.append_column("right", pa.array([own + top["right"] for own in right], texts))

    schema = ", ".join(_typed(fields)) + ", node string, root string, left array<string>, right array<string>"
    return numbered.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(prove, schema)


def _typed(fields: str) -> list[str]:
    """``row:struct<...>,leaf:string`` as parts of a schema."""
    row, leaf = fields.rsplit(",", 1)
    return [f"row {row.split(':', 1)[1]}", f"leaf {leaf.split(':', 1)[1]}"]


def manifest(rows: DataFrame, by: str, key: str, leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """``rows`` with ``subroot`` (root of the row's tree), ``root`` (of all subroots, in ascending order of ``by``), and the proof:
    ``left`` and ``right`` hold per level, from the leaf to the root, the digests beside the row's ancestor.

    One tree per value of ``by``, its leaves (column ``leaf``) in ascending order of ``key``. Columns of ``rows`` that have a
    name of the result are replaced.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    height = _height(fanout)
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    named = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("order"), F.col(leaf).alias("leaf"), F.col(by).alias("by"), named.alias("row"))
    leaves = materialize(leaves, "digests")
    numbered = _numbered(leaves.drop("by"), fanout, height)
    blocks = materialize(_block_roots(numbered, fanout, height), "block-roots")
    upper = _butterfly(blocks, fanout)

    # the same once more, with the subroots as the leaves of one tree
    trees = upper.filter("block = 0").select("tree", F.col("node").alias("leaf"))
    orders = leaves.groupBy("tree").agg(F.min("by").alias("order"))
    tops = trees.join(orders, "tree").select(F.lit("").alias("tree"), "order", "leaf", F.struct("tree").alias("row"))
    over = _numbered(tops, fanout, height)
    above = _butterfly(materialize(_block_roots(over, fanout, height), "block-roots"), fanout)
    top = _proofs(over, above.withColumn("root", F.col("node")), fanout, height)
    top = materialize(top.select(F.col("row.tree").alias("tree"), "root", F.col("left").alias("l"), F.col("right").alias("r")), "tops")

    whole = upper.join(top, "tree").select(
        "tree", "block", "several", "node", "root", F.concat("left", "l").alias("left"), F.concat("right", "r").alias("right")
    )
    got = _proofs(numbered, whole, fanout, height)
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in ("subroot", "root", "left", "right")]
    return got.select(*kept, F.col("node").alias("subroot"), "root", "left", "right")


def proof_digest(left: Column, right: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.concat(F.lit(""), F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), "")), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), leaf,
                       lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def tamper_test(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, source, lang, n_chars, text)`` with its proof digest, and the root that its proof leads to after
    ``n_chars`` grew by one in rows whose crc32 of doc_id 7 divides; ``verified`` where that is the manifest's root."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = [F.try_add(f, F.lit(1).cast("long")) if i == 3 else f for i, f in enumerate(fields)]
    given = docs.select(
        F.col("doc_id").cast("long"), "lang", leaf_digest(*fields).alias("leaf"), F.when(changed, leaf_digest(*more)).alias("tampered")
    )
    proved = manifest(given, "lang", "doc_id")
    left, right = F.col("left"), F.col("right")
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(left, right).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), left, right).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def comparison_sql() -> str:
    """The whole of ``tamper_test`` as one recursive statement."""

    def leaf(n_chars: str) -> str:
        parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    climb = """SELECT t, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY t, lvl, pos // 2, n"""
    # Spark's crc32 of a short ASCII text, bit by bit, as DuckDB has no such function
    crc = """bits(doc_id, s, i, c) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT doc_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS x FROM bits WHERE i < 8 * length(s))),
crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM bits WHERE i = 8 * length(s))"""
    return f"""WITH RECURSIVE {crc},
docs AS (SELECT *, {leaf('n_chars')} AS leaf, {leaf('(n_chars + 1)')} AS changed FROM documents),
placed AS (SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS given, coalesce('=' || lang, '-') AS t,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM docs LEFT JOIN crc USING (doc_id)),
up(t, lvl, pos, h, n) AS (SELECT t, 0, pos, leaf, n FROM placed UNION ALL {climb.format('up')}),
tops AS (SELECT t, h, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up JOIN (SELECT t, any_value(lang) AS k FROM placed GROUP BY t) USING (t) WHERE n = 1),
over_(t, lvl, pos, h, n) AS (SELECT '', 0, pos, h, n FROM tops UNION ALL {climb.format('over_')}),
steps AS (
  SELECT p.doc_id, p.t, p.pos, u.lvl, s.h AS sib, (p.pos >> u.lvl) & 1 AS odd FROM placed p
  JOIN (SELECT DISTINCT t, lvl FROM up WHERE n > 1) u ON u.t = p.t
  LEFT JOIN up s ON s.t = p.t AND s.lvl = u.lvl AND s.pos = xor((p.pos >> u.lvl), 1)
  UNION ALL
  SELECT p.doc_id, p.t, p.pos, 1000 + o.lvl, s.h, (q.pos >> o.lvl) & 1 FROM placed p JOIN tops q ON q.t = p.t
  JOIN (SELECT DISTINCT lvl FROM over_ WHERE n > 1) o ON TRUE
  LEFT JOIN over_ s ON s.lvl = o.lvl AND s.pos = xor((q.pos >> o.lvl), 1)),
paths AS (SELECT t, pos, sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof, list(coalesce(sib, '') ORDER BY lvl) AS sibs,
  list(odd ORDER BY lvl) AS odds FROM steps GROUP BY t, pos),
fold(t, pos, i, h, sibs, odds) AS (
  SELECT t, pos, 0, given, coalesce(sibs, []), coalesce(odds, []) FROM placed LEFT JOIN paths USING (t, pos)
  UNION ALL
  SELECT t, pos, i + 1, sha256(CASE WHEN odds[i + 1] = 1 THEN sibs[i + 1] || h ELSE h || sibs[i + 1] END), sibs, odds
  FROM fold WHERE i < len(sibs))
SELECT p.doc_id, p.leaf, q.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN tops q ON q.t = p.t JOIN (SELECT h FROM over_ WHERE n = 1) r ON TRUE LEFT JOIN paths w ON w.t = p.t AND w.pos = p.pos
JOIN fold f ON f.t = p.t AND f.pos = p.pos AND f.i = len(f.sibs)"""
