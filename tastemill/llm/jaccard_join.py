"""Groups of documents whose word-shingle sets are alike, exactly: a prefix join with token combinations.

A document's set holds 58-bit hashes of its distinct shingles, with the shingle's length in the high bits, so that sorted
hashes begin with the longest, and so mostly rarest, shingles. Two sets link when 100 |A and B| >= percent |A or B|, so a set of
n shingles can miss at most m = n - ceil(percent n / 100) of a partner's. All sets are ordered alike, and a link shows in
the first tokens of both:

1. Equal sets are one class, known by a 64-bit hash of the set (``doc`` below); only classes go on, each as one row, however
   often a row is repeated and however many texts share a doc_id.
2. Every class stores a prefix of its sorted hashes, half as long again as the m + 1 it needs. Tokens that more than ``rare``
   classes have among their first m + 1 are frequent; those classes are given signatures anew, and tokens that more than
   ``rare`` of them would then sign with become frequent, too, a few times over. Any choice of frequent tokens is exact: it
   only decides how long the lists of step 4 get.
3. In the final order rare tokens (sorted) come before frequent ones (sorted). Each of the first m + 1 tokens that are rare is
   a signature. Where a set has only r <= m rare ones, its prefix goes on through the frequent tokens, which are dealt by
   hash to G groups, until the tokens of the groups less one each add up to m + 1 - r; signatures are then the *pairs* of
   prefix tokens of one group. Fewer than r + sum(tokens of a group - 1) misses leave a rare token or two of a group,
   so linked sets share a signature. G follows the power of two below the larger set's size; sets near the next power
   are indexed under both. Stored prefixes are enough for most sets; whole texts are read again for the rest.
4. Sets that share a signature are candidates. Their stored prefixes, m + s hashes long, have at least s in common if they
   link (the least s of the two), which drops chance hits; the others are compared in full. To spare the square of a group's
   size, first with one member of each signature's list, then with another one, and what is linked becomes one label; after
   that only members of different labels are compared: pairs are no longer needed inside a label. Short lists give their
   pairs. What hangs together by long lists, such as a large group of copies just below the threshold, is cut into blocks;
   a task takes two blocks and counts all common tokens by matrix products, so that no candidate pair is ever a row.

Defined results: a text with fewer words than a shingle has the whole sequence as its one shingle; NULL, empty and blank
texts have the empty set, which links with nothing; rows that repeat a doc_id with other texts are joined like any others, and
that id links them; a row without doc_id gets no component and links nothing; repeated rows are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import discard
from tastemill.llm.graph import components
from tastemill.session import materialize

#: Odd multipliers of the 64-bit mixing steps.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
GROUP_TOKENS = 8
#: Members from which a list is compared by blocks, sets in a block, and tokens of one matrix product.
LONG_LIST, BLOCK, COLUMNS = 48, 256, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def _ranked(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sorted distinct tokens: 6 bits that fall with the shingle's length, then 58 of its hash."""
    high = np.uint64(63) - np.minimum(lengths, 63).astype(np.uint64)
    return np.unique((high << np.uint64(58)) | (hashes >> np.uint64(6)))


def shingles(data: bytes | None, words: int) -> np.ndarray:
    """Tokens of the distinct word shingles of a whole text; A-Z count as a-z."""
    found = data.lower().split() if data else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        whole = b" ".join(found)
        return _ranked(np.array([xxhash.xxh3_64_intdigest(whole, 1)], np.uint64), np.array([len(whole)]))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    last = len(one) - words + 1
    out = one[:last].copy()
    for i in range(1, words):
        out = _mix(out * M1 + one[i : i + last])
    return _ranked(out, size[words:] - size[:-words])


def allowed_misses(n: int, percent: int) -> int:
    return n - -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Hashes kept of a set: those it may miss, and as many again as two prefixes must share."""
    misses = allowed_misses(n, percent)
    return misses + max(4, misses // 2)


def _scheme(n: int) -> int:
    return n.bit_length() - 1


def pair_signatures(frequent: np.ndarray, need: int, scheme: int) -> np.ndarray:
    """Hashes of the same-group pairs of the shortest prefix whose groups, less one token each, hold ``need`` tokens."""
    groups = max(1, (1 << scheme) // GROUP_TOKENS)
    group = (_mix(frequent * M1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    opens = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    first = np.zeros(len(group), bool)
    first[order] = opens
    enough = int(np.searchsorted(np.cumsum(~first), need)) + 1
    tokens, group = frequent[:enough], group[:enough]
    order = np.argsort(group, kind="stable")
    tokens, group = tokens[order], group[order]
    out, step = [], 1
    while step < len(tokens):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        out.append(_mix(tokens[:-step][same] * M1 + tokens[step:][same]) + np.uint64(scheme))
        step += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int, n: int | None = None) -> tuple | None:
    """(single tokens, pairs) that a set of ``n`` tokens signs with. ``tokens`` are all of them or the first ones, ``frequent``
    the frequent ones among these; None if the first ones are not enough."""
    n = len(tokens) if n is None else n
    need = allowed_misses(n, percent) + 1
    is_frequent = np.isin(tokens, frequent)
    rare = tokens[~is_frequent]
    none = np.empty(0, np.uint64)
    if len(rare) >= need:
        return rare[:need], none
    if len(tokens) < n:
        return None
    schemes = range(_scheme(n), _scheme(100 * n // percent) + 1)
    return rare, np.concatenate([none, *(pair_signatures(tokens[is_frequent], need - len(rare), s) for s in schemes)])


def _sets(docs: DataFrame, words: int, make, schema: str) -> DataFrame:
    """``make(doc_ids, sets)`` -> list of Arrow columns, over batches of documents."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(make(part.column(0), [shingles(t, words) for t in texts]), names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _longs(lists: list[np.ndarray | None]) -> pa.Array:
    whole = [np.empty(0, np.uint64) if x is None else x for x in lists]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int32)
    flat = np.concatenate([*whole, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in lists]))


def _classes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), 2) for s in sets], np.uint64).view(np.int64))


def _signed(rows: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """(doc, n, singles, pairs) of rows (doc, n, tokens); both NULL where the tokens given are not enough."""
    tokens = rows.select("doc", F.explode("tokens").alias("sig"))
    # at most all tokens of one set: ``doc`` is a class, of which there is one row
    among = tokens.join(frequent, "sig", "left_semi").groupBy("doc").agg(F.collect_list("sig").alias("frequent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sizes = part.column(1).to_pylist()
                lists = [
                    [np.asarray(x.values if x.is_valid else [], np.int64).view(np.uint64) for x in part.column(i)] for i in (2, 3)
                ]
                got = [signatures(t, f, percent, n) for t, f, n in zip(*lists, sizes, strict=True)]
                both = [_longs([None if g is None else g[i] for g in got]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *both], ["doc", "n", "singles", "pairs"])

    known = rows.join(among, "doc", "left").select("doc", F.col("n").cast("long").alias("n"), "tokens", "frequent")
    return known.mapInArrow(run, "doc long, n long, singles array<long>, pairs array<long>")


def _signatures(heads: DataFrame, whole_sets, percent: int, rare: int, rounds: int = 3) -> DataFrame:
    """(sig, doc, n): the signatures of all classes."""
    needed = F.slice("prefix", F.lit(1), (_misses(F.col("n"), percent) + 1).cast("int"))
    plain = heads.select("doc", "n", F.explode(needed).alias("sig"))
    counts = plain.groupBy("sig").count()
    frequent = materialize(counts.filter(F.col("count") > rare).select("sig"), "frequent")
    hit = materialize(plain.join(frequent, "sig", "left_semi").select("doc").distinct(), "hit")
    whole: list[DataFrame] = []  # whole sets of the classes whose stored prefixes were not enough so far
    for turn in range(rounds):
        stored = heads.join(hit, "doc", "left_semi").select("doc", "n", F.col("prefix").alias("tokens"))
        first = materialize(_signed(stored, frequent, percent), "signed")
        short = first.filter(F.col("singles").isNull()).select("doc")
        for known in whole:
            short = short.join(known.select("doc"), "doc", "left_anti")
        whole.append(materialize(whole_sets(materialize(short, "short")), "whole"))
        second = materialize(_signed(reduce(DataFrame.unionByName, whole), frequent, percent), "signed_whole")
        signed = first.filter(F.col("singles").isNotNull()).unionByName(second)
        if turn + 1 == rounds:
            break
        again = signed.select(F.explode("singles").alias("sig")).groupBy("sig").count()
        again = materialize(again.filter(F.col("count") > rare).select("sig"), "again")
        if not again.limit(1).count():
            break
        also = materialize(plain.join(again, "sig", "left_semi").select("doc").union(hit).distinct(), "hit")
        joined = materialize(frequent.union(again), "frequent")
        discard(first, second, hit, frequent, again)
        hit, frequent = also, joined
    redone = signed.select(F.explode(F.concat("singles", "pairs")).alias("sig"), "doc", "n")
    rest = plain.join(hit, "doc", "left_anti").select("sig", "doc", "n")
    sigs = materialize(rest.unionByName(redone), "signatures")
    discard(first, second, *whole)
    return sigs


def _base(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def make(ids, sets):
        n = [len(s) for s in sets]
        prefix = [s[: prefix_length(len(s), percent)] for s in sets]
        return [ids, pa.array(n, pa.int64()), _classes(sets), _longs(prefix)]

    return _sets(docs, words, make, "doc_id long, n long, doc long, prefix array<long>")


def _whole(docs: DataFrame, ids: DataFrame, several: DataFrame | None, words: int) -> DataFrame:
    """(doc, n, tokens): the whole sets of the classes ``ids(doc, doc_id)``, each once. ``several`` holds the doc_ids of more than
    one row, whose rows may repeat or have other sets."""

    def read(wanted: DataFrame, repeated: bool) -> DataFrame:
        texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        return _sets(
            texts.distinct() if repeated else texts, words,
            lambda _, sets: [_classes(sets), pa.array([len(s) for s in sets], pa.int64()), _longs(sets)],
            "doc long, n long, tokens array<long>",
        )

    if several is None:
        return read(ids, False)
    shared = ids.join(several, "doc_id", "left_semi")
    once = read(shared, True).join(shared.select("doc"), "doc", "left_semi").dropDuplicates(["doc"])
    return read(ids.join(several, "doc_id", "left_anti"), False).unionByName(once)


def _alike(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _misses(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100 - 1e-9)


def _verify(pairs: DataFrame, heads: DataFrame, whole_sets, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link: by their prefixes, then by their whole sets."""
    one = heads.select(F.col("doc").alias("a"), F.col("prefix").alias("x"), F.col("n").alias("n"))
    other = heads.select(F.col("doc").alias("b"), F.col("prefix").alias("y"), F.col("n").alias("m"))
    least = F.least(F.size("x") - _misses(F.col("n"), percent), F.size("y") - _misses(F.col("m"), percent))
    near = pairs.join(other, "b").join(one, "a").filter(F.size(F.array_intersect("x", "y")) >= least)
    near = materialize(near.select("a", "b").distinct(), "near")

    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "near_docs")
    sets = materialize(whole_sets(ids).select("doc", "tokens"), "near_sets")
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    joined = near.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("x", "y")))
    either = F.size("x") + F.size("y") - F.col("both")
    links = materialize(joined.filter(F.col("both") * 100 >= either * percent).select("a", "b"), "links")
    discard(sets, near, ids)
    return links


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of rows (a, n, b, m) whose sizes allow a link."""
    kept = pairs.filter((F.col("a") != F.col("b")) & _alike(F.col("n"), F.col("m"), percent))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the labels that ``links(a, b)`` connect."""
    of_a = labels.select(F.col("doc").alias("a"), F.col("label").alias("la"))
    of_b = labels.select(F.col("doc").alias("b"), F.col("label").alias("lb"))
    between = links.join(of_a, "a").join(of_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = components(between).select(F.col("node").alias("label"), "root")
    joined = labels.join(roots, "label", "left").select("doc", F.coalesce("root", "label").alias("label"))
    return materialize(joined, "labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (sig, doc, n, label) of the signatures whose lists still hold several labels."""
    marked = members.join(labels, "doc")
    several = marked.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return materialize(marked.join(several.filter("low < high").select("sig"), "sig", "left_semi"), "mixed")


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of linked sets of different labels, one for each two labels."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen[token] > 1
    owner, token = owner[common], np.unique(token[common], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        a, b = np.searchsorted(token, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        both += has @ has.T
    hit = both * 100 >= percent * (size[:, None] + size[None, :] - both)
    a, b = np.nonzero(np.triu(hit, 1) & (labels[:, None] != labels[None, :]))
    if not len(a):
        return a, b
    pair = np.sort(np.stack([labels[a], labels[b]], 1), 1)
    one = np.unique(pair, axis=0, return_index=True)[1]
    return a[one], b[one]


def _block_links(lists: DataFrame, whole_sets, percent: int) -> DataFrame:
    """(a, b): links between members (sig, doc, label) of long lists, at least one for each two labels that link."""
    stars = lists.groupBy("sig").agg(F.min("doc").alias("a")).join(lists.select("sig", F.col("doc").alias("b")), "sig")
    roots = materialize(components(stars.select("a", "b").distinct()).withColumnRenamed("node", "doc"), "long_lists")
    blocks = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sets = materialize(whole_sets(roots.select("doc")).select("doc", "tokens"), "long_sets")
    rows = sets.join(lists.select("doc", "label").distinct(), "doc").join(roots, "doc").join(blocks, "root")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.withColumn("own", own).select("root", "doc", "label", "tokens", "own", other)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc")
        lists_ = [np.asarray(t, np.int64).view(np.uint64) for t in frame["tokens"]]
        a, b = linked_pairs(lists_, frame["label"].to_numpy(), percent)
        ids = frame["doc"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    keyed = rows.select("root", "doc", "label", "tokens", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    links = materialize(keyed.groupBy("root", "low", "high").applyInPandas(compare, "a long, b long"), "links")
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90, rare: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(_base(docs, words, percent), "sets")
    named = base.filter(F.col("doc_id").isNotNull())
    some = named.filter(F.col("n") > 0)
    classes = some.groupBy("doc").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    classes = materialize(classes, "classes")
    copies = some.select("doc_id", "doc").distinct().join(classes.filter("first < last").drop("last"), "doc")
    copies = materialize(copies.filter(F.col("first") != F.col("doc_id")).select("doc_id", "doc"), "copies")
    of_id = F.when(F.col("n") > 0, F.col("doc"))
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(of_id).alias("a"), F.max(of_id).alias("z"))
    several = materialize(several.filter("rows > 1").drop("rows"), "several")
    repeated = several if several.limit(1).count() else None

    # a set this small links with equal sets only
    large = some.filter(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    heads = large.join(copies, ["doc_id", "doc"], "left_anti").select("doc", "doc_id", "n", "prefix")
    if repeated is not None:
        once = heads.join(repeated, "doc_id", "left_semi").select(heads.columns).dropDuplicates(["doc"])
        heads = heads.join(repeated, "doc_id", "left_anti").select(heads.columns).unionByName(once)
    heads = materialize(heads, "heads")
    rows = materialize(base.select("doc_id", F.col("n").alias("n_shingles"), "doc"), "rows")
    discard(base)
    id_of = classes.select("doc", F.col("first").alias("doc_id"))

    def whole_sets(ids: DataFrame) -> DataFrame:
        return _whole(docs, id_of.join(ids, "doc", "left_semi"), repeated, words)

    sigs = _signatures(heads, whole_sets, percent, rare)

    lists = sigs.groupBy("sig").agg(F.min("doc").alias("a"), F.min_by("n", "doc").alias("m"), F.max("doc").alias("last"))
    members = sigs.join(lists.filter("a < last").select("sig", "a", "m"), "sig")
    members = materialize(members, "members")
    discard(sigs)
    labels = materialize(members.select("doc").distinct().withColumn("label", F.col("doc")), "labels")
    near = materialize(heads.join(labels.select("doc"), "doc", "left_semi").drop("doc_id"), "near_heads")
    discard(heads)

    def linked(pairs: DataFrame) -> DataFrame:
        return _verify(_ordered(pairs, percent), near, whole_sets, percent)

    # 4a: the first member of each list
    labels = _relabel(labels, linked(members.withColumnRenamed("doc", "b")))
    members = members.select("sig", "doc", "n")

    # 4b: another member, drawn per list
    mixed = _mixed(members, labels)
    draw = F.xxhash64("sig", "doc")
    drawn = mixed.groupBy("sig").agg(F.min(F.struct(draw.alias("h"), "doc", "n", "label")).alias("p"))
    drawn = drawn.select("sig", F.col("p.doc").alias("a"), F.col("p.n").alias("m"), F.col("p.label").alias("pl"))
    pairs = mixed.withColumnRenamed("doc", "b").join(drawn, "sig").filter(F.col("pl") != F.col("label"))
    labels = _relabel(labels, linked(pairs))

    # 4c: all members of different labels
    mixed = _mixed(mixed.select("sig", "doc", "n"), labels)
    long = materialize(mixed.groupBy("sig").count().filter(F.col("count") > LONG_LIST).select("sig"), "long")
    links = _block_links(mixed.join(long, "sig", "left_semi"), whole_sets, percent)
    short = mixed.join(long, "sig", "left_anti")
    one = short.select("sig", F.col("label").alias("la"), F.col("doc").alias("a"), "n")
    other = short.select("sig", F.col("label").alias("lb"), F.col("doc").alias("b"), F.col("n").alias("m"))
    pairs = one.join(other, "sig").filter(F.col("la") < F.col("lb"))
    labels = _relabel(labels, links.unionByName(linked(pairs)))

    if repeated is not None:  # a doc_id links the classes of its texts
        ids = rows.filter(F.col("n_shingles") > 0).select("doc_id", "doc").distinct()
        ids = ids.join(repeated.filter("a < z"), "doc_id").filter(F.col("a") != F.col("doc"))
        roots = components(labels.select(F.col("doc").alias("a"), F.col("label").alias("b")).union(ids.select("a", "doc")))
        alone = labels.join(roots, F.col("doc") == F.col("node"), "left_anti")
        labels = materialize(roots.select(F.col("node").alias("doc"), F.col("root").alias("label")).unionByName(alone), "labels")
    marked = labels.join(classes, "doc")
    least = marked.groupBy("label").agg(F.min("first").alias("component"))
    known = marked.join(least, "label").select("doc", "component")
    equal = classes.filter("first < last").join(labels, "doc", "left_anti").select("doc", F.col("first").alias("component"))
    found = rows.join(known.unionByName(equal), "doc", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))
