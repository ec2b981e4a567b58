"""Conversations in reply order, without quotations: quoted passages are linked to the messages they come from.

Lines that start with ``>`` are quoted, the number of these marks being the level; runs of lines of one level are passages. A
passage and each of its lines are normalised (lower case, single spaces), hashed, and joined to the messages of the same
conversation whose own text, or a line of it, has the hash: the latest one before the quoting message. A message replies to
the message that matches most characters at its lowest matched level (ties: the later one), or, if nothing matches, to the message before
it. Conversations are listed depth first: a message, then the replies to it, earlier ones first. Quoted lines that are linked, alone
or with their passage, and a line such as "Ann wrote:" right above them, are taken out of the text. Lines that begin with
``>`` and link to nothing, such as a prompt, a comparison or a quotation from elsewhere, stay as they are.

Only DataFrame functions; a conversation may be of any length and branch anywhere: places come from sums of subtree sizes, in
rows of fixed width. Defined results: messages of one turn, and repeated rows, are
ordered by role and text and kept; a NULL turn comes first; messages without conv_id form one conversation; a NULL or
blank text is an empty message; a NULL role is written as ``unknown``; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import discard
from tastemill.operators.ordering import number_rows, sum_before
from tastemill.session import materialize

MARKS = r"^((?:[ \t]*>)+)"
HEADER = r"(?i)^.{0,200}\b(wrote|schrieb|a écrit|escribió)\b.{0,100}:$"
#: Positions of a conversation that one task walks together.
SLICE = 1_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (level, body, whole), one per line."""

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(x, MARKS, "")).alias("body"), F.trim(x).alias("whole"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), line)


def own_lines(lines: Column) -> Column:
    """Bodies of the unquoted lines, without headers of quotations."""
    heads = F.filter(
        lines,
        lambda x, i: (x["level"] == 0)
        & ~(x["body"].rlike(HEADER) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.transform(heads, lambda x: x["body"])


def latest(rows: DataFrame, keys: list[str], order: list, at: str, value: Column, alias: str) -> DataFrame:
    """``rows`` with the largest ``value`` of the key's rows up to this one, in slices of positions ``at``; ``value`` must
    not fall along ``order``."""
    cut = rows.withColumn("_slice", F.floor(F.col(at) / SLICE)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_slice").agg(F.max("_value").alias("_end"))
    carried = ends.select(*keys, "_slice", F.max("_end").over(earlier).alias("_carried"))
    local = cut.withColumn("_inside", F.max("_value").over(inside))
    joined = local.join(carried, [*keys, "_slice"])
    return joined.withColumn(alias, F.coalesce("_inside", "_carried")).drop("_slice", "_value", "_inside", "_carried")


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv, at, level, kind, hash, weight, first, n): passages and their lines, n lines from the first on."""
    lines = messages.filter(F.exists("lines", lambda x: x["level"] > 0)).select(
        "conv", "at", F.posexplode("lines").alias("pos", "line")
    )
    lines = lines.select("conv", "at", "pos", F.col("line.level").alias("level"), normalised(F.col("line.body")).alias("body"))
    lines = lines.filter((F.col("level") > 0) & (F.col("body") != ""))
    place = F.row_number().over(Window.partitionBy("conv", "at", "level").orderBy("pos"))
    runs = lines.withColumn("run", F.col("pos") - place)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "body")))  # the lines of one passage of one message
    passages = runs.groupBy("conv", "at", "level", "run").agg(ordered.alias("parts"))
    whole = passages.select("conv", "at", "level", F.lit("all").alias("kind"), F.concat_ws(" ", F.col("parts.body")).alias("body"),
                            F.col("parts")[0]["pos"].alias("first"), F.size("parts").alias("n"))
    both = whole.unionByName(
        lines.select("conv", "at", "level", F.lit("line").alias("kind"), "body", F.col("pos").alias("first"), F.lit(1).alias("n"))
    )
    return both.select("conv", "at", "level", "kind", F.xxhash64("body").alias("hash"), F.length("body").alias("weight"), "first", "n")


def originals(messages: DataFrame) -> DataFrame:
    """(conv, at, kind, hash) of every message's own text and of its lines."""
    whole = messages.select("conv", "at", F.lit("all").alias("kind"), normalised(F.array_join("own", "\n")).alias("body"))
    lines = messages.select("conv", "at", F.lit("line").alias("kind"), F.explode("own").alias("body"))
    lines = lines.withColumn("body", normalised(F.col("body")))
    rows = whole.unionByName(lines).filter(F.col("body") != "")
    return rows.select("conv", "at", "kind", F.xxhash64("body").alias("hash")).distinct()


def linked_quotes(messages: DataFrame) -> DataFrame:
    """(conv, at, level, weight, first, n, parent) of the quotations that match an earlier message of the conversation."""
    quotes = quoted_passages(messages)
    keys = ["conv", "kind", "hash"]
    sources = originals(messages).join(quotes.select(*keys).distinct(), keys, "left_semi")
    none = F.lit(None).cast("int")
    rows = quotes.withColumn("source", F.lit(0)).unionByName(
        sources.select("conv", "at", none.alias("level"), "kind", "hash", none.alias("weight"), none.alias("first"), none.alias("n"),
                       F.lit(1).alias("source"))
    )
    # a message's own lines come after its quotations, so that it never answers itself
    found = latest(rows, keys, ["at", "source"], "at", F.when(F.col("source") == 1, F.col("at")), "parent")
    return found.filter((F.col("source") == 0) & F.col("parent").isNotNull()).select("conv", "at", "level", "weight", "first", "n", "parent")


def reply_links(quotes: DataFrame) -> DataFrame:
    """(conv, at, parent): the message that most of a message's linked quotations come from."""
    best = F.min(F.struct("level", -F.col("weight"), -F.col("parent")))
    votes = quotes.groupBy("conv", "at", "level", "parent").agg(F.sum("weight").alias("weight"))
    chosen = votes.groupBy("conv", "at").agg(best.alias("best"))
    return chosen.select("conv", "at", (-F.col("best")["col3"]).alias("parent"))


def without_quotes(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv, at, kept) of the messages with linked quotations: their other lines, in order, without headers of what went."""
    gone = quotes.select("conv", "at", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos")).distinct()
    lines = messages.join(gone.select("conv", "at").distinct(), ["conv", "at"], "left_semi").select("conv", "at", F.posexplode("lines").alias("pos", "line"))
    marked = lines.join(gone.withColumn("gone", F.lit(True)), ["conv", "at", "pos"], "left")
    next_gone = F.coalesce(F.lead("gone").over(Window.partitionBy("conv", "at").orderBy("pos")), F.lit(False))
    header = (F.col("line.level") == 0) & F.col("line.body").rlike(HEADER) & next_gone
    kept = marked.withColumn("header", header).filter(F.col("gone").isNull() & ~F.col("header"))
    # the lines of one message
    texts = kept.groupBy("conv", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "line.whole"))).alias("parts"))
    every = gone.select("conv", "at").distinct().join(texts, ["conv", "at"], "left")
    return every.select("conv", "at", F.coalesce(F.col("parts.whole"), F.array().cast("array<string>")).alias("kept"))


def with_below(branches: DataFrame) -> DataFrame:
    """(conv, branch, below): sums of ``size`` over each branch and all that hang below it, by doubling over (conv, branch,
    up, size): after k rounds ``size`` holds what is less than 2^k steps below, and ``up`` is 2^k steps above."""
    now = materialize(branches.select("conv", "branch", "up", "size"), "branches")
    while now.filter(F.col("up").isNotNull()).limit(1).count():
        hung = now.filter(F.col("up").isNotNull())
        more = hung.groupBy("conv", F.col("up").alias("branch")).agg(F.sum("size").alias("more"))
        above = now.select("conv", F.col("branch").alias("up"), F.col("up").alias("next"))
        joined = now.join(above, ["conv", "up"], "left").join(more, ["conv", "branch"], "left")
        size = F.col("size") + F.coalesce("more", F.lit(0))
        after = materialize(joined.select("conv", "branch", F.col("next").alias("up"), size.alias("size")), "branches")
        discard(now)
        now = after
    return now.select("conv", "branch", F.col("size").alias("below"))


def with_above(branches: DataFrame) -> DataFrame:
    """(conv, branch, offset): sums of ``step`` over each branch and all branches above it, by doubling over (conv, branch, up,
    step)."""
    now = materialize(branches.select("conv", "branch", "up", "step"), "branches")
    while now.filter(F.col("up").isNotNull()).limit(1).count():
        above = now.select("conv", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("step").alias("before"))
        step = F.col("step") + F.coalesce("before", F.lit(0))
        joined = now.join(above, ["conv", "up"], "left")
        after = materialize(joined.select("conv", "branch", F.col("next").alias("up"), step.alias("step")), "branches")
        discard(now)
        now = after
    return now.select("conv", "branch", F.col("step").alias("offset"))


def thread_offsets(branches: DataFrame) -> DataFrame:
    """(conv, branch, offset): messages of the conversation listed before each branch of (conv, branch, parent, up, size)."""
    sized = branches.join(with_below(branches), ["conv", "branch"])
    # a branch's own messages come first; then the branches that leave it, those of later messages before
    hung = materialize(sized.filter(F.col("up").isNotNull()), "hung")
    passed = materialize(sum_before(hung, ["conv", "up", F.desc("parent"), "branch"], "below", "passed"), "passed")
    firsts = passed.groupBy("conv", "up").agg(F.min("passed").alias("first"))
    own = branches.select("conv", F.col("branch").alias("up"), F.col("size").alias("own"))
    placed = passed.join(firsts, ["conv", "up"]).join(own, ["conv", "up"])
    steps = placed.select("conv", "branch", "up", (F.col("own") + F.col("passed") - F.col("first")).alias("step"))
    roots = branches.filter(F.col("up").isNull()).select("conv", "branch", "up", F.lit(0).cast("long").alias("step"))
    return with_above(steps.unionByName(roots))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, n_quoted, content, formatted of ``conversations(conv_id, turn, role, text)``."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn", "role", "text"
    )
    placed = number_rows(rows, ["conv"], ["turn", "role", "text"], "at")
    lined = placed.withColumn("lines", parsed_lines(F.col("text"))).withColumn("own", own_lines(F.col("lines")))
    messages = materialize(lined.drop("text"), "messages")

    quotes = materialize(linked_quotes(messages), "quotes")
    links = reply_links(quotes)
    joined = messages.join(links, ["conv", "at"], "left").join(without_quotes(messages, quotes), ["conv", "at"], "left")
    text = F.array_join(F.coalesce("kept", F.col("lines.whole")), "\n")
    joined = joined.withColumn("content", F.trim(F.regexp_replace(text, r"^\n+|\n+$", ""))).drop("kept")
    before = F.when(F.col("at") > 1, F.col("at") - 1)
    tied = joined.withColumn("parent", F.coalesce("parent", before))
    # a branch starts at the first message and wherever the parent is not the message before
    starts = F.when(F.col("parent").isNull() | (F.col("parent") != F.col("at") - 1), F.col("at"))
    tied = materialize(latest(tied, ["conv"], ["at"], "at", starts, "branch"), "replies")

    opening = tied.filter(F.col("branch") == F.col("at")).select("conv", "branch", "parent")
    above = tied.select("conv", F.col("at").alias("parent"), F.col("branch").alias("up"))
    sizes = tied.groupBy("conv", "branch").agg(F.count(F.lit(1)).alias("size"))
    tree = opening.join(above, ["conv", "parent"], "left").join(sizes, ["conv", "branch"])
    offsets = thread_offsets(materialize(tree.select("conv", "branch", "parent", "up", "size"), "tree"))
    # the messages of a branch follow each other in their conversation
    position = (F.col("offset") + F.col("at") - F.col("branch") + 1).cast("long")
    ordered = tied.join(offsets, ["conv", "branch"]).withColumn("position", position)

    turns = tied.select("conv", F.col("at").alias("parent"), F.col("turn").alias("parent_turn"))
    role = F.coalesce("role", F.lit("unknown"))
    return ordered.join(turns, ["conv", "parent"], "left").select(
        "conv_id", "position", "turn", "role", "parent_turn",
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"), "content",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("content"), F.lit("\n")).alias("formatted"),
    )
