"""Reply order against a message-by-message version."""

import random

from tastemill.llm import chat
from tests.llm.helpers import replies

SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return [tuple(r[c] for c in ("conv_id", "position", "turn", "role", "parent_turn", "content")) for r in chat.reply_ordered(df).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))


def test_threads(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 3)  # conversations that span slices
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "ok", "thanks"]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.choice([1, 2, 5, 12, 20])):
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            if texts and rng.random() < 0.7:
                quoted = rng.choice(texts).split("\n")
                quoted = quoted if rng.random() < 0.6 else quoted[:1]
                head = "Ann wrote:\n" if rng.random() < 0.5 else ""
                text = head + "\n".join(rng.choice(["> ", ">", " > "]) + line for line in quoted) + "\n" + text
            texts.append(text)
            rows.append((conv or None, turn, rng.choice(["user", "assistant", None]), text))
    rows += [(99, 0, "user", None), (99, None, "user", ""), (99, 1, "a", "> x"), (99, 1, "a", "> x"), (98, 5, None, "x\r\n> y")]
    assert ordered(got(spark.createDataFrame(rows, SCHEMA))) == ordered(replies(rows))


def test_interleaved_threads(spark, monkeypatch):
    written, kept = [], chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df, name: written.append((name, df.dtypes)) or kept(df, name))
    rows = [(1, i, "user", (f"> line {i - 2}\n" if i > 1 else "") + f"line {i}") for i in range(300)]  # a branch per message
    rows += [(2, i, "user", ("> first\n" if i else "first\n") + f"line {i}") for i in range(200)]  # all under one message
    assert ordered(got(spark.createDataFrame(rows, SCHEMA))) == ordered(replies(rows))
    wide = {name for name, types in written for column, kind in types if kind.startswith("array") and column not in ("lines", "own")}
    assert not wide, "rows that grow with the depth of a thread"


def test_quotes_are_linked_and_removed(spark):
    rows = [(1, 1, "user", "Which colour?\nAnd which size?"), (1, 2, "user", "Hello"), (1, 3, "assistant", "Ann wrote:\n> which  COLOUR?\nRed."),
            (1, 4, "user", "Bob wrote:\n> Red.\n>> Which colour?\nThanks")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", position int")
    out = {r["turn"]: r for r in chat.reply_ordered(df).collect()}
    assert [out[t]["parent_turn"] for t in (1, 2, 3, 4)] == [None, 1, 1, 3]
    assert out[3]["content"] == "Red." and out[4]["content"] == "Thanks" and out[4]["n_quoted"] == 2
    assert out[3]["formatted"] == "<|assistant|>\nRed.\n"


def test_empty(spark):
    assert chat.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_that_only_look_like_quotes_stay(spark):
    texts = ["x > 3 is true\n> = 4 is not", ">>> f(x)\n1", "Carl schrieb am Montag:\n> from a book\nI agree", "Am Montag schrieb Bob <b@x>:\n> x > 3 is true\n> kept\nYes",
             "> kept\n> as one passage", "See Ann wrote:\n> kept as one passage\nend", "long " * 30_000 + "\n> " + "no source " * 5_000]
    rows = [(1, n, "user", t) for n, t in enumerate(texts)]
    out = {r["turn"]: r for r in chat.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0]["content"] == texts[0] and out[1]["content"] == texts[1] and out[2]["content"] == texts[2]
    assert out[3]["content"] == "> kept\nYes" and out[3]["parent_turn"] == 0
    assert out[4]["content"] == texts[4] and out[5]["content"] == texts[5] and out[6]["content"] == "\n".join(x.strip() for x in texts[6].split("\n"))
    assert ordered(got(spark.createDataFrame(rows, SCHEMA))) == ordered(replies(rows))
