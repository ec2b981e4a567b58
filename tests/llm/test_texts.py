"""Language, quality and main text."""

import os

import numpy as np
import pytest

from tastemill.llm import language, quality
from tastemill.llm.common import table
from tastemill.llm.html_text import extract, main_text
from tests.llm.helpers import DOCS

SF = os.environ.get("TASTEMILL_LLM_SF", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got["lang_pred"] == got["lang"]).mean() > 0.99
    assert got["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en", None, 1) for i in range(20)] + [(i, "le chat et le chien", "fr", None, 1) for i in range(20, 40)]
    rows += [(40, None, "en", "s", 1), (41, "", None, "s", 1), (42, "123 ½ !?", "fr", "s", 1), (None, "le chat", "fr", "s", 1),
             (43, "cat " * 50_000, None, "s", 1), (44, "chi " * 3, None, "s", 1), (45, "日本", None, "s", 1)]
    docs = spark.createDataFrame([(*r, 0.0, "x") for r in rows], DOCS + ", score double, lang_pred string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == 47
    for key in (40, 41, 42):
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert got[None]["held_out"] and got[None]["lang_pred"] == "fr"
    assert got[43]["lang_pred"] == "en"
    assert got[44]["lang_pred"] == "fr"  # never seen, but its n-grams were
    assert got[45]["lang_pred"] in ("en", "fr")
    nothing = spark.createDataFrame([(1, "text", None, None, 1)], DOCS)
    assert [r["lang_pred"] for r in language.identify(nothing).collect()] == ["und"]
    assert language.identify(nothing.limit(0)).count() == 0


def test_rare_languages(spark):
    rng = np.random.default_rng(4)

    def vocabulary(letters, n):
        return ["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(n)]

    vocabularies = {"big": vocabulary("abcdefghijklm", 4000), "mid": vocabulary("hijklmnopqrs", 4000), "few": vocabulary("mnopqrstuvwx", 150)}
    weights = {lang: 1 / np.arange(10, 10 + len(words)) for lang, words in vocabularies.items()}

    def text(lang):
        return " ".join(rng.choice(vocabularies[lang], 100, p=weights[lang] / weights[lang].sum()))

    rows = [(i, text("big"), "big") for i in range(3000)] + [(i, text("mid"), "mid") for i in range(3000, 4000)]
    rows += [(4000 + i, text("few"), "few") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    asked = [(lang, text(lang)) for lang in vocabularies for _ in range(30)]
    for bound in (300, 10_000):  # few rows of a sample, and a sample with all rows
        model = language.train(docs, sample_rows=bound)
        assert model.langs == ["big", "few", "mid"]
        names, _ = model.predict([t for _, t in asked])
        assert sum(a == b for a, (b, _) in zip(names, asked, strict=True)) >= 87


@needs_tables
def test_quality_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_quality_edges(spark):
    rows = [(i, "A plain text, all in order." if i % 2 else "A!! B!! C!! D!!", None, None, 1) for i in range(60)]
    rows += [(100, None, None, None, 1), (101, "", None, None, 1), (102, "x" * 100_000, None, None, 1), (None, "A!! B!!", None, None, 1)]
    docs = spark.createDataFrame([(*r, 9.0, 9) for r in rows], DOCS + ", score double, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == i % 2 for i in range(60))
    assert got[100]["score"] == got[101]["score"] > 0.3
    unlabelled = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_sample_is_bounded(spark):
    rows = [(7, "Repeated text, in order.")] * 5000 + [(i, "A plain text, all in order. " + "Ab9! " * (i % 7)) for i in range(8, 40)]
    long = " ".join(f"{'a9' * (i % 5)}{'B-' * (i % 7)}{'x' * (i % 2)}{',;.:!?'[i % 6] * 2}{'(['[i // 6 % 2]}{'9A'[i // 12 % 2]}" for i in range(2000))
    docs = spark.createDataFrame([*rows, (50, long)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 40)] + [(50, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_rows=20)
    assert len(model.labels) == 20
    model = quality.train(docs, labels)
    assert len(model.labels) == 34 and model.times.sum() == 5033
    assert set(quality.terms(long)) <= set(model.columns) and len(quality.terms(long)) > 256


def test_weighted_votes_equal_repeated_rows():
    rng = np.random.default_rng(2)
    basis, vectors, labels = np.eye(4), rng.random((9, 4)), np.array([0, 1, 1, 0, 1, 0, 0, 1, 1.0])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    times = np.array([1, 4, 1, 2, 1, 1, 30, 1, 1])
    columns = {b"%d" % i: i for i in range(4)}
    few = quality.Voters(columns, np.ones(4), basis, vectors, labels, 5, 4.0, times)
    at = np.repeat(np.arange(9), times)
    all_ = quality.Voters(columns, np.ones(4), basis, vectors[at], labels[at], 5, 4.0, np.ones(len(at)))
    asked = [quality.Counter({b"%d" % i: int(n) for i, n in enumerate(rng.integers(1, 9, 4))}) for _ in range(50)]
    assert np.allclose(few.score(asked), all_.score(asked))


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, which this long sentence explains at some length to everyone.</p></div>
<div id="content"><h2>A   headline &amp; more</h2><p>First <b>bold</b> para&shy;graph<br>of the article, long enough to count.
<p>Second paragraph of the article &#8211; also long enough, with <a href=x>a link</a> in it.</div>
<div id="comments"><p>A reader's comment that is not part of the article at all, and rather long.</p></div>
<form><input value=x><p>Subscribe to our newsletter now</p></form><!-- ad --><footer>&copy; someone</footer></body></html>"""


def test_page():
    want = (
        "A headline & more First bold para\xadgraph of the article, long enough to count. "
        "Second paragraph of the article – also long enough, with a link in it."
    )
    assert main_text(PAGE) == want


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("  plain \n text ", "plain text"), ("<p>a<p>b", "a b"), ("&amp;&lt;x&amp", "&<x&"),
        ("<nav><a>menu</a></nav>", ""), ("<table><tr><td>a<td>b</table>", "a b"), ("<div>" * 5000 + "deep", "deep"),
        ("<article><header><h1>Title</h1></header><p>Body text.</p></article>", "Title Body text."),
        ("<p>cut off <b>here &quo", "cut off here &quo"), ("</div></p>x<", "x<"), ("<!-- only -->", ""),
        ("<article><p>A<em>b</em>c</p></article>", "Abc"), ("<article><p>x</p></article><footer><p>y</p>", "x"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_sections_are_kept_together():
    section = "<section><h2>Head</h2><p>{0}</p><p>{0}</p></section>".format("word " * 40)
    menu = "<div><a href=1>one</a><a href=2>two</a><a href=3>three</a></div>"
    text = main_text(f"<body>{menu}<main>{section * 3}</main>{menu}</body>")
    assert text.count("Head") == 3 and "one" not in text


ARTICLE = "<h2>Title</h2><p>{0}</p><p>{0}</p>".format("A sentence of the article, as long as such sentences are. " * 4)
SIDE = "<div class='sidebar'><p>A remark beside the text, which is not part of it at all.</p></div>"


@pytest.mark.parametrize(
    "opening,closing",
    [
        ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='no-sidebar'>", "</div>"),
        ("<div class='content comments-open'>", "</div>"), ("<div class='share-enabled'><main>", "</main></div>"),
        ("<section id='related-work'>", "</section>"), ("<form method=post action=x><div>", "</div></form>"),
        ("<form><div class='social'><article>", "</article></div></form>"), ("<div id='widget'><div>", "</div></div>"),
        ("<aside><main>", "</main></aside>"), ("<div class='content--with-sidebar'><article class='search'>", "</article></div>"),
    ],
)
def test_wrappers_named_like_furniture(opening, closing):
    text = main_text(f"<body><nav><a href=1>Home</a></nav>{opening}{ARTICLE}{SIDE}{closing}<footer>By the owners of the site</footer>")
    assert text.startswith("Title A sentence") and text.count("A sentence") == 8
    assert "beside the text" not in text and "Home" not in text and "owners" not in text


def test_long_comments_stay_out():
    comments = "<div id='comments'>{}</div>".format("<article class='comment'><p>A comment of a reader, and rather long.</p></article>" * 40)
    assert main_text(f"<body><article><p>The text itself.</p></article>{comments}") == "The text itself."


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] is None or r["page_id"] == 2] == ["", ""]


@needs_tables
def test_pages_of_the_tables(spark):
    """The test pages hold their article in one element."""
    import html
    import re

    for row in extract(table(spark, SF, "pages")).select("html", "text").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", row["html"], re.S).group(1)
        body = re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)>", " ", body))
        assert row["text"] == " ".join(html.unescape(body).split())
