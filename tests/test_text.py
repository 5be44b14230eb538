from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.options import CleanOptions


def one(spark, column, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("step", "given_", "want"),
    [
        (T.clean_bullets, "• item", "item"),
        (T.clean_bullets, "●▪ item • kept", "item • kept"),
        (T.clean_bullets, "item", "item"),
        (T.clean_whitespace, "a  b \t c\nd ", "a b c d"),
        (T.clean_dashes, "a–b-c", "a b c"),
        (T.clean_trailing, "end.,:;", "end"),
        (T.clean_trailing, "a.b", "a.b"),
        (T.clean_lower, "МаСЛо", "масло"),
        (T.strip, " \t x \n", "x"),
    ],
)
def test_cleaning_steps(spark, step, given_, want):
    assert one(spark, step, given_) == want


def test_clean_order_and_switches(spark):
    text = "  • Один – ДВА.  "
    assert one(spark, lambda c: T.clean(c), text) == "Один – ДВА"
    stripped = "• Один – ДВА.;"
    assert one(spark, lambda c: T.clean(c), stripped) == "Один – ДВА"
    assert one(spark, lambda c: T.clean(c, CleanOptions(dashes=True, lowercase=True)), stripped) == "один два"
    assert one(spark, lambda c: T.clean(c, CleanOptions(clean=False)), text) == text
    assert one(spark, lambda c: T.clean(c), None) is None
    assert one(spark, lambda c: T.clean(c), "") == ""


def test_text_elements_split_at_blank_lines(spark):
    got = one(spark, T.text_elements, "one\nstill one\n \n\n two \n\n")
    assert [e["text"] for e in got] == ["one\nstill one", "two"]


def test_outline_elements(spark):
    got = one(spark, T.markdown_elements, "# Head\nbody\n####### no head\n## Sub")
    assert [(e["category"], e["text"]) for e in got] == [
        ("Title", "Head"), ("NarrativeText", "body"), ("NarrativeText", "####### no head"), ("Title", "Sub"),
    ]
    got = one(spark, T.org_elements, "** Head\nbody\n*bold*")
    assert [e["category"] for e in got] == ["Title", "NarrativeText", "NarrativeText"]


def test_html_elements(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav>menu</nav>"
        "<!-- <p>gone</p> --><h1 class='x'>Head &amp;lt;</h1><p>open <b>bold<p>next&nbsp;one &middot; &copy;"
        "<ul><li>item</ul><pre>code</pre><footer>foot</footer></body></html>"
    )
    got = [(e["category"], e["text"]) for e in one(spark, T.html_elements, html)]
    assert got == [
        ("Title", "Head &lt;"), ("NarrativeText", "open bold"), ("NarrativeText", "next\u00a0one · ©"),
        ("ListItem", "item"), ("NarrativeText", "code"),
    ]


def cut(text: str, n: int) -> list[str]:
    """Plain-Python reading of the cutting rule."""
    out = []
    while text:
        if len(text) <= n - 1:
            piece = text
        else:
            spaces = [i + 1 for i, c in enumerate(text[:n]) if c in " \t\n\r\f\x0b" and i > 0]
            piece = text[: spaces[-1]] if spaces else text[:n]
        out.append(piece)
        text = text[len(piece):]
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="аb \n—é𝄞", min_size=1, max_size=400), min_size=1, max_size=30))
def test_split_oversized_is_lossless(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", T.split_oversized(F.col("t"), 50).alias("p")).collect():
        assert row["p"] == cut(row["t"], 50)
        assert "".join(row["p"]) == row["t"]


def test_split_overlap(spark):
    text = "word " * 60
    plain = cut(text, 80)
    got = one(spark, lambda c: T.split_oversized(c, 100, 20), text)
    assert got == [plain[0]] + [plain[i - 1][-20:] + plain[i] for i in range(1, len(plain))]
    assert max(map(len, got)) <= 100


def test_blank(spark):
    rows = spark.createDataFrame([(" \n ",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.is_blank(F.col("t"))).collect()] == [True, False, True]


def test_space_class_covers_regex_space():
    assert all(c in T.SPACES for c in " \t\n\r\f\x0b") and re.fullmatch(f"[{T.SPACES}]+", "  ")


def test_trailing_punctuation_goes_behind_white_space_too(spark):
    rows = [("Oil level.  ",), (" a:;., ",), ("\u00a0b. ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(T.clean(F.col("t")).alias("a"), T.clean_trailing(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == ["Oil level", "a", "b", None]
    assert [r.b for r in got] == ["Oil level", "a", "b", None]


def test_pages_by_hand(spark):
    """Expectations written out, without the patterns under test."""
    pages = {
        "<p>&laquo;a&raquo; &mdash; &#39;b&#39; &#x41;&eacute;</p>": [("NarrativeText", "«a» — 'b' Aé")],
        "<p>icon \ue000x\ue001 y</p>": [("NarrativeText", "icon \ue000x\ue001 y")],
        "<h2>T\ufdd1</h2><p>a<script>var x = '<p>';": [("Title", "T"), ("NarrativeText", "a")],
        "<ul><li>one<li>two</ul><!-- open <p>no": [("ListItem", "one"), ("ListItem", "two")],
        "<p>before</p><nav-item>Home</nav-item><p>main text</p>": [("NarrativeText", "before"), ("NarrativeText", "Home"), ("NarrativeText", "main text")],
        "<style-guide>a</style-guide><p>b": [("NarrativeText", "a"), ("NarrativeText", "b")],
        "<!-- <script> --><p>kept</p>": [("NarrativeText", "kept")],
        "<script>var s = '<!--';</script><p>also kept</p>": [("NarrativeText", "also kept")],
        "<p><a title=\"x > y\">link</a> <b id='<p>'>c</b> if a < b": [("NarrativeText", "link c if a < b")],
        "<p>it's <a title=\"open>one</a> d</p><footer class='x'>f</footer >e": [("NarrativeText", "it's one d"), ("NarrativeText", "e")],
        "<SCRIPT SRC='a>b'>x</SCRIPT\n><H2 id=a>T</H2>": [("Title", "T")],
    }
    df = spark.createDataFrame([(p,) for p in pages], "t string").select("t", T.html_elements(F.col("t")).alias("e"))
    assert {r.t: [(e.category, e.text) for e in r.e] for r in df.collect()} == pages
