"""Scalar functions: texts, Hangul, words, titles, queries."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.functions import korean, markup, render, words
from moraine.operators import search


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c")).alias("v")).collect()]


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, ""),
        ("   ", ""),
        ("{{Infobox|a=b}} text", "text"),
        ("{{unclosed template", ""),
        ("[[Seoul|the capital]] and [[Busan]]", "the capital and Busan"),
        ("'''bold''' ''it''", "bold it"),
        ("[[분류:도시]] a [[Category:X|y]]", "a"),
        ("a<ref name=x>note {{cite}}</ref>b<ref name=y/>c", "abc"),
        ("== Head ==\nbody", "Head body"),
        ("a &amp; b &#39; c", "a b c"),
        ("||cell||cell||\nrest", "rest"),
        ("[http://x.example label] end", "end"),
        ("가" * 200, "가" * 200),
    ],
)
def test_strip_markup(spark, text, wanted):
    assert one(spark, markup.strip_markup, text) == [wanted]


def test_snippets_are_cut(spark):
    assert one(spark, markup.snippet, "가" * 5000)[0] == "가" * 150
    assert one(spark, markup.snippet_source, "가" * 5000, "", None) == ["가" * 500, None, None]


def test_formats(spark):
    assert one(spark, markup.wiki_format, None, "short", "x" * 40, "[목차] a longer text", "{| a table |} here", "== a == [[Category:B]] c") == ["plain", "plain", "plain", "namumark", "mediawiki", "mediawiki"]


def test_tags_keep_order_and_repeats(spark):
    assert one(spark, markup.tags, "[[Category:B]] [[분류:가|x]] [[category:B]] [[분류: ]]") == [["가", "B", "B"]]


SYLLABLES = st.text(alphabet=st.characters(min_codepoint=0xAC00, max_codepoint=0xD7A3), max_size=12)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(SYLLABLES, min_size=1, max_size=20))
def test_letters_of_syllables(spark, texts):
    def letters(text):
        out = ""
        for c in text:
            k = ord(c) - korean.FIRST
            out += korean.INITIALS[k // 588] + korean.MEDIALS[k % 588 // 28] + (korean.FINALS[k % 28 - 1] if k % 28 else "")
        return out

    assert one(spark, korean.decompose, *texts) == [letters(t) for t in texts]
    assert one(spark, korean.initials, *texts) == ["".join(korean.INITIALS[(ord(c) - korean.FIRST) // 588] for c in t) for t in texts]


def test_letters_of_other_characters(spark):
    assert one(spark, korean.decompose, "", "aㄱ1힣") == ["", "aㄱ1ㅎㅣㅎ"]
    assert one(spark, korean.initials, "가b ㄴ다ㅏ") == ["ㄱㄴㄷ"]
    assert one(spark, korean.has_letters, "가나", "ㄱ나", "ㅏ") == [False, True, True]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab가나 1", max_size=12), min_size=1, max_size=20))
def test_ngrams(spark, texts):
    wanted = [[w[i : i + n] for w in t.split() for n in (2, 3) for i in range(len(w) - n + 1)] for t in texts]
    assert one(spark, lambda c: words.ngrams(words.tokens(c)), *texts) == wanted


def test_titles(spark):
    long = "word " * 60
    got = one(spark, words.title_parts, "Title\nbody text", "A first sentence. And a second one.", long, "short text")
    assert [tuple(r) for r in got] == [
        ("Title", "body text"),
        ("A first sentence.", "And a second one."),
        tuple(got[2]),
        ("short text", "short text"),
    ]
    assert len(got[2]["title"]) <= 120 and long.startswith(got[2]["title"])


@pytest.mark.parametrize("text, wanted", [(None, None), ("", ""), ("a+b", r"a\+b"), ('"a+b" c:d', r'"a+b" c\:d'), ('x "open (end', r"x \"open \(end")])
def test_escaped_queries(text, wanted):
    assert search.escape_query(text) == wanted


def test_grams_of_a_query():
    assert search.grams_of_query("abc d") == ["ab", "bc", "abc"]


def test_mediawiki_blocks():
    html, categories, notes = render.media("intro<ref>n</ref> {{a|{{b}}}}\n== H ==\n* x\n** y\n* z\n{|\n! h\n|-\n| v || w\n|}\n[[Category:C]]\n== References ==\nq\n== K ==\nr")
    assert categories == ["C"] and notes == ["n"]
    assert html.split("\n") == [
        "<p>intro</p>", '<h2 id="H">H</h2>', "<ul><li>x<ul><li>y</li></ul></li><li>z</li></ul>", "<table><tr><th>h</th></tr><tr><td>v</td><td>w</td></tr></table>", '<h2 id="K">K</h2>', "<p>r</p>",
    ]


def test_namu_blocks():
    html, categories, notes = render.namu("'''b''' [* f]\n||a||b||\n> q\n{{{#!syntax x\n1<2\n}}}\n----\n[[분류:K]]")
    assert categories == ["K"] and notes == ["f"]
    assert html.split("\n") == ["<p><strong>b</strong></p>", "<table><tr><td>a</td><td>b</td></tr></table>", "<blockquote>q</blockquote>", "<pre><code>1&lt;2</code></pre>", "<hr/>"]


def test_rendering_escapes_and_survives_long_texts():
    assert "<script" not in render.media("[[a|<script>]] [http://x.example <b>]")[0].replace("&lt;script", "")
    assert len(render.media("'''x''' " * 20_000)[0]) > 100_000
    assert render.namu("")[0] == ""


@pytest.mark.parametrize("name, dialects", [("참고", 1), ("관련 항목", 1), ("함께 보기", 1), ("같이 보기", 2), ("본론", 0)])
def test_closing_sections_of_each_dialect(name, dialects):
    text = f"x\n== {name} ==\ngone\n== Next ==\nkept"
    assert ["gone" not in f(text)[0] for f in (render.media, render.namu)] == [dialects > 0, dialects > 1]
    assert all("kept" in f(text)[0] for f in (render.media, render.namu))
