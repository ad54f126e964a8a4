"""Layout of small pages, and against a plain recursive reading of well-formed ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from helmline.llm import html_text

CASES = [
    ("<p>One<p>Two <b>bold</b>\n  text", "One\n\nTwo bold text"),
    ("<div>a</div><div>b<br>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>end", "- x\n- y\n  - z\n\nend"),
    ("<ol start=3><li>x</li><li value=9>y</li><li>z</li></ol>", "3. x\n9. y\n10. z"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide     c\na     b  d"),
    ("<td>no table", "no table"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p><script>var a='<p>no';</script>", "yes"),
    ("<head><title>t</title></head><body>b &amp; c&nbsp;d", "b & c\xa0d"),
    ("<pre>a  b\n  c</pre>x", "a  b\n  c\n\nx"),
    ("a<!-- no --> b <!doctype html>c </i>d", "a b c d"),
    ("<p>a</div>b</p></p>c < d", "ab\n\nc < d"),
    ("x<input value=no><textarea>no</textarea><select><option>no</select>y", "xy"),
    ("", ""), (None, ""), ("<", "<"), ("plain", "plain"), ("<div", ""), ("<p>a<script>never closed", "a"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert html_text.text_of(page) == text


def test_every_visible_word_in_order():
    rng = random.Random(2)

    def piece(depth):
        if depth == 0 or rng.random() < 0.3:
            w = f"w{rng.randrange(10 ** 6)}"
            return w + " ", [w]
        tag = rng.choice(["div", "p", "span", "ul", "table", "b", "section", "script", "i hidden"])
        parts = [piece(depth - 1 if tag != "p" else 0) for _ in range(rng.randrange(1, 4))]
        inner = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "{}")
        if tag == "script":
            return "<script>hidden words</script>", []
        text = "".join(inner.format(a) for a, _ in parts)
        words = [] if "hidden" in tag else [w for _, b in parts for w in b]
        return f"<{tag}>{text}</{tag.split()[0]}>", words

    for _ in range(300):
        page, words = piece(4)
        assert re.findall(r"w\d+", html_text.text_of(page)) == words, page


def test_deep_and_long():
    assert html_text.text_of("<div>" * 30000 + "x") == "x"
    assert len(html_text.text_of("<p>word " * 20000).split()) == 20000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a"), (2, "")], "page_id bigint, html string").withColumn("text", F.lit(0))
    assert sorted(map(str, html_text.extract(df).collect())) == sorted(
        ["Row(page_id=1, text='a')", "Row(page_id=None, text='')", "Row(page_id=1, text='a')", "Row(page_id=2, text='')"])
    assert html_text.extract(df.limit(0)).count() == 0


FOREIGN = [
    ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then", "If x=1 then"),
    ("a <math><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding=tex>no</annotation></math> b", "a 1 2 b"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>One</text><text>Two</text></svg> end",
     "One Two end"),
    ("<svg><title/><style/><text>yes</text><text display=none>no</text></svg><p>x", "yes\n\nx"),
    ("<svg/>a<div>b</div>", "a\nb"),
]


@pytest.mark.parametrize("page,text", FOREIGN)
def test_formulas_and_drawings(page, text):
    assert html_text.text_of(page) == text
