import re
import time

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import queries
from tidegrid.llm.htmltext import extract, visible_text

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<b>x</b>\n  <i>y</i>z": "x yz",
    "<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol><li>c</ul>after": "- a\n- b\n  3. x\n  9. y\n- c\n\nafter",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide<tr><td rowspan=2>r<td>2<tr><td>3</table>":
        "Name       N\nlong name  1\nwide\nr          2\n           3",
    "<table><td>stray cell</table>x": "stray cell\n\nx",
    "<td>no table</td> here": "no table here",
    "<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>": "a        b\n\nin  ner",
    "<head><title>t</title><style>p{}</style>text ends the head": "text ends the head",
    "<script>if (a</b) '<p>'</script>x<style></style>y<noscript>n</noscript>": "xy",
    "<p hidden>h<p style='Display : NONE'>d<p style='visibility:hidden'>v<span style='visibility:visible'>seen</span></p>z": "seen\n\nz",
    "<details><summary>S</summary>closed</details><details open><summary>T</summary>open</details>": "S\nT\nopen",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<pre>\n a\n   b</pre>": " a\n   b",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<!-- <p>c --> x <![CDATA[q]]> &lt;b&gt; 1 < 2": "x <b> 1 < 2",
    "<p title='a > b'>q</p><p title=\"open>r": "q\n\nr",
    "<textarea>\n<b>&amp;</textarea>": "<b>&",
    "a&nbsp;&nbsp;b": "a  b",
    "<a href=x>unclosed <b>tags": "unclosed tags",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    got = visible_text(source)
    assert [x.rstrip() for x in got.split("\n")] == CASES[source].split("\n")


def test_hostile_pages_take_linear_time():
    began = time.time()
    for s in ("<div>" * 100000 + "x", "<a href=\"" * 50000, "<" * 200000, "<table>" * 2000 + "x", "<p" * 100000, "&" * 300000, "<!--" * 100000,
              "<p '" * 50000, "<script>" * 30000, "</p>" * 100000):
        visible_text(s)
    assert time.time() - began < 60


def test_hostile_tables_take_linear_time_and_space():
    began = time.time()
    spans = "<table>" + '<tr><td colspan=1000 rowspan=65534>x' * 4000 + "</table>"
    assert visible_text(spans).split() == ["x"] * 4000
    assert time.time() - began < 1.5
    steps = "<table>" + "".join(f"<tr><td rowspan={5000 - i}>x" for i in range(4000)) + "</table>"
    assert visible_text(steps).split() == ["x"] * 4000
    assert time.time() - began < 20
    long = "<table><tr>" + "<td>" + "y" * 9000 + "<td>z" + "<tr><td>a<td>b" * 1000 + "</table>"
    assert len(visible_text(long)) < 10 * len(long)
    wide = "<table><tr>" + ("<td>" + "y" * 80) * 300 + "<tr><td colspan=299><td>b" * 1000 + "</table>"
    assert len(visible_text(wide)) < 20 * len(wide)


def test_spans_keep_their_columns():
    page = ("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<td>e<tr><td>f<td>g<td>h<tr><td>i<td>j</table>")
    assert visible_text(page).split("\n") == ["a  b  c", "   d     e", "   f  g  h", "i  j"]
    # Spans that meet a cell above: the later one holds the shared columns.
    page = "<table><tr><td>a<td rowspan=3>b<tr><td colspan=2 rowspan=3>c<tr><td>d<tr><td>e<tr><td>f</table>"
    assert visible_text(page).split("\n") == ["a  b", "c", "      d", "      e", "f"]


def test_attributes_hide_in_any_case():
    assert visible_text("<p Hidden>no</p><p HIDDEN>no</p><p StYlE='DISPLAY: None'>no</p><p>yes</p>") == "yes"
    assert visible_text("<p Style='Visibility:Hidden'>no <b STYLE='visibility:VISIBLE'>yes</b></p>") == "yes"


def test_query_shows_every_word_outside_hidden_elements(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op2(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    from html import unescape

    for r in rows:
        page = re.sub(r"<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", pages[r.page_id], flags=re.S)
        words = unescape(re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", page))
        words = re.sub(r"<[^>]*>", " ", words).replace("\xa0", " ").split()
        got = [w for w in r.visible_text.split() if w != "-"]
        assert got == [w for w in words if w != "-"]
        assert r.n_chars == len(r.visible_text)


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "<p>x", None), (3, "", "b")], "page_id long, html string, visible_text string")
    got = extract(df.withColumn("text", F.lit("y"))).collect()
    assert sorted((str(r.page_id), str(r.visible_text)) for r in got) == [("1", "None"), ("1", "None"), ("3", ""), ("None", "x")]
    assert extract(df.where("page_id > 9")).collect() == []
