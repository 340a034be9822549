import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyflow.functions import blocks, html

PIECES = ["<p>", "</p>", "<b>", "</b>", "<i class='x'>", "</i>", "<div>", "</div>", "<blockquote>", "</blockquote>", "<br>", "<br/>", "<hr>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href='u'>", "</a>", "<span>", "</span>", "<noscript>", "</noscript>", "<h2>", "</h2>", "<img src=s>", "one", "two words", " ", "&amp;", "&#38;", "\n", "x < y", "<!-- c -->", "<del>", "</del>"]
MARKUP = st.lists(st.sampled_from(PIECES), max_size=25).map("".join)


def nested(markup):
    """Whether every end tag closes the last open element, and inline elements hold no blocks."""
    open_ = []
    for end, name, alone in re.findall(r"<(/?)([a-z0-9]+)[^>]*?(/?)>", markup):
        if alone:
            continue
        if end:
            if not open_ or open_.pop() != name:
                return False
        else:
            if name in blocks.BLOCKS and open_ and open_[-1] in blocks.PHRASES:
                return False
            open_.append(name)
    return not open_


def words(markup):
    return re.sub(r"<[^>]*>", "", re.sub(r"<!--.*?-->", "", markup)).replace("<", "&lt;")


@settings(max_examples=600, deadline=None)
@given(MARKUP)
def test_balanced_markup_nests_and_keeps_its_text(markup):
    out = blocks.balance(markup)
    assert nested(out)
    assert blocks.balance(out) == out
    assert words(out) == words(re.sub(r"x < y", "x &lt; y", markup))


@settings(max_examples=600, deadline=None)
@given(MARKUP)
def test_paragraphs_nest_keep_words_and_happen_once(markup):
    out = blocks.paragraphs(f"<div>{markup}</div>")
    assert nested(out.replace("<!-- paragraphs-made -->", ""))
    assert blocks.paragraphs(out) == out
    assert re.sub(r"\s+", "", words(out)) == re.sub(r"\s+", "", words(markup.replace("x < y", "x &lt; y")))


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<p><b>Title<br><p>one</b> two</p>", "<p><b>Title<br /></b></p><p><b>one</b> two</p>"),
        ("<b>1<i>2</b>3</i>4", "<b>1<i>2</i></b><i>3</i>4"),
        ("<div><b>x</div>y", "<div><b>x</b></div><b>y</b>"),
        ("<ul><li>a<li>b</ul>c</li>", "<ul><li>a</li><li>b</li></ul>c"),
        ("<table><tr><td><b>x<td>y</table>z", "<table><tr><td><b>x</b></td><td>y</td></tr></table>z"),
        ("<p>a<noscript><img src=x><div>q</div></noscript>b</p>", '<p>a<noscript><img src="x" /><div>q</div></noscript>b</p>'),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<script>if (a<b) { '</p>' }</script>", "<script>if (a<b) { '</p>' }</script>"),
        ("<i/>x</br>", "<i></i>x<br />"),
        ("", ""),
    ],
)
def test_balance(markup, want):
    assert blocks.balance(markup) == want


def made(markup):
    return blocks.paragraphs(markup).removeprefix('<!-- paragraphs-made -->\n<div id="paragraphs-made">\n').removesuffix("</div>\n")


@pytest.mark.parametrize(
    "markup, want",
    [
        # Double breaks are usual; a single one ends a paragraph too, three leave a gap, more a rule.
        ("<div>a<br><br>b<br/>c<br /> <br>d<br><br><br>e<br><br><br><br>f</div>", "<p>a</p>\n<p>b</p>\n<p>c</p>\n<p>d</p>\n<p><br /></p>\n<p>e</p>\n<hr />\n<p>f</p>\n"),
        # Without double ones, single breaks end paragraphs, and one more leaves a gap.
        ("<div>a<br>b<br>c</div>", "<p>a</p>\n<p>b</p>\n<p>c</p>\n"),
        # Many short lines with single breaks are wrapped ones.
        ("<div>a a<br>b b<br>c c<br>d d<br><br>e e</div>", "<p>a a \nb b \nc c \nd d</p>\n<p>e e</p>\n"),
        # Long lines are not.
        (f"<div>{'a' * 200}<br>{'b' * 200}<br>c<br><br>{'d' * 200}</div>", f"<p>{'a' * 200}</p>\n<p>{'b' * 200}</p>\n<p>c</p>\n<p>{'d' * 200}</p>\n"),
        # Bare text around blocks is wrapped, at every level; quotes keep their breaks.
        ("<div>x<p>one<br>two</p>y<blockquote>q<br>r<p>s</p></blockquote><div>n<i>m</i></div></div>", "<p>x</p>\n<p>one<br />two</p>\n<p>y</p>\n<blockquote>\n<p>q<br />r</p>\n<p>s</p>\n</blockquote>\n<div>\n<p>n<i>m</i></p>\n</div>\n"),
        # Inline elements close and open again where a paragraph ends in them.
        ("<div><b>a<i>b<br><br>c</i>d</b>e</div>", "<p><b>a<i>b</i></b></p>\n<p><b><i>c</i>d</b>e</p>\n"),
        # Breaks alone between blocks leave a gap, and an empty paragraph is one.
        ("<div><p>a</p><br><br><p>b</p><p> </p>c</div>", "<p>a</p>\n<p><br /></p>\n<p>b</p>\n<p><br /></p>\n<p>c</p>\n"),
        # Rules lose their attributes and the breaks around them.
        ('<div>a<br><hr width="5"><br>b<pre> c\n d<br></pre></div>', "<p>a</p>\n<hr />\n<p>b</p>\n<pre> c\n d<br /></pre>\n"),
        ("<div>a<ul><li>b</ul>words bars</div>", "<p>a</p>\n<ul><li>b</li></ul>\n<p>words bars</p>\n"),
        # Nine breaks and more are always a rule.
        ("<div>a" + "<br>" * 9 + "b</div>", "<p>a</p>\n<hr />\n<p>b</p>\n"),
        # Several blocks without a div around them.
        ("<p>a</p>b<div>c</div>", "<p>a</p>\n<p>b</p>\n<div>\n<p>c</p>\n</div>\n"),
    ],
)
def test_paragraphs(markup, want):
    assert made(markup) == want


def test_plain_text_and_nulls(spark):
    assert blocks.paragraphs("no tags at all") == "no tags at all"
    row = spark.createDataFrame([(None, "a<br>b")], "x string, y string").select(blocks.paragraphed(F.col("x")).alias("x"), blocks.balanced(F.col("y")).alias("y")).first()
    assert row.x is None and row.y == "a<br />b"


def test_deep_and_long_pages():
    assert nested(blocks.balance("<div>" * 3000 + "x"))
    assert nested(blocks.balance("<b>" * 500 + "<p>x" * 50))
    assert len(made("<div>" + "line<br><br>" * 20_000 + "</div>").splitlines()) == 20_000


def test_classes_and_emails(spark):
    df = spark.createDataFrame([('<div class="a chapter b"><p class="chapter">x</p></div>', '<a class="__cf_email__" data-cfemail="zz">x</a><span class="__cf_email__" data-cfemail="422321006f">y</span>')], "x string, y string")
    row = df.select(blocks.without_class("chapter")(F.col("x")).alias("x"), blocks.emails_shown(F.col("y")).alias("y")).first()
    assert row.x == '<div class="a b"><p>x</p></div>'
    assert row.y == '<a class="__cf_email__" data-cfemail="zz">x</a><span data-cfemail="422321006f" class="decoded_email">acB-</span>'


def test_css(spark):
    css = "a{b:url( 'x.png')} c{d:url(x.png)url(\"x.png\")} e{f:url(y.TTF)} g{h:url()} i{j:url(unknown)}"
    got = spark.createDataFrame([(css,), ("plain",), (None,)], "css string").select(html.css_relinked(F.col("css"), F.create_map(F.lit("x.png"), F.lit("n$1.png"), F.lit("y.TTF"), F.lit("no"))).alias("r"))
    assert [r.r for r in got.collect()] == ["a{b:url( 'x.png')} c{d:url(n$1.png)url(\"n$1.png\")} e{f:url(y.TTF)} g{h:url()} i{j:url(unknown)}", "plain", None]


@pytest.mark.parametrize("markup", ["<title>a&am</title>", "<p>a&amp<b>b&#38 c</b> &lt;</p>", "AT&T", "a&", "<p>&&am</p>"])
def test_texts_keep_entities_without_an_end(markup):
    assert blocks.balance(markup) == markup
    assert html.clean_markup(markup) == markup


def test_text_of_an_unclosed_title_stays():
    assert blocks.balance("<title>a &am") == "<title>a &am</title>"
