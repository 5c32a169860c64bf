"""References against bases. `url_cases.json` holds [reference, base, result] of another implementation of the standard."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefacts import functions as X
from sitefacts import urls

CASES = json.load(open(os.path.join(os.path.dirname(__file__), "url_cases.json")))


def href(raw, base):
    u = urls.parse(raw, urls.parse(base))
    return u and u.href()


def test_cases_of_the_standard():
    assert len(CASES) > 300 and [c for c in CASES if href(*c[:2]) != c[2]] == []


# Where that implementation is older than the standard, or wrong.
@pytest.mark.parametrize("raw, base, want", [("foo://bar/..", "https://a.example/", "foo://bar/"), ("/a^b", "https://a.example/", "https://a.example/a%5Eb"), ("https://FAẞ.de/", "https://a.example/", "https://xn--fa-hia.de/"),
    ("x#y", "mailto:x@y.z", None), ("#y", "mailto:x@y.z", "mailto:x@y.z#y"), ("https://xn--mgba3gch31f060k.com/", "https://a.example/", "https://xn--mgba3gch31f060k.com/")])
def test_further_cases(raw, base, want):
    assert href(raw, base) == want


PIECES = st.lists(st.sampled_from(["http:", "https:", "file:", "foo:", "//", "/", "\\", "..", ".", "%2e", "?", "#", "@", ":", "80", "a.example", "[::1]", "1.2", "ß", "日本", "%", "%41", " ", "\t", "x", "C|", "xn--", "0x7f", "\u200d", "^", "'"]), max_size=8).map("".join)


@settings(max_examples=2000, deadline=None)
@given(PIECES, st.sampled_from(["https://a.example/b/c?q#f", "file:///C:/x", "foo:/p", "mailto:x"]))
def test_results_are_their_own_serialisation(raw, base):
    got = href(raw, base)
    assert got is None or urls.parse(got).href() == got


def test_columns_equal_the_parser(spark):
    more = ["/en/825?page=2&ref=x", "/a/b.html#top", "https://m.b.example/x.y/z?a=%zz#q", "/a/.b", "/a/..", "/a'b", "//b.example/x", "/", "", "/a?b=./../c", "https://b.example", "https://b.example/%7e", "http://u@b.example/", "/a?'", "https://b.1/", "/a//b", "/a|b", "/a\n", "/a?b\n"]
    bases = ["https://a.example/b/c?q=1#f", "https://a.example", "http://a.example:80/x", "https://A.example/", "http://1.2.3/", "nonsense", None, "https://u:p@a.example/"]
    rows = [(r, b) for r in [c[0] for c in CASES if "\x00" not in c[0]][::3] + more + [None] for b in bases]
    df = spark.createDataFrame(rows, "raw string, base string")
    for flags in ((False, True), (True, False)):
        got = df.select("raw", "base", X.resolve_url(F.col("raw"), F.col("base"), *flags).alias("u")).collect()
        assert [r for r in got if r.u != X.resolve_text(r.raw, r.base, *flags)] == []


def test_plain_references_do_not_go_to_python(spark, monkeypatch):
    monkeypatch.setattr(X, "resolve_text", lambda *_: "python")
    df = spark.createDataFrame([(r,) for r in ["/en/825?page=2&ref=x#a", "https://b.example/a.html", "/", "../x", "https://B.example/", "/a/../b", None]], "raw string")
    got = df.select(X.resolve_url(F.col("raw"), F.lit("https://a.example/b/c?q#f")).alias("u")).collect()
    assert [r.u for r in got] == ["https://a.example/en/825?page=2&ref=x", "https://b.example/a.html", "https://a.example/", "python", "python", "python", "python"]
