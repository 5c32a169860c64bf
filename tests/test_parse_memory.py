"""Parsing pages takes memory in proportion to a piece of a batch, and every page is parsed once."""

import tracemalloc

import pyarrow as pa

from sitefacts import adapters, pages


def test_a_batch_is_parsed_in_pieces():
    body = "<title>t</title>" + "".join(f'<a href="/{i}">link {i}</a>' for i in range(2000))
    tracemalloc.start()
    got = pages.held_array(pa.array([body, None] * 300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 600 and got[0].as_py() == pages.held(body) and got[599].as_py() == pages.held(None)
    assert peak < 120 << 20  # all of it as Python objects takes over 300 MB


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_parsed_once(spark):
    one = plan(adapters.crawled(spark, "/root/testdata/sf0.001"))
    assert one.count("ArrowEvalPython") + one.count("ArrowEvalArrow") + one.count("BatchEvalPython") <= 3 and "Join" not in one
    two = plan(pages.page_metadata(pages.observed(adapters.fetches(spark, "/root/testdata/sf0.001"))))
    assert two.count("EvalPython") <= 2


def test_first_canonical_that_resolves(spark):
    html = '<base href="/b/"><link rel="canonical" href="http://[bad"><link rel="canonical" href="c#f"><link rel="canonical" href="/d"><title>&amp;</title>'
    rows = spark.createDataFrame([("r", 1, "https://s.example/x", 200, "text/html", None, None, html), ("r", 2, "https://s.example/y", 200, "text/html", None, None, '<base href="http://[bad"><link rel="canonical" href="z">'), ("r", 3, None, 200, "text/html", None, None, None)],
        "run_id string, seq long, url string, status int, content_type string, x_robots_tag string, location string, body string")
    got = {r.seq: (r.base, r.canonical) for r in pages.crawl_metadata(pages.observed(rows, html_only=True)).collect()}
    assert got == {1: ("https://s.example/b/", "https://s.example/b/c"), 2: ("https://s.example/y", "https://s.example/z"), 3: (None, None)}
    whole = {r.seq: (r.base, r.canonical, r.warnings) for r in pages.page_metadata(pages.observed(rows)).collect()}
    assert whole == {1: ("https://s.example/b/", "https://s.example/d", []), 2: ("https://s.example/y", "https://s.example/z", ["base_malformed"]), 3: (None, None, [])}
