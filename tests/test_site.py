"""Operators on small made inputs; the queries over the given tables are in test_oracle.py."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sitefacts import assess, compare, evidence, graph, pages, reports, robots, speed
from sitefacts import functions as X
from sitefacts import opportunities as O


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("raw, base, want", [
    ("/b?b=2&a=1#x", "https://A.example:443/q", "https://a.example/b?b=2&a=1"), ("../c", "http://a.example/x/y/z", "http://a.example/x/c"), ("für", "https://a.example/", "https://a.example/f%C3%BCr"),
    ("mailto:x@y.z", "https://a.example/", None), ("https://u:p@a.example/", "https://a.example/", None), ("http://a.example:99999/", "https://a.example/", None), ("//b.example", "https://a.example/", "https://b.example/"),
    ("\t/a\n b ", "https://a.example/", "https://a.example/a%20b"), (None, "https://a.example/", None), ("https://a.example/%7e?q=%zz", "https://a.example/", "https://a.example/%7e?q=%zz")])
def test_resolve(raw, base, want):
    assert X.resolve_text(raw, base) == want


def test_page_flavour_keeps_fragments_and_other_schemes():
    assert X.resolve_text("#a", "https://a.example/b", True, False) == "https://a.example/b#a"
    assert X.resolve_text("mailto:x@y.z", "https://a.example/", True, False) == "mailto:x@y.z"


def test_scalars(spark):
    urls = frame(spark, [("https://A.example:8443/x?y#z",), ("http://a.example:80",), ("ftp://x",), (None,)], "u string")
    got = urls.select(X.origin(F.col("u")).alias("o"), X.path_query(F.col("u")).alias("p"), X.is_http_url(F.col("u")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("https://a.example:8443", "/x?y", True), ("http://a.example", "/", True), (None, "/", False), (None, None, False)]
    texts = ["12", "-1.5e3", "9007199254740993", "NaN", "", "1e999", "1e-999", "9007199254740991.1", "1.00000000000000001", "0", "0.0", "9007199254740991", None]
    numbers = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.safe_number(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [12.0, -1500.0, None, None, None, None, None, None, None, 0.0, 0.0, 9007199254740991.0, None]
    times = frame(spark, [(dt.datetime(2026, 3, 9, 6, 30),)], "t timestamp").select(X.pacific_date(F.col("t")), X.pacific_days_ago(3, F.col("t")), X.default_window(F.col("t")).end_date).first()
    assert tuple(times) == (dt.date(2026, 3, 8), dt.date(2026, 3, 5), dt.date(2026, 3, 5))
    dates = frame(spark, [("2024-02-29",), ("2023-02-29",), ("2024-2-1",), (None,)], "d string").select(X.valid_date(F.col("d"))).collect()
    assert [r[0] for r in dates] == [True, False, False, False]
    some = frame(spark, [(["index", "NONE"], None, "noindexed"), (["nonexistent"], "x, noindex", "none"), (None, None, None)], "a array<string>, h string, t string")
    assert [tuple(r) for r in some.select(X.has_noindex(F.col("a"), F.col("h")), X.mentions_noindex(F.col("t")), X.has_nofollow(F.col("a"), F.col("h"))).collect()] == [(True, True, True), (True, False, False), (False, False, False)]
    assert frame(spark, [("123",), ("properties/5",), ("x",)], "p string").select(X.norm_property(F.col("p"))).collect() == [("properties/123",), ("properties/5",), (None,)]
    assert frame(spark, [('{"b":1,"a":[2]}',), ("{",)], "j string").select(X.valid_json(F.col("j")), X.canonical_json(F.try_parse_json("j"))).collect() == [(True, '{"a":[2],"b":1}'), (False, None)]


@pytest.mark.parametrize("rule, path, allowed", [("/a/b", "/a%2Fb", True), ("/a%2Fb", "/a%2fb", False), ("/foo/bar/ツ", "/foo/bar/%E3%83%84", False), ("/%62ar", "/bar", False), ("/literal%2A", "/literal-anything", True), ("/bad%", "/bad%", False),
    ("/*/private", "/x/private/y", False), ("/*.php$", "/a.php", False), ("/*.php$", "/a.php?id=1", True), ("", "/x", True), ("/A", "/a", True), ("/a.b", "/axb", True)])
def test_robots_patterns(rule, path, allowed):
    norm, pattern = X.robots_norm_text(path), X.robots_norm_text(rule)
    body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$"))
    hit = bool(pattern) and re.match(body + ("$" if pattern.endswith("$") else ""), norm) is not None
    assert hit != allowed


def test_robots_groups_ties_and_status(spark):
    body = "Disallow: /early\nUser-agent: a\nUser-Agent: B # two\nDisallow: /x\nFoo: bar\nAllow: /x\nUser-agent: *\nDisallow: /\nUser-agent: b\nDisallow: /b%41\nbroken\nUser-agent:\nSitemap:\nSitemap: /s.xml"
    files = frame(spark, [("o", "/robots.txt", 200, body), ("down", "/robots.txt", 429, "User-agent: a\nAllow: /"), ("gone", "/robots.txt", 404, "User-agent: *\nDisallow: /"), ("o", "/llms.txt", 200, "hi"), ("o", "/llms-full.txt", 404, "x")], "origin string, path string, status int, body string")
    rows = robots.lines(files)
    urls = frame(spark, [("o", "/x1"), ("o", "/bA"), ("o", "/bB"), ("down", "/"), ("gone", "/")], "origin string, path string")
    got = {(r.origin, r.path, r.agent): (r.allowed, r.robots_group, r.rule) for r in robots.robots_verdicts(urls, rows, ["A", "b", "other"]).collect()}
    assert got["o", "/x1", "A"] == (True, "a", "/x") and got["o", "/bA", "b"] == (False, "b", "/b%41") and got["o", "/bB", "b"] == (True, "b", None) and got["o", "/x1", "other"] == (False, "*", "/")
    assert got["down", "/", "A"] == (False, "*", "/") and got["gone", "/", "A"] == (True, None, None)
    assert {(r.line, r.issue) for r in robots.robots_issues(rows).where("origin = 'o'").collect()} == {(1, "rule_before_user_agent"), (11, "missing_colon"), (12, "empty_user_agent"), (13, "empty_sitemap")}
    assert [r.sitemap for r in robots.robots_sitemaps(rows).collect()] == ["/s.xml"]
    assert {(r.path, r.bytes, r.warning) for r in robots.llms_presence(files).collect()} == {("/llms.txt", 2, None), ("/llms-full.txt", None, None)}


PAGE = """<head><title> A &amp; B</title><base href="/sub/"><meta content="d1" name="Description"><meta name=description content="d2"><link rel=canonical href="c?x#f"><link rel="canonical" href="">
<meta property="OG:Image" content=1><meta property="og:image" content=2><meta name="twitter:card" content=s><meta name=robots content="noindex"><link rel="Alternate x" hreflang=de href="/de"><link rel=alternate href=/no>
<link rel=alternate hreflang=fr href="http://["><script type="application/ld+json">{"a":1}</script><script type="application/ld+json"> </script><script type="application/ld+json">{bad</script></head>
<h1>H <b>1</b></h1><!-- <img src=no> --><script>"<img src=no>"</script><noscript><img src=n alt=x></noscript><img src=1 alt=""><img src=2><img src=3 alt="t" width=5><a href="i?a=1&amp;b=2#one" rel=nofollow>One  <i>x</i></a><a>none</a><a href="/two">Two</a>"""


def test_page_flavours(spark):
    rows = [("r", 1, "https://s.example/p", 200, "TEXT/HTML; charset=utf-8", None, None, PAGE), ("r", 2, "https://s.example/q", 200, "image/png", None, None, "<title>x</title>"), ("r", 3, "https://s.example/r", 200, "text/html", None, None, None)]
    fetches = frame(spark, rows, "run_id string, seq long, url string, status int, content_type string, x_robots_tag string, location string, body string")
    seen = pages.observed(fetches)
    m = {r.seq: r for r in pages.page_metadata(seen).collect()}
    assert (m[1].title, m[1].description, m[1].canonical, m[1].robots, m[1].warnings) == ("A &amp; B", "d2", "https://s.example/sub/c?x#f", ["robots: noindex"], [])
    assert m[3].title is None and m[3].sha256 is None and m[2].title == "x"
    c = {r.seq: r for r in pages.crawl_metadata(pages.observed(fetches, html_only=True)).collect()}
    assert (c[1].title, c[1].canonical, c[2].title, c[2].parsed) == ("A & B", "https://s.example/sub/c?x", None, False)
    assert [(r.property, r.content) for r in pages.social(seen, "og").collect()] == [("og:image", "1"), ("og:image", "2")] and [r.content for r in pages.social(seen, "twitter").collect()] == ["s"]
    assert [(r.lang, r.href, r.warning) for r in pages.hreflang(pages.page_metadata(seen)).collect()] == [("de", "https://s.example/de", None), ("fr", None, "alternate_malformed")]
    assert [(r.raw, r.valid_json) for r in pages.structured_data(seen).collect()] == [('{"a":1}', True), ("{bad", False)]
    got = [(r.src, r.alt_present, r.alt, r.in_noscript, r.omitted) for r in pages.images(seen, 3).orderBy("pos").collect()]
    assert got == [("1", True, "", False, 1), ("2", False, None, False, 1), ("3", True, "t", False, 1)]
    assert tuple(pages.image_alt_summary(seen).where("seq = 1").first())[3:] == (4, 1, 1, 2)
    assert [(r.href, r.rel, r.text, r.omitted) for r in pages.anchors(seen, 1).collect()] == [("i?a=1&b=2#one", "nofollow", "One x", 1)]
    assert pages.seo_fields(seen, items=1).where("seq = 1").first().truncated and pages.bound_body(fetches, 10).where("error = 'size_limit'").count() == 2
    e = {(r.kind, r.raw): r.to for r in graph.edges(pages.crawl_metadata(pages.observed(fetches, html_only=True))).collect()}
    assert e["link", "i?a=1&b=2#one"] == "https://s.example/sub/i?a=1&b=2" and e["link", "/two"] == "https://s.example/two"


def test_graph_depths_chains_and_findings(spark):
    u = lambda p: f"https://s.example/{p}"
    links = frame(spark, [("r", 1, 0, u("a"), u("b"), "redirect", None), ("r", 2, 0, u("b"), u("c"), "link", None), ("r", 3, 0, u("c"), u("a"), "link", None), ("r", 4, 0, u("l"), u("m"), "redirect", None), ("r", 5, 0, u("m"), u("l"), "redirect", None), ("r", 6, 0, u("o"), "https://other.example/", "redirect", None), ("r", 7, 0, u("n"), None, "redirect", None), ("r", 8, 0, u("g"), u("gone"), "redirect", None), ("r", 9, 0, u("c"), u("c"), "link", None)],
        "run_id string, seq long, pos int, from string, to string, kind string, rel string")
    assert {(r.url, r.depth) for r in graph.depths(links, frame(spark, [("r", u("a"))], "run_id string, url string")).collect()} == {(u("a"), 0), (u("b"), 0), (u("c"), 1)}
    ends = {r.start: (r.termination, r.hops) for r in graph.redirect_chains(links, frame(spark, [("r", u(x)) for x in "abc"], "run_id string, url string")).collect()}
    assert ends == {u("a"): ("observed_destination", 1), u("l"): ("loop", 2), u("m"): ("loop", 2), u("o"): ("outside_origin", 1), u("n"): ("invalid_target", 1), u("g"): ("unfetched", 1)}
    pages_ = frame(spark, [("r", u("a"), 200, True, "t", None, None, ["robots: noindex"], None), ("r", u("c"), 404, False, None, None, None, None, None), ("r", u("z"), 200, True, "t", "d", u("y"), None, None)],
        "run_id string, url string, status int, parsed boolean, title string, description string, canonical string, robots array<string>, x_robots_tag string")
    both = frame(spark, [("r", u("c")), ("r", u("z"))], "run_id string, url string")
    kinds = {(r.url[-1], r.kind) for r in graph.findings(pages_, links, graph.redirect_chains(links, pages_, paths=True).limit(0), both, both.limit(0)).collect()}
    assert kinds == {("a", "missing_html_metadata"), ("a", "noindex_directive"), ("c", "http_error"), ("z", "canonical_difference"), ("z", "no_incoming_link_observed")}


def test_sessions_do_not_depend_on_hours(spark):
    at = [0, 10, 45, 65, 100, 160, 161]
    rows = [(i, dt.datetime(2024, 1, 1, 23) + dt.timedelta(minutes=m), 1, f"e{i}") for i, m in enumerate(at)]
    got = reports.sessions(frame(spark, rows, "event_id long, ts timestamp, user_id long, event_name string")).orderBy("event_id").collect()
    assert [r.session for r in got] == ["1-1", "1-1", "1-2", "1-2", "1-3", "1-4", "1-4"] and [r.first_event_name for r in got] == ["e0", "e0", "e2", "e2", "e4", "e5", "e5"]


def test_reports_refuse_and_warn(spark):
    with pytest.raises(ValueError):
        reports.date_range(spark.range(1), "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        reports.realtime_report(spark.range(1), "2024-01-01", [("x", 0, 1)])
    assert reports.realtime_state(3, 1) == {"status": "partial", "next_offset": None} and reports.realtime_state(0, 1)["status"] == "invalid"
    row = spark.range(1).select(reports.report_warnings(*[F.lit(x) for x in (True, None, False, False, True, False, False)]).alias("w"), reports.observation_name(F.lit("search"), F.array(F.lit("page"), F.lit("date")), F.lit(True)).alias("n")).first()
    assert row.w == ["thresholded", "page_aggregation", "not_exhausted"] and row.n == "search.page+date.organic"
    fresh = reports.freshness(frame(spark, [(dt.date(2026, 8, 28), z, dt.datetime(2026, 8, 31, 2)) for z in ("UTC", "America/Los_Angeles", "No/Where", None)], "end_date date, time_zone string, collected_at timestamp"), frame(spark, [("UTC",), ("America/Los_Angeles",)], "zone string"))
    assert {r.time_zone: r.freshness for r in fresh.collect()} == {"UTC": "settled", "America/Los_Angeles": "not_settled", "No/Where": "cannot_assess", None: "cannot_assess"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), f"e{m % 2}") for m in range(0, 60, 3)] + [(dt.datetime(2024, 1, 3), "late")]
    df = frame(spark, rows, "ts timestamp, event_name string")
    df.write.parquet(str(tmp_path / "in"))
    s = reports.realtime_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    batch = df.groupBy(F.window("ts", "30 minutes", "1 minute"), "event_name").count().where("event_name <> 'late'")
    assert {(r.start, r.event_name, r.event_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r.window.start, r.event_name, r["count"]) for r in batch.collect()}


def test_comparison_never_fills(spark):
    side = lambda rows: frame(spark, rows, "k string, metric string, raw string")
    b, a = side([("shared", "m", "2"), ("gone", "m", "9"), ("zero", "m", "0"), ("odd", "m", "9007199254740993")]), side([("shared", "m", "4"), ("new", "m", "7"), ("zero", "m", "1"), ("odd", "m", "1")])
    assert {r.k: (r.delta, r.percent) for r in compare.deltas(b, a, ["k"]).collect()} == {"shared": (2.0, 100.0), "zero": (1.0, None), "odd": (None, None)}
    assert [r.k for r in compare.only_in(b, a, ["k"]).collect()] == ["gone"] and [r.k for r in compare.only_in(a, b, ["k"]).collect()] == ["new"]
    assert [(r.k, r.omitted) for r in compare.cap(b, ["metric"], ["k"], 1).collect()] == [("gone", 3)]


def test_snapshot_rejects(spark):
    good = '{"schemaVersion":1,"config":{"site":"s"},"target":"s","observations":[{"name":"a","pages":[{"request":{},"response":{}}]}]}'
    docs = [("ok", good), ("version", good.replace("1", "2", 1)), ("site", good.replace('"target":"s"', '"target":"t"')), ("page", good.replace('"response":{}', '"x":1')), ("names", good.replace("]}]}", ']},{"name":"a","pages":[]}]}')), ("none", good[:10])]
    s, o, rejects = evidence.split_snapshots(frame(spark, docs, "snapshot_id string, body string"))
    assert [r.snapshot_id for r in s.collect()] == ["ok"] and o.count() == 1
    got = {r.snapshot_id: r.reasons for r in rejects.collect()}
    assert got["version"] == ["other_version"] and got["site"] == ["other_site"] and got["page"] == ["malformed_page"] and got["names"] == ["repeated_name"] and "not_json" in got["none"]
    assert compare.source_identity(frame(spark, docs[:1], "snapshot_id string, body string")).first().sha256


def test_opportunity_rules(spark):
    rows = [("https://s.example/a?x=1", 1, 100, 0.01, 11.0), ("https://s.example/b", 0, 50, 0.0, 30.0), ("https://s.example/popular", 8, 200, 0.04, 2.0), ("https://s.example/bad", 3, 2, 0.1, 1.0), ("https://s.example/ctr", 0, 50, -0.2, 1.0)]
    report = frame(spark, rows, "page string, clicks long, impressions long, ctr double, position double")
    kept = O.cohort(report)
    assert [(r.page[-1], r.rank, r.observed) for r in O.ranked(kept).orderBy("rank").collect()] == [("1", 1, 2), ("b", 2, 2)]
    assert tuple(O.cohort_summary(report, kept, spark).first()) == (5, 2, 2, "partial") and O.cohort_summary(None, kept, spark).first().observed is None
    land = frame(spark, [("/a?x=1", "google", 5, 3), ("(other)", "x", 9, 1)], "landing string, source string, sessions long, engaged_sessions long")
    ev = frame(spark, [("/a?x=1", "google", "view", 7)], "landing string, source string, event_name string, event_count long")
    got = {r.page[-1]: (r.landing_rows, r.event_rows) for r in O.organic_association(kept, "https://s.example/", land, ev).collect()}
    assert got == {"1": (1, 1), "b": (None, None)} and [r.landing for r in O.unassociated(land, kept, "https://s.example/").collect()] == ["(other)"]


def test_speed_history_and_lab(spark):
    rows = spark.sql("SELECT 'u' AS url, 'o' AS origin, 'PHONE' AS form_factor, array(named_struct('first_date', DATE '2024-01-01', 'last_date', DATE '2024-01-28'), named_struct('first_date', DATE '2024-01-08', 'last_date', DATE '2024-02-04')) AS periods, map('lcp', named_struct('p75s', array('1', NULL), 'densities', array(array(0.5D), array(0.7D)))) AS metrics")
    assert [(r.metric, r.period_no, r.p75, r.densities) for r in speed.history(rows).collect()] == [("lcp", 0, "1", [0.5]), ("lcp", 1, None, [0.7])]
    lab = speed.lab_results(frame(spark, [('{"id":"u","lighthouseResult":{"categories":{"seo":{"score":0.9}},"audits":{"x":{"score":null,"numericValue":5,"details":{"overallSavingsMs":7}}}},"loadingExperience":{"metrics":{"L":{"percentile":3,"category":"FAST","distributions":[{"min":0,"max":1,"proportion":0.5}]}}}}',), ("{",)], "body string"))
    assert {(r.kind, r.id, r.score, r.value, r.savings_ms) for r in speed.lab_audits(lab).collect()} == {("category", "seo", 0.9, None, None), ("audit", "x", None, 5.0, 7.0)} and speed.lab_field(lab).first().proportion == 0.5
    caps = spark.sql("SELECT 'u' AS url, 'https://x/#a' AS final_url, false AS history_truncated, array(named_struct('url', 'https://x/', 'status', 301, 'x_robots_tag', 'a'), named_struct('url', 'https://x/', 'status', 200, 'x_robots_tag', 'b')) AS documents")
    assert speed.target_document(caps).first().document.status == 200
