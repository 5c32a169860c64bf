"""Snapshots assembled from rows and read back as saved evidence."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sitefacts import evidence, snapshot
from sitefacts.workdir import saved

DAY, AT = dt.date(2024, 1, 1), dt.datetime(2024, 3, 1)
TIMES = "start_date date, end_date date, started_at timestamp, finished_at timestamp"
ASKED = f"snapshot_id string, name string, target string, dims array<string>, aggregation string, {TIMES}"
ROWS = "snapshot_id string, name string, keys array<string>, clicks long, impressions long, ctr double, position double"
SITES = "snapshot_id string, site string, pages array<string>, search_property string, analytics_property string, sitemap string, success_events array<string>, caveats array<string>, start_date date, end_date date"


def asked(spark, names, dims=("page",)):
    return spark.createDataFrame([("s", n, "https://a.example/", list(dims), "byPage", DAY, DAY, AT, AT) for n in names], ASKED)


def rows(spark, counts):
    return spark.createDataFrame([("s", name, [f"p{i}"], i, 10, i / 10, 1.5) for name, n in counts.items() for i in range(n)], ROWS)


def site(spark, ids, **kw):
    return spark.createDataFrame([(i, "https://a.example/", kw.get("pages"), "sc", None, None, kw.get("events"), kw.get("caveats"), DAY, DAY) for i in ids], SITES)


def test_search_pages_end_as_a_reader_would(spark):
    cases = [(0, [0], True), (1, [1], True), (2, [2, 0], True), (5, [2, 2, 1], True), (6, [2, 2, 2], False), (7, [2, 2, 2], False)]
    got = snapshot.search_observations(asked(spark, [f"r{n}" for n, _, _ in cases]), rows(spark, {f"r{n}": n for n, _, _ in cases} | {"other": 3}), size=2, most=3)
    found = {r.name: r for r in got.collect()}
    assert len(found) == len(cases)
    for n, sizes, exhausted in cases:
        o = found[f"r{n}"]
        pages = [json.loads(p) for p in o.pages]
        assert [len(p["response"]["rows"]) for p in pages] == sizes and [p["request"]["startRow"] for p in pages] == [0, 2, 4][:len(sizes)]
        clicks = [r["clicks"] for p in pages for r in p["response"]["rows"]]
        assert clicks == sorted(range(n), reverse=True)[:6]
        kept = min(n, 6)
        assert tuple(o.pagination) == (exhausted, None if exhausted else kept, kept) and o.status == ("ok" if exhausted else "partial")
        assert ("not_exhausted" in o.warnings) != exhausted and "page_aggregation" in o.warnings


def test_analytics_pages_end_at_the_row_count(spark):
    cases = [(0, [0], True), (2, [2], True), (3, [2, 1], True), (4, [2, 2], True), (5, [2, 2], False)]
    schema = f"snapshot_id string, name string, target string, dims array<string>, metrics array<string>, metric_types array<string>, time_zone string, currency string, thresholded boolean, filter string, {TIMES}"
    want = spark.createDataFrame([("s", f"a{n}", "properties/1", ["eventName"], ["eventCount"], ["TYPE_INTEGER"], "UTC", None, True, '{"filter":{"fieldName":"hostName"}}', DAY, DAY, AT, AT) for n, _, _ in cases], schema)
    have = spark.createDataFrame([("s", f"a{n}", [f"e{i}"], [str(i)]) for n, _, _ in cases for i in range(n)], "snapshot_id string, name string, keys array<string>, raw array<string>")
    made = saved(snapshot.analytics_observations(want, have, size=2, most=2))
    found = {r.name: r for r in made.collect()}
    for n, sizes, exhausted in cases:
        o = found[f"a{n}"]
        p = [json.loads(x) for x in o.pages]
        assert [len(x["response"]["rows"]) for x in p] == sizes and {x["response"]["rowCount"] for x in p} == {n} and o.pagination.exhausted == exhausted
        assert p[0]["request"]["dimensionFilter"] == {"filter": {"fieldName": "hostName"}} and "thresholded" in o.warnings
    docs, rejects = snapshot.build_snapshot(site(spark, ["s"]), made)
    s, back, bad = evidence.split_snapshots(docs)
    assert rejects.count() == 0 and bad.count() == 0 and evidence.report_violations(evidence.report_pages(back), s).count() == 0


def test_round_trip(spark):
    reports = snapshot.search_observations(asked(spark, ["search.page", "search.empty"]), rows(spark, {"search.page": 5}), size=2)
    by_date = snapshot.search_observations(asked(spark, ["search.date"], ["date"]), spark.createDataFrame([("s", "search.date", [d], 1, 1, 1.0, 1.0) for d in ("2024-01-02", "2024-01-01")], ROWS))
    seen = spark.createDataFrame([("s", AT, AT, "https://a.example/ü\"", 200), ("s", AT, AT, "https://a.example/gone", 404)], "snapshot_id string, started_at timestamp, finished_at timestamp, url string, status int")
    pages = snapshot.single(seen, "web", "page", F.concat(F.lit("page:"), "url"), F.col("url"), F.struct("url"), F.struct("status", F.lit(None).cast("string").alias("title")), F.when(F.col("status") > 399, "error").otherwise("ok"), F.col("status"))
    made = reports.unionByName(by_date).unionByName(pages)
    made = saved(made)
    docs, rejects = snapshot.build_snapshot(site(spark, ["s"], pages=["https://a.example/"], caveats=["moved in May"], events=["buy"]), made)
    docs = saved(docs)
    s, o, bad = evidence.split_snapshots(docs)
    assert rejects.count() == 0 and bad.count() == 0
    fields = ["name", "provider", "operation", "target", "status", "started_at", "finished_at", "pagination", "warnings", "error"]
    key = lambda r: r.name
    assert sorted(o.select(*fields).collect(), key=key) == sorted(made.select(*fields).collect(), key=key)
    want = {r.name: [json.loads(p) for p in r.pages] for r in made.collect()}
    assert {r.name: [json.loads(p) for p in r.pages] for r in o.withColumn("pages", F.transform("pages", lambda p: F.to_json(p))).collect()} == want
    assert {(r.observation, r.rule) for r in evidence.report_violations(evidence.report_pages(o), s).collect()} == {("search.date", "NR-3")}
    assert evidence.normalize_reports(o, s).count() == 20  # five rows of four numbers
    snap = s.first()
    assert snap.status == "partial" and snap.observed_search_dates == ["2024-01-01", "2024-01-02"] and {"moved in May", "success_events_not_validated"} <= set(snap.warnings)
    body = json.loads(docs.first().body)
    assert body["providers"] == {"search": "selected", "analytics": "not_selected", "sitemap": "not_selected", "web": "selected"} and body["deploymentVersion"] is None
    assert {x["name"]: x.get("errorCode") for x in body["summary"]}["page:https://a.example/gone"] == "not_found"


def test_snapshots_that_cannot_be_one(spark):
    one = snapshot.search_observations(asked(spark, ["n"]), rows(spark, {"n": 1}))
    many = one.unionByName(one.withColumn("snapshot_id", F.lit("twice"))).unionByName(one.withColumn("snapshot_id", F.lit("twice")))
    many = many.unionByName(one.withColumn("snapshot_id", F.lit("full")).crossJoin(spark.range(101)).withColumn("name", F.col("id").cast("string")).drop("id"))
    docs, rejects = snapshot.build_snapshot(site(spark, ["s", "twice", "full", "none"]), many)
    assert [r.snapshot_id for r in docs.collect()] == ["s"]
    assert {tuple(r) for r in rejects.collect()} == {("twice", "repeated_name"), ("full", "observation_count"), ("none", "no_observation")}
    assert snapshot.build_snapshot(site(spark, []), many)[0].count() == 0
