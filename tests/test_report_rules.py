"""One fixture for each rule, which breaks this rule only, and what makes two reports incomparable."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from sitefacts import compare, evidence, ranks
from sitefacts import functions as X


def analytics(currency="USD", start="2024-01-01", end="2024-01-14"):
    def page(offset, limit, rows):
        return {"request": {"dimensions": [{"name": "eventName"}], "metrics": [{"name": "eventCount"}, {"name": "totalRevenue"}], "dateRanges": [{"startDate": start, "endDate": end}], "offset": offset, "limit": limit, "returnPropertyQuota": offset == 0},
            "response": {"dimensionHeaders": [{"name": "eventName"}], "metricHeaders": [{"name": "eventCount", "type": "TYPE_INTEGER"}, {"name": "totalRevenue", "type": "TYPE_CURRENCY"}], "rowCount": 3,
                "rows": [{"dimensionValues": [{"value": k}], "metricValues": [{"value": n}, {"value": v}]} for k, n, v in rows], "metadata": {"timeZone": "Europe/Paris", "currencyCode": currency, "samplingMetadatas": []}}}
    return {"provider": "analytics", "operation": "report", "name": "a", "target": "https://s.example/", "status": "ok", "finishedAt": "2024-03-01T00:00:00Z", "pagination": {"exhausted": True, "nextOffset": None, "rowsReturned": 3},
        "pages": [page(0, 2, [("x", "5", "1.5"), ("y", "7", "0")]), page(2, 1, [("z", "1", "2.25")])]}


def search(start="2024-01-01", end="2024-01-14"):
    def page(at, limit, rows):
        return {"request": {"startDate": start, "endDate": end, "dimensions": ["query"], "startRow": at, "rowLimit": limit}, "response": {"responseAggregationType": "byProperty", "rows": [{"keys": [k], "clicks": n, "impressions": 10, "ctr": n / 10, "position": 1.0123456789012345} for k, n in rows]}}
    return {"provider": "search", "operation": "report", "name": "s", "target": "https://s.example/", "status": "ok", "finishedAt": "2024-03-01T00:00:00Z", "pagination": {"exhausted": True, "nextOffset": None, "rowsReturned": 3}, "pages": [page(0, 2, [("p", 1), ("q", 2)]), page(2, 500, [("r", 3)])]}


def document(*observations, start="2024-01-01", end="2024-01-14", observed=("2024-01-14",)):
    return json.dumps({"schemaVersion": 1, "config": {"site": "https://s.example/"}, "target": "https://s.example/", "status": "ok", "startDate": start, "endDate": end, "observedSearchDates": list(observed), "observations": list(observations)})


def put(*path):
    """A change of the value at `path`; the last item is the value, or a function of it."""
    def change(o):
        *way, last, value = path
        for p in way:
            o = o[p]
        if callable(value):
            value(o[last])
        else:
            o[last] = value
    return change


def both(*path):
    return lambda o: [put("pages", i, *path)(o) for i in (0, 1)]


BROKEN = [
    (search, both("request", "dataState", "all"), "NR-1"), (search, put("pages", 0, "response", "metadata", {"first_incomplete_date": "2024-01-13"}), "NR-1"), (search, put("pages", 1, "response", "metadata", {"first_incomplete_hour": "x"}), "NR-1"),
    (search, put("pages", 1, "request", "startRow", 3), "NR-2"), (analytics, put("pages", 0, "request", "offset", 1), "NR-2"),
    (search, both("request", "dimensions", ["date"]), "NR-3"), (search, both("request", "dimensions", ["hour"]), "NR-3"),
    (analytics, both("request", "dateRanges", lambda r: r.append({"startDate": "2023-01-01", "endDate": "2023-01-14"})), "NR-4"),
    (analytics, lambda o: (both("request", "dimensions", [{"name": "city"}])(o), both("response", "dimensionHeaders", [{"name": "city"}])(o)), "NR-5"), (analytics, both("request", "dimensions", 0, "dimensionExpression", {"lowerCase": {"dimensionName": "eventName"}}), "NR-5"),
    (analytics, lambda o: (both("request", "metrics", [{"name": "eventCount"}] * 2)(o), both("response", "metricHeaders", [{"name": "eventCount"}] * 2)(o)), "NR-6"),
    (analytics, both("response", "dimensionHeaders", [{"name": "hostName"}]), "NR-7"), (analytics, both("response", "metricHeaders", lambda h: h.reverse()), "NR-7"),
    (analytics, both("response", "metadata", lambda m: m.pop("currencyCode")), "NR-8"), (analytics, both("request", "dateRanges", 0, "endDate", "2024-01-13"), "NR-9"), (search, both("request", "startDate", "2024-01-02"), "NR-9"),
    (analytics, put("pages", 1, "response", "metadata", "currencyCode", "EUR"), "NR-10"), (analytics, put("pages", 1, "response", "metadata", "timeZone", "UTC"), "NR-10"), (analytics, put("pages", 1, "response", "metricHeaders", 0, "type", "TYPE_FLOAT"), "NR-10"),
    (analytics, put("pages", 1, "request", "keepEmptyRows", True), "NR-10"), (search, put("pages", 1, "request", "type", "image"), "NR-10"), (search, put("pages", 1, "response", "responseAggregationType", "byPage"), "NR-10"),
    (search, put("pages", 1, "response", "rows", 0, "keys", ["r", "t"]), "NR-11"), (analytics, put("pages", 0, "response", "rows", 1, "metricValues", [{"value": "1"}]), "NR-11"), (search, put("pages", 1, "response", "rows", 0, "keys", ["p"]), "NR-12"),
    (analytics, both("response", "rowCount", 2), "NR-13"), (analytics, both("response", "rowCount", 4), "NR-13"), (analytics, both("response", "rowCount", "3"), "NR-13"), (analytics, put("pages", 1, "response", "rowCount", 4), "NR-13"), (analytics, both("response", "rowCount", 3.5), "NR-13"),
    (search, put("pagination", "nextOffset", 99), "NR-14"), (search, put("pagination", "rowsReturned", 4), "NR-14"), (search, put("pagination", {"exhausted": False, "nextOffset": None, "rowsReturned": 3}), "NR-14"), (search, put("pagination", {"exhausted": False, "nextOffset": 99, "rowsReturned": 3}), "NR-14"),
    (search, both("response", "responseAggregationType", ""), "schema"), (analytics, both("response", "metadata", lambda m: m.pop("timeZone")), "schema"),
    (search, lambda o: None, None), (analytics, lambda o: None, None), (search, put("pagination", {"exhausted": False, "nextOffset": 3, "rowsReturned": 3}), None), (search, put("pages", 1, "request", "rowLimit", 7), None), (search, put("pages", 1, "request", "type", "web"), None),
    (analytics, put("pages", 1, "request", "returnPropertyQuota", True), None), (search, put("pages", 0, "response", "metadata", {"note": 1}), None)]


def test_every_rule_alone(spark):
    docs = []
    for i, (make, change, _) in enumerate(BROKEN):
        o = copy.deepcopy(make())
        change(o)
        docs.append((f"d{i}", document(o)))
    s, o, rejects = evidence.split_snapshots(spark.createDataFrame(docs, "snapshot_id string, body string"))
    assert rejects.count() == 0
    got = {}
    for r in evidence.report_violations(evidence.report_pages(o), s).collect():
        got.setdefault(r.snapshot_id, []).append(r.rule)
    assert [(i, sorted(got.get(f"d{i}", []))) for i in range(len(BROKEN))] == [(i, [rule] if rule else []) for i, (*_, rule) in enumerate(BROKEN)]
    rows = evidence.normalize_reports(o, s).groupBy("snapshot_id").count().collect()
    assert {r.snapshot_id for r in rows} == {f"d{i}" for i, (*_, rule) in enumerate(BROKEN) if not rule}


def test_limitations(spark):
    def made(make, change=lambda o: None, **kw):
        o = copy.deepcopy(make())
        change(o)
        return document(o, **kw)

    meta = lambda k, v: both("response", "metadata", k, v)
    docs = [made(search), made(search, observed=()), made(search, put("status", "partial")), made(search, put("pagination", {"exhausted": False, "nextOffset": 3, "rowsReturned": 3})), made(search, put("error", {"code": "x"})), made(analytics),
        made(analytics, meta("subjectToThresholding", True)), made(analytics, meta("dataLossFromOtherRow", True)), made(analytics, meta("samplingMetadatas", [{"samplesReadCount": "1"}])), made(analytics, put("finishedAt", "2024-01-16T12:00:00Z")), made(analytics, meta("timeZone", "Nowhere/None"))]
    s, o, _ = evidence.split_snapshots(spark.createDataFrame([(f"d{i:02}", d) for i, d in enumerate(docs)], "snapshot_id string, body string"))
    zones = spark.createDataFrame([("Europe/Paris",)], "zone string")
    got = [r.limitations for r in evidence.limitations(evidence.report_pages(o), s, zones).orderBy("snapshot_id").collect()]
    assert got == [[], ["end_date_not_observed"], ["not_exhausted"], ["not_exhausted"], ["not_exhausted"], [], ["thresholded"], ["other_row"], ["sampled"], ["freshness_not_settled"], ["freshness_cannot_assess"]]


def compared(spark, before, after, most=100, b=("2024-01-01", "2024-01-14"), a=("2024-01-15", "2024-01-28")):
    docs = [("b", document(*before, start=b[0], end=b[1], observed=(b[1],))), ("a", document(*after, start=a[0], end=a[1], observed=(a[1],)))]
    s, o, _ = evidence.split_snapshots(spark.createDataFrame(docs, "snapshot_id string, body string"))
    pages = evidence.report_pages(o)
    facts = evidence.report_facts(pages).withColumnRenamed("observation", "name")
    side = o.select("snapshot_id", "site", "name", "provider", "operation", "target", "status", F.size("pages").alias("n_pages")).join(facts, ["snapshot_id", "name"], "left")
    norm = evidence.normalize_reports(o, s).withColumnRenamed("observation", "name")
    half = lambda df, k: df.where(F.col("snapshot_id") == k)
    pairs = compare.pair(half(side, "b"), half(side, "a"), half(norm, "b"), half(norm, "a"))
    return compare.compare_snapshots(pairs, half(norm, "b"), half(norm, "a"), pairs.limit(0), most)


@pytest.mark.parametrize("change, want", [(lambda o: None, "compared"), (both("response", "metadata", "currencyCode", "EUR"), "incompatible"), (both("response", "metadata", "timeZone", "UTC"), "incompatible"), (both("response", "metricHeaders", 0, "type", "TYPE_FLOAT"), "incompatible"),
    (both("request", "keepEmptyRows", True), "incompatible"), (put("pages", 1, "request", "limit", 900), "compared"), (put("target", "https://t.example/"), "incompatible"), (put("status", "error"), "unavailable"), (put("pages", 0, "response", "rows", 0, "metricValues", 0, "value", "n/a"), "limited")])
def test_pairs(spark, change, want):
    after = analytics(start="2024-01-15", end="2024-01-28")
    change(after)
    assert [(r["name"], r.status) for r in compared(spark, [analytics()], [after])[0].collect()] == [("a", want)]


def test_numbers_of_a_source_are_compared_and_one_sided_keys_do_not_limit(spark):
    after = search(start="2024-01-15", end="2024-01-28")
    for i, k in enumerate(["p", "u", "v"]):
        (after["pages"][0]["response"]["rows"] + after["pages"][1]["response"]["rows"])[i]["keys"] = [k]
    status, changes, gone, new = compared(spark, [search()], [after], most=1)
    assert [(r.status, r.common, r.others) for r in status.collect()] == [("compared", 1, 4)]
    assert {(r.metric, r.delta, r.omitted) for r in changes.collect()} == {(m, 0.0, 0) for m in ("clicks", "impressions", "ctr", "position")}
    assert {(r["keys"][0], r.omitted) for r in gone.collect()} == {("q", 1)} and {(r["keys"][0], r.omitted) for r in new.collect()} == {("u", 1)}


def test_number_grammar(spark):
    texts = {"+5": None, ".5": None, "5.": None, "1.0000000000000000": 1.0, "1.50000000000000000000": 1.5, "0.1234567890123456": None, "-0": -0.0, "1e3": 1000.0, "1E+3": 1000.0, "12\n": None, " 1": None, "1_0": None, "9007199254740991": 9007199254740991.0, "9007199254740992": None, "000000000000000000000000000000000000000000007": 7.0, "0e5": 0.0, "1e-400": None, "1e400": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.safe_number(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == texts


def test_first_rows_of_a_group_of_a_million(spark):
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 1000 == 7, F.lit("small")).otherwise(F.lit(None).cast("string")).alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v"), "id")
    out = ranks.first_of_each(rows, ["g"], [F.desc("v"), F.asc("id")], 5)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append((r.place, r.v, r.total))
    top = sorted((i * 7919 % 1_000_003 for i in range(1_000_000) if i % 1000 != 7), reverse=True)[:5]
    assert sorted(got[None]) == [(i + 1, v, 999_000) for i, v in enumerate(top)] and len(got["small"]) == 5 and got["small"][0][2] == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # in each task, and again where a group's few rows meet
