"""Paging by ranks, and what reading page by page comes to, against a plain loop."""

import pytest
from pyspark.sql import functions as F

from sitefacts import reports


def plain(provider, n, limit, most, start):
    offset, pages, retained = start, 0, 0
    for _ in range(most):
        count = max(0, min(limit, n - offset))
        pages, retained, offset = pages + 1, retained + count, offset + count
        if count < limit if provider == "search" else offset >= n:
            return pages, retained, True, None, "ok"
    return pages, retained, False, offset, "partial"


@pytest.mark.parametrize("provider", ["search", "analytics"])
def test_state_equals_a_loop(spark, provider):
    for n, limit, most, start in [(0, 5, 3, 0), (1, 5, 3, 0), (5, 5, 3, 0), (9, 5, 3, 0), (10, 5, 2, 0), (14, 5, 3, 0), (15, 5, 3, 0), (16, 5, 3, 0), (30, 5, 3, 4), (3, 5, 3, 7)]:
        got = reports.pagination_state(spark.range(n), limit, most, start, provider).first()
        assert tuple(got)[1:] == plain(provider, n, limit, most, start), (n, limit, most, start)


def test_pages_hold_the_rows_in_order_without_a_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = reports.paginate(df, [F.desc("v")], 30, 3, start=10)
    assert sorted((r.row_no, r.page_no, r.v) for r in got.collect()) == [(i + 1, i // 30, 989 - i) for i in range(90)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan


def test_saved_pages(spark):
    rows = [("ok", "search", 0, 5, 5, None), ("ok", "search", 1, 2, 5, None), ("ok", "search", 2, 9, 9, None), ("open", "search", 0, 5, 5, None), ("stuck", "analytics", 0, 5, 5, 9), ("stuck", "analytics", 1, 0, 5, 9), ("stuck", "analytics", 2, 4, 5, 9),
        ("bad", "analytics", 0, 5, 5, None), ("later", "analytics", 0, 5, 5, 9), ("later", "analytics", 1, 4, 5, -1), ("done", "analytics", 0, 5, 5, 7), ("done", "analytics", 1, 2, 5, 7), ("none", "analytics", 0, 0, 5, 0)]
    df = spark.createDataFrame(rows, "report string, provider string, page_no int, n_rows int, row_limit int, row_count long")
    got = {r.report: (r.pages, r.retained, r.exhausted, r.error, r.next_offset, r.status) for r in reports.pagination_of(df, ["report"]).collect()}
    assert got == {"ok": (2, 7, True, None, None, "ok"), "open": (1, 5, False, None, 5, "partial"), "stuck": (2, 5, False, "no_progress", 5, "partial"), "bad": (0, 0, False, "invalid_response", 0, "error"),
        "later": (1, 5, False, "invalid_response", 5, "partial"), "done": (2, 7, True, None, None, "ok"), "none": (1, 0, True, None, None, "ok")}


def test_aggregation_labels(spark):
    facts = spark.sql("SELECT DATE '2024-01-01' AS date, 'p' AS page, 1 AS clicks, 2 AS impressions, 1.0D AS position, 7 AS search_id")
    assert [reports.search_report(facts, d, aggregation=a, labelled=True).first().aggregation for d, a in (([], "auto"), (["page"], "auto"), (["page"], "byProperty"))] == ["byProperty", "byPage", "byProperty"]
    with pytest.raises(ValueError):
        reports.search_report(facts, aggregation="byMoon")
