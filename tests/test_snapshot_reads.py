"""The snapshots' reports come from one pass over the facts, and only configured pages are parsed."""

from sitefacts import pages, queries, ranks, reports

SF = "/root/testdata/sf0.001"
SUITE = [[], ["page"], ["query", "page"], ["date"]]
FACTS = "page string, query string, date string, clicks long, impressions long, position double"


def test_reports_of_one_pass(spark):
    rows = [("p", "q", "2024-01-02", 1, 2, 1.0), (None, "q", "2024-01-02", 0, 2, 2.0), ("p", None, None, 2, 3, 2.5), (None, None, "2024-03-02", 0, 0, 4.0), ("r", "q", "2024-01-03", None, None, None)]
    for facts, range_ in ((rows, ()), (rows, ("2024-01-01", "2024-01-31")), ([], ()), (rows[:1], ("2023-01-01", "2023-01-31"))):
        df = spark.createDataFrame(facts, FACTS).selectExpr("page", "query", "CAST(date AS date) AS date", "clicks", "impressions", "position")
        got = reports.search_reports(df, SUITE, *range_).collect()
        for i, dims in enumerate(SUITE):
            want = reports.search_report(df, dims, *range_).collect()
            fields = [*dims, "clicks", "impressions", "ctr", "position"]
            assert sorted(str([r[c] for c in fields]) for r in got if r.report == i) == sorted(str([r[c] for c in fields]) for r in want)
            assert all(r[c] is None for r in got if r.report == i for c in ("page", "query", "date") if c not in dims)
        assert all(r.report in range(4) for r in got)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_and_bodies_are_read_once(spark, monkeypatch):
    ranked, parsed = [], []
    monkeypatch.setattr("sitefacts.snapshot.ranked", lambda rows, *a: ranked.append(plan(rows)) or ranks.ranked(rows, *a))
    observed = pages.observed
    monkeypatch.setattr("sitefacts.pages.observed", lambda fetches, *a, **k: parsed.append(plan(fetches)) or observed(fetches, *a, **k))
    queries.assembled(spark, SF)
    assert sum("Relation" in line and "l_partkey" in line for line in ranked[0].splitlines()) == 1
    assert len(parsed) == 1 and "LeftSemi" in parsed[0]
