"""The breakdowns shuffle the facts once, before a row becomes five, and dear inputs are computed once."""

from sitefacts import opportunities, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_dealt_before_they_are_multiplied(spark):
    facts = spark.createDataFrame([("p", None, "d", "c", None, 1, 2, 1.0), (None, "q", "d", "c", None, 0, 2, 2.0), ("p", "q", "e", "c", None, 0, 3, 2.0)], "page string, query string, device string, country string, date date, clicks long, impressions long, position double")
    df = opportunities.exact_breakdowns(facts)
    assert df._jdf.queryExecution().sparkPlan().toString().count("Expand") == 0
    got = {(r.page, r.breakdown, r.value): (r.clicks, r.impressions, r.position) for r in df.collect()}
    assert len(got) == df.count() == 12
    assert got["p", "totals", None] == (1, 5, 1.6) and got["p", "query", None] == (1, 2, 1.0) and got[None, "query", "q"] == (0, 2, 2.0) and got["p", "date", None] == (1, 5, 1.6)


def test_display_reads_written_breakdowns(spark):
    assert "l_partkey" not in plan(queries.QUERIES["investigate_display"][0](spark, SF))


def test_pages_are_listed_once(spark):
    text = plan(queries.QUERIES["investigate_pages"][0](spark, SF))
    assert sum("Relation" in line and "l_partkey" in line for line in text.splitlines()) == 1
