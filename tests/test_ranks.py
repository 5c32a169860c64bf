from pyspark.sql import functions as F

from sitefacts.ranks import ranked


def test_ranks_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, None if i % 50 == 0 else i % 13, "x") for i in range(1000)], "id int, v int, rank string")
    got = ranked(rows, [F.desc_nulls_last("v"), F.asc("id")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1001))
    assert [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    assert ranked(rows.limit(0), [F.asc("id")]).count() == 0


def test_ranks_need_no_single_task(spark):
    plan = ranked(spark.range(100), [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
