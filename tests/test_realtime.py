"""Realtime panes against a plain recount, with late rows, restarts and epochs that run again."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitefacts import realtime, reports

ZERO = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, event_name string"


def recount(epochs, lateness=10, window=30, slide=1):
    """(windows, late, mark) of epochs, each a list of (ts, name)."""
    windows, late, mark = Counter(), Counter(), None
    for rows in epochs:
        for ts, name in rows:
            if ts is None or mark is not None and ts < mark - dt.timedelta(minutes=lateness):
                late[name] += 1
                continue
            pane = ZERO + dt.timedelta(minutes=slide) * ((ts - ZERO) // dt.timedelta(minutes=slide))
            for back in range(0, window, slide):
                windows[pane - dt.timedelta(minutes=back), name] += 1
        mark = max([t for t, _ in rows if t] + ([mark] if mark else []), default=mark)
    return windows, late, mark


def same(spark, path, epochs, **kw):
    windows, late, mark = recount(epochs, **kw)
    got = realtime.windows(spark, path, window=kw.get("window", 30), slide=kw.get("slide", 1)).collect()
    length = dt.timedelta(minutes=kw.get("window", 30))
    assert {(r.window_start, r.event_name): r.event_count for r in got} == dict(windows)
    assert all(r.window_end == r.window_start + length and r.closed == (r.window_end <= mark - dt.timedelta(minutes=10)) for r in got)
    assert {r.event_name: r.late for r in realtime.late_counts(spark, path).collect()} == dict(late)
    return got


def test_stream_of_files_equals_recount_over_a_restart(spark, tmp_path):
    pick = random.Random(5)
    epochs = [[(ZERO + dt.timedelta(minutes=20 * n, seconds=pick.randint(-1500, 1200), microseconds=pick.randint(0, 999999)), pick.choice(["view", "buy", None])) for _ in range(40)] for n in range(3)]
    epochs[2] += [(None, "view"), (ZERO - dt.timedelta(days=1), "buy")]
    arrive = lambda n: spark.createDataFrame(epochs[n], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    for done in range(3):
        arrive(done)
        s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        realtime.realtime_table(s, path, str(tmp_path / "c")).awaitTermination()  # each starts anew from the checkpoint
        got = same(spark, path, epochs[:done + 1])
    assert any(not r.closed for r in got) and any(r.closed for r in got)


@pytest.mark.parametrize("slide, window", [(1, 1), (5, 30)])
def test_an_epoch_run_again_counts_once(spark, tmp_path, slide, window):
    epochs = [[(ZERO + dt.timedelta(minutes=m), "a") for m in (0, 7, 59)], [(ZERO + dt.timedelta(minutes=m), "a") for m in (48, 49, 100)], []]
    for n, rows in enumerate(epochs):
        for _ in range(2):
            realtime.write_epoch(spark.createDataFrame(rows, SCHEMA), n, str(tmp_path), slide=slide)
    same(spark, str(tmp_path), epochs, slide=slide, window=window)


def test_first_epoch_without_rows_or_times(spark, tmp_path):
    for n, rows in enumerate([[], [(None, "a")], [(ZERO, "a"), (ZERO, "a")]]):
        realtime.write_epoch(spark.createDataFrame(rows, SCHEMA), n, str(tmp_path))
    same(spark, str(tmp_path), [[], [(None, "a")], [(ZERO, "a"), (ZERO, "a")]])
    with pytest.raises(ValueError):
        realtime.windows(spark, str(tmp_path), window=30, slide=7)


def test_ordered_report(spark):
    rows = [(ZERO - dt.timedelta(minutes=m), n) for m, n in ((0, "a"), (1, "b"), (2, "b"), (3, "c"), (61, "c"))]
    e = spark.createDataFrame(rows, SCHEMA)
    got = reports.realtime_report(e, str(ZERO), [("wide", 59, 0)], order=[F.desc("event_count"), "event_name"], limit=2)
    assert [(r.row_no, r.event_name, r.event_count) for r in got.orderBy("row_no").collect()] == [(1, "b", 2), (2, "a", 1)]
