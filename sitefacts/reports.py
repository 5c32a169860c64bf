"""Search and analytics reports (RP-1..24) and the realtime report (RT-1..4) as DataFrame functions.

Search facts are (date, page, query, country, device, clicks, impressions, position, ...); events are (event_id, ts,
user_id, host, channel, source, medium, event_name, landing key ...). Nothing is filled with zero: a group without
rows has no row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X
from .ranks import ranked

ORGANIC = "Organic Search"
AGGREGATIONS = ("auto", "byPage", "byProperty", "byNewsShowcasePanel")


def filter_tree(tree) -> Column:
    """RP-9: {"and": [...]}, {"or": [...]}, {"not": tree} or {"field", "value", "case_sensitive"}."""
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(filter_tree, tree["and"]), F.lit(True))
    if "or" in tree:
        return reduce(lambda a, b: a | b, map(filter_tree, tree["or"]), F.lit(False))
    if "not" in tree:
        return ~filter_tree(tree["not"])
    column, value = F.col(tree["field"]), F.lit(tree["value"])
    return column == value if tree.get("case_sensitive", True) else F.lower(column) == F.lower(value)


def filter_groups(groups) -> Column:
    """RP-3: AND-ed (dimension, operator, expression) filters, one plain column that reaches the scan."""
    ops = {"equals": lambda c, v: c == v, "notEquals": lambda c, v: c != v, "contains": lambda c, v: F.contains(c, F.lit(v)), "notContains": lambda c, v: ~F.contains(c, F.lit(v)),
           "includingRegex": lambda c, v: c.rlike(v), "excludingRegex": lambda c, v: ~c.rlike(v)}
    return reduce(lambda a, b: a & b, (ops[op](F.col(d), v) for d, op, v in groups), F.lit(True))


def date_range(df: DataFrame, start: str, end: str, today: str | None = None) -> DataFrame:
    """RP-2: inclusive; `today` is the Pacific date that the end may not pass."""
    if start > end or today and end > today:
        raise ValueError(f"not a date range: {start} to {end}")
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def search_metrics() -> list:
    impressions = F.sum("impressions").cast("double")
    return [F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"), F.round(F.try_divide(F.sum("clicks").cast("double"), impressions), 6).alias("ctr"),
            F.round(F.try_divide(F.sum(F.col("position") * F.col("impressions")), impressions), 6).alias("position")]


def search_report(facts: DataFrame, dims=(), start=None, end=None, filters=(), search_type=None, data_state=None, aggregation="auto", labelled=False) -> DataFrame:
    """RP-1..5. With byProperty a search id counts once: its best position and at most one click and impression.

    `labelled` adds the label as a column; auto is byPage where pages are asked for, else byProperty in name.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {aggregation}")
    rows = date_range(facts, start, end) if start else facts
    for column, value in (("type", search_type), ("data_state", data_state)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(filter_groups(filters)) if filters else rows
    if aggregation == "byProperty":
        rows = rows.groupBy("search_id", *dims).agg(F.max("clicks").alias("clicks"), F.max("impressions").alias("impressions"), F.min("position").alias("position"))
    out = rows.groupBy(*dims).agg(*search_metrics())
    label = ("byPage" if "page" in dims else "byProperty") if aggregation == "auto" else aggregation
    return out.withColumn("aggregation", F.lit(label)) if labelled else out


def search_reports(facts: DataFrame, suite: list, start=None, end=None) -> DataFrame:
    """`search_report` by each list of dimensions of `suite`, all in one pass over the facts: `report` is the place in
    `suite`, and dimensions that a report does not have are null. Totals have a row without facts, too."""
    rows = date_range(facts, start, end) if start else facts
    dims = list(dict.fromkeys(d for ds in suite for d in ds))
    rows = rows.select(*dims, "clicks", "impressions", "position", F.lit(True).alias("__fact"))
    rows = rows.unionByName(rows.sparkSession.range(1).select(F.lit(False).alias("__fact")), allowMissingColumns=True)  # only for totals of no facts
    bits = [sum((d not in ds) << i for i, d in enumerate(reversed(dims))) for ds in suite]
    out = rows.groupingSets([[F.col(d) for d in ds] for ds in suite], *dims).agg(F.grouping_id().alias("__bits"), *search_metrics(), F.bool_or("__fact").alias("__fact"))
    report = F.coalesce(*[F.when(F.col("__bits") == b, i) for i, b in enumerate(bits)])
    return out.where(F.col("__fact") | (F.col("__bits") == (1 << len(dims)) - 1)).select(report.alias("report"), *dims, "clicks", "impressions", "ctr", "position")


def page_of(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """RP-6: rows offset + 1 to offset + limit in the order, by ranks that need no single task; `row_no` tells the place."""
    return ranked(df, order, "row_no").where((F.col("row_no") > offset) & (F.col("row_no") <= offset + limit))


def paginate(df: DataFrame, order: list, limit: int, max_pages: int = 20, start: int = 0) -> DataFrame:
    """RP-7: the retained rows with page_no (from 0) and row_no (from 1, after `start`)."""
    kept = page_of(df, order, start, limit * max_pages)
    return kept.withColumn("row_no", F.col("row_no") - start).withColumn("page_no", F.floor((F.col("row_no") - 1) / limit).cast("long"))


def pagination_state(df: DataFrame, limit: int, max_pages: int = 20, start: int = 0, provider: str = "search") -> DataFrame:
    """RP-7: (row_count, pages, retained, exhausted, next_offset, status) of reading `df` page by page.

    A search report is exhausted by a page with fewer rows than `limit`, so it may end with an empty page; an analytics
    report by having as many rows as its rowCount says.
    """
    n = df.agg(F.count("*").alias("row_count")).withColumn("left", F.greatest(F.col("row_count") - start, F.lit(0)))
    full = F.floor(F.col("left") / limit)
    pages = full + 1 if provider == "search" else F.greatest(F.ceil(F.col("left") / limit), F.lit(1))
    out = n.withColumn("pages", F.least(pages, F.lit(max_pages)).cast("long")).withColumn("retained", F.least(F.col("left"), F.lit(limit * max_pages)).cast("long"))
    done = (F.col("left") < limit * max_pages) if provider == "search" else (F.col("left") <= limit * max_pages)
    return out.select("row_count", "pages", "retained", done.alias("exhausted"), F.when(~done, F.col("retained") + start).alias("next_offset"), F.when(done, "ok").otherwise("partial").alias("status"))


def pagination_of(pages: DataFrame, key: list) -> DataFrame:
    """RP-7 over saved pages (key, provider, page_no, n_rows, row_limit, row_count): what reading them came to.

    Reading stops at the first page that exhausts the report, has no valid rowCount, or makes no progress: an error after
    a page is partial.
    """
    order = Window.partitionBy(*key).orderBy("page_no")  # at most 20 pages a report
    search = F.col("provider") == "search"
    rows = pages.withColumn("offset", F.sum("n_rows").over(order))
    odd = ~search & F.coalesce((F.col("row_count") < 0) | (F.col("row_count") > X.SAFE), F.lit(True))
    done = ~odd & F.when(search, F.col("n_rows") < F.col("row_limit")).otherwise(F.col("offset") >= F.col("row_count"))
    rows = rows.withColumn("error", F.when(odd, "invalid_response").when(~done & (F.col("n_rows") == 0), "no_progress")).withColumn("done", done)
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("done") | F.isnotnull("error")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where(~F.col("over"))
    kept = F.when(F.col("error") != "invalid_response", F.col("n_rows")).when(F.isnull("error"), F.col("n_rows")).otherwise(0)
    out = rows.groupBy(*key).agg(F.count_if(~F.col("error").eqNullSafe(F.lit("invalid_response"))).alias("pages"), F.sum(kept).alias("retained"), F.bool_or("done").alias("exhausted"), F.max("error").alias("error"))
    status = F.when(F.isnotnull("error"), F.when(F.col("pages") > 0, "partial").otherwise("error")).when(F.col("exhausted"), "ok").otherwise("partial")
    return out.withColumn("next_offset", F.when(~F.col("exhausted"), F.col("retained"))).withColumn("status", status)


def search_suite(facts: DataFrame, start, end) -> dict:
    """RP-14: totals, by page, by query, by date."""
    return {name: search_report(facts, dims, start, end) for name, dims in (("totals", []), ("page", ["page"]), ("query", ["query"]), ("date", ["date"]))}


def observed_dates(facts: DataFrame, end: str | None = None) -> DataFrame:
    """RP-21: dates with a search row, and whether the end date is among them."""
    out = facts.select("date").distinct()
    if end is None:
        return out
    return out.agg(F.array_sort(F.collect_set("date")).alias("dates")).withColumn("end_observed", F.array_contains("dates", F.lit(end).cast("date")))


def sessions(events: DataFrame, gap: str = "INTERVAL '30' MINUTES", firsts=("event_name",)) -> DataFrame:
    """Events with session, session_events and first_<c> of the session for each of `firsts`.

    A session ends after `gap` without events. A user's events are ordered hour by hour, and hours are stitched by a
    window over one row per user and hour, so a user with very many events fills no task.
    """
    rows = events.withColumn("hour", F.date_trunc("HOUR", "ts"))
    hours = rows.groupBy("user_id", "hour").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    by_user = Window.partitionBy("user_id").orderBy("hour")
    hours = hours.withColumn("opens", F.coalesce(F.col("low") - F.lag("high").over(by_user) > F.expr(gap), F.lit(True)).cast("int")).drop("low", "high")
    order = Window.partitionBy("user_id", "hour").orderBy("ts", "event_id")
    rows = rows.withColumn("new", F.coalesce(F.col("ts") - F.lag("ts").over(order) > F.expr(gap), F.lit(False)).cast("int"))
    inside = rows.groupBy("user_id", "hour").agg(F.sum("new").alias("inside"))
    hours = hours.join(inside, ["user_id", "hour"]).withColumn("first_no", F.sum(F.col("opens") + F.col("inside")).over(by_user) - F.col("inside")).select("user_id", "hour", "first_no")
    rows = rows.withColumn("in_hour", F.sum("new").over(order)).join(hours, ["user_id", "hour"]).withColumn("session", F.col("first_no") + F.col("in_hour")).drop("new", "in_hour", "first_no", "hour")
    facts = rows.groupBy("user_id", "session").agg(F.count("*").alias("session_events"), *[F.min_by(c, F.struct("ts", "event_id")).alias(f"first_{c}") for c in firsts])
    return rows.join(facts, ["user_id", "session"]).withColumn("session", F.concat_ws("-", F.col("user_id").cast("string"), F.col("session").cast("string")))


def session_counts() -> list:
    return [F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(F.col("session_events") > 1, F.col("session"))).alias("engaged_sessions")]


def hostname_census(events: DataFrame, view: str = "view") -> DataFrame:
    """RP-15: every host, without the production filter."""
    return events.groupBy("host").agg(F.count_distinct("session").alias("sessions"), F.count_if(F.col("event_name") == view).alias("views"))


def channel_report(events: DataFrame, host: str) -> DataFrame:
    """RP-16."""
    return events.where(F.col("host") == host).groupBy("channel", "source", "medium").agg(*session_counts())


def event_report(events: DataFrame, host: str, key_events: list) -> DataFrame:
    """RP-17: key events by the configured names."""
    return events.where(F.col("host") == host).groupBy("event_name").agg(F.count("*").alias("event_count"), F.count_if(F.col("event_name").isin(*key_events)).alias("key_events"))


def organic(events: DataFrame, host: str) -> DataFrame:
    return events.where((F.col("host") == host) & (F.col("channel") == ORGANIC))


def organic_landings(events: DataFrame, host: str) -> DataFrame:
    """RP-18."""
    return organic(events, host).groupBy("landing", "source").agg(*session_counts())


def organic_events(events: DataFrame, host: str) -> DataFrame:
    """RP-19."""
    return organic(events, host).groupBy("event_name").agg(F.count("*").alias("event_count"))


def organic_landing_events(events: DataFrame, host: str) -> DataFrame:
    """RP-20: events tied to their session's first page."""
    return organic(events, host).groupBy("landing", "source", "event_name").agg(F.count("*").alias("event_count"))


def analytics_report(events: DataFrame, dims: list, metrics: dict, ranges: list, dim_filter=None, metric_filter=None, order=(), aggregations=(), keep_empty=False, limit=None, offset=0) -> DataFrame:
    """RP-8..13: `ranges` are (name, start, end) with inclusive dates; an event counts in every range that holds it.

    The outer bounds of all ranges reach the scan. `aggregations` adds rows of kind total, minimum, maximum, count.
    """
    low, high = min(r[1] for r in ranges), max(r[2] for r in ranges)
    rows = events.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp_ntz")))
    rows = rows.where(filter_tree(dim_filter)) if dim_filter else rows
    day = F.col("ts").cast("date")
    held = F.array_compact(F.array(*[F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in ranges]))
    out = rows.withColumn("date_range", F.explode(held)).groupBy("date_range", *dims).agg(*[c.alias(n) for n, c in metrics.items()])
    out = out if keep_empty else out.where(F.greatest(*[F.col(m).cast("double") for m in metrics], F.lit(0.0)) > 0)
    out = out.where(metric_filter) if metric_filter is not None else out
    if aggregations:
        how = {"total": F.sum, "minimum": F.min, "maximum": F.max, "count": F.count}
        none = [F.lit(None).cast(out.schema[d].dataType).alias(d) for d in dims]
        extra = [out.groupBy("date_range").agg(*[how[a](m).cast(out.schema[m].dataType).alias(m) for m in metrics]).select(F.lit(a).alias("row_kind"), "date_range", *none, *metrics) for a in aggregations]
        out = reduce(DataFrame.unionByName, extra, out.select(F.lit("row").alias("row_kind"), "date_range", *dims, *metrics))
    if order and not limit:
        out = out.orderBy(*order)
    return page_of(out, order, offset, limit).drop("row_no") if limit and order else out.offset(offset).limit(limit) if limit else out


def freshness(reports: DataFrame, zones: DataFrame, days: int = 3) -> DataFrame:
    """RP-22: `reports` has end_date, time_zone, collected_at; `zones` has zone, the known names (some hundreds)."""
    known = reports.join(F.broadcast(zones.select(F.col("zone").alias("time_zone"), F.lit(True).alias("known"))), "time_zone", "left")
    zone = F.when(F.col("known"), F.col("time_zone")).otherwise(F.lit("UTC"))
    age = F.date_diff(F.to_date(F.from_utc_timestamp("collected_at", zone)), F.col("end_date"))
    return known.withColumn("freshness", F.when(F.isnull("known"), "cannot_assess").when(age < days, "not_settled").otherwise("settled")).drop("known")


def report_warnings(thresholded, other_row, sampled, anonymised, by_page, non_final, exhausted) -> Column:
    """RP-23: caveats of boolean columns, without repeats."""
    said = [(thresholded, "thresholded"), (other_row, "other_row"), (sampled, "sampled"), (anonymised, "anonymised_queries"), (by_page, "page_aggregation"), (non_final, "data_not_final"), (~exhausted, "not_exhausted")]
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in said])))


def observation_name(provider: Column, dims: Column, organic_only: Column) -> Column:
    """RP-24."""
    base = F.concat(provider, F.lit("."), F.when(F.size(dims) > 0, F.concat_ws("+", dims)).otherwise(F.lit("totals")))
    return F.concat(base, F.when(organic_only, F.lit(".organic")).otherwise(F.lit("")))


def realtime_report(events: DataFrame, now: str, ranges=(("default", 29, 0),), dims=("event_name",), value: str | None = "value", dim_filter=None, metric_filter=None, order=None, limit: int = 10_000) -> DataFrame:
    """RT-1, 3 over a table: events by minutes before `now`; an event counts in every range that holds it.

    With `order` the first `limit` rows in it come back with their place `row_no`; there is no offset to read on from.
    """
    for name, start, end in ranges:
        if not 0 <= end <= start <= 59:
            raise ValueError(f"not a minute range: {name}")
    far = max(r[1] for r in ranges)
    at = F.lit(now).cast("timestamp_ntz")
    rows = events.where((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"INTERVAL '{far + 1}' MINUTES")))
    rows = rows.where(filter_tree(dim_filter)) if dim_filter else rows
    ago = F.floor(F.timestamp_diff("SECOND", F.col("ts"), at) / 60)
    held = F.array_compact(F.array(*[F.when(ago.between(e, s), F.lit(n)) for n, s, e in ranges]))
    out = rows.withColumn("minute_range", F.explode(held)).groupBy("minute_range", *dims).agg(F.count("*").alias("event_count"))
    out = out.where(metric_filter) if metric_filter is not None else out
    return page_of(out, order, 0, limit) if order else out


def realtime_state(row_count: int, returned: int) -> dict:
    """RT-2: there is no offset to go on from."""
    status = "invalid" if row_count < returned else "partial" if row_count > returned else "ok"
    return {"status": status, "next_offset": None}


def realtime_stream(stream: DataFrame, dims=("event_name",), window="30 minutes", slide="1 minute", lateness="10 minutes") -> DataFrame:
    """RT-1, 4 over a stream whose `ts` is a TIMESTAMP: moving windows, rows later than `lateness` dropped by the watermark."""
    rows = stream.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide), *dims).agg(F.count("*").alias("event_count"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *dims, "event_count")


def late_rows(events: DataFrame, lateness: str = "INTERVAL '10' MINUTES") -> DataFrame:
    """RT-4: events that arrive (`arrived_at`) later than the accepted lateness, counted apart."""
    return events.where(F.col("arrived_at") - F.col("ts") > F.expr(lateness)).groupBy("event_name").agg(F.count("*").alias("late"))
