"""Snapshot assembly (EV-7): observations from the outputs of operators, as documents that `evidence.split_snapshots` takes.

An observation is a row (snapshot_id, name, provider, operation, target, status, started_at, finished_at, pages: array of
JSON {request, response}, pagination, warnings, error). Report rows are dealt into pages by their place in the whole
order, so no report is sorted or gathered in one task; a page holds at most `size` rows, a report at most `most` pages,
and what lies beyond is told by `pagination`, never dropped in silence. A report without rows has one empty page.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence
from . import reports as R
from .ranks import ranked

OBSERVATION = ["snapshot_id", "name", "provider", "operation", "target", "status", "started_at", "finished_at", "pages", "pagination", "warnings", "error"]
PAGINATION = "struct<exhausted:boolean,nextOffset:bigint,rowsReturned:bigint>"
ERROR = "struct<code:string,message:string,httpStatus:int>"
# Caveats that hold for every snapshot, as codes.
ALWAYS = ["deployment_and_reference_unknown", "no_rows_may_be_no_data", "dates_in_different_time_zones", "landings_are_raw", "changes_are_descriptive"]


def dealt(asked: DataFrame, rows: DataFrame, order: list, size: int, most: int, provider: str) -> DataFrame:
    """`asked` with n (all rows of the report), page_no and page_rows (in order), a row for each page that a reader gets.

    Reports are known by (snapshot_id, name); `rows` has `row` beside the columns of `order`, whose last should tell rows
    apart. A search report ends with a page of fewer than `size` rows, an analytics report at its row count.
    """
    key = ["snapshot_id", "name"]
    placed = ranked(rows, [F.col("snapshot_id"), F.col("name"), *order], "__rank")
    first = placed.groupBy(*key).agg(F.min("__rank").alias("__first"), F.count("*").alias("n"))
    left = asked.join(first, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pages = F.floor(F.col("n") / size) + 1 if provider == "search" else F.greatest(F.ceil(F.col("n") / size), F.lit(1))
    wanted = left.drop("__first").withColumn("page_no", F.explode(F.sequence(F.lit(0), F.least(pages, F.lit(most)).cast("int") - 1)))
    at = F.col("__rank") - F.col("__first")
    held = placed.join(first.drop("n"), key).where(at < size * most).withColumn("page_no", F.floor(at / size).cast("int"))
    held = held.groupBy(*key, "page_no").agg(F.array_sort(F.collect_list(F.struct(F.col("__rank").alias("k"), "row"))).alias("page_rows"))
    none = F.array().cast(held.schema["page_rows"].dataType)
    return wanted.join(held, [*key, "page_no"], "left").withColumn("page_rows", F.transform(F.coalesce("page_rows", none), lambda x: x["row"]))


def gathered(pages: DataFrame, asked: list, size: int, most: int, warnings: Column) -> DataFrame:
    """A row a report of its pages (column `page`, JSON): at most `most` a group."""
    out = pages.groupBy("snapshot_id", "name", *asked, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda x: x.page).alias("pages"))
    done = (F.col("n") < size * most) if "aggregation" in asked else (F.col("n") <= size * most)
    kept = F.least(F.col("n"), F.lit(size * most))
    state = F.struct(done.alias("exhausted"), F.when(~done, kept).alias("nextOffset"), kept.alias("rowsReturned")).cast(PAGINATION)
    out = out.withColumn("exhausted", done).withColumn("pagination", state).withColumn("status", F.when(done, "ok").otherwise("partial")).withColumn("operation", F.lit("report"))
    return out.withColumn("warnings", warnings).withColumn("error", F.lit(None).cast(ERROR)).select(*OBSERVATION)


def period() -> list:
    return [F.col("start_date").cast("string").alias("startDate"), F.col("end_date").cast("string").alias("endDate")]


def search_observations(asked: DataFrame, rows: DataFrame, size: int = 25_000, most: int = 20) -> DataFrame:
    """Search reports. `asked`: snapshot_id, name, target, dims, aggregation, start_date, end_date, started_at,
    finished_at. `rows`: snapshot_id, name, keys, clicks, impressions, ctr, position; most clicks come first."""
    row = F.struct("keys", "clicks", "impressions", "ctr", "position")
    rows = rows.select("snapshot_id", "name", "keys", "clicks", row.alias("row"))
    pages = dealt(asked.withColumn("provider", F.lit("search")), rows, [F.desc("clicks"), F.col("keys")], size, most, "search")
    request = F.struct(*period(), F.col("dims").alias("dimensions"), F.lit("web").alias("type"), F.lit("final").alias("dataState"), (F.col("page_no") * size).alias("startRow"), F.lit(size).alias("rowLimit"))
    response = F.struct(F.col("page_rows").alias("rows"), F.col("aggregation").alias("responseAggregationType"))
    pages = pages.withColumn("page", F.to_json(F.struct(request.alias("request"), response.alias("response"))))
    no = F.lit(False)
    said = R.report_warnings(no, no, no, F.array_contains("dims", "query"), F.array_contains("dims", "page"), no, F.col("exhausted"))
    return gathered(pages, ["provider", "target", "dims", "aggregation", "start_date", "end_date", "started_at", "finished_at"], size, most, said)


def analytics_observations(asked: DataFrame, rows: DataFrame, size: int = 250_000, most: int = 20) -> DataFrame:
    """Analytics reports. `asked`: as above, without aggregation but with metrics, metric_types, time_zone, currency,
    thresholded, and filter (JSON or null). `rows`: snapshot_id, name, keys, raw (metric texts); ordered by keys."""
    named = lambda c: F.transform(c, lambda x: F.struct(x.alias("name")))
    value = lambda c: F.transform(c, lambda x: F.struct(x.alias("value")))
    row = F.struct(value(F.col("keys")).alias("dimensionValues"), value(F.col("raw")).alias("metricValues"))
    rows = rows.select("snapshot_id", "name", "keys", row.alias("row"))
    pages = dealt(asked.withColumn("provider", F.lit("analytics")), rows, [F.col("keys")], size, most, "analytics")
    request = F.struct(named(F.col("dims")).alias("dimensions"), named(F.col("metrics")).alias("metrics"), F.array(F.struct(*period())).alias("dateRanges"), F.try_parse_json("filter").alias("dimensionFilter"), (F.col("page_no") * size).alias("offset"), F.lit(size).alias("limit"))
    headers = F.transform(F.arrays_zip(F.col("metrics").alias("name"), F.col("metric_types").alias("type")), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    metadata = F.struct(F.col("time_zone").alias("timeZone"), F.col("currency").alias("currencyCode"), F.col("thresholded").alias("subjectToThresholding"))
    response = F.struct(named(F.col("dims")).alias("dimensionHeaders"), headers.alias("metricHeaders"), F.col("n").alias("rowCount"), F.col("page_rows").alias("rows"), metadata.alias("metadata"))
    pages = pages.withColumn("page", F.to_json(F.struct(request.alias("request"), response.alias("response"))))
    no = F.lit(False)
    said = R.report_warnings(F.col("thresholded"), no, no, no, no, no, F.col("exhausted"))
    return gathered(pages, ["provider", "target", "dims", "metrics", "metric_types", "time_zone", "currency", "thresholded", "filter", "start_date", "end_date", "started_at", "finished_at"], size, most, said)


def single(rows: DataFrame, provider: str, operation: str, name: Column, target: Column, request: Column, response: Column, status: Column, http_status: Column | None = None) -> DataFrame:
    """One observation a row, of one page: page facts, an inspection, a sitemap inventory. `rows` also has snapshot_id,
    started_at, finished_at. With status error there is no page, and the error's code follows from the HTTP status."""
    failed = status == "error"
    page = F.to_json(F.struct(request.alias("request"), response.alias("response")))
    http = F.lit(None).cast("int") if http_status is None else http_status.cast("int")
    error = F.struct(evidence.error_code(http).alias("code"), F.concat(F.lit("HTTP "), http.cast("string")).alias("message"), http.alias("httpStatus")).cast(ERROR)
    none = F.lit(None)
    return rows.select("snapshot_id", name.alias("name"), F.lit(provider).alias("provider"), F.lit(operation).alias("operation"), target.alias("target"), status.alias("status"), "started_at", "finished_at",
        F.when(failed, F.array().cast("array<string>")).otherwise(F.array(page)).alias("pages"), none.cast(PAGINATION).alias("pagination"), F.array().cast("array<string>").alias("warnings"), F.when(failed, error).alias("error"))


def observed_dates(observations: DataFrame) -> DataFrame:
    """Sorted dates with a row in the saved search report by date alone: (snapshot_id, dates)."""
    by_date = observations.where("provider = 'search' AND operation = 'report'").select("snapshot_id", F.explode("pages").alias("page")).withColumn("page", F.try_parse_json("page"))
    by_date = by_date.where(F.to_json(evidence.get("page", "$.request.dimensions", "variant")) == '["date"]')
    keys = by_date.select("snapshot_id", F.explode(evidence.get("page", "$.response.rows", "array<struct<keys:array<string>>>")).alias("r")).select("snapshot_id", F.get("r.keys", F.lit(0)).alias("date")).distinct()
    return keys.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("date")).alias("dates"))


def build_snapshot(sites: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EV-7: (documents, rejects): (snapshot_id, body) as `split_snapshots` takes them, and the snapshots that can't be
    one with the reason: without an observation, with more than 100, or with a name twice.

    `sites`: snapshot_id, site, pages, search_property, analytics_property, sitemap, success_events, caveats, start_date,
    end_date. Status and start roll up as in EV-1; what is not known (deployment, reference) is null, not left out.
    """
    counts = observations.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))
    met = sites.join(counts, "snapshot_id", "left")
    reason = F.when(F.isnull("n"), "no_observation").when(F.col("n") > 100, "observation_count").when(F.col("names") < F.col("n"), "repeated_name")
    met = met.withColumn("reason", reason)
    good = met.where(F.isnull("reason")).drop("n", "names", "reason")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    head = F.struct("provider", "operation", "name", "target", "status", stamp("started_at").alias("startedAt"), stamp("finished_at").alias("finishedAt"), "pagination", "warnings", "error")
    # pages are JSON already: they go in as text, so numbers keep their form
    text = F.concat(F.regexp_replace(F.to_json(head), r"\}\z", ""), F.lit(',"pages":['), F.concat_ws(",", "pages"), F.lit("]}"))
    summed = F.struct("provider", "operation", "name", "target", "status", F.col("error.code").alias("errorCode"))
    kept = observations.join(good.select("snapshot_id"), "snapshot_id", "left_semi")  # at most 100 a group from here on
    all_of = kept.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("name", text.alias("body"), F.to_json(summed).alias("line")))).alias("obs"))
    rolled = evidence.rollup(kept).select("snapshot_id", "status", "started_at", "finished_at")
    config = F.struct("site", "pages", F.col("search_property").alias("searchProperty"), F.col("analytics_property").alias("analyticsProperty"), "sitemap", F.col("success_events").alias("successEvents"), F.col("caveats").alias("measurementCaveats"))
    selected = lambda c: F.when(c, "selected").otherwise("not_selected")
    chosen = F.struct(selected(F.isnotnull("search_property")).alias("search"), selected(F.isnotnull("analytics_property")).alias("analytics"), selected(F.isnotnull("sitemap")).alias("sitemap"), selected(F.coalesce(F.size("pages") > 0, F.lit(False))).alias("web"))
    none = F.array().cast("array<string>")
    events = F.when(F.coalesce(F.size("success_events") > 0, F.lit(False)), "success_events_not_validated").otherwise("no_success_events")
    said = F.concat(F.array(*map(F.lit, ALWAYS)), F.coalesce("caveats", none), F.array(events))
    rows = good.join(rolled, "snapshot_id").join(all_of, "snapshot_id").join(observed_dates(kept), "snapshot_id", "left")
    doc = F.struct(F.lit(1).alias("schemaVersion"), F.lit("snapshot").alias("operation"), F.col("site").alias("target"), "status", stamp("started_at").alias("startedAt"), stamp("finished_at").alias("finishedAt"), F.col("start_date").cast("string").alias("startDate"),
        F.col("end_date").cast("string").alias("endDate"), F.coalesce("dates", none).alias("observedSearchDates"), config.alias("config"), chosen.alias("providers"), F.lit(None).cast("string").alias("deploymentVersion"), F.lit(None).cast("string").alias("referenceIdentity"), said.alias("warnings"))
    lines = F.concat_ws(",", F.transform("obs", lambda o: o.line))
    bodies = F.concat_ws(",", F.transform("obs", lambda o: o.body))
    body = F.concat(F.regexp_replace(F.to_json(doc, {"ignoreNullFields": "false"}), r"\}\z", ""), F.lit(',"summary":['), lines, F.lit('],"observations":['), bodies, F.lit("]}"))
    return rows.select("snapshot_id", body.alias("body")), met.where(F.isnotnull("reason")).select("snapshot_id", "reason")
