"""Saved evidence: sources (SRC-1, 2, 5..9, 11..15), roll-up (EV-1..7) and validation of reports (NR-1..16).

An observation is one row with `pages`, an array of VARIANT {request, response}. Nothing is inferred; a document that
breaks a rule is a row of the rejects, never a failed job.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X
from . import reports as R
from .workdir import saved

# The dimensions that an analytics comparison allows.
ANALYTICS_DIMENSIONS = ["hostName", "sessionDefaultChannelGroup", "sessionSourceMedium", "eventName", "landingPagePlusQueryString", "sessionSource"]


def get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def read_snapshots(spark, path: str):
    """SRC-1: (snapshots, observations, rejects) of JSON documents, one a file."""
    return split_snapshots(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("snapshot_id"), F.col("value").alias("body")))


def split_snapshots(documents: DataFrame):
    """The same of a table (snapshot_id, body). Version 1, 1 to 100 observations of different names, whole pages, the
    configured site as target, or the document is rejected with its reasons."""
    rows = documents.withColumn("v", F.try_parse_json("body"))
    obs = get("v", "$.observations", "array<variant>")
    rows = rows.withColumn("obs", obs).withColumn("site", get("v", "$.config.site"))
    names = F.transform("obs", lambda o: get(o, "$.name"))
    broken = F.exists("obs", lambda o: F.exists(F.coalesce(get(o, "$.pages", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.isnull(get(p, "$.request", "variant")) | F.isnull(get(p, "$.response", "variant"))))
    reasons = F.array_compact(F.array(F.when(F.isnull("v"), "not_json"), F.when(F.coalesce(get("v", "$.schemaVersion", "int"), F.lit(0)) != 1, "other_version"),
        F.when(~F.coalesce(F.size("obs").between(1, 100), F.lit(False)), "observation_count"), F.when(F.size(F.array_distinct(names)) < F.size("obs"), "repeated_name"),
        F.when(F.coalesce(get("v", "$.target"), F.lit("")) != F.coalesce("site", F.lit("?")), "other_site"), F.when(broken, "malformed_page")))
    rows = rows.withColumn("reasons", reasons)
    good = rows.where(F.size("reasons") == 0)
    stamp = lambda p: get("v", p, "timestamp")
    snapshots = good.select("snapshot_id", "site", get("v", "$.status").alias("status"), stamp("$.startedAt").alias("started_at"), stamp("$.finishedAt").alias("finished_at"), get("v", "$.startDate").cast("date").alias("start_date"),
        get("v", "$.endDate").cast("date").alias("end_date"), get("v", "$.observedSearchDates", "array<string>").alias("observed_search_dates"), get("v", "$.warnings", "array<string>").alias("warnings"), get("v", "$.config", "variant").alias("config"))
    o = good.select("snapshot_id", "site", F.posexplode("obs").alias("obs_no", "o"))
    observations = o.select("snapshot_id", "site", "obs_no", *[get("o", f"$.{c}").alias(c) for c in ("provider", "operation", "name", "target", "status")], get("o", "$.startedAt", "timestamp").alias("started_at"),
        get("o", "$.finishedAt", "timestamp").alias("finished_at"), get("o", "$.pages", "array<variant>").alias("pages"), get("o", "$.pagination", "struct<exhausted:boolean,nextOffset:bigint,rowsReturned:bigint>").alias("pagination"),
        get("o", "$.warnings", "array<string>").alias("warnings"), get("o", "$.error", "struct<code:string,message:string,httpStatus:int>").alias("error"))
    return snapshots, observations, rows.where(F.size("reasons") > 0).select("snapshot_id", "reasons")


def write_evidence(df: DataFrame, path: str, kind: str = "parquet"):
    """SRC-2: partitioned by site where there is one."""
    w = df.write.partitionBy("site") if "site" in df.columns else df.write
    return w.format(kind).save(path)


def pages_of(observations: DataFrame) -> DataFrame:
    rows = observations.drop("status", "started_at", "finished_at").select("*", F.posexplode("pages").alias("page_no", "page"))
    return rows.drop("pages")


def search_rows(observations: DataFrame) -> DataFrame:
    """SRC-5: a row for each row of the saved search pages."""
    rows = pages_of(observations.where("provider = 'search'"))
    rows = rows.select("snapshot_id", F.col("name").alias("observation"), "page_no", get("page", "$.response.responseAggregationType").alias("aggregation"), F.posexplode(get("page", "$.response.rows", "array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>")).alias("row_no", "r"))
    return rows.select("snapshot_id", "observation", "page_no", "row_no", "aggregation", "r.*")


def analytics_rows(observations: DataFrame) -> DataFrame:
    """SRC-6: keys and raw metric texts of the saved analytics pages, beside the headers."""
    rows = pages_of(observations.where("provider = 'analytics'"))
    names = lambda p: F.transform(get("page", p, "array<struct<name:string,type:string>>"), lambda x: x["name"])
    rows = rows.select("snapshot_id", F.col("name").alias("observation"), "page_no", names("$.response.dimensionHeaders").alias("dims"), names("$.response.metricHeaders").alias("metrics"),
        F.posexplode(get("page", "$.response.rows", "array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>")).alias("row_no", "r"))
    return rows.select("snapshot_id", "observation", "page_no", "row_no", "dims", "metrics", F.transform("r.dimensionValues", lambda x: x.value).alias("keys"), F.transform("r.metricValues", lambda x: x.value).alias("raw"))


def inspections(observations: DataFrame) -> DataFrame:
    """SRC-7."""
    fields = "struct<verdict:string,coverageState:string,indexingState:string,robotsTxtState:string,googleCanonical:string,userCanonical:string,lastCrawlTime:string>"
    rows = pages_of(observations.where("operation = 'inspect'")).select("snapshot_id", F.col("target").alias("property"), get("page", "$.request.inspectionUrl").alias("url"), get("page", "$.response.inspectionResult.indexStatusResult", fields).alias("r"))
    return rows.select("snapshot_id", "property", "url", F.col("r.verdict").alias("verdict"), F.col("r.coverageState").alias("coverage_state"), F.col("r.googleCanonical").alias("google_canonical"), F.col("r.userCanonical").alias("user_canonical"), F.col("r.lastCrawlTime").alias("last_crawl_time"))


def property_candidates(observations: DataFrame) -> DataFrame:
    """SRC-11: search properties and analytics properties side by side; none is chosen."""
    p = pages_of(observations)
    a = p.where("provider = 'search'").select("snapshot_id", F.explode(get("page", "$.response.siteEntry", "array<struct<siteUrl:string,permissionLevel:string>>")).alias("x")).select("snapshot_id", F.lit("search").alias("provider"), F.col("x.siteUrl").alias("property"), F.col("x.permissionLevel").alias("detail"))
    b = p.where("provider = 'analytics'").select("snapshot_id", F.explode(get("page", "$.response.accountSummaries", "array<struct<displayName:string,propertySummaries:array<struct<property:string,displayName:string>>>>")).alias("x")).select("snapshot_id", F.explode_outer("x.propertySummaries").alias("y"))
    return a.unionByName(b.select("snapshot_id", F.lit("analytics").alias("provider"), F.col("y.property").alias("property"), F.col("y.displayName").alias("detail")))


def site_config(rows: DataFrame) -> DataFrame:
    """SRC-12: defaults, and what is wrong with the configuration."""
    host = F.regexp_extract(F.lower("site"), r"^https?://([^/?#:]+)", 1)
    listed = F.array_distinct(F.coalesce("pages", F.array("site")))
    out = rows.withColumn("production_host", F.coalesce("production_host", host)).withColumn("pages", listed)
    return out.withColumn("issues", F.array_compact(F.array(F.when(F.size("pages") > 10, "too_many_pages"), F.when(F.exists("pages", lambda p: F.regexp_extract(F.lower(p), r"^https?://([^/?#:]+)", 1) != host), "page_of_other_host"))))


def key_events(observations: DataFrame) -> DataFrame:
    """SRC-13: configured key events of all metadata pages, and whether a further page was left."""
    rows = pages_of(observations.where("operation = 'key_events'")).select("snapshot_id", get("page", "$.response.nextPageToken").isNotNull().alias("more"), get("page", "$.response.keyEvents", "array<struct<eventName:string>>").alias("e"))
    return rows.groupBy("snapshot_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("e", lambda x: x.eventName))))).alias("key_events"), F.max("more").alias("incomplete"))


def submitted_sitemaps(observations: DataFrame) -> DataFrame:
    """SRC-14."""
    rows = pages_of(observations.where("operation = 'sitemaps'")).select("snapshot_id", F.explode(get("page", "$.response.sitemap", "array<struct<path:string,isPending:boolean,isSitemapsIndex:boolean>>")).alias("x"))
    return rows.select("snapshot_id", F.col("x.path").alias("path"), F.col("x.isPending").alias("pending"), F.col("x.isSitemapsIndex").alias("is_index"))


def property_metadata(observations: DataFrame) -> DataFrame:
    """SRC-15."""
    return pages_of(observations.where("operation = 'property'")).select("snapshot_id", get("page", "$.response.name").alias("property"), get("page", "$.response.timeZone").alias("time_zone"))


def error_code(status: Column) -> Column:
    """EV-4."""
    return F.when(status == 401, "unauthorized").when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status == 404, "not_found").otherwise("http_error")


def failure_status(n_pages: Column) -> Column:
    """EV-3: an error after a retained page is partial."""
    return F.when(n_pages > 0, "partial").otherwise("error")


def token_status(observations: DataFrame) -> DataFrame:
    """EV-5: a further page left in the first response makes an observation partial."""
    more = F.coalesce(get(F.get("pages", F.lit(0)), "$.response.nextPageToken").isNotNull(), F.lit(False))
    return observations.withColumn("warnings", F.when(more, F.array_append(F.coalesce("warnings", F.array().cast("array<string>")), F.lit("more_pages_left"))).otherwise(F.col("warnings"))).withColumn("status", F.when(more & (F.col("status") == "ok"), "partial").otherwise(F.col("status")))


def summary(observations: DataFrame) -> DataFrame:
    """EV-2, AS-15."""
    return observations.select("snapshot_id", "provider", "operation", "name", "target", "status", F.col("error.code").alias("error_code"), "warnings")


def rollup(observations: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """EV-1: all ok or all error, else partial; the earliest start."""
    out = observations.groupBy(key).agg(F.bool_and(F.col("status") == "ok").alias("ok"), F.bool_and(F.col("status") == "error").alias("bad"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.count("*").alias("observations"))
    return out.select(key, F.when(F.col("ok"), "ok").when(F.col("bad"), "error").otherwise("partial").alias("status"), "started_at", "finished_at", "observations")


def provider_selection(config: DataFrame) -> DataFrame:
    """EV-6."""
    return config.select("site", F.col("search_property").isNotNull().alias("search"), F.col("analytics_property").isNotNull().alias("analytics"), F.col("sitemap").isNotNull().alias("sitemap"))


def scope_rows(v: Column, dropped=(), defaults=None) -> Column:
    """Sorted (path, value) of a VARIANT object's fields, values as canonical JSON; `dropped` names fall out."""
    m = get(v, "$", "map<string,variant>")
    kept = F.filter(F.map_keys(m), lambda k: ~k.isin(*dropped)) if dropped else F.map_keys(m)
    rows = F.transform(kept, lambda k: F.struct(k.alias("path"), F.to_json(F.element_at(m, k)).alias("value")))
    missing = [F.when(~F.coalesce(F.array_contains(F.map_keys(m), F.lit(k)), F.lit(False)), F.struct(F.lit(k).alias("path"), F.lit(d).alias("value"))) for k, d in (defaults or {}).items()]
    return F.array_sort(F.concat(F.coalesce(rows, F.array().cast("array<struct<path:string,value:string>>")), F.array_compact(F.array(*missing)))) if missing else F.array_sort(rows)


def report_pages(observations: DataFrame) -> DataFrame:
    """Both providers' saved pages in one shape, which `normalize_reports` judges.

    `scope` is the request without its period, paging and quota; `semantics` says what the numbers mean: aggregation and
    time zone, or time zone, currency and metric types. Both are sorted (path, value) rows.
    """
    q, r = (lambda p, k="string": get("page", f"$.request.{p}", k)), (lambda p, k="string": get("page", f"$.response.{p}", k))
    rows = pages_of(observations.withColumnsRenamed({"status": "obs_status", "finished_at": "collected_at"}).where("operation = 'report' AND provider IN ('search', 'analytics')"))
    search = F.col("provider") == "search"
    name = lambda c: F.transform(c, lambda x: x["name"])
    arr = "array<struct<name:string,type:string>>"
    none = F.array().cast("array<string>")
    srows = F.transform(r("rows", "array<struct<keys:array<string>,clicks:string,impressions:string,ctr:string,position:string>>"), lambda x: F.struct(F.coalesce(x["keys"], none).alias("keys"), F.array(x.clicks, x.impressions, x.ctr, x.position).alias("raw")))
    arows = F.transform(r("rows", "array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>"), lambda x: F.struct(F.transform(F.coalesce(x.dimensionValues, F.array().cast("array<struct<value:string>>")), lambda d: d.value).alias("keys"), F.transform(x.metricValues, lambda m: m.value).alias("raw")))
    metrics = F.array(*map(F.lit, ("clicks", "impressions", "ctr", "position")))
    request, flag = get("page", "$.request", "variant"), lambda p: F.coalesce(r(f"metadata.{p}", "boolean"), F.lit(False))
    scope = F.when(search, scope_rows(request, ("startDate", "endDate", "startRow", "rowLimit"), {"dimensions": "[]", "type": '"web"', "dataState": '"final"'})).otherwise(scope_rows(request, ("dateRanges", "offset", "limit", "returnPropertyQuota"), {"dimensions": "[]"}))
    said = lambda **kv: F.array(*[F.struct(F.lit(k).alias("path"), v.alias("value")) for k, v in sorted(kv.items())])
    semantics = F.when(search, said(aggregation=r("responseAggregationType"), time_zone=F.lit(X.PACIFIC))).otherwise(said(time_zone=r("metadata.timeZone"), currency=r("metadata.currencyCode"), metrics=F.to_json(r("metricHeaders", "variant"))))
    unfinished = F.exists(F.coalesce(F.map_keys(r("metadata", "map<string,variant>")), none), lambda k: k.startswith("first_incomplete") | (k == "firstIncompleteDate"))
    schema = F.when(search, F.coalesce(r("responseAggregationType"), F.lit("")) == "").otherwise((F.coalesce(r("metadata.timeZone"), F.lit("")) == "") | ~F.coalesce(F.size(r("metricHeaders", arr)) > 0, F.lit(False)))
    return rows.select("snapshot_id", "site", F.col("name").alias("observation"), "provider", "operation", "target", "page_no", "pagination", "obs_status", "collected_at", F.isnotnull("error").alias("failed"),
        F.coalesce(F.when(search, q("dimensions", "array<string>")).otherwise(name(q("dimensions", arr))), none).alias("dims"), F.when(search, metrics).otherwise(name(q("metrics", arr))).alias("metrics"),
        F.when(search, q("startDate")).otherwise(q("dateRanges[0].startDate")).cast("date").alias("start_date"), F.when(search, q("endDate")).otherwise(q("dateRanges[0].endDate")).cast("date").alias("end_date"),
        F.when(search, 1).otherwise(F.size(q("dateRanges", "array<variant>"))).alias("n_ranges"), F.coalesce(F.when(search, q("startRow", "bigint")).otherwise(q("offset", "bigint")), F.lit(0)).alias("offset"),
        q("dataState").alias("data_state"), unfinished.alias("unfinished"), F.coalesce(name(r("dimensionHeaders", arr)), none).alias("header_dims"), name(r("metricHeaders", arr)).alias("header_metrics"),
        F.transform(r("metricHeaders", arr), lambda x: x["type"]).alias("metric_types"), r("metadata.currencyCode").alias("currency"), r("metadata.timeZone").alias("time_zone"), F.coalesce(F.to_json(r("rowCount", "variant")), F.lit("0")).alias("row_count"),
        flag("dataLossFromOtherRow").alias("other_row"), flag("subjectToThresholding").alias("thresholded"), F.coalesce(F.size(r("metadata.samplingMetadatas", "array<variant>")) > 0, F.lit(False)).alias("sampled"),
        scope.alias("scope"), semantics.alias("semantics"), r("responseAggregationType").alias("aggregation"), F.coalesce(schema, F.lit(True)).alias("odd_schema"),
        F.exists(F.coalesce(q("dimensions", "array<variant>"), F.array().cast("array<variant>")), lambda d: F.coalesce(get(d, "$.dimensionExpression", "variant").isNotNull(), F.lit(False))).alias("expressions"),
        F.coalesce(F.when(search, srows).otherwise(arows), F.array().cast("array<struct<keys:array<string>,raw:array<string>>>")).alias("rows"))


def report_violations(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """NR-1..14: one row per report and broken rule; no row for a report that can be used. `schema`: a response without
    an aggregation label, a time zone or metric headers."""
    key = ["snapshot_id", "observation"]
    order = Window.partitionBy(*key).orderBy("page_no")  # at most 20 pages a report
    rows = pages.join(snapshots.select("snapshot_id", F.col("start_date").alias("s0"), F.col("end_date").alias("s1")), "snapshot_id", "left")
    rows = rows.withColumn("due", F.coalesce(F.sum(F.size("rows")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a, s = F.col("provider") == "analytics", F.col("provider") == "search"
    n_count = F.when(F.col("row_count").rlike(r"^[0-9]+(\.0+)?\z"), F.substring_index("row_count", ".", 1).try_cast("bigint"))
    shape = F.exists("rows", lambda r: (F.size(r["keys"]) != F.size("dims")) | F.coalesce(F.size(r.raw) != F.size("metrics"), F.lit(True)))
    money = F.exists(F.coalesce("metric_types", F.array().cast("array<string>")), lambda t: F.coalesce(t == "TYPE_CURRENCY", F.lit(False)))
    single = {"schema": F.col("odd_schema"), "NR-1": s & ((F.coalesce("data_state", F.lit("final")) != "final") | F.col("unfinished")), "NR-2": F.col("offset") != F.col("due"), "NR-3": s & F.arrays_overlap("dims", F.array(F.lit("date"), F.lit("hour"))),
              "NR-4": a & (F.col("n_ranges") != 1), "NR-5": a & ((F.size(F.array_except("dims", F.array(*map(F.lit, ANALYTICS_DIMENSIONS)))) > 0) | F.col("expressions")), "NR-6": F.size(F.array_distinct("metrics")) < F.size("metrics"),
              "NR-7": a & ((F.col("header_dims") != F.col("dims")) | (F.col("header_metrics") != F.col("metrics")) | F.isnull("header_metrics")), "NR-8": a & money & (F.coalesce("currency", F.lit("")) == ""),
              "NR-9": (F.col("start_date") != F.col("s0")) | (F.col("end_date") != F.col("s1")) | F.isnull("start_date") | F.isnull("end_date") | F.isnull("s0") | F.isnull("s1"), "NR-11": shape}
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), rule) for rule, c in single.items()]))
    per_page = rows.select(*key, F.explode(broken).alias("rule"))
    fixed = F.struct("scope", "semantics", "start_date", "end_date")
    per = rows.groupBy(*key).agg(F.count_distinct(fixed).alias("kinds"), F.sum(F.size("rows")).alias("kept"), F.count_distinct("row_count").alias("counts"), F.count_if(n_count.isNull() | (n_count > X.SAFE)).alias("bad_count"),
        F.max(n_count).alias("row_count"), F.first("pagination").alias("pagination"), F.first("provider").alias("provider"))
    is_a, p = F.col("provider") == "analytics", F.col("pagination")
    done = F.coalesce(p.exhausted, F.lit(False))
    whole = {"NR-10": F.col("kinds") > 1, "NR-13": is_a & ((F.col("bad_count") > 0) | (F.col("counts") > 1) | (F.col("row_count") < F.col("kept")) | (done & (F.col("row_count") != F.col("kept")))),
             "NR-14": p.isNotNull() & (~p.rowsReturned.eqNullSafe(F.col("kept")) | ~p.nextOffset.eqNullSafe(F.when(~done, F.col("kept"))))}
    per_report = per.select(*key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), rule) for rule, c in whole.items()]))).alias("rule"))
    repeated = pages.select(*key, F.explode("rows").alias("r")).groupBy(*key, "r.keys").count().where("count > 1").select(*key, F.lit("NR-12").alias("rule"))
    return per_page.unionByName(per_report).unionByName(repeated).distinct()


def limitations(pages: DataFrame, snapshots: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """NR-15: what limits a usable report: (snapshot_id, observation, limitations).

    `zones` are the known time zones (column zone); without them an analytics report's freshness can't be assessed.
    """
    per = pages.groupBy("snapshot_id", "observation").agg(*[F.bool_or(c).alias(c) for c in ("thresholded", "other_row", "sampled", "failed")], F.bool_and(F.coalesce("pagination.exhausted", F.lit(False)) & (F.col("obs_status") == "ok")).alias("whole"),
        F.first("provider").alias("provider"), F.max("end_date").alias("end_date"), F.min("time_zone").alias("time_zone"), F.max("collected_at").alias("collected_at"))
    zones = pages.sparkSession.createDataFrame([], "zone string") if zones is None else zones
    met = R.freshness(per, zones).join(snapshots.select("snapshot_id", "observed_search_dates"), "snapshot_id", "left")
    analytics = F.col("provider") == "analytics"
    trailing = (F.col("provider") == "search") & ~F.coalesce(F.array_contains("observed_search_dates", F.col("end_date").cast("string")), F.lit(False))
    said = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("thresholded", "other_row", "sampled")], F.when(trailing, "end_date_not_observed"), F.when(analytics & (F.col("freshness") != "settled"), F.concat(F.lit("freshness_"), "freshness")), F.when(~F.coalesce("whole", F.lit(False)) | F.col("failed"), "not_exhausted")))
    return met.select("snapshot_id", "observation", said.alias("limitations"))


def report_facts(pages: DataFrame) -> DataFrame:
    """A row a report with what its pages share: period, scope and semantics, those of the first page."""
    first = lambda c: F.min_by(c, "page_no").alias(c)
    return pages.groupBy("snapshot_id", "observation").agg(*map(first, ("scope", "semantics", "start_date", "end_date", "dims", "metrics")))


def normalize_reports(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """NR-16: a row for each row and metric of the reports without a violation, in long form with the raw text.

    `is_number` tells that the source held a number, not a text. The rules read the pages several times, so these are
    parsed once and kept in the shared folder.
    """
    return normalized_pages(saved(report_pages(observations)), snapshots)


def normalized_pages(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The same of `report_pages`."""
    good = pages.join(report_violations(pages, snapshots).select("snapshot_id", "observation").distinct(), ["snapshot_id", "observation"], "left_anti")
    rows = good.select("snapshot_id", "site", "observation", "provider", "operation", "target", "scope", "semantics", "start_date", "end_date", "dims", "metrics", (F.col("provider") == "search").alias("is_number"), F.explode("rows").alias("r"))
    return rows.select(*rows.columns[:-2], "is_number", F.col("r.keys").alias("keys"), F.posexplode(F.arrays_zip(F.col("metrics").alias("metric"), F.col("r.raw").alias("raw"))).alias("metric_no", "m")).select("*", "m.metric", "m.raw").drop("m", "metrics")
