"""Pages to investigate (OP-1..11) and the investigation of exact pages (IV-1..10)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X
from . import reports as R
from .ranks import first_of_each

SAFE = X.SAFE


def usable() -> Column:
    """OP-1: safe non-negative integers, clicks within impressions, ctr and position in range."""
    whole = lambda c: (F.col(c) >= 0) & (F.col(c) <= SAFE) & (F.col(c) == F.floor(c))
    return F.coalesce(whole("impressions") & whole("clicks") & (F.col("clicks") <= F.col("impressions")) & F.col("ctr").between(0, 1) & (F.col("position") >= 0), F.lit(False))


def cohort(report: DataFrame, min_impressions: int = 20, max_clicks: int = 2) -> DataFrame:
    """OP-2: over all usable rows of the report."""
    return report.where(usable() & (F.col("impressions") >= min_impressions) & (F.col("clicks") <= max_clicks))


def ranked(rows: DataFrame, most: int = 10) -> DataFrame:
    """OP-3: the top rows with their rank and the number observed and omitted. Only `most` rows are ranked."""
    order = [F.desc("impressions"), F.asc("clicks"), F.asc("page")]
    top = rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    n = rows.agg(F.count("*").alias("observed"))
    return top.join(F.broadcast(n)).withColumn("omitted", F.greatest(F.col("observed") - most, F.lit(0)).cast("long"))  # one row


def cohort_summary(report: DataFrame | None, kept: DataFrame, spark) -> DataFrame:
    """OP-11: without a search report nothing is known, which is not zero."""
    if report is None:
        return spark.sql("SELECT CAST(NULL AS BIGINT) AS observed, CAST(NULL AS BIGINT) AS unusable, CAST(NULL AS BIGINT) AS cohort, 'partial' AS status")
    a, b = report.agg(F.count("*").alias("observed"), F.count_if(~usable()).alias("unusable")), kept.agg(F.count("*").alias("cohort"))
    return a.join(b).withColumn("status", F.when(F.col("unusable") > 0, "partial").otherwise("ok"))  # one row each


def organic_association(candidates: DataFrame, site: str, landings: DataFrame, events: DataFrame, cap: int = 10) -> DataFrame:
    """OP-4: candidates with their path, organic sessions by source and events, both capped with counts; null if none.

    Only the first `cap` rows of a landing reach the array; a landing such as / with very many sources is never whole in a
    task.
    """
    def few(table, value, *more):
        top = first_of_each(table, ["landing"], [F.desc(value), *map(F.asc, more)], cap, "o", "n")
        rows = F.transform(F.array_sort(F.collect_list(F.struct("o", *more, *[c for c in table.columns if c not in ("landing", *more)]))), lambda x: x.dropFields("o"))
        return top.groupBy(F.col("landing").alias("path")).agg(F.max("n").alias("n"), rows.alias("top"))

    a = few(landings.select("landing", "source", "sessions", "engaged_sessions"), "sessions", "source").withColumnsRenamed({"n": "landing_rows", "top": "landing_top"})
    b = few(events.select("landing", "source", "event_name", "event_count"), "event_count", "source", "event_name").withColumnsRenamed({"n": "event_rows", "top": "event_top"})
    return candidates.withColumn("path", X.configured_path(F.col("page"), F.lit(site))).join(a, "path", "left").join(b, "path", "left")


def latest(rows: DataFrame, key: list, time: str = "collected_at") -> DataFrame:
    """The last row of each key; of several at one time the first by its text."""
    return first_of_each(rows, key, [F.desc_nulls_last(time), F.to_json(F.struct(*rows.columns))], 1, "__place", "__total").drop("__place", "__total")


def technical(candidates: DataFrame, pages: DataFrame, inspections: DataFrame, search_property: str | None = None) -> DataFrame:
    """OP-5..8: page and inspection evidence by exact URL, ordered next checks, and what stays unknown.

    `pages` are whole reads that were ok (url, final_url, status, canonical, robots, x_robots_tag, collected_at),
    `inspections` (url, property, verdict, google_canonical, user_canonical, collected_at); of several the last counts,
    and with `search_property` only inspections of that property. A missing canonical or verdict is a difference. Columns
    of `organic_association`, where `candidates` has them, tell what stays unknown of analytics.
    """
    p = latest(pages.select("url", "final_url", "status", "canonical", "robots", "x_robots_tag", "collected_at"), ["url"])
    noindex = F.coalesce(X.mentions_noindex(F.concat_ws(",", "robots")), F.lit(False)) | F.coalesce(X.mentions_noindex(F.col("x_robots_tag")), F.lit(False))
    off = ~F.col("canonical").eqNullSafe(F.col("url")) | ~F.col("status").eqNullSafe(F.lit(200)) | ~F.col("final_url").eqNullSafe(F.col("url")) | noindex
    p = p.select("url", "status", "final_url", F.col("canonical").alias("page_canonical"), off.alias("off_route"), F.lit(True).alias("read"))
    i = inspections if search_property is None else inspections.where(F.col("property") == search_property)
    i = latest(i.select("url", "verdict", "google_canonical", "user_canonical", "collected_at"), ["url"]).select("url", "verdict", "google_canonical", "user_canonical", F.lit(True).alias("inspected"))
    rows = candidates.withColumnRenamed("page", "url").join(p, "url", "left").join(i, "url", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    elsewhere = F.coalesce(F.col("google_canonical") != F.col("url"), F.lit(False)) | F.coalesce(F.col("user_canonical") != F.col("url"), F.lit(False))
    checks = F.array_compact(F.array(F.when(has("inspected") & ~F.col("verdict").eqNullSafe(F.lit("PASS")), "reconcile_verdict"), F.when(has("inspected") & elsewhere, "check_reported_canonicals"), F.lit("inspect_page_queries"), F.when(has("off_route"), "check_route_policy"),
        F.when(~has("read"), "read_page"), F.when(~has("inspected"), "inspect_url"), F.lit("validate_events")))
    unknown = [F.lit("no_page_breakdown"), F.when(~has("read"), "page_not_read"), F.when(~has("inspected"), "not_inspected")]
    if "path" in rows.columns:
        unknown[1:1] = [F.when(F.isnull("path"), "no_path_association"), F.when(F.isnull("landing_rows"), "organic_landings_not_observed"), F.when(F.isnull("event_rows"), "organic_events_not_observed")]
    return rows.withColumn("next_checks", checks).withColumn("unknowns", F.array_compact(F.array(*unknown)))


def followups(rows: DataFrame) -> DataFrame:
    """OP-9: a request row for the page's queries always, for a page read and an inspection where missing and valid."""
    good = X.is_http_url(F.col("url"))
    asks = F.array_compact(F.array(F.lit("search_queries_of_page"), F.when(good & F.array_contains("next_checks", "read_page"), "page_read"), F.when(good & F.array_contains("next_checks", "inspect_url"), "url_inspection")))
    return rows.select("url", F.explode(asks).alias("request"))


def unassociated(landings: DataFrame, shown: DataFrame, site: str, cap: int = 10) -> DataFrame:
    """OP-10: organic landings of no displayed candidate, the top ones by sessions, with the number there are."""
    paths = shown.select(X.configured_path(F.col("page"), F.lit(site)).alias("landing"))
    rest = landings.join(paths, "landing", "left_anti")
    n = rest.agg(F.count("*").alias("unassociated"))
    return rest.orderBy(F.desc("sessions"), "landing", "source").limit(cap).join(F.broadcast(n))  # one row


def exact_breakdowns(facts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """IV-1: totals, query, device, country and date of each page, apart and not joint, in one pass.

    The facts are dealt by page before a row becomes five, so they are shuffled once and every table is summed where its
    page is.
    """
    rows = facts if pages is None else facts.join(pages.select("page"), "page", "left_semi")
    rows = rows.select("page", "query", "device", "country", "date", "clicks", "impressions", "position").repartition("page")
    kind = lambda k, value: F.struct(F.lit(k).alias("breakdown"), value.cast("string").alias("value"))
    tables = [kind("totals", F.lit(None)), *[kind(k, F.col(k)) for k in ("query", "device", "country", "date")]]
    rows = rows.select("page", F.inline(F.array(*tables)), "clicks", "impressions", "position")
    return rows.groupBy("page", "breakdown", "value").agg(*R.search_metrics())


def landing_evidence(urls: DataFrame, site: str, landings: DataFrame, events: DataFrame) -> DataFrame:
    """IV-2: traffic and events by source of exact landings; only where the URL is a configured path of the site."""
    paths = urls.select("url", X.configured_path(F.col("url"), F.lit(site)).alias("landing")).where("landing IS NOT NULL")
    a = paths.join(landings, "landing").select("url", "source", F.lit(None).cast("string").alias("event_name"), "sessions", "engaged_sessions", F.lit(None).cast("long").alias("event_count"))
    b = paths.join(events, "landing").select("url", "source", "event_name", F.lit(None).cast("long").alias("sessions"), F.lit(None).cast("long").alias("engaged_sessions"), "event_count")
    return a.unionByName(b)


def search_row_issues(rows: DataFrame, arity: int) -> DataFrame:
    """IV-3: how many rows of saved search evidence can be used."""
    fine = usable() & (F.size("keys") == arity)
    return rows.groupBy("snapshot_id", "observation").agg(F.count_if(fine).alias("usable"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("unusable"))


def analytics_row_issues(rows: DataFrame, path: Column, arity: int, metrics: int) -> DataFrame:
    """IV-4: digits-only metrics, arity, and the exact path as first key."""
    fine = (F.size("keys") == arity) & (F.size("raw") == metrics) & (F.get("keys", F.lit(0)) == path) & F.forall("raw", lambda v: v.rlike(r"^[0-9]+$"))
    return rows.groupBy("snapshot_id", "observation").agg(F.count_if(fine).alias("usable"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("unusable"))


def displayed(breakdowns: DataFrame, most: int = 28) -> DataFrame:
    """IV-5: the newest dates in ascending order; of other tables the first rows in the provider's order; omitted counts.

    The provider's order is `row_no` where the rows have one; else clicks, the order in which it lists rows.
    """
    newest = F.when(F.col("breakdown") == "date", F.col("value"))
    order = [F.desc(newest), *([F.asc("row_no")] if "row_no" in breakdowns.columns else [F.desc("clicks")]), F.asc("value")]
    kept = first_of_each(breakdowns, ["page", "breakdown"], order, most, "k", "n")
    place = F.when(F.col("breakdown") == "date", F.least(F.col("n"), F.lit(most)) + 1 - F.col("k")).otherwise(F.col("k"))
    return kept.withColumn("place", place.cast("long")).withColumn("omitted", F.greatest(F.col("n") - most, F.lit(0)).cast("long")).drop("k", "n")


def investigate(urls: DataFrame, site: str, facts: DataFrame, landings: DataFrame, events: DataFrame, pages: DataFrame, inspections: DataFrame, most: int = 28, failed: DataFrame | None = None, unusable: DataFrame | None = None) -> DataFrame:
    """IV-6..10: one brief per URL: findings, page and inspection facts, ordered next checks, unknowns.

    The breakdowns are aggregated once. `pages` and `inspections` are as in `technical`, with title and description;
    `failed` (url, source, status, code) are observations that were not ok, `unusable` (url, source, rows) rows that
    could not be read. `finding` is the statement on the totals, `findings` are all statements.
    """
    kinds = ("totals", "query", "device", "country", "date")
    tables = exact_breakdowns(facts, urls.select(F.col("url").alias("page")))
    only = F.col("breakdown") == "totals"
    sums = tables.groupBy(F.col("page").alias("url")).agg(*[F.max(F.when(only, F.col(c))).alias(c) for c in ("clicks", "impressions", "ctr", "position")], *[F.count_if(F.col("breakdown") == k).alias(f"n_{k}") for k in kinds])
    land = landing_evidence(urls, site, landings, events).groupBy("url").agg(F.sum("sessions").alias("retained_sessions"), F.count("event_count").alias("event_rows"))
    p = latest(pages.select("url", "final_url", "status", "title", "description", "canonical", "robots", "x_robots_tag", "collected_at"), ["url"]).withColumn("read", F.lit(True))
    i = latest(inspections.select("url", "verdict", "google_canonical", "user_canonical", "collected_at"), ["url"]).drop("collected_at").withColumn("inspected", F.lit(True))
    none = urls.sparkSession.createDataFrame([], "url string, said array<string>")
    listed = lambda df, text: none if df is None else df.select("url", text.alias("t")).groupBy("url").agg(F.array_sort(F.collect_list("t")).alias("said"))  # a few observations a URL
    bad = listed(failed, F.concat("source", F.lit(": "), "status", F.lit("; "), F.coalesce("code", F.lit("pagination incomplete")))).withColumnRenamed("said", "bad")
    odd = listed(unusable, F.concat("source", F.lit(": "), F.col("rows").cast("string"), F.lit(" unusable rows"))).withColumnRenamed("said", "odd") if unusable is not None else none.withColumnRenamed("said", "odd")
    rows = urls.select("url").distinct().withColumn("path", X.configured_path(F.col("url"), F.lit(site)))
    for part in (sums, land, p, i, bad, odd):
        rows = rows.join(part, "url", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    finding = F.when(F.col("n_totals") == 1, F.concat(F.col("clicks").cast("string"), F.lit(" clicks of "), F.col("impressions").cast("string"), F.lit(" impressions"))).otherwise("no usable totals row")
    stated = [F.when(F.col("n_totals") == 1, F.concat(finding, F.lit(", CTR "), text("ctr"), F.lit(", position "), text("position"))), *[F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{k}: "), F.col(f"n_{k}").cast("string"), F.lit(" rows, "), F.least(F.col(f"n_{k}"), F.lit(most)).cast("string"), F.lit(" shown"))) for k in kinds[1:]],
        F.when(has("read"), F.concat(F.lit("HTTP "), text("status"), F.lit("; title "), text("title"), F.lit("; description "), text("description"), F.lit("; canonical "), text("canonical"), F.lit("; final URL "), text("final_url"))),
        F.when(has("inspected"), F.concat(F.lit("stored verdict "), text("verdict")))]
    elsewhere = F.coalesce(F.col("google_canonical") != F.col("url"), F.lit(False)) | F.coalesce(F.col("user_canonical") != F.col("url"), F.lit(False))
    off = ~F.col("status").eqNullSafe(F.lit(200)) | ~F.col("final_url").eqNullSafe(F.col("url")) | ~F.col("canonical").eqNullSafe(F.col("url")) | F.coalesce(X.has_noindex(F.col("robots"), F.col("x_robots_tag")), F.lit(False))
    bare = (F.coalesce("title", F.lit("")) == "") | (F.coalesce("description", F.lit("")) == "")
    checks = F.array_compact(F.array(F.when(has("inspected") & (~F.col("verdict").eqNullSafe(F.lit("PASS")) | elsewhere), "reconcile_stored_state"), F.when(has("read") & off, "check_route_policy"), F.when(has("read") & bare, "missing_title_or_description"),
        F.lit("review_separate_breakdowns"), F.lit("compare_daily_rows"), F.lit("validate_events")))
    unknowns = F.concat(F.array_compact(F.array(F.when(F.isnull("path"), "analytics_skipped"), *[F.when(F.coalesce(f"n_{k}", F.lit(0)) == 0, f"search.{k}: no usable rows") for k in kinds], F.when(~has("read"), "page_not_read"), F.when(~has("inspected"), "not_inspected"))), F.coalesce("bad", F.array().cast("array<string>")), F.coalesce("odd", F.array().cast("array<string>")))
    rows = rows.withColumn("finding", finding).withColumn("findings", F.array_compact(F.array(*stated))).withColumn("next_checks", checks).withColumn("unknowns", unknowns)
    return rows.withColumnsRenamed({"n_query": "queries", "n_date": "dates"}).withColumn("status", F.when(F.size("unknowns") > 0, "partial").otherwise("ok"))
