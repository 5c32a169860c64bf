"""The given tables as search facts, analytics events, crawl archives, robots files, sitemaps and saved evidence."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as X
from . import pages as P
from . import reports as R

SITE = "https://example.com/"
HOST = "example.com"
KEY_EVENTS = ["purchase", "signup"]


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_facts(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    clicked = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return rows.select(F.col("l_shipdate").cast("date").alias("date"), F.concat(F.lit(f"{SITE}part/"), F.col("p_partkey").cast("string")).alias("page"), F.col("p_type").alias("query"), F.col("n_name").alias("country"),
        F.when(F.col("l_linestatus") == "O", "MOBILE").otherwise("DESKTOP").alias("device"), clicked.cast("int").alias("clicks"), F.col("l_quantity").cast("long").alias("impressions"), F.col("l_linenumber").cast("double").alias("position"), F.col("l_orderkey").alias("search_id"))


def raw_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("event_name"), "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.when(F.col("user_id") % 5 == 0, "localhost").otherwise(HOST).alias("host"))


def analytics_events(spark, sf_dir) -> DataFrame:
    """Sessions end after a day without events; channel, source and landing are those of the first event."""
    rows = raw_events(spark, sf_dir).withColumn("path", F.concat(F.lit("/part/"), F.col("k").cast("string")))
    rows = R.sessions(rows, "INTERVAL '1' DAY", ("k", "path"))
    k = F.col("first_k")
    return rows.select("event_id", "ts", "user_id", "event_name", "value", "host", "session", "session_events", F.col("first_path").alias("landing"), F.when(k < 40, R.ORGANIC).when(k < 70, "Direct").otherwise("Referral").alias("channel"),
        F.when(k % 3 == 0, "google").when(k % 3 == 1, "bing").otherwise("other").alias("source"), F.when(k < 40, "organic").otherwise("none").alias("medium"))


def fetches(spark, sf_dir) -> DataFrame:
    """One crawl run; a page whose number ends in 7 was not found."""
    none = F.lit(None).cast("string")
    missing = F.col("page_id") % 10 == 7
    return table(spark, sf_dir, "pages").select(F.lit("run").alias("run_id"), F.col("page_id").alias("seq"), "url", F.when(missing, 404).otherwise(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.when(F.col("page_id") % 10 == 3, "noindex").alias("x_robots_tag"), none.alias("location"), F.col("html").alias("body"))


def marked_up(spark, sf_dir) -> DataFrame:
    """The fetches with social cards, alternates, structured data and images of each page before its own html."""
    n = F.col("seq").cast("string")
    bodies = [F.lit('<meta property="OG:title" content="Page '), n, F.lit('"><meta property="og:image" content="/a.png"><meta property="og:image" content="/b.png"><meta name="twitter:card" content="summary">'),
        F.lit('<link rel="alternate" hreflang="de" href="/de/'), n, F.lit('"><link rel="nofollow Alternate" hreflang="x-default" href="http://[bad">'),
        F.lit('<script type="application/ld+json">{"@id":'), n, F.lit('}</script><script type="application/ld+json">{broken</script>'),
        F.lit('<noscript><img src="/k.png" alt="picture '), n, F.lit('"></noscript><img src="/i.png" alt=""><img src="/j.png">')]
    return fetches(spark, sf_dir).withColumn("body", F.concat(*bodies, F.coalesce("body", F.lit(""))))


def crawled(spark, sf_dir) -> DataFrame:
    return P.crawl_metadata(P.observed(fetches(spark, sf_dir), html_only=True))


def part_links(spark, sf_dir) -> DataFrame:
    """Edges between parts of consecutive lines of an order; from a first line that was returned it is a redirect."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    url = lambda c: F.concat(F.lit(f"{SITE}part/"), F.col(c).cast("string"))
    kind = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "redirect").otherwise("link")
    return line.join(after, ["l_orderkey", "l_linenumber"]).select(F.lit("run").alias("run_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), url("l_partkey").alias("from"), url("next").alias("to"), kind.alias("kind"), F.lit(None).cast("string").alias("rel"))


def robots_files(spark, sf_dir) -> DataFrame:
    """A robots file for every host of the pages; hosts that start with m. fail, those with www. are stricter."""
    origins = table(spark, sf_dir, "pages").select(X.origin(F.col("url")).alias("origin")).distinct()
    body = F.when(F.contains("origin", F.lit("//www.")), "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?page=\n\nUser-agent: GPTBot\nDisallow: /\nno colon here\nSitemap: /map.xml").otherwise("User-agent: *\nDisallow: /*.html$\nDisallow:\n# all else\nAllow: /de/ # too\nUser-agent:")
    return origins.select("origin", F.lit("/robots.txt").alias("path"), F.when(F.contains("origin", F.lit("//m.")), 503).otherwise(200).alias("status"), body.alias("body"))


def sitemap_docs(spark, sf_dir) -> DataFrame:
    """A sitemap for every origin, listing its pages, and an index for every origin above it."""
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><lastmod>"), day, F.lit("</lastmod></url>"))
    rows = table(spark, sf_dir, "pages").select(X.origin(F.col("url")).alias("origin"), "page_id", entry.alias("e")).groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("page_id", "e"))).alias("es"))
    body = F.concat(F.lit("<urlset>"), F.concat_ws("", F.transform("es", lambda x: x.e)), F.lit("</urlset>"))
    maps = rows.select(F.concat("origin", F.lit("/pages.xml")).alias("url"), F.lit(200).alias("status"), body.alias("body"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("origin"), F.lit("/pages.xml</loc></sitemap><sitemap><loc>"), F.col("origin"), F.lit("/gone.xml</loc></sitemap><sitemap><loc>https://elsewhere.example/x.xml</loc></sitemap></sitemapindex>"))
    return maps.unionByName(rows.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), index.alias("body")))


def broken_sitemaps(spark, sf_dir) -> DataFrame:
    """For every page a sound sitemap of it, one with foreign content that is no fault, and one for each fault."""
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    loc = F.concat(F.lit("<loc>"), escaped, F.lit("</loc>"))
    whole = lambda inside, head="<urlset>", tail="</urlset>": F.concat(F.lit(head + "<url>"), inside, F.lit("</url>" + tail))
    bodies = {"sound": whole(loc), "foreign": whole(F.concat(F.lit("<i:loc><i:b>x</i:b></i:loc>"), loc), '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i">'),
        "prefix": F.concat(F.lit('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url>'), F.lit("</s:url></s:urlset>")), "no_loc": whole(F.lit("<lastmod>2024-01-01</lastmod>")), "two_locs": whole(F.concat(loc, loc)),
        "unknown": F.concat(F.lit("<urlset><x>"), loc, F.lit("</x></urlset>")), "nested": whole(F.concat(F.lit("<loc><b>"), escaped, F.lit("</b></loc>"))), "doctype": whole(loc, "<!DOCTYPE urlset><urlset>"), "open": whole(loc, tail=""),
        "foreign_entry": F.concat(F.lit('<urlset xmlns:i="urn:i"><i:url>'), loc, F.lit("</i:url></urlset>"))}
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), b.alias("body")) for n, b in bodies.items()])).alias("made")
    return table(spark, sf_dir, "pages").select("url", made).select(F.concat("url", F.lit("#"), F.col("made.name")).alias("url"), F.lit(200).alias("status"), "made.body")


def snapshot_documents(spark, sf_dir) -> DataFrame:
    """(snapshot_id, body): two saved snapshots a host, each with reports on its half of January.

    The event report has two pages, the search report one, and totals failed. Few users make a report thresholded. In
    localhost's second half the currency is another one and the search data are not final.
    """
    e = raw_events(spark, sf_dir).withColumn("half", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "first").when(F.col("ts") < F.lit("2024-01-29").cast("timestamp_ntz"), "second")).where("half IS NOT NULL")
    rows = e.groupBy("host", "half", "event_name").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("k") < 10).alias("clicks"))
    value = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    row = F.struct(F.array(value("event_name")).alias("dimensionValues"), F.array(value("n"), value("users")).alias("metricValues"))
    found = F.struct(F.array("event_name").alias("keys"), "clicks", F.col("n").alias("impressions"), F.round(F.col("clicks") / F.col("n"), 4).alias("ctr"), F.lit(1.5).alias("position"))
    per = rows.groupBy("host", "half").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_list(found)).alias("found"), F.sum("n").alias("events"), F.min("users").alias("least"))
    start, end = F.when(F.col("half") == "first", "2024-01-01").otherwise("2024-01-15"), F.when(F.col("half") == "first", "2024-01-14").otherwise("2024-01-28")
    odd = (F.col("host") != HOST) & (F.col("half") == "second")
    head = lambda *names: F.array(*[F.struct(F.lit(n).alias("name"), F.lit("TYPE_INTEGER").alias("type")) for n in names])
    meta = F.struct(F.lit("UTC").alias("timeZone"), F.when(odd, "EUR").otherwise("USD").alias("currencyCode"), (F.col("least") < 30).alias("subjectToThresholding"))

    def page(first, most):
        request = F.struct(F.array(F.struct(F.lit("eventName").alias("name"))).alias("dimensions"), F.array(F.struct(F.lit("eventCount").alias("name")), F.struct(F.lit("totalUsers").alias("name"))).alias("metrics"), F.array(F.struct(start.alias("startDate"), end.alias("endDate"))).alias("dateRanges"), F.lit(first).alias("offset"), F.lit(most).alias("limit"))
        return F.struct(request.alias("request"), F.struct(head("eventName").alias("dimensionHeaders"), head("eventCount", "totalUsers").alias("metricHeaders"), F.size("rows").alias("rowCount"), F.slice("rows", first + 1, most).alias("rows"), meta.alias("metadata")).alias("response"))

    request = F.struct(start.alias("startDate"), end.alias("endDate"), F.array(F.lit("query")).alias("dimensions"), F.lit(0).alias("startRow"), F.lit(1000).alias("rowLimit"))
    response = F.struct(F.col("found").alias("rows"), F.lit("byProperty").alias("responseAggregationType"), F.struct(F.when(odd, end).alias("first_incomplete_date")).alias("metadata"))
    site = F.concat(F.lit("https://"), F.col("host"), F.lit("/"))

    def observed(provider, name, status, pages, n):
        done = F.struct(F.lit(True).alias("exhausted"), n.alias("rowsReturned")).alias("pagination")
        return F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit("report").alias("operation"), F.lit(name).alias("name"), site.alias("target"), F.lit(status).alias("status"), F.lit("2024-03-01T00:00:00Z").alias("startedAt"), F.lit("2024-03-01T00:01:00Z").alias("finishedAt"), pages.alias("pages"), done))

    obs = [observed("analytics", "analytics.eventName", "ok", F.array(page(0, 2), page(2, 1000)), F.size("rows")), observed("search", "search.query", "ok", F.array(F.struct(request.alias("request"), response.alias("response"))), F.size("found")), observed("search", "search.totals", "error", F.array(), F.lit(0))]
    doc = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.struct(site.alias("site")).alias("config"), site.alias("target"), F.lit("partial").alias("status"), start.alias("startDate"), end.alias("endDate"), F.array(end).alias("observedSearchDates")))
    body = F.concat(F.regexp_replace(doc, r"\}\z", ""), F.lit(',"observations":['), F.concat_ws(",", *obs), F.lit("]}"))
    return per.select(F.concat_ws("-", "host", "half").alias("snapshot_id"), body.alias("body"))


def crux_bodies(spark, sf_dir) -> DataFrame:
    """A field record for every event name: bins of values and the 75th percentile."""
    e = raw_events(spark, sf_dir).groupBy("event_name").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("low"), F.count_if(F.col("value") >= 200).alias("high"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").alias("p75"))
    d = lambda c: F.round(F.col(c) / F.col("n"), 6)
    bins = F.array(F.struct(F.lit("0").alias("start"), F.lit("50").alias("end"), d("low").alias("density")), F.struct(F.lit("200").alias("start"), F.lit(None).cast("string").alias("end"), d("high").alias("density")))
    day = lambda n: F.struct(F.lit(2024).alias("year"), F.lit(1).alias("month"), F.lit(n).alias("day"))
    record = F.struct(F.struct(F.concat(F.lit(SITE), F.col("event_name")).alias("url"), F.lit("PHONE").alias("formFactor")).alias("key"), F.struct(F.struct(bins.alias("histogram"), F.struct(F.col("p75").cast("string").alias("p75")).alias("percentiles")).alias("value")).alias("metrics"), F.struct(day(1).alias("firstDate"), day(30).alias("lastDate")).alias("collectionPeriod"))
    return e.select(F.to_json(F.struct(record.alias("record"))).alias("body"))
