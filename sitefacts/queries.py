"""The registered queries, each with SQL of its own where SQL can express it."""

from pyspark.sql import functions as F

from . import adapters as A
from . import assess, compare, crawl, evidence, graph, realtime, robots, sitemaps, snapshot, speed
from . import functions as X
from . import opportunities as O
from . import pages as P
from . import reports as R
from .ranks import first_of_each
from .workdir import saved, shared_dir

START, END = "1995-01-01", "2001-12-31"
FACTS = """SELECT CAST(l_shipdate AS DATE) AS date, 'https://example.com/part/' || p_partkey AS page, p_type AS query, n_name AS country,
 CASE WHEN l_linestatus = 'O' THEN 'MOBILE' ELSE 'DESKTOP' END AS device, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END AS clicks,
 CAST(l_quantity AS BIGINT) AS impressions, CAST(l_linenumber AS DOUBLE) AS position, l_orderkey AS search_id
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""
METRICS = """CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(clicks)::DOUBLE / sum(impressions)::DOUBLE, 6) AS ctr,
 round(sum(position * impressions) / sum(impressions)::DOUBLE, 6) AS position"""
EVENTS = """SELECT event_id, ts, user_id, event_type AS event_name, value, CASE WHEN user_id % 5 = 0 THEN 'localhost' ELSE 'example.com' END AS host, user_id || '-' || no AS session,
 count(*) OVER s AS session_events, '/part/' || k0 AS landing, CASE WHEN k0 < 40 THEN 'Organic Search' WHEN k0 < 70 THEN 'Direct' ELSE 'Referral' END AS channel,
 CASE k0 % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' ELSE 'other' END AS source, CASE WHEN k0 < 40 THEN 'organic' ELSE 'none' END AS medium
 FROM (SELECT *, first_value(k) OVER (PARTITION BY user_id, no ORDER BY ts, event_id) AS k0 FROM (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM events) a) b) c
 WINDOW s AS (PARTITION BY user_id, no)"""
COUNTS = "count(DISTINCT session) AS sessions, count(DISTINCT CASE WHEN session_events > 1 THEN session END) AS engaged_sessions"
PROD, ORG = "host = 'example.com'", "host = 'example.com' AND channel = 'Organic Search'"
PERIOD = "SELECT user_id, event_type AS event_name, count(*) AS n FROM events WHERE ts >= '{}' AND ts < '{}' GROUP BY ALL"
BEFORE, AFTER = PERIOD.format("2024-01-01", "2024-01-15"), PERIOD.format("2024-01-15", "2024-01-29")
HOURS = "SELECT user_id, event_type AS event_name, hour(ts) AS hour, count(*) AS n FROM events WHERE ts >= '{}' AND ts < '{}' GROUP BY ALL"
SAVED = """SELECT CASE WHEN user_id % 5 = 0 THEN 'localhost' ELSE 'example.com' END AS host, CASE WHEN ts < '2024-01-15' THEN 'first' ELSE 'second' END AS half, event_type AS keys, count(*) AS n, count(DISTINCT user_id) AS u,
 count(*) FILTER (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 10) AS c FROM events WHERE ts < '2024-01-29' GROUP BY ALL"""
SAVED_VALUES = f"""SELECT host, half, keys, name, metric, raw FROM (SELECT host, half, keys, n, u, c FROM ({SAVED}) v) q,
 LATERAL (VALUES ('analytics.eventName', 'eventCount', CAST(n AS VARCHAR)), ('analytics.eventName', 'totalUsers', CAST(u AS VARCHAR)), ('search.query', 'clicks', CAST(c AS VARCHAR)), ('search.query', 'impressions', CAST(n AS VARCHAR)),
  ('search.query', 'ctr', CAST(round(c::DOUBLE / n, 4) AS VARCHAR)), ('search.query', 'position', '1.5')) m(name, metric, raw)"""
# What makes a pair of saved reports incomparable or limited, from the saved halves.
SAVED_PAIRS = f"""SELECT host, name, CASE WHEN name = 'search.totals' THEN 'unavailable' WHEN host = 'localhost' THEN 'incompatible' WHEN name = 'analytics.eventName' AND thresholded THEN 'limited' ELSE 'compared' END AS status
 FROM (SELECT host, bool_or(least < 30) AS thresholded FROM (SELECT host, half, min(u) AS least FROM ({SAVED}) v GROUP BY ALL) m GROUP BY host HAVING count(*) = 2) h, (VALUES ('analytics.eventName'), ('search.query'), ('search.totals')) o(name)"""
COHORT = f"SELECT page, {METRICS} FROM ({FACTS}) f GROUP BY page HAVING sum(impressions) >= 20 AND sum(clicks) <= 2"
TECHNICAL = f"""SELECT page AS url, concat_ws(',', CASE WHEN i.k IS NOT NULL AND i.k % 2 <> 0 THEN 'reconcile_verdict' END, CASE WHEN i.k % 3 = 0 THEN 'check_reported_canonicals' END, 'inspect_page_queries',
  CASE WHEN p.k % 9 = 0 OR p.k % 7 = 0 OR p.k % 5 = 0 OR p.k % 8 = 0 THEN 'check_route_policy' END, CASE WHEN p.k IS NULL THEN 'read_page' END, CASE WHEN i.k IS NULL THEN 'inspect_url' END, 'validate_events') AS next_checks,
  concat_ws(',', 'no_page_breakdown', CASE WHEN p.k IS NULL THEN 'page_not_read' END, CASE WHEN i.k IS NULL THEN 'not_inspected' END) AS unknowns
 FROM (SELECT page FROM ({COHORT}) c ORDER BY impressions DESC, clicks, page LIMIT 1000) c LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_type LIKE '%N%') p ON page = 'https://example.com/part/' || p.k
 LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_type LIKE '%E%') i ON page = 'https://example.com/part/' || i.k"""
BREAKDOWNS = f"""SELECT page, CASE WHEN grouping(query) = 0 THEN 'query' WHEN grouping(device) = 0 THEN 'device' WHEN grouping(country) = 0 THEN 'country' WHEN grouping(date) = 0 THEN 'date' ELSE 'totals' END AS breakdown,
  coalesce(query, device, country, CAST(date AS VARCHAR)) AS value, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM ({FACTS}) f GROUP BY GROUPING SETS ((page), (page, query), (page, device), (page, country), (page, date))"""
ANCHORS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) - 1 AS pos FROM pages"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
CRAWLED = "SELECT page_id, url, CASE WHEN page_id % 10 = 7 THEN 404 ELSE 200 END AS status, html FROM pages"
INVENTORY = f"""WITH o AS (SELECT {ORIGIN} AS o, CAST(sum(octet_length(encode('<url><loc>' || replace(url, '&', '&amp;') || '</loc><lastmod>' || strftime(DATE '2024-01-01' + CAST(page_id % 60 AS INT), '%Y-%m-%d') || '</lastmod></url>'))) + 17 AS BIGINT) AS size, count(DISTINCT url) AS n FROM pages GROUP BY 1)
 SELECT o || '/sitemap.xml' AS root, CASE position WHEN 4 THEN name ELSE o || name END AS url, position, CASE position WHEN 1 THEN CAST(octet_length(encode('<sitemapindex><sitemap><loc>' || o || '/pages.xml</loc></sitemap><sitemap><loc>' || o || '/gone.xml</loc></sitemap><sitemap><loc>https://elsewhere.example/x.xml</loc></sitemap></sitemapindex>')) AS BIGINT) WHEN 2 THEN size END AS bytes, error,
  CASE position WHEN 1 THEN 0::BIGINT WHEN 2 THEN n END AS urls, 0::BIGINT AS omitted, n AS all_urls
 FROM o, (VALUES (1, '/sitemap.xml', NULL), (2, '/pages.xml', NULL), (3, '/gone.xml', 'not_fetched'), (4, 'https://elsewhere.example/x.xml', 'outside_origin')) d(position, name, error)"""
EDGES = """SELECT DISTINCT a.l_partkey AS f, b.l_partkey AS t, CASE WHEN a.l_linenumber = 1 AND a.l_returnflag = 'R' THEN 0 ELSE 1 END AS cost, a.l_orderkey AS seq, a.l_linenumber AS pos
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


def facts(dims):
    return lambda spark, sf: R.search_report(A.search_facts(spark, sf), dims, START, END)


def facts_sql(dims):
    keys = ", ".join(dims)
    return f"SELECT {keys + ', ' if dims else ''}{METRICS} FROM ({FACTS}) f WHERE date BETWEEN '{START}' AND '{END}'" + (f" GROUP BY {keys}" if dims else "")


def events(f, *args):
    return lambda spark, sf: f(A.analytics_events(spark, sf), *args)


def period(spark, sf, start, end):
    e = A.raw_events(spark, sf).where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return e.groupBy("user_id", "event_name").agg(F.count("*").cast("string").alias("raw")).withColumn("metric", F.lit("events"))


def periods(spark, sf):
    return period(spark, sf, "2024-01-01", "2024-01-15"), period(spark, sf, "2024-01-15", "2024-01-29")


def changes(spark, sf):
    return compare.deltas(*periods(spark, sf), ["user_id", "event_name"])


def hours(spark, sf, start, end):
    """Events by hour of the day, so that either period has keys of its own."""
    e = A.raw_events(spark, sf).where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return e.groupBy("user_id", "event_name", F.hour("ts").alias("hour")).agg(F.count("*").cast("string").alias("raw"))


def only(first):
    def run(spark, sf):
        here, there = [hours(spark, sf, "2024-01-01", "2024-01-15"), hours(spark, sf, "2024-01-15", "2024-01-29")][::1 if first else -1]
        return compare.only_in(here, there, ["user_id", "event_name", "hour"])
    return run


def candidates(spark, sf, most=10):
    return O.ranked(O.cohort(facts(["page"])(spark, sf)), most)


def search_paged(spark, sf):
    return R.paginate(facts(["page"])(spark, sf), [F.desc("impressions"), "page"], 50, 20).select("page", "impressions", "row_no", "page_no")


def by_property(spark, sf):
    return R.search_report(A.search_facts(spark, sf), ["country"], START, END, [("device", "equals", "MOBILE")], aggregation="byProperty")


def analytics_multi_range(spark, sf):
    e = A.raw_events(spark, sf)
    return R.analytics_report(e, ["event_name"], {"event_count": F.count("*"), "users": F.count_distinct("user_id")}, [("first", "2024-01-01", "2024-01-14"), ("second", "2024-01-10", "2024-01-28")])


def analytics_summary_rows(spark, sf):
    return R.analytics_report(A.raw_events(spark, sf), ["event_name"], {"event_count": F.count("*")}, [("all", "2024-01-01", "2024-01-31")], {"not": {"field": "host", "value": "LOCALHOST", "case_sensitive": False}}, aggregations=["total", "minimum", "maximum", "count"])


def analytics_having_order(spark, sf):
    return R.analytics_report(A.raw_events(spark, sf), ["user_id"], {"event_count": F.count("*")}, [("all", "2024-01-01", "2024-01-31")], metric_filter=F.col("event_count") >= 5, order=[F.desc("event_count"), "user_id"], limit=20)


def realtime_two_ranges(spark, sf):
    now = A.raw_events(spark, sf).agg(F.max("ts").cast("string")).first()[0]
    return R.realtime_report(A.raw_events(spark, sf), now, [("near", 29, 0), ("wide", 59, 0)])


def realtime_sliding(spark, sf):
    """The events as a stream, read to their end: every window with an event, those still open included."""
    path = f"{sf}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "event[s].parquet"))
    out = shared_dir(spark)
    realtime.realtime_table(s.select("ts", F.col("event_type").alias("event_name")), out, shared_dir(spark)).awaitTermination()
    return realtime.windows(spark, out)


def realtime_ordered(spark, sf):
    now = A.raw_events(spark, sf).agg(F.max("ts").cast("string")).first()[0]
    return R.realtime_report(A.raw_events(spark, sf), now, [("wide", 59, 0)], ["event_name", "user_id"], order=[F.desc("event_count"), "event_name", "user_id"], limit=25)


def freshness_check(spark, sf):
    e = A.raw_events(spark, sf).groupBy(F.col("ts").cast("date").alias("end_date"), (F.col("user_id") % 4).alias("z")).agg((F.max("ts") + F.expr("INTERVAL '3' DAYS")).cast("timestamp").alias("collected_at"))
    zone = F.element_at(F.array(*map(F.lit, ("UTC", "America/Los_Angeles", "Asia/Tokyo", "Nowhere/Land"))), (F.col("z") + 1).cast("int"))
    known = spark.createDataFrame([("UTC",), ("America/Los_Angeles",), ("Asia/Tokyo",)], "zone string")
    return R.freshness(e.withColumn("time_zone", zone).drop("z"), known)


def page_metadata(spark, sf):
    return P.page_metadata(P.observed(A.fetches(spark, sf))).select(F.col("seq").alias("page_id"), "url", "title", "description", "canonical", "bytes", "warnings")


def page_identity(spark, sf):
    p = A.table(spark, sf, "pages")
    return p.select("page_id", "url", X.sha256(F.col("html")).alias("sha256"), X.byte_len(F.col("html")).alias("bytes"))


def page_anchors(spark, sf):
    return P.anchors(P.observed(A.fetches(spark, sf))).select(F.col("seq").alias("page_id"), "pos", "href", "text")


def page_social(spark, sf):
    seen = saved(P.observed(A.marked_up(spark, sf)))
    return every([P.social(seen, k) for k in ("og", "twitter")]).select(F.col("seq").alias("page_id"), "property", "content")


def page_hreflang(spark, sf):
    rows = P.hreflang(P.page_metadata(P.observed(A.marked_up(spark, sf))))
    return rows.select(F.col("seq").alias("page_id"), "lang", "raw", "href", "warning")


def page_jsonld(spark, sf):
    return P.structured_data(P.observed(A.marked_up(spark, sf))).select(F.col("seq").alias("page_id"), "pos", "raw", "valid_json")


def page_images(spark, sf):
    return P.images(P.observed(A.marked_up(spark, sf))).select(F.col("seq").alias("page_id"), "pos", "src", "alt_present", "alt", "in_noscript", "omitted")


def robots_of(f):
    return lambda spark, sf: f(robots.lines(A.robots_files(spark, sf)))


AGENTS = ["Googlebot", "gptbot"]


def verdicts(spark, sf):
    urls = A.table(spark, sf, "pages").select(X.origin(F.col("url")).alias("origin"), X.path_query(F.col("url")).alias("path"))
    return robots.robots_verdicts(urls, robots.lines(A.robots_files(spark, sf)), AGENTS)


def registry(spark):
    body = '{"Googlebot": {"operator": "[Big](https://x)", "respect": "Yes, it does", "function": "search"}, "gptbot": {"operator": "", "respect": "no idea"}}'
    return robots.crawler_registry(spark.createDataFrame([(body,)], "body string"))


def ai_crawler_audit(spark, sf):
    return robots.ai_crawler_audit(robots.lines(A.robots_files(spark, sf)), registry(spark), AGENTS)


def robots_report(spark, sf):
    out = robots.robots_report(A.robots_files(spark, sf), registry(spark), AGENTS)
    return out.withColumn("sitemaps", F.concat_ws(",", "sitemaps"))


def inventory(spark, sf):
    docs = A.sitemap_docs(spark, sf)
    roots = docs.where("url LIKE '%/sitemap.xml'").select(F.col("url").alias("root"))
    return sitemaps.sitemap_inventory(roots, docs)


def site_graph(spark, sf):
    c = saved(A.crawled(spark, sf))  # every page is parsed once
    return c, saved(graph.edges(c))


def graph_findings(spark, sf):
    c, links = site_graph(spark, sf)
    seeds = c.where("seq = 0").select("run_id", "url")
    listed = c.where("seq % 2 = 0").select("run_id", "url")
    chains = graph.redirect_chains(links, c, paths=True)
    return graph.findings(c, links, chains, listed, seeds).select("url", "kind", "evidence")


def first_part(spark):
    return spark.range(1).select(F.lit("run").alias("run_id"), F.lit(f"{A.SITE}part/1").alias("url"))


def graph_depths(spark, sf):
    return graph.depths(A.part_links(spark, sf), first_part(spark)).select("url", "depth")


def redirect_chains(spark, sf):
    links = A.part_links(spark, sf)
    seen = A.table(spark, sf, "part").select(F.lit("run").alias("run_id"), F.concat(F.lit(f"{A.SITE}part/"), F.col("p_partkey").cast("string")).alias("url"))
    return graph.redirect_chains(links, seen).select("start", "final", "termination", "hops")


def graph_frontier(spark, sf):
    found = A.part_links(spark, sf).select("run_id", F.lit(A.SITE).alias("site"), F.col("to").alias("url"), F.col("pos").cast("int").alias("depth"), F.when(F.col("kind") == "redirect", 6).otherwise(0).alias("hop"), F.lit(False).alias("seed"), F.lit(False).alias("robots_error"), F.lit(False).alias("rate_limited"), (F.col("seq") % 5 > 0).alias("allowed"))
    return crawl.frontier(found).select("url", "reason", "depth", "hop")


def crawl_replay(spark, sf):
    """The graph of parts, whose robots file forbids every part ending in 7, with a sitemap of every fiftieth part."""
    links, at = A.part_links(spark, sf), F.concat(F.lit(f"{A.SITE}part/"), F.col("p_partkey").cast("string"))
    part = A.table(spark, sf, "part").select(F.lit("run").alias("run_id"), at.alias("url"), F.lit(200).alias("status"), F.array().cast("array<string>").alias("robots"), F.lit(None).cast("string").alias("x_robots_tag"), "p_partkey")
    seeds = first_part(spark).withColumn("site", F.lit(A.SITE))
    files = spark.range(1).select(F.lit(A.SITE.rstrip("/")).alias("origin"), F.lit("/robots.txt").alias("path"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /part/*7$").alias("body"))
    denied, blocked = crawl.robots_policy(seeds.select("run_id", "site"), part.select("run_id", "url"), files, "Sitefacts")
    listed = part.where("p_partkey % 50 = 0").select("run_id", "url", F.col("p_partkey").alias("pos"))
    return crawl.replay(part, links, seeds, listed, denied, blocked)[0]


def crawled_sites(spark, sf):
    """Every host of the pages crawled from its first page, with its robots file and its sitemaps."""
    c = A.crawled(spark, sf).withColumn("url", F.regexp_replace("url", "#.*$", "")).withColumn("run_id", X.origin(F.col("url")))
    c = saved(c)
    links = saved(graph.edges(c))
    seeds = c.groupBy("run_id").agg(F.min_by("url", "seq").alias("url")).withColumn("site", F.concat("run_id", F.lit("/")))
    docs, files = A.sitemap_docs(spark, sf), A.robots_files(spark, sf)
    listed, visits = sitemaps.crawl_sitemaps(docs.where("url LIKE '%/sitemap.xml'").select(F.col("url").alias("root")), docs)
    run = F.regexp_replace("root", r"/sitemap\.xml$", "").alias("run_id")
    listed = saved(listed.select(run, "url", "pos"))
    urls = links.select("run_id", F.col("to").alias("url")).unionByName(seeds.select("run_id", "url")).unionByName(listed.select("run_id", "url")).where("url IS NOT NULL").distinct()
    denied, blocked = crawl.robots_policy(seeds.select("run_id", "site"), urls, files, "Sitefacts")
    wrong = F.size(F.filter("steps", lambda s: s.error.isNotNull())) + F.col("omitted_documents") + F.col("omitted_urls")
    faults = visits.select(run, wrong.cast("long").alias("faults")).unionByName(robots.robots_issues(robots.lines(files)).groupBy(F.col("origin").alias("run_id")).agg(F.count("*").alias("faults")))
    return (*crawl.replay(c, links, seeds, listed, denied, blocked), c, faults)


def crawl_sites(spark, sf):
    return crawled_sites(spark, sf)[0]


def crawl_coverage(spark, sf):
    return crawl.coverage(*crawled_sites(spark, sf))


def page_table(spark, sf):
    c, links = site_graph(spark, sf)
    out = graph.page_table(c, graph.depths(links, c.where("seq = 0").select("run_id", "url")), verdicts(spark, sf).where("agent = 'Googlebot'"))
    return out.select(F.col("seq").alias("page_id"), "url", "status", "depth", "allowed")


def inspection_sample(spark, sf):
    c = A.crawled(spark, sf)
    stored = c.where("seq % 2 = 0").select("url", F.lit("PASS").alias("verdict"))
    return graph.inspection_sample(c, stored).select(F.col("seq").alias("page_id"), "url", F.col("k").cast("long").alias("place"), "verdict")


def snapshots(spark, sf):
    return evidence.split_snapshots(A.snapshot_documents(spark, sf))


def assembled(spark, sf):
    """Snapshots from operators' outputs: the search suite, both hosts' January of events, and each origin of the pages
    with its sitemap and up to ten configured pages."""
    at = [F.lit("2024-03-01T00:00:00Z").cast("timestamp").alias("started_at"), F.lit("2024-03-01T00:01:00Z").cast("timestamp").alias("finished_at")]
    day = lambda d: F.lit(d).cast("date")
    none = F.array().cast("array<string>")
    january = [day("2024-01-01").alias("start_date"), day("2024-01-31").alias("end_date")]

    found, asked = A.search_facts(spark, sf), spark.range(1).select(F.lit("example.com-search").alias("snapshot_id"), F.lit(A.SITE).alias("target"), day(START).alias("start_date"), day(END).alias("end_date"), *at)
    suite = [[], ["page"], ["query"], ["date"]]
    name = lambda provider, dims: F.concat(F.lit(f"{provider}."), F.lit("+".join(dims) or "totals"))
    texts = lambda dims: F.array(*[F.col(d).cast("string") for d in dims]).cast("array<string>")
    rows = R.search_reports(found, suite, START, END)
    keyed = lambda to: F.coalesce(*[F.when(F.col("report") == i, to(d)) for i, d in enumerate(suite)])
    rows = rows.select(F.lit("example.com-search").alias("snapshot_id"), keyed(lambda d: name("search", d)).alias("name"), keyed(texts).alias("keys"), "clicks", "impressions", "ctr", "position")
    wanted = [asked.select("*", name("search", d).alias("name"), F.array(*map(F.lit, d)).cast("array<string>").alias("dims"), F.lit("byPage" if "page" in d else "byProperty").alias("aggregation")) for d in suite]
    search = snapshot.search_observations(every(wanted), rows, size=1000)

    e = A.raw_events(spark, sf).where(F.col("ts").between("2024-01-01", "2024-01-31T23:59:59.999999")).withColumn("snapshot_id", F.concat("host", F.lit("-january")))
    hosts = e.groupBy("snapshot_id", "host").agg(F.lit(False).alias("thresholded"))
    types = F.array(F.lit("TYPE_INTEGER"), F.lit("TYPE_INTEGER"))
    wanted = [hosts.select("snapshot_id", name("analytics", [n for n, _ in d]).alias("name"), F.lit("properties/1").alias("target"), F.array(*[F.lit(n) for n, _ in d]).cast("array<string>").alias("dims"), F.array(F.lit("eventCount"), F.lit("totalUsers")).alias("metrics"), types.alias("metric_types"),
        F.lit("UTC").alias("time_zone"), F.lit("USD").alias("currency"), "thresholded", F.lit(None).cast("string").alias("filter"), *january, *at) for d in ([], [("eventName", "event_name")])]
    rows = [e.groupBy("snapshot_id", *[c for _, c in d]).agg(F.array(F.count("*").cast("string"), F.count_distinct("user_id").cast("string")).alias("raw")).select("snapshot_id", name("analytics", [n for n, _ in d]).alias("name"), texts([c for _, c in d]).alias("keys"), "raw") for d in ([], [("eventName", "event_name")])]
    analytics = snapshot.analytics_observations(every(wanted), every(rows), size=2)

    urls = A.table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("seq")).withColumn("origin", X.origin(F.col("url")))
    listed = saved(first_of_each(urls, ["origin"], ["seq"], 10).select("origin", "url", "seq"))
    bodies = A.fetches(spark, sf).join(listed.select("seq"), "seq", "left_semi")  # no other page is parsed
    read = P.crawl_metadata(P.observed(bodies, html_only=True)).drop("url").join(listed, "seq").select(F.col("origin").alias("snapshot_id"), *at, "url", "status", "title", "description", "canonical", "sha256")
    page = snapshot.single(read, "web", "page", F.concat(F.lit("page:"), "url"), F.col("url"), F.struct("url"), F.struct("status", "title", "description", "canonical", "sha256"), F.when(F.col("status") >= 400, "error").otherwise("ok"), F.col("status"))
    maps = sitemaps.sitemap_coverage(inventory(spark, sf)).select(X.origin(F.col("root")).alias("snapshot_id"), *at, "root", "documents", "urls", "complete")
    sitemap = snapshot.single(maps, "web", "sitemap-inventory", F.lit("web.sitemap"), F.col("root"), F.struct(F.col("root").alias("url")), F.struct("documents", "urls", "complete"), F.when(F.col("complete"), "ok").otherwise("partial"))

    text = lambda v: F.lit(v).cast("string")
    site = lambda df, url, pages, s, a, m, dates: df.select("snapshot_id", url.alias("site"), pages.alias("pages"), s.alias("search_property"), a.alias("analytics_property"), m.alias("sitemap"), none.alias("success_events"), none.alias("caveats"), *dates)
    sites = [site(asked, F.lit(A.SITE), none, text("sc-domain:example.com"), text(None), text(None), ["start_date", "end_date"]),
             site(hosts, F.concat(F.lit("https://"), "host", F.lit("/")), none, text(None), text("properties/1"), text(None), january),
             site(listed.groupBy(F.col("origin").alias("snapshot_id")).agg(F.array_sort(F.collect_list("url")).alias("urls")), F.concat("snapshot_id", F.lit("/")), F.col("urls"), text(None), text(None), F.concat("snapshot_id", F.lit("/sitemap.xml")), january)]
    return snapshot.build_snapshot(every(sites), saved(every([search, analytics, page, sitemap])))


def every(parts):
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def snapshot_assembly(spark, sf):
    """The assembled snapshots read back as saved evidence, with whether each report can be compared."""
    s, o, _ = evidence.split_snapshots(saved(assembled(spark, sf)[0]))
    pages = saved(evidence.report_pages(o))
    broken = evidence.report_violations(pages, s).select("snapshot_id", F.col("observation").alias("name")).distinct().withColumn("broken", F.lit(True))
    rows = o.join(broken, ["snapshot_id", "name"], "left")
    return rows.select("snapshot_id", "name", "provider", "status", F.size("pages").alias("pages"), F.col("pagination.rowsReturned").alias("rows_returned"), F.col("pagination.nextOffset").alias("next_offset"), F.col("error.code").alias("error_code"), ((F.col("operation") == "report") & F.isnull("broken")).alias("usable"))


def snapshot_values(spark, sf):
    """What a comparison reads from the assembled snapshots: every number of the reports that can be used."""
    s, o, _ = evidence.split_snapshots(saved(assembled(spark, sf)[0]))
    return evidence.normalize_reports(o, s).select("snapshot_id", F.col("observation").alias("name"), F.concat_ws("|", "keys").alias("keys"), "metric", F.round(F.col("raw").cast("double"), 6).alias("value"))


def evidence_rollup(spark, sf):
    return evidence.rollup(snapshots(spark, sf)[1]).select("snapshot_id", "status", "observations")


def report_violations(spark, sf):
    s, o, _ = snapshots(spark, sf)
    late = s.withColumn("end_date", F.when(F.col("snapshot_id") == "localhost-first", F.date_add("end_date", 1)).otherwise(F.col("end_date")))
    return evidence.report_violations(evidence.report_pages(o), late)


def normalized(spark, sf):
    s, o, _ = snapshots(spark, sf)
    return evidence.normalize_reports(o, s).select("snapshot_id", "observation", F.concat_ws("|", "keys").alias("keys"), "metric", "raw", F.to_json(F.filter("semantics", lambda x: x.path.isin("aggregation", "currency", "time_zone"))).alias("semantics"))


def report_limitations(spark, sf):
    s, o, _ = snapshots(spark, sf)
    return evidence.limitations(evidence.report_pages(o), s, spark.createDataFrame([("UTC",)], "zone string")).select("snapshot_id", "observation", F.concat_ws(",", "limitations").alias("limitations"))


def compared(spark, sf):
    s, o, _ = snapshots(spark, sf)
    pages = saved(evidence.report_pages(o))  # read for facts, rules, limitations and rows
    norm = saved(evidence.normalized_pages(pages, s).withColumnRenamed("observation", "name"))
    facts = evidence.report_facts(pages).select("snapshot_id", F.col("observation").alias("name"), "scope", "semantics", "start_date", "end_date")
    side = o.select("snapshot_id", "site", "name", "provider", "operation", "target", "status", F.size("pages").alias("n_pages")).join(facts, ["snapshot_id", "name"], "left")
    limits = evidence.limitations(pages, s, spark.createDataFrame([("UTC",)], "zone string")).where(F.size("limitations") > 0)
    limits = limits.join(s.select("snapshot_id", "site"), "snapshot_id").select("site", F.col("observation").alias("name")).distinct()
    half = lambda df, w: df.where(F.col("snapshot_id").endswith(w))
    (b, a), (nb, na) = [half(side, w) for w in ("first", "second")], [half(norm, w) for w in ("first", "second")]
    pairs = compare.pair(b, a, nb.select("site", "name").distinct(), na.select("site", "name").distinct())
    return compare.compare_snapshots(pairs, nb, na, limits)


def compare_snapshots(spark, sf):
    return compared(spark, sf)[1].select("site", "name", F.concat_ws("|", "keys").alias("keys"), "metric", "before_raw", "after_raw", "delta", "percent", "omitted")


def compare_summary(spark, sf):
    return compare.comparison_summary(compared(spark, sf)[0])


def organic_tables(spark, sf):
    e = saved(A.analytics_events(spark, sf))  # both tables need sessions
    return R.organic_landings(e, A.HOST), R.organic_landing_events(e, A.HOST)


def opportunity_organic(spark, sf):
    out = O.organic_association(candidates(spark, sf, 1000), A.SITE, *organic_tables(spark, sf))
    return out.select("page", "path", "landing_rows", "event_rows")


def technical(spark, sf):
    """Parts as pages, some read twice; a ninth is missing now, and a seventh redirects."""
    k, url = F.col("p_partkey"), F.concat(F.lit(f"{A.SITE}part/"), F.col("p_partkey").cast("string"))
    once = A.table(spark, sf, "part").select("p_partkey", "p_type", url.alias("url"))
    pages = once.select("url", F.when(k % 7 == 0, f"{A.SITE}moved").otherwise(F.col("url")).alias("final_url"), F.when(k % 9 == 0, 404).otherwise(200).alias("status"), F.when(k % 5 != 0, F.col("url")).alias("canonical"), F.array(F.when(k % 8 == 0, "noindex").otherwise("index")).alias("robots"), F.lit(None).cast("string").alias("x_robots_tag"), F.lit("2024-02-02").alias("collected_at"), "p_type")
    pages = pages.where("p_type LIKE '%N%'")
    old = pages.withColumn("status", F.lit(500)).withColumn("collected_at", F.lit("2024-02-01"))
    seen = once.where("p_type LIKE '%E%'").select("url", F.lit(A.SITE).alias("property"), F.when(k % 2 == 0, "PASS").alias("verdict"), F.when(k % 3 == 0, "https://example.com/other").otherwise(F.col("url")).alias("google_canonical"), F.lit(None).cast("string").alias("user_canonical"), F.lit("2024-02-02").alias("collected_at"))
    other = seen.withColumn("property", F.lit("sc-domain:other")).withColumn("verdict", F.lit("FAIL")).withColumn("collected_at", F.lit("2024-03-01"))
    return O.technical(candidates(spark, sf, 1000), pages.unionByName(old), seen.unionByName(other), A.SITE)


def opportunity_technical(spark, sf):
    return technical(spark, sf).select("url", F.concat_ws(",", "next_checks").alias("next_checks"), F.concat_ws(",", "unknowns").alias("unknowns"))


def opportunity_followups(spark, sf):
    return O.followups(technical(spark, sf))


def opportunity_unassociated(spark, sf):
    return O.unassociated(organic_tables(spark, sf)[0], candidates(spark, sf), A.SITE)


def investigate_pages(spark, sf):
    facts_ = A.search_facts(spark, sf)
    urls = saved(facts_.select(F.col("page").alias("url")).distinct())  # the facts are not joined again for each use of it
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    pages = urls.select("url", F.col("url").alias("final_url"), F.when(k % 9 == 0, 404).otherwise(200).alias("status"), F.when(k % 4 != 0, "t").alias("title"), F.lit("d").alias("description"), F.when(k % 5 != 0, F.col("url")).alias("canonical"), F.array(F.lit("index")).alias("robots"), F.lit(None).cast("string").alias("x_robots_tag"), F.lit(None).cast("string").alias("collected_at")).where(k % 10 != 0)
    seen = urls.select("url", F.when(k % 2 == 0, "PASS").alias("verdict"), F.col("url").alias("google_canonical"), F.col("url").alias("user_canonical"), F.lit(None).cast("string").alias("collected_at")).where(k % 3 != 0)
    out = O.investigate(urls, A.SITE, facts_, *organic_tables(spark, sf), pages, seen)
    return out.select("url", "finding", "queries", "dates", "retained_sessions", F.concat_ws(",", "next_checks").alias("next_checks"), F.concat_ws(",", "unknowns").alias("unknowns"), "status")


def investigate_display(spark, sf):
    tables = saved(O.exact_breakdowns(A.search_facts(spark, sf)).select("page", "breakdown", "value", "clicks"))  # ranked and counted
    return O.displayed(tables, 5).select("page", "breakdown", "value", "place", "omitted")


def site_events(spark, sf):
    return R.event_report(A.raw_events(spark, sf), A.HOST, A.KEY_EVENTS).withColumn("site", F.lit(A.SITE))


def config(spark):
    return spark.range(1).select(F.lit(A.SITE).alias("site"), F.lit(A.HOST).alias("production_host"), F.lit(A.SITE).alias("search_property"), F.lit("properties/1").alias("analytics_property"), F.array(F.lit("signup")).alias("excluded_events"), F.array(F.lit("refund")).alias("success_events"))


def assess_top_rows(spark, sf):
    rows = R.organic_landings(A.analytics_events(spark, sf), A.HOST)
    return assess.assessment_tables(rows, ["source"], ["landing"], "sessions").select("source", "landing", "sessions", F.col("place").cast("long").alias("place"), "observed", "displayed")


def assess_other_hosts(spark, sf):
    census = R.hostname_census(A.analytics_events(spark, sf)).withColumn("site", F.lit(A.SITE))
    return assess.other_hostnames(census, config(spark))


def assess_key_events(spark, sf):
    return assess.reported_key_events(site_events(spark, sf), config(spark))


def assess_not_observed(spark, sf):
    e = site_events(spark, sf)
    wanted = config(spark).select("site", F.explode("success_events").alias("event_name"))
    return assess.not_observed(wanted, e, "success-event-not-observed").unionByName(assess.not_observed(e.select("site", F.concat("event_name", F.lit("_twice")).alias("event_name")), e, "configured-event-not-observed"))


def assess_findings(spark, sf):
    s, o, _ = snapshots(spark, sf)
    keys = site_events(spark, sf).groupBy("site").agg(F.array_sort(F.collect_list("event_name")).alias("key_events"), F.lit(True).alias("incomplete"))
    latest = o.where("snapshot_id LIKE 'example.com-second'").select("site", "name", "status", F.size("pages").alias("n_pages"))
    out = assess.configured(config(spark), keys).unionByName(assess.expected_reports(assess.standard_suite(config(spark)), latest)).unionByName(assess.provider_incomplete(latest))
    return assess.with_next_checks(out).select("site", "finding", "level", "subject", "value", F.isnotnull("next_check").alias("has_next_check"))


def crux_histogram(spark, sf):
    return speed.histogram(speed.crux_records(A.crux_bodies(spark, sf))).select("url", "metric", "bin", "low", "high", "density")


FETCH = ("run_id", "seq", "url")  # a url may be fetched twice


def capture_diff(spark, sf):
    f = A.fetches(spark, sf).where("status = 200")
    later = f.withColumn("body", F.regexp_replace("body", "<h1>", "<h1>New "))
    return speed.capture_diff(P.seo_fields(P.observed(f)), P.seo_fields(P.observed(later)), FETCH)


def document_diff(spark, sf):
    f = A.fetches(spark, sf)
    return speed.document_diff(f, f.withColumn("status", F.lit(200)).where("seq % 3 <> 0"), FETCH)


def stars(sql):
    return f"SELECT * FROM ({sql}) q"


RULES = """(VALUES ('www', '*', 'disallow', '/en/', '^/en/'), ('www', '*', 'allow', '/en/1', '^/en/1'), ('www', '*', 'disallow', '/*?page=', '^/.*\\?page='), ('www', 'gptbot', 'disallow', '/', '^/'),
 ('m', '*', 'disallow', '/', '^/'), ('other', '*', 'disallow', '/*.html$', '^/.*\\.html$'), ('other', '*', 'allow', '/de/', '^/de/')) r(kind, name, type, rule, rx)"""
KIND = "CASE WHEN origin LIKE '%//www.%' THEN 'www' WHEN origin LIKE '%//m.%' THEN 'm' ELSE 'other' END"


def verdict_sql(urls):
    return f"""WITH a AS (SELECT DISTINCT origin, path, agent, {KIND} AS kind FROM ({urls}) u, (VALUES ('Googlebot'), ('gptbot')) g(agent)),
 n AS (SELECT *, CASE WHEN kind = 'www' AND agent = 'gptbot' THEN 'gptbot' ELSE '*' END AS name FROM a),
 b AS (SELECT n.*, r.type, r.rule, row_number() OVER (PARTITION BY n.origin, n.path, n.agent ORDER BY length(r.rule) DESC, r.type) AS k FROM n LEFT JOIN {RULES} ON r.kind = n.kind AND r.name = n.name AND regexp_matches(n.path, r.rx))
 SELECT origin, path, agent, coalesce(type, 'allow') = 'allow' AS allowed, CASE WHEN name = 'gptbot' THEN 'GPTBot' ELSE '*' END AS robots_group, rule FROM b WHERE k = 1"""


URLS = f"SELECT {ORIGIN} AS origin, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages"
STEP = f"SELECT f, arg_min(t, (seq, pos, CAST(t AS VARCHAR))) AS t FROM ({EDGES}) e WHERE cost = 0 GROUP BY f"
UNASSOCIATED = f"""SELECT *, count(*) OVER () AS unassociated FROM (SELECT landing, source, {COUNTS} FROM ({EVENTS}) e WHERE {ORG} GROUP BY landing, source) l
 WHERE landing NOT IN (SELECT replace(page, 'https://example.com', '') FROM ({COHORT}) c ORDER BY impressions DESC, clicks, page LIMIT 10)"""

QUERIES = {f"search_by_{d}": (facts([d]), facts_sql([d])) for d in ("page", "query", "country", "device", "date")} | {
    "search_totals": (facts([]), facts_sql([])),
    "search_observed_dates": (lambda s, sf: R.observed_dates(A.search_facts(s, sf)), f"SELECT DISTINCT date FROM ({FACTS}) f"),
    "search_paged": (search_paged, f"SELECT page, impressions, k AS row_no, (k - 1) // 50 AS page_no FROM (SELECT *, row_number() OVER (ORDER BY impressions DESC, page) AS k FROM ({facts_sql(['page'])}) r) q WHERE k <= 1000"),
    "search_by_property": (by_property, f"SELECT country, {METRICS} FROM (SELECT search_id, country, max(clicks) AS clicks, max(impressions) AS impressions, min(position) AS position FROM ({FACTS}) f WHERE device = 'MOBILE' GROUP BY search_id, country) q GROUP BY country"),
    "search_page_exact_breakdowns": (lambda s, sf: O.exact_breakdowns(A.search_facts(s, sf)), " UNION ALL ".join(f"SELECT page, '{n}' AS breakdown, {v} AS value, {METRICS} FROM ({FACTS}) f GROUP BY page{g}" for n, v, g in (("totals", "NULL", ""), ("query", "query", ", query"), ("device", "device", ", device"), ("country", "country", ", country"), ("date", "CAST(date AS VARCHAR)", ", date")))),
    "opportunity_cohort": (candidates, f"SELECT page, clicks, impressions, ctr, position, k AS rank, n AS observed, n - 10 AS omitted FROM (SELECT *, row_number() OVER (ORDER BY impressions DESC, clicks, page) AS k, count(*) OVER () AS n FROM ({COHORT}) c) q WHERE k <= 10"),
    "opportunity_organic": (opportunity_organic, f"""SELECT page, replace(page, 'https://example.com', '') AS path, l.n AS landing_rows, v.n AS event_rows FROM (SELECT * FROM ({COHORT}) c ORDER BY impressions DESC, clicks, page LIMIT 1000) c
 LEFT JOIN (SELECT landing, count(*) AS n FROM (SELECT DISTINCT landing, source FROM ({EVENTS}) e WHERE {ORG}) x GROUP BY landing) l ON l.landing = replace(page, 'https://example.com', '')
 LEFT JOIN (SELECT landing, count(*) AS n FROM (SELECT DISTINCT landing, source, event_name FROM ({EVENTS}) e WHERE {ORG}) x GROUP BY landing) v ON v.landing = replace(page, 'https://example.com', '')"""),
    "opportunity_technical": (opportunity_technical, TECHNICAL),
    "opportunity_followups": (opportunity_followups, f"SELECT url, unnest(['search_queries_of_page'] || CASE WHEN contains(next_checks, 'read_page') THEN ['page_read'] ELSE [] END || CASE WHEN contains(next_checks, 'inspect_url') THEN ['url_inspection'] ELSE [] END) AS request FROM ({TECHNICAL}) t"),
    "opportunity_unassociated": (opportunity_unassociated, f"SELECT * FROM ({UNASSOCIATED}) u ORDER BY sessions DESC, landing, source LIMIT 10"),
    "page_identity": (page_identity, "SELECT page_id, url, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages"),
    "page_metadata": (page_metadata, None), "page_seo_fields": (lambda s, sf: P.seo_fields(P.observed(A.fetches(s, sf))), None),
    "page_anchors": (page_anchors, "SELECT page_id, CAST(pos AS INT) AS pos, href, href[2:] AS text FROM (" + ANCHORS + ") a"),
    "page_image_alt": (lambda s, sf: P.image_alt_summary(P.observed(A.fetches(s, sf))).select(F.col("seq").alias("page_id"), "images", "missing", "empty", "meaningful"), "SELECT page_id, CAST(len(regexp_extract_all(html, '<img ')) AS BIGINT) AS images, 0::BIGINT AS missing, 0::BIGINT AS empty, 0::BIGINT AS meaningful FROM pages"),
    "page_social": (page_social, "SELECT page_id, property, content FROM pages, LATERAL (VALUES ('og:title', 'Page ' || page_id), ('og:image', '/a.png'), ('og:image', '/b.png'), ('twitter:card', 'summary')) m(property, content)"),
    "page_hreflang": (page_hreflang, f"SELECT page_id, 'de' AS lang, '/de/' || page_id AS raw, {ORIGIN} || '/de/' || page_id AS href, NULL::VARCHAR AS warning FROM pages UNION ALL SELECT page_id, 'x-default', 'http://[bad', NULL, 'alternate_malformed' FROM pages"),
    "page_jsonld": (page_jsonld, """SELECT page_id, pos, raw, valid_json FROM pages, LATERAL (VALUES (0, '{"@id":' || page_id || '}', true), (1, '{broken', false)) b(pos, raw, valid_json)"""),
    "page_images": (page_images, "SELECT page_id, pos, src, alt IS NOT NULL AS alt_present, alt, pos = 2 AS in_noscript, 0 AS omitted FROM pages, LATERAL (VALUES (0, '/i.png', ''), (1, '/j.png', NULL), (2, '/k.png', 'picture ' || page_id)) i(pos, src, alt)"),
    "hostname_census": (events(R.hostname_census), f"SELECT host, count(DISTINCT session) AS sessions, count(CASE WHEN event_name = 'view' THEN 1 END) AS views FROM ({EVENTS}) e GROUP BY host"),
    "channel_report": (events(R.channel_report, A.HOST), f"SELECT channel, source, medium, {COUNTS} FROM ({EVENTS}) e WHERE {PROD} GROUP BY ALL"),
    "event_report": (lambda s, sf: R.event_report(A.raw_events(s, sf), A.HOST, A.KEY_EVENTS), f"SELECT event_name, count(*) AS event_count, count(CASE WHEN event_name IN ('purchase', 'signup') THEN 1 END) AS key_events FROM ({EVENTS}) e WHERE {PROD} GROUP BY event_name"),
    "organic_landings": (events(R.organic_landings, A.HOST), f"SELECT landing, source, {COUNTS} FROM ({EVENTS}) e WHERE {ORG} GROUP BY landing, source"),
    "organic_events": (events(R.organic_events, A.HOST), f"SELECT event_name, count(*) AS event_count FROM ({EVENTS}) e WHERE {ORG} GROUP BY event_name"),
    "organic_landing_events": (events(R.organic_landing_events, A.HOST), f"SELECT landing, source, event_name, count(*) AS event_count FROM ({EVENTS}) e WHERE {ORG} GROUP BY ALL"),
    "analytics_multi_range": (analytics_multi_range, "SELECT r.date_range, event_type AS event_name, count(*) AS event_count, count(DISTINCT user_id) AS users FROM events JOIN (VALUES ('first', DATE '2024-01-01', DATE '2024-01-14'), ('second', DATE '2024-01-10', DATE '2024-01-28')) r(date_range, low, high) ON CAST(ts AS DATE) BETWEEN low AND high GROUP BY ALL"),
    "analytics_summary_rows": (analytics_summary_rows, """WITH q AS (SELECT event_type AS event_name, count(*) AS event_count FROM events WHERE user_id % 5 <> 0 AND CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY event_type)
 SELECT 'row' AS row_kind, 'all' AS date_range, event_name, event_count FROM q UNION ALL SELECT 'total', 'all', NULL, CAST(sum(event_count) AS BIGINT) FROM q UNION ALL SELECT 'minimum', 'all', NULL, min(event_count) FROM q UNION ALL SELECT 'maximum', 'all', NULL, max(event_count) FROM q UNION ALL SELECT 'count', 'all', NULL, count(*) FROM q"""),
    "analytics_having_order": (analytics_having_order, "SELECT 'all' AS date_range, user_id, count(*) AS event_count FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY user_id HAVING count(*) >= 5 ORDER BY event_count DESC, user_id LIMIT 20"),
    "realtime_two_ranges": (realtime_two_ranges, "WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT event_type AS event_name, floor(date_diff('microsecond', ts, now) / 60000000) AS ago FROM events, n) SELECT r.minute_range, event_name, count(*) AS event_count FROM a JOIN (VALUES ('near', 29), ('wide', 59)) r(minute_range, far) ON ago BETWEEN 0 AND far GROUP BY ALL"),
    "realtime_sliding": (realtime_sliding, """SELECT m - to_minutes(i) AS window_start, m - to_minutes(i) + INTERVAL 30 MINUTE AS window_end, event_name, CAST(sum(n) AS BIGINT) AS event_count, m - to_minutes(i) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS closed
 FROM (SELECT date_trunc('minute', ts) AS m, event_type AS event_name, count(*) AS n FROM events GROUP BY ALL) e, range(30) r(i) GROUP BY ALL"""),
    "realtime_ordered": (realtime_ordered, "SELECT * FROM (SELECT 'wide' AS minute_range, event_type AS event_name, user_id, count(*) AS event_count, row_number() OVER (ORDER BY count(*) DESC, event_type, user_id) AS row_no FROM events WHERE floor(date_diff('microsecond', ts, (SELECT max(ts) FROM events)) / 60000000) <= 59 GROUP BY event_type, user_id) q WHERE row_no <= 25"),
    "freshness_check": (freshness_check, None),
    "compare_periods": (changes, f"SELECT b.user_id, b.event_name, 'events' AS metric, CAST(b.n AS VARCHAR) AS before_raw, CAST(a.n AS VARCHAR) AS after_raw, CAST(a.n - b.n AS DOUBLE) AS delta, round(100.0::DOUBLE * (a.n - b.n) / b.n, 6) AS percent FROM ({BEFORE}) b JOIN ({AFTER}) a USING (user_id, event_name)"),
    "compare_only_before": (only(True), f"SELECT user_id, event_name, hour, CAST(n AS VARCHAR) AS raw FROM ({HOURS.format('2024-01-01', '2024-01-15')}) b ANTI JOIN ({HOURS.format('2024-01-15', '2024-01-29')}) a USING (user_id, event_name, hour)"),
    "compare_only_after": (only(False), f"SELECT user_id, event_name, hour, CAST(n AS VARCHAR) AS raw FROM ({HOURS.format('2024-01-15', '2024-01-29')}) b ANTI JOIN ({HOURS.format('2024-01-01', '2024-01-15')}) a USING (user_id, event_name, hour)"),
    "compare_snapshots": (compare_snapshots, f"""SELECT 'https://' || host || '/' AS site, name, keys, metric, b.raw AS before_raw, a.raw AS after_raw, CAST(a.raw AS DOUBLE) - CAST(b.raw AS DOUBLE) AS delta,
 CASE WHEN CAST(b.raw AS DOUBLE) <> 0 THEN round(100.0::DOUBLE * (CAST(a.raw AS DOUBLE) - CAST(b.raw AS DOUBLE)) / CAST(b.raw AS DOUBLE), 6) END AS percent, 0::BIGINT AS omitted
 FROM (SELECT * FROM ({SAVED_VALUES}) x WHERE half = 'first') b JOIN (SELECT * FROM ({SAVED_VALUES}) y WHERE half = 'second') a USING (host, name, keys, metric) JOIN (SELECT host, name FROM ({SAVED_PAIRS}) p WHERE status IN ('compared', 'limited')) f USING (host, name)"""),
    "compare_summary": (compare_summary, "SELECT 'https://' || host || '/' AS site, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in compare.STATUSES) + f" FROM ({SAVED_PAIRS}) p GROUP BY host"),
    "report_limitations": (report_limitations, f"SELECT host || '-' || half AS snapshot_id, name AS observation, CASE WHEN name = 'analytics.eventName' AND min(u) < 30 THEN 'thresholded' ELSE '' END AS limitations FROM ({SAVED}) v, (VALUES ('analytics.eventName'), ('search.query')) o(name) GROUP BY host, half, name"),
    "snapshot_assembly": (snapshot_assembly, f"""SELECT 'example.com-search' AS snapshot_id, 'search.' || name AS name, 'search' AS provider, CASE WHEN n < 20000 THEN 'ok' ELSE 'partial' END AS status, CAST(least(n // 1000 + 1, 20) AS INT) AS pages, least(n, 20000) AS rows_returned,
  CASE WHEN n >= 20000 THEN 20000::BIGINT END AS next_offset, NULL::VARCHAR AS error_code, name <> 'date' AS usable FROM ({' UNION ALL '.join(f"SELECT '{d or 'totals'}' AS name, count(*) AS n FROM ({facts_sql([d] if d else [])}) r" for d in ('', 'page', 'query', 'date'))}) s
 UNION ALL SELECT host || '-january', name, 'analytics', 'ok', CAST(CASE name WHEN 'analytics.totals' THEN 1 ELSE (n + 1) // 2 END AS INT), CASE name WHEN 'analytics.totals' THEN 1 ELSE n END, NULL, NULL, true
  FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'localhost' ELSE 'example.com' END AS host, count(DISTINCT event_type) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY 1) h, (VALUES ('analytics.totals'), ('analytics.eventName')) o(name)
 UNION ALL SELECT DISTINCT {ORIGIN}, 'web.sitemap', 'web', 'partial', 1, NULL::BIGINT, NULL::BIGINT, NULL, false FROM pages
 UNION ALL SELECT o, 'page:' || url, 'web', CASE WHEN k % 10 = 7 THEN 'error' ELSE 'ok' END, CASE WHEN k % 10 = 7 THEN 0 ELSE 1 END, NULL, NULL, CASE WHEN k % 10 = 7 THEN 'not_found' END, false
  FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k) AS place FROM (SELECT {ORIGIN} AS o, url, min(page_id) AS k FROM pages GROUP BY ALL) u) p WHERE place <= 10"""),
    "snapshot_values": (snapshot_values, f"""SELECT 'example.com-search' AS snapshot_id, name, keys, metric, round(value, 6) AS value FROM (SELECT 'search.page' AS name, page AS keys, clicks, impressions, ctr, position FROM ({facts_sql(['page'])}) p QUALIFY row_number() OVER (ORDER BY clicks DESC, page) <= 20000
  UNION ALL SELECT 'search.query', query, clicks, impressions, ctr, position FROM ({facts_sql(['query'])}) q UNION ALL SELECT 'search.totals', '', clicks, impressions, ctr, position FROM ({facts_sql([])}) t) s,
  LATERAL (VALUES ('clicks', clicks::DOUBLE), ('impressions', impressions::DOUBLE), ('ctr', ctr), ('position', position)) m(metric, value)
 UNION ALL SELECT host || '-january', name, keys, metric, value FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'localhost' ELSE 'example.com' END AS host, CASE WHEN grouping(event_type) = 0 THEN 'analytics.eventName' ELSE 'analytics.totals' END AS name, coalesce(event_type, '') AS keys, count(*) AS n, count(DISTINCT user_id) AS u
   FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY GROUPING SETS ((1), (1, event_type))) e, LATERAL (VALUES ('eventCount', n::DOUBLE), ('totalUsers', u::DOUBLE)) m(metric, value)"""),
    "evidence_rollup": (evidence_rollup, f"SELECT host || '-' || half AS snapshot_id, CASE WHEN count(*) > 0 THEN 'partial' END AS status, 3::BIGINT AS observations FROM ({SAVED}) v GROUP BY host, half"),
    "report_violations": (report_violations, f"SELECT DISTINCT host || '-' || half AS snapshot_id, name AS observation, CASE half WHEN 'first' THEN 'NR-9' ELSE 'NR-1' END AS rule FROM ({SAVED_VALUES}) v WHERE host = 'localhost' AND (half = 'first' OR name = 'search.query')"),
    "normalized_reports": (normalized, f"""SELECT host || '-' || half AS snapshot_id, name AS observation, keys, metric, raw, CASE name WHEN 'search.query' THEN '[{{"path":"aggregation","value":"byProperty"}},{{"path":"time_zone","value":"America/Los_Angeles"}}]'
 ELSE '[{{"path":"currency","value":"' || CASE WHEN host = 'localhost' AND half = 'second' THEN 'EUR' ELSE 'USD' END || '"}},{{"path":"time_zone","value":"UTC"}}]' END AS semantics FROM ({SAVED_VALUES}) v WHERE NOT (host = 'localhost' AND half = 'second' AND name = 'search.query')"""),
    "robots_rules": (robots_of(robots.robots_rules), None), "robots_issues": (robots_of(robots.robots_issues), None),
    "robots_verdicts": (verdicts, verdict_sql(URLS)),
    "ai_crawler_audit": (ai_crawler_audit, f"SELECT origin, agent AS name, CASE agent WHEN 'gptbot' THEN 'Unknown' ELSE 'Big' END AS operator, CASE agent WHEN 'gptbot' THEN 'Unknown' ELSE 'search' END AS category, allowed FROM ({verdict_sql(f'SELECT DISTINCT {ORIGIN} AS origin, chr(47) AS path FROM pages')}) v"),
    "robots_report": (robots_report, None),
    "sitemap_entries": (lambda s, sf: sitemaps.sitemap_entries(A.sitemap_docs(s, sf)), None), "sitemap_inventory": (inventory, f"SELECT root, url, position, bytes, error, urls, omitted, all_urls FROM ({INVENTORY}) i"),
    "sitemap_rejects": (lambda s, sf: sitemaps.sitemap_rejects(A.broken_sitemaps(s, sf)), """SELECT url || '#' || fault AS url, CASE fault WHEN 'prefix' THEN 'unsupported_sitemap' ELSE 'invalid_sitemap' END AS reject FROM pages,
 (VALUES ('prefix'), ('no_loc'), ('two_locs'), ('unknown'), ('nested'), ('doctype'), ('open'), ('foreign_entry')) f(fault)"""),
    "sitemap_coverage": (lambda s, sf: sitemaps.sitemap_coverage(inventory(s, sf)), f"SELECT root, count(*) FILTER (error IS NULL) AS documents, count(*) FILTER (error IS NOT NULL) AS errors, 0::BIGINT AS unvisited, max(all_urls) AS urls, max(omitted) AS omitted, false AS complete FROM ({INVENTORY}) i GROUP BY root"),
    "sitemap_future": (lambda s, sf: sitemaps.future_lastmods(sitemaps.sitemap_entries(A.sitemap_docs(s, sf)), "2024-02-01"), "SELECT DISTINCT strftime(DATE '2024-01-01' + CAST(page_id % 60 AS INT), '%Y-%m-%d') AS lastmod FROM pages WHERE DATE '2024-01-01' + CAST(page_id % 60 AS INT) > DATE '2024-02-01'"),
    "graph_edges": (lambda s, sf: site_graph(s, sf)[1].select(F.col("seq").alias("page_id"), "pos", "raw", "kind", F.col("to").alias("target")), f"SELECT page_id, CAST(pos AS INT) AS pos, href AS raw, 'link' AS kind, {ORIGIN} || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target FROM ({ANCHORS}) a WHERE page_id % 10 <> 7"),
    "graph_incoming": (lambda s, sf: graph.incoming(A.part_links(s, sf)).select("url", "links", "from_others", "pages"), "SELECT 'https://example.com/part/' || b.l_partkey AS url, count(*) AS links, count(CASE WHEN a.l_partkey <> b.l_partkey THEN 1 END) AS from_others, count(DISTINCT a.l_partkey) AS pages FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE NOT (a.l_linenumber = 1 AND a.l_returnflag = 'R') GROUP BY b.l_partkey"),
    "graph_depths": (graph_depths, f"WITH RECURSIVE e AS (SELECT f, t, min(cost) AS cost FROM ({EDGES}) x GROUP BY f, t), d AS (SELECT 1::BIGINT AS n, 0 AS depth UNION SELECT e.t, d.depth + e.cost FROM d JOIN e ON e.f = d.n WHERE d.depth + e.cost <= 12) SELECT 'https://example.com/part/' || n AS url, CAST(min(depth) AS INT) AS depth FROM d GROUP BY n"),
    "redirect_chains": (redirect_chains, f"""WITH RECURSIVE s AS ({STEP}), c AS (SELECT f AS start, [f] AS path, t AS cur FROM s UNION ALL SELECT c.start, list_append(c.path, c.cur), s.t FROM c JOIN s ON s.f = c.cur WHERE NOT list_contains(c.path, c.cur))
 SELECT 'https://example.com/part/' || start AS start, 'https://example.com/part/' || cur AS final, CASE WHEN list_contains(path, cur) THEN 'loop' ELSE 'observed_destination' END AS termination, CAST(len(path) AS BIGINT) AS hops FROM c WHERE list_contains(path, cur) OR cur NOT IN (SELECT f FROM s)"""),
    "graph_findings": (graph_findings, None), "graph_frontier": (graph_frontier, None), "crawl_replay": (crawl_replay, None), "crawl_sites": (crawl_sites, None), "crawl_coverage": (crawl_coverage, None), "page_table": (page_table, None),
    "inspection_sample": (inspection_sample, "SELECT page_id, url, k AS place, CASE WHEN page_id % 2 = 0 THEN 'PASS' END AS verdict FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS k FROM pages WHERE page_id % 10 <> 7) p WHERE k <= 3"),
    "investigate_pages": (investigate_pages, f"""WITH b AS (SELECT page AS url, CAST(split_part(page, '/', 5) AS BIGINT) AS k, max(CASE breakdown WHEN 'totals' THEN clicks END) AS clicks, max(CASE breakdown WHEN 'totals' THEN impressions END) AS impressions, count(*) FILTER (breakdown = 'query') AS queries, count(*) FILTER (breakdown = 'date') AS dates FROM ({BREAKDOWNS}) x GROUP BY page)
 SELECT url, clicks || ' clicks of ' || impressions || ' impressions' AS finding, queries, dates, CAST(retained_sessions AS BIGINT) AS retained_sessions,
  concat_ws(',', CASE WHEN k % 3 <> 0 AND k % 2 <> 0 THEN 'reconcile_stored_state' END, CASE WHEN k % 10 <> 0 AND (k % 9 = 0 OR k % 5 = 0) THEN 'check_route_policy' END, CASE WHEN k % 10 <> 0 AND k % 4 = 0 THEN 'missing_title_or_description' END, 'review_separate_breakdowns', 'compare_daily_rows', 'validate_events') AS next_checks,
  concat_ws(',', CASE WHEN k % 10 = 0 THEN 'page_not_read' END, CASE WHEN k % 3 = 0 THEN 'not_inspected' END) AS unknowns, CASE WHEN k % 10 = 0 OR k % 3 = 0 THEN 'partial' ELSE 'ok' END AS status
 FROM b LEFT JOIN (SELECT 'https://example.com' || landing AS url, sum(sessions) AS retained_sessions FROM (SELECT landing, source, {COUNTS} FROM ({EVENTS}) e WHERE {ORG} GROUP BY landing, source) l GROUP BY landing) s USING (url)"""),
    "investigate_display": (investigate_display, f"""SELECT page, breakdown, value, CASE breakdown WHEN 'date' THEN least(n, 5) + 1 - k ELSE k END AS place, greatest(n - 5, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY page, breakdown ORDER BY CASE breakdown WHEN 'date' THEN value END DESC, clicks DESC, value) AS k, count(*) OVER (PARTITION BY page, breakdown) AS n FROM ({BREAKDOWNS}) b) q WHERE k <= 5"""),
    "assess_top_rows": (assess_top_rows, f"SELECT source, landing, sessions, place, observed, least(observed, 10) AS displayed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sessions DESC, landing) AS place, count(*) OVER (PARTITION BY source) AS observed FROM (SELECT landing, source, {COUNTS} FROM ({EVENTS}) e WHERE {ORG} GROUP BY landing, source) l) q WHERE place <= 10"),
    "assess_other_hosts": (assess_other_hosts, f"SELECT 'https://example.com/' AS site, 'other-hostnames' AS finding, 'fact' AS level, host AS subject, CAST(count(DISTINCT session) AS VARCHAR) AS value FROM ({EVENTS}) e WHERE host <> 'example.com' GROUP BY host"),
    "assess_key_events": (assess_key_events, f"SELECT 'https://example.com/' AS site, CASE event_name WHEN 'signup' THEN 'excluded-key-event' ELSE 'reported-key-event' END AS finding, CASE event_name WHEN 'signup' THEN 'check' ELSE 'fact' END AS level, event_name AS subject, CAST(count(*) AS VARCHAR) AS value FROM ({EVENTS}) e WHERE {PROD} AND event_name IN ('signup', 'purchase') GROUP BY event_name"),
    "assess_not_observed": (assess_not_observed, f"SELECT 'https://example.com/' AS site, 'success-event-not-observed' AS finding, 'unknown' AS level, 'refund' AS subject, NULL::VARCHAR AS value UNION ALL SELECT DISTINCT 'https://example.com/', 'configured-event-not-observed', 'fact', event_type || '_twice', NULL FROM events WHERE user_id % 5 <> 0"),
    "assess_findings": (assess_findings, f"""SELECT 'https://example.com/' AS site, finding, level, subject, value, true AS has_next_check FROM (VALUES ('success-events-unverified', 'fact', 'https://example.com/', '1'), ('key-event-metadata-partial', 'unknown', 'https://example.com/', NULL),
  ('report-unavailable', 'unknown', 'search.totals', NULL), ('report-unavailable', 'unknown', 'search.page', NULL), ('report-unavailable', 'unknown', 'analytics.hostName', NULL), ('report-unavailable', 'unknown', 'analytics.sessionDefaultChannelGroup+sessionSourceMedium', NULL),
  ('report-unavailable', 'unknown', 'analytics.landingPagePlusQueryString+sessionSource.organic', NULL), ('report-unavailable', 'unknown', 'analytics.eventName.organic', NULL), ('report-unavailable', 'unknown', 'analytics.landingPagePlusQueryString+sessionSource+eventName.organic', NULL),
  ('provider-incomplete', 'unknown', 'search.totals', 'error')) f(finding, level, subject, value)
 UNION ALL SELECT 'https://example.com/', 'configured-key-events', 'fact', 'https://example.com/', string_agg(DISTINCT event_type, ',' ORDER BY event_type), true FROM events WHERE user_id % 5 <> 0"""),
    "crux_histogram": (crux_histogram, """SELECT 'https://example.com/' || event_type AS url, 'value' AS metric, b AS bin, low, high, density FROM (SELECT event_type, round(count(CASE WHEN value < 50 THEN 1 END)::DOUBLE / count(*), 6) AS l, round(count(CASE WHEN value >= 200 THEN 1 END)::DOUBLE / count(*), 6) AS h FROM events GROUP BY event_type) e,
 LATERAL (SELECT 0 AS b, '0' AS low, '50' AS high, l AS density UNION ALL SELECT 1, '200', NULL, h) x"""),
    "capture_diff": (capture_diff, "SELECT url, field, CASE WHEN field = 'h1' THEN 'different' ELSE 'equal' END AS result FROM pages, (VALUES ('titles'), ('descriptions'), ('canonicals'), ('robots'), ('h1'), ('json_ld'), ('links'), ('link_texts')) f(field) WHERE page_id % 10 <> 7"),
    "document_diff": (document_diff, "SELECT url, field, CASE WHEN page_id % 3 = 0 THEN 'unavailable' WHEN field = 'status' AND page_id % 10 = 7 THEN 'different' ELSE 'equal' END AS result FROM pages, (VALUES ('status'), ('x_robots_tag')) f(field)"),
}


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
