"""A crawl of many sites replayed over an archive (GR-12..14), with its whole state: queue, robots, sitemap and limits.

A run is one site crawled under one policy. URLs get their place in the queue when they are admitted, and are fetched in
the order of places, so a round fetches all that the last round admitted, for every run at once, and admits what those
pages name, in the order of pages and edges. What a round holds of a run is bounded by the policy: at most `max_pages`
pages with a page's links, and at most `cap` URLs known. Rows that are admitted are written once and only read later.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X
from . import robots as B
from .workdir import saved

CALLS = ("run_id", "url", "depth", "hop", "reason", "rank")


def refusal(barred: Column, max_depth: int, max_hops: int, include_query: bool) -> Column:
    """The first reason against fetching `url` at `depth` after `hop` redirects, or null; `seed` exempts from the query rule."""
    query = F.col("url").rlike(r"\?.") & ~F.coalesce(F.col("seed"), F.lit(False)) & F.lit(not include_query)
    return F.coalesce(barred, F.when(F.col("hop") > max_hops, "redirect_limit"), F.when(query, "query_not_selected"), F.when(F.col("depth") > max_depth, "depth_limit"))


def frontier(discovered: DataFrame, max_depth: int = 3, max_hops: int = 5, include_query: bool = False) -> DataFrame:
    """GR-12: one row per (run_id, url) with the first reason against fetching it, or null.

    `discovered` is (run_id, site, url, depth, hop, seed, robots_error, rate_limited, allowed). A permitted
    discovery clears what others of the same URL were rejected for.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    barred = F.when(~F.coalesce(X.same_origin(F.col("site"), F.col("url")), F.lit(False)), "outside_origin").when(flag("robots_error"), "robots_error").when(flag("rate_limited"), "rate_limited")
    barred = barred.when(~F.coalesce(F.col("allowed"), F.lit(True)), "robots_disallow")
    rows = discovered.withColumn("reason", refusal(barred, max_depth, max_hops, include_query))
    best = F.min_by(F.struct("reason", "depth", "hop"), F.struct(F.col("reason").isNotNull(), "depth", "hop"))
    return rows.groupBy("run_id", "url").agg(best.alias("b")).select("run_id", "url", "b.reason", "b.depth", "b.hop")


def robots_policy(sites: DataFrame, urls: DataFrame, files: DataFrame, agent: str):
    """(denied, blocked) for `replay`: (run_id, url) that the run's robots file forbids, (run_id, reason) of runs whose
    file failed. `sites` is (run_id, site), `urls` (run_id, url)."""
    lines = saved(B.lines(files))
    failed = B.in_force(files).where("note IS NOT NULL").select("origin", F.when(F.startswith("note", F.lit("status_")), "robots_unreachable").otherwise("robots_too_large").alias("reason"))
    at = sites.select("run_id", X.origin(F.col("site")).alias("origin"))
    here = urls.select("run_id", "url", X.origin(F.col("url")).alias("origin"), X.path_query(F.col("url")).alias("path")).join(at, ["run_id", "origin"])
    here = saved(here.distinct())
    no = B.robots_verdicts(here, lines, [agent]).where("NOT allowed").select("origin", "path")
    return here.join(no, ["origin", "path"]).select("run_id", "url"), at.join(failed, "origin").select("run_id", "reason")


def barred_by(rows: DataFrame, sites: DataFrame, denied: DataFrame | None, blocked: DataFrame | None) -> DataFrame:
    """`rows` of (run_id, url) with `barred`: what forbids a URL whatever its depth."""
    none = F.lit(None).cast("string")
    rows = rows.join(sites, "run_id")
    rows = rows.join(denied.select("run_id", "url", F.lit("robots_disallow").alias("rule")).distinct(), ["run_id", "url"], "left") if denied is not None else rows.withColumn("rule", none)
    rows = rows.join(blocked.groupBy("run_id").agg(F.min("reason").alias("whole")), "run_id", "left") if blocked is not None else rows.withColumn("whole", none)
    barred = F.coalesce(F.when(~F.coalesce(X.same_origin(F.col("site"), F.col("url")), F.lit(False)), "outside_origin"), F.col("whole"), F.col("rule"))
    return rows.withColumn("barred", barred).drop("site", "rule", "whole")


def _known(rows, parts, name):
    """`rows` with the flag `name`: whether one of the written `parts` has (run_id, url)."""
    if not parts:
        return rows.withColumn(name, F.lit(False))
    known = reduce(DataFrame.unionByName, [p.select("run_id", "url") for p in parts]).withColumn(name, F.lit(True))
    return rows.join(known, ["run_id", "url"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _merged(parts, most=8):
    return parts if len(parts) < most else [saved(reduce(DataFrame.unionByName, parts))]


def _admit(calls, seen, queued, runs, cap):
    """A row per URL that the calls of a round name: `found` if it is known or there is room for it, `place` if it is
    queued now, `calls` how often it was named. The first call decides `reason`, the first without one the place."""
    fine = F.isnull("reason")
    rows = _known(calls, queued, "placed").where("NOT placed").groupBy("run_id", "url").agg(F.min("rank").alias("first"), F.min_by("reason", "rank").alias("reason"), F.min(F.when(fine, F.col("rank"))).alias("ok"),
        F.min_by(F.struct("depth", "hop"), F.when(fine, F.col("rank"))).alias("how"), F.count("*").alias("calls"))
    rows = _known(rows, seen, "met").join(runs, "run_id")
    new = F.row_number().over(Window.partitionBy("run_id", "met").orderBy("first", "url"))
    rows = rows.withColumn("found", F.col("met") | (new + F.col("discovered") <= cap))
    goes = F.col("found") & F.isnotnull("ok")
    place = F.row_number().over(Window.partitionBy("run_id", goes).orderBy("ok", "url")) + F.col("queued")
    return saved(rows.select("run_id", "url", "reason", "met", "found", F.when(goes, place).alias("place"), F.when(goes, F.col("how.depth")).alias("depth"), F.when(goes, F.col("how.hop")).alias("hop"), "calls", F.lit(0).alias("pos")))


def _drip(sitemap, seen, queued, runs, cap, max_pages):
    """The same of runs whose queue is empty: URLs of their sitemaps in order, up to the first that is queued."""
    idle = runs.where(F.isnull("halt") & (F.col("fetched") >= F.col("queued")) & (F.col("queued") < max_pages))
    rows = _known(_known(sitemap.join(idle, "run_id").where("pos > cursor"), queued, "placed"), seen, "met")
    room = F.row_number().over(Window.partitionBy("run_id", "met").orderBy("pos")) + F.col("discovered") <= cap
    rows = rows.withColumn("found", F.col("met") | room)
    goes = F.col("found") & ~F.col("placed") & F.isnull("reason")
    rows = rows.withColumn("goes", goes).withColumn("next", F.min(F.when(F.col("goes"), F.col("pos"))).over(Window.partitionBy("run_id")))
    rows = rows.where(F.isnull("next") | (F.col("pos") <= F.col("next")))
    goes = F.col("goes")
    return saved(rows.select("run_id", "url", "reason", (F.col("met") | F.col("placed")).alias("met"), "found", F.when(goes, F.col("queued") + 1).alias("place"), F.when(goes, 0).alias("depth"), F.when(goes, 0).alias("hop"), F.when(F.col("placed"), 0).otherwise(1).cast("long").alias("calls"), "pos"))


def _after(runs, rows):
    """Counters of the runs after these admissions."""
    sums = rows.groupBy("run_id").agg(F.count("place").alias("p"), F.count_if(F.col("found") & ~F.col("met")).alias("d"), F.sum(F.when(~F.col("found"), F.col("calls")).otherwise(0)).alias("o"), F.max("pos").alias("c"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return runs.join(sums, "run_id", "left").select("run_id", plus("queued", F.col("p")), plus("discovered", F.col("d")), plus("omitted_urls", F.col("o")), F.greatest("cursor", F.coalesce("c", F.lit(0))).alias("cursor"), "fetched", "halt")


def replay(crawled: DataFrame, links: DataFrame, seeds: DataFrame, sitemap: DataFrame | None = None, denied: DataFrame | None = None, blocked: DataFrame | None = None,
           max_pages: int = 20, max_depth: int = 3, max_hops: int = 5, include_query: bool = False, cap: int = 5000):
    """GR-13: (rows, runs). Rows are (run_id, url, depth, hop, place, reason): pages fetched have a place, others the first
    reason they were left out for. Runs are (run_id, pages, discovered, omitted_urls, halted).

    Seeds are (run_id, site, url[, pos]), `sitemap` (run_id, url, pos), `denied` and `blocked` as of `robots_policy`;
    `blocked` also takes runs that a 429 stopped before (`rate_limited`). Links lead a level down unless marked nofollow,
    redirects stay and count a hop. A sitemap's URLs come one by one, at depth 0, when the queue is empty. Of `cap`
    known URLs on, every naming of a new one counts as omitted. A page answered with 429 ends its run. URLs queued but not
    fetched, and URLs of sitemaps not reached, are `page_limit`, or `rate_limited` in a run that was stopped. A page that
    the archive lacks takes its place and names nothing. No seeds: no rows.
    """
    sites = saved(seeds.groupBy("run_id").agg(F.min("site").alias("site")))
    policy = (max_depth, max_hops, include_query)
    nofollow = crawled.groupBy("run_id", F.col("url").alias("from")).agg(F.bool_or(X.has_nofollow(F.col("robots"), F.col("x_robots_tag"))).alias("nf"))
    ways = links.where("kind IN ('link', 'redirect') AND to IS NOT NULL").join(nofollow, ["run_id", "from"], "left")
    ways = ways.where((F.col("kind") == "redirect") | ~(F.coalesce("nf", F.lit(False)) | F.coalesce(F.col("rel").rlike(r"(?i)\bnofollow\b"), F.lit(False))))
    ways = saved(barred_by(ways.select("run_id", "from", F.col("to").alias("url"), "kind", F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos")), sites, denied, blocked))
    stops = crawled.where("status = 429").select("run_id", "url", F.lit(True).alias("stops")).distinct()
    zero = [F.lit(0).alias("depth"), F.lit(0).alias("hop")]
    order = F.col("pos").cast("long") if "pos" in seeds.columns else F.lit(0).cast("long")
    rank = lambda *c: F.struct(*[x.cast("long").alias(f"r{i}") for i, x in enumerate(c)], F.col("url").alias("u")).alias("rank")
    first = barred_by(seeds.select("run_id", "url", order.alias("pos"), *zero, F.lit(True).alias("seed")), sites, denied, blocked)
    calls = first.withColumn("reason", refusal(F.col("barred"), *policy)).select(*CALLS[:5], rank(F.lit(0), F.lit(0), F.col("pos")))
    if sitemap is not None:
        sitemap = barred_by(sitemap.select("run_id", "url", F.col("pos").cast("int").alias("pos"), *zero, F.lit(False).alias("seed")), sites, denied, blocked)
        sitemap = saved(sitemap.withColumn("reason", refusal(F.col("barred"), *policy)).select("run_id", "url", "reason", "pos"))
    count = F.lit(0).cast("long")
    runs = saved(sites.select("run_id", count.alias("queued"), count.alias("discovered"), count.alias("omitted_urls"), F.lit(0).alias("cursor"), count.alias("fetched"), F.lit(None).cast("long").alias("halt")))
    seen, queued = [], []
    while True:
        going, rounds = runs.where("halt IS NULL").select("run_id"), [_admit(calls, seen, queued, runs, cap)]
        seen, queued = [*seen, rounds[0].where("found AND NOT met")], [*queued, rounds[0].where("place IS NOT NULL")]
        runs = _after(runs, rounds[0])
        if sitemap is not None:
            rounds.append(_drip(sitemap, seen, queued, runs, cap, max_pages))
            seen, queued = [*seen, rounds[1].where("found AND NOT met")], [*queued, rounds[1].where("place IS NOT NULL")]
            runs = _after(runs, rounds[1])
        batch = reduce(DataFrame.unionByName, rounds).join(going, "run_id", "left_semi").where(F.col("place") <= max_pages).select("run_id", "url", "depth", "hop", "place")
        batch = saved(batch.join(stops, ["run_id", "url"], "left"))
        if batch.isEmpty():
            break
        ends = batch.groupBy("run_id").agg(F.min(F.when(F.col("stops"), F.col("place"))).alias("end"))
        runs = saved(runs.join(ends, "run_id", "left").select("run_id", "queued", "discovered", "omitted_urls", "cursor", F.when(F.isnotnull("halt"), F.col("fetched")).otherwise(F.coalesce("end", "queued")).alias("fetched"), F.coalesce("halt", "end").alias("halt")))
        seen, queued = _merged(seen), _merged(queued)
        live = batch.join(ends, "run_id").where(F.isnull("end") | (F.col("place") < F.col("end"))).withColumnRenamed("url", "from")
        link = F.col("kind") == "link"
        met = live.join(ways, ["run_id", "from"]).select("run_id", "url", (F.col("depth") + link.cast("int")).alias("depth"), F.when(link, 0).otherwise(F.col("hop") + 1).alias("hop"), "barred", F.lit(False).alias("seed"), rank(F.col("place"), F.col("seq"), F.col("pos")))
        calls = met.withColumn("reason", refusal(F.col("barred"), *policy)).select(*CALLS)
    known = reduce(DataFrame.unionByName, seen).select("run_id", "url", "reason")
    placed = reduce(DataFrame.unionByName, queued).select("run_id", "url", "depth", "hop", "place")
    if sitemap is not None:
        rest = sitemap.join(runs.select("run_id", "cursor"), "run_id").where("pos > cursor").select("run_id", "url").join(known, ["run_id", "url"], "left_anti")
        known = known.unionByName(rest.withColumn("reason", F.lit(None).cast("string")))
    last = F.when(F.isnotnull("halt"), "rate_limited").otherwise("page_limit")
    out = known.join(placed, ["run_id", "url"], "left").join(runs.select("run_id", "halt"), "run_id")
    done = F.isnotnull("place") & (F.col("place") <= F.least(F.lit(max_pages), F.coalesce("halt", F.lit(max_pages))))
    out = out.select("run_id", "url", *[F.when(done, F.col(c)).alias(c) for c in ("depth", "hop", "place")], F.when(~done, F.when(F.isnull("place"), F.coalesce("reason", last)).otherwise(last)).alias("reason"))
    stopped = F.isnotnull("halt")
    return out, runs.select("run_id", F.least("fetched", "queued", F.lit(max_pages)).alias("pages"), "discovered", "omitted_urls", stopped.alias("halted"))


def coverage(rows: DataFrame, runs: DataFrame, crawled: DataFrame, faults: DataFrame | None = None, max_links: int = 500) -> DataFrame:
    """GR-14: what a run fetched and left out. It is complete if nothing was: no URL skipped or omitted, no page missing in
    the archive or with more than `max_links` links, no 429, and no fault of robots files or sitemaps.

    `faults` is (run_id, faults).
    """
    links = F.greatest(F.size("page.anchors") - max_links, F.lit(0)) if "page" in crawled.columns else F.lit(0)
    stored = crawled.groupBy("run_id", "url").agg(F.max(F.coalesce(links, F.lit(0))).cast("long").alias("more"))
    fetched = rows.where("place IS NOT NULL").select("run_id", "url").join(stored, ["run_id", "url"], "left")
    a = fetched.groupBy("run_id").agg(F.count_if(F.isnull("more")).alias("not_in_archive"), F.sum(F.coalesce("more", F.lit(0))).alias("omitted_links"))
    b = rows.where("reason IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("skipped"))
    out = runs.join(a, "run_id", "left").join(b, "run_id", "left")
    out = out.join(faults.groupBy("run_id").agg(F.sum("faults").alias("faults")), "run_id", "left") if faults is not None else out.withColumn("faults", F.lit(0))
    left = ("not_in_archive", "omitted_links", "skipped", "omitted_urls", "faults")
    out = out.select("run_id", "pages", "discovered", "halted", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in left])
    return out.withColumn("complete", reduce(Column.__and__, [F.col(c) == 0 for c in left], ~F.col("halted")))
