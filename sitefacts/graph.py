"""Site graph (GR-1..11, GR-15, GR-16) over a crawl archive, keyed by run_id. Loops cut their lineage by written tables."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X
from . import pages as P
from .workdir import saved

REDIRECTS = (301, 302, 303, 307, 308)
# What to do about a finding.
NEXT_CHECKS = {"http_error": "Check the route and the pages that link to it.", "missing_html_metadata": "Check whether the field is meant to be empty, and the rendered page.", "canonical_difference": "Check whether another canonical is intended.",
    "noindex_directive": "Check whether the page is meant to be left out.", "no_incoming_link_observed": "Crawl further and check the navigation; a part of a site proves no orphan.", "redirect_chain": "Check each redirect and where the chain ends."}


def edges(crawled: DataFrame, max_links: int = 500) -> DataFrame:
    """GR-1 of crawl_metadata rows: links, every canonical and redirects; `to` is null where it can't be resolved."""
    links = P.anchors(crawled, max_links).join(crawled.select("run_id", "seq", "base"), ["run_id", "seq"])
    links = links.select("run_id", "seq", F.col("url").alias("from"), X.resolve_url(F.col("href"), F.col("base")).alias("to"), F.col("href").alias("raw"), F.lit("link").alias("kind"), "rel", "text", "pos")
    canonical = crawled.select("run_id", "seq", F.col("url").alias("from"), "base", F.posexplode(F.filter("page.links", lambda x: x.rel == "canonical")).alias("pos", "x"))
    none = F.lit(None).cast("string")
    canonical = canonical.select("run_id", "seq", "from", X.resolve_url(F.col("x.href"), F.col("base")).alias("to"), F.col("x.href").alias("raw"), F.lit("canonical").alias("kind"), none.alias("rel"), none.alias("text"), "pos")
    moved = crawled.where(F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull())
    moved = moved.select("run_id", "seq", F.col("url").alias("from"), X.resolve_url(F.col("location"), F.col("url")).alias("to"), F.col("location").alias("raw"), F.lit("redirect").alias("kind"), none.alias("rel"), none.alias("text"), F.lit(0).alias("pos"))
    return links.unionByName(canonical).unionByName(moved)


def depths(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR-2: (run_id, url, depth) of every URL reached: a link costs 1, a redirect 0, canonicals are not followed.

    A round follows all ways, links and redirects, from the URLs whose depth became less in the round before, so there are
    as many rounds as a shortest way has steps. It writes those that are new or nearer than before; a URL is written
    again only if a longer chain of steps turns out to be a nearer way.
    """
    ways = saved(links.where("kind IN ('link', 'redirect') AND to IS NOT NULL AND from <> to").groupBy("run_id", "from", "to").agg(F.min((F.col("kind") == "link").cast("int")).alias("cost")))
    fresh = saved(seeds.select("run_id", "url", F.lit(0).alias("depth")).distinct())
    parts = [fresh]
    while True:
        known = reduce(DataFrame.unionByName, parts).groupBy("run_id", "url").agg(F.min("depth").alias("depth"))
        met = fresh.join(ways, (fresh.run_id == ways.run_id) & (fresh.url == ways["from"])).select(fresh.run_id, F.col("to").alias("url"), (F.col("depth") + F.col("cost")).alias("depth"))
        met = met.groupBy("run_id", "url").agg(F.min("depth").alias("depth"))
        met = met.join(known.withColumnRenamed("depth", "before"), ["run_id", "url"], "left").where("before IS NULL OR depth < before").drop("before")
        fresh = saved(met)
        if fresh.isEmpty():
            return known
        parts = [*parts, fresh] if len(parts) < 8 else [saved(known), fresh]


def _doubled(nodes: DataFrame, most: int, paths: bool):
    """(done, live) of nodes (run_id, node, jump, hops, final, termination[, path]) after every node looked at least `most`
    hops ahead. A jump doubles each round; one that meets an end is done. A null jump is an end."""
    done, live, span = [nodes.where("jump IS NULL")], saved(nodes.where("jump IS NOT NULL")), 1
    while span < most and not live.isEmpty():
        known = live
        for part in done:
            known = known.unionByName(part)
        there = known.select("run_id", F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("hops").alias("more"), F.col("final").alias("f"), F.col("termination").alias("t"), *([F.col("path").alias("rest")] if paths else []))
        met = live.join(there, ["run_id", "jump"])
        met = saved(met.select("run_id", "node", F.col("further").alias("jump"), (F.col("hops") + F.col("more")).alias("hops"), F.col("f").alias("final"), F.col("t").alias("termination"), *([F.concat("path", "rest").alias("path")] if paths else [])))
        done, live, span = [*done, met.where("jump IS NULL")], met.where("jump IS NOT NULL"), span * 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, live


def redirect_chains(links: DataFrame, fetched: DataFrame, paths: bool = False) -> DataFrame:
    """GR-3: from every redirect the first redirect of each target is followed until the chain ends: (run_id, start, final,
    termination, hops), and with `paths` the URLs from start to final.

    Jumps double, so a chain of n hops takes log2(n) rounds. What is left after as many hops as there are redirects
    leads into a loop: the URLs that jumps end in then are those on loops, whose least URL names the loop.
    """
    first = links.where("kind = 'redirect'").groupBy("run_id", F.col("from").alias("node")).agg(F.min_by("to", F.struct("seq", "pos", "to")).alias("to"))
    first = saved(first)
    here = fetched.select("run_id", F.col("url").alias("to"), F.lit(True).alias("seen")).distinct()
    on = first.select("run_id", F.col("node").alias("to"), F.lit(True).alias("moves"))
    met = first.join(on, ["run_id", "to"], "left").join(here, ["run_id", "to"], "left")
    end = F.when(F.isnull("to"), "invalid_target").when(~F.coalesce(X.same_origin(F.col("node"), F.col("to")), F.lit(False)), "outside_origin").when(F.isnull("moves"), F.when(F.col("seen"), "observed_destination").otherwise("unfetched"))
    kind = [F.array("node").alias("path")] if paths else []
    nodes = saved(met.select("run_id", "node", F.when(F.isnull(end), F.col("to")).alias("jump"), F.lit(1).cast("long").alias("hops"), F.when(F.isnotnull(end), F.col("to")).alias("final"), end.alias("termination"), *kind))
    done, live = _doubled(nodes, nodes.count(), paths)
    out = done.withColumn("path", F.when(F.isnull("final"), F.col("path")).otherwise(F.concat("path", F.array("final")))) if paths else done
    if not live.isEmpty():
        out = out.unionByName(_loops(nodes, live, paths))
    return out.select("run_id", F.col("node").alias("start"), "final", "termination", "hops", *(["path"] if paths else []))


def _loops(nodes: DataFrame, live: DataFrame, paths: bool) -> DataFrame:
    """Rows of `redirect_chains` for the starts that lead into a loop; `hops` counts the way to it and once around."""
    ring = saved(live.select("run_id", F.col("jump").alias("node")).distinct())
    kind, none = ([F.array("node").alias("path")] if paths else []), F.lit(None).cast("string")
    step = saved(ring.join(nodes, ["run_id", "node"]).select("run_id", "node", "jump", F.col("node").alias("leader")))
    jumps, span, size = step, 1, ring.count()
    while span < size:  # the least URL within reach, which doubles
        there = jumps.select("run_id", F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("leader").alias("theirs"))
        jumps = saved(jumps.join(there, ["run_id", "jump"]).select("run_id", "node", F.col("further").alias("jump"), F.least("leader", "theirs").alias("leader")))
        span *= 2
    led = jumps.select("run_id", "node", "leader")
    length = led.groupBy("run_id", "leader").agg(F.count("*").alias("around"))
    ends = led.select("run_id", "node", none.alias("jump"), F.lit(0).cast("long").alias("hops"), F.col("node").alias("final"), F.lit("loop").alias("termination"), *([F.array().cast("array<string>").alias("path")] if paths else []))
    tails = nodes.join(live.select("run_id", "node"), ["run_id", "node"], "left_semi").join(ring, ["run_id", "node"], "left_anti")
    done, _ = _doubled(saved(ends.unionByName(tails)), nodes.count() + 1, paths)
    out = done.join(led.withColumnRenamed("node", "final"), ["run_id", "final"]).join(length, ["run_id", "leader"])
    if paths:  # the loop once, from its leader on, turned to begin where a start enters it
        to_lead = led.join(step.drop("leader"), ["run_id", "node"]).select("run_id", "node", F.when(F.col("node") != F.col("leader"), F.col("jump")).alias("jump"), F.when(F.col("node") != F.col("leader"), 1).otherwise(0).cast("long").alias("hops"), none.alias("final"), none.alias("termination"))
        far = _doubled(saved(to_lead), size + 1, False)[0].select("run_id", "node", "hops")
        rings = led.join(far, ["run_id", "node"]).groupBy("run_id", "leader").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("o"), "node"))), lambda x: x.node).alias("ring"))
        at = F.array_position("ring", F.col("final")).cast("int")
        out = out.join(rings, ["run_id", "leader"]).withColumn("path", F.concat("path", F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1), F.array("final")))
    return out.select("run_id", "node", none.alias("jump"), (F.col("hops") + F.col("around")).alias("hops"), "final", "termination", *(["path"] if paths else []))


def incoming(links: DataFrame) -> DataFrame:
    """GR-4: links to each URL, also without those from itself, and the least of the pages they come from."""
    rows = links.where("kind = 'link' AND to IS NOT NULL")
    return rows.groupBy("run_id", F.col("to").alias("url")).agg(F.count("*").alias("links"), F.count_if(F.col("from") != F.col("to")).alias("from_others"), F.count_distinct("from").alias("pages"))


def findings(crawled: DataFrame, links: DataFrame, chains: DataFrame, sitemap: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR-5..11: (run_id, url, kind, evidence as JSON, next_check). `sitemap` and `seeds` are (run_id, url)."""
    html = (F.col("status") == 200) & F.col("parsed")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    inn = incoming(links)
    def rows(df, kind, *evidence):
        return df.select("run_id", "url", F.lit(kind).alias("kind"), F.to_json(F.struct(*evidence)).alias("evidence"), F.lit(NEXT_CHECKS[kind]).alias("next_check"))

    out = rows(crawled.where("status >= 400").join(inn, ["run_id", "url"], "left"), "http_error", "status", "links", "pages")
    out = out.unionByName(rows(crawled.where(html & (empty("title") | empty("description") | empty("canonical"))), "missing_html_metadata", "title", "description", "canonical"))
    out = out.unionByName(rows(crawled.where("canonical IS NOT NULL AND canonical <> url"), "canonical_difference", "canonical"))
    out = out.unionByName(rows(crawled.where(X.has_noindex(F.col("robots"), F.col("x_robots_tag"))), "noindex_directive", "robots", "x_robots_tag"))
    lone = crawled.select("run_id", "url").distinct().join(sitemap.select("run_id", "url"), ["run_id", "url"], "left_semi").join(seeds.select("run_id", "url"), ["run_id", "url"], "left_anti").join(inn.where("from_others > 0"), ["run_id", "url"], "left_anti")
    out = out.unionByName(rows(lone, "no_incoming_link_observed", F.lit(True).alias("in_sitemap")))
    return out.unionByName(rows(chains.withColumnRenamed("start", "url"), "redirect_chain", "path", "termination"))


def page_table(crawled: DataFrame, depth: DataFrame, verdicts: DataFrame) -> DataFrame:
    """GR-15: pages with their depth and robots verdict; `verdicts` is robots_verdicts for one agent."""
    rows = crawled.withColumn("origin", X.origin(F.col("url"))).withColumn("path", X.path_query(F.col("url")))
    rows = rows.join(depth, ["run_id", "url"], "left").join(verdicts.select("origin", "path", "allowed"), ["origin", "path"], "left")
    return rows.select("run_id", "seq", "url", "status", "title", "description", "canonical", "sha256", "bytes", "depth", "allowed")


def inspection_sample(crawled: DataFrame, inspections: DataFrame, n: int = 3) -> DataFrame:
    """GR-16: the first n pages of each run that are HTML with status 200, and their stored inspections if any."""
    some = crawled.where((F.col("status") == 200) & F.col("parsed")).withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where(F.col("k") <= n)
    return some.select("run_id", "seq", "url", "k").join(inspections, "url", "left")
