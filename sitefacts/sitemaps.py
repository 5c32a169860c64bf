"""Sitemaps (SM-1..5). Documents are (url, status, body), one row a url; no document can fail the job.

A document is judged by events on (namespace, local name, depth). Anything outside the grammar rejects it whole:

    depth 1  urlset or sitemapindex without a prefix, in no namespace or the standard one
    depth 2  url or sitemap of the same namespace, with exactly one non-empty loc
    depth 3  anything; loc and lastmod of the same namespace are read, those of others are not
    below    nothing inside such a loc or lastmod
"""

from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as X
from .ranks import ranked
from .workdir import saved

STANDARD = "http://www.sitemaps.org/schemas/sitemap/0.9"
ROOTS = {"urlset": ("url", "page"), "sitemapindex": ("sitemap", "child")}
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
HEADS = 10  # an inventory schedules at most five documents, so no more of a document's children can matter
PARSED = "url string, status int, bytes long, kind string, pos int, loc string, lastmods array<string>, reject string, refs long, heads array<string>"


class Rejected(Exception):
    pass


class Reader:
    """The automaton. `entries` are (kind, loc, [lastmod])."""

    def __init__(self):
        self.entries, self.depth, self.namespace, self.root, self.name, self.text, self.loc, self.lastmods = [], 0, "", None, None, [], None, []

    def start(self, name, attrs):
        uri, local, prefix = self.split(name)
        self.depth += 1
        if self.depth == 1:
            if prefix:
                raise Rejected("unsupported_sitemap")
            if local not in ROOTS or uri not in ("", STANDARD):
                raise Rejected("invalid_sitemap")
            self.root, self.namespace = local, uri
        elif self.depth == 2:
            if (uri, local) != (self.namespace, ROOTS[self.root][0]):
                raise Rejected("invalid_sitemap")
            self.loc, self.lastmods = None, []
        elif self.depth == 3:
            self.name, self.text = (local if uri == self.namespace else None), []
        elif self.name in ("loc", "lastmod"):
            raise Rejected("invalid_sitemap")

    def end(self, _):
        if self.depth == 3:
            text = "".join(self.text).strip(SPACE)
            if self.name == "loc":
                if self.loc is not None or not text:
                    raise Rejected("invalid_sitemap")
                self.loc = text
            elif self.name == "lastmod":
                self.lastmods.append(text)
            self.name = None
        elif self.depth == 2:
            if self.loc is None:
                raise Rejected("invalid_sitemap")
            self.entries.append((ROOTS[self.root][1], self.loc, self.lastmods))
        self.depth -= 1

    def data(self, text):
        if self.depth == 3:
            self.text.append(text)

    def doctype(self, *_):
        raise Rejected("invalid_sitemap")

    @staticmethod
    def split(name):
        """(namespace, local name, prefix) of expat's `namespace local prefix`."""
        parts = name.split("\n")
        return ("", name, "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")


def read_document(body):
    """The entries of a valid document, else Rejected, whatever the body is."""
    reader, p = Reader(), expat.ParserCreate("utf-8", "\n")
    p.namespace_prefixes = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.StartDoctypeDeclHandler = reader.start, reader.end, reader.data, reader.doctype
    try:
        p.Parse((body or "").encode(), True)
    except Rejected:
        raise
    except Exception:  # malformed XML, lone surrogates, and whatever a parser may still raise
        raise Rejected("invalid_sitemap") from None
    return reader.entries


def parsed(docs: DataFrame, max_bytes: int = 8_000_000) -> DataFrame:
    """A row of kind `document` for each document, with its reject, and for a valid one a row for each entry.

    `refs` counts the child references, `heads` are the first ten different ones. A body over `max_bytes` is not read.
    """
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for url, status, body in zip(b.url, b.status, b.body):
                status, entries, reject = (None if pd.isna(status) else int(status)), [], None
                size = 0 if body is None else len(body.encode("utf-8", "replace"))
                try:
                    if size > max_bytes:
                        raise Rejected("size_limit")
                    entries = read_document(body)
                except Rejected as e:
                    reject = str(e)
                children = [loc for kind, loc, _ in entries if kind == "child"]
                rows.append((url, status, size, "document", None, None, None, reject, len(children), list(dict.fromkeys(children))[:HEADS]))
                rows += [(url, status, size, kind, i, loc, mods, None, None, None) for i, (kind, loc, mods) in enumerate(entries)]
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32", "status": "Int32", "refs": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32", "status": "Int32", "refs": "Int64"})

    return docs.select("url", F.col("status").cast("int").alias("status"), "body").mapInPandas(run, PARSED)


def entries_of(read: DataFrame) -> DataFrame:
    """url, pos, kind, loc, lastmod (the entry's first), lastmods of `parsed` documents."""
    return read.where("kind <> 'document'").select("url", "pos", "kind", "loc", F.get("lastmods", F.lit(0)).alias("lastmod"), "lastmods")


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """SM-1: entries of the accepted documents."""
    return entries_of(parsed(docs))


def sitemap_rejects(docs: DataFrame) -> DataFrame:
    """SM-1: url, reject of the other documents."""
    return parsed(docs).where("kind = 'document' AND reject IS NOT NULL").select("url", "reject")


def future_lastmods(entries: DataFrame, today) -> DataFrame:
    """SM-4: distinct lastmods whose date sorts after `today` (YYYY-MM-DD)."""
    return entries.select(F.explode("lastmods").alias("lastmod")).where(F.substring("lastmod", 1, 10) > today).distinct()


def _visits(roots, documents, max_docs, max_bytes, each, permitted, children, every):
    """One row a root with `steps`, an array of (url, bytes, error), the `queue` left over, and the children omitted.

    Rounds visit one document of every root: its queue is an array of at most `max_docs` names, so a round is one join
    of a row a root with a row a document. `children(state)` gives the names to append; with `every`, each of them is
    a reference of its own and the rest is omitted, else a name is scheduled once.
    """
    step = "array<struct<url:string,bytes:bigint,error:string>>"
    state = roots.select("root", F.array("root").alias("queue"), F.lit(0).cast("long").alias("bytes"), F.array().cast(step).alias("steps"), F.lit(0).cast("long").alias("omitted"))
    facts = documents.withColumnsRenamed({"url": "doc", "bytes": "size"})
    for _ in range(max_docs):
        seen = F.transform("steps", lambda s: s.url)
        fresh = F.filter(F.transform("queue", lambda u, i: F.when(~F.array_contains(seen, u), i)), lambda i: i.isNotNull())
        state = state.withColumn("queue", F.slice("queue", F.coalesce(F.get(fresh, F.lit(0)), F.size("queue")) + 1, F.lit(2**31 - 1)))
        state = state.withColumn("url", F.when(F.col("bytes") < max_bytes, F.get("queue", F.lit(0)))).withColumn("queue", F.when(F.isnull("url"), F.col("queue")).otherwise(F.slice("queue", 2, F.lit(2**31 - 1))))
        met = state.join(facts, F.col("url") == F.col("doc"), "left")
        denied = permitted(F.col("root"), F.col("url"))
        ok = (F.col("status") >= 200) & (F.col("status") < 300)
        fetched = F.isnull(denied) & F.isnotnull("doc") & (F.col("size") <= F.least(F.lit(each), F.lit(max_bytes) - F.col("bytes")))
        error = F.coalesce(denied, F.when(F.isnull("doc"), "not_fetched"), F.when(~fetched, "size_limit"), F.when(~ok, F.concat(F.lit("HTTP_"), F.col("status").cast("string"))), F.col("reject"))
        met = met.withColumn("error", F.when(F.isnotnull("url"), error)).withColumn("fine", F.isnotnull("url") & F.isnull("error"))
        met = met.withColumn("bytes", F.col("bytes") + F.when(F.isnotnull("url") & fetched & (F.lit(every) | ok), F.col("size")).otherwise(0))
        met = met.withColumn("steps", F.when(F.isnull("url"), F.col("steps")).otherwise(F.concat("steps", F.array(F.struct("url", F.when(fetched, F.col("size")).alias("bytes"), "error")))))
        known = F.concat(F.transform("steps", lambda s: s.url), F.col("queue"))
        names = children(met) if every else F.filter(children(met), lambda c: ~F.array_contains(known, c))
        room = F.greatest(F.lit(0), F.lit(max_docs) - F.size(known))
        met = met.withColumn("new", F.when(F.col("fine"), F.slice(names, F.lit(1), room)).otherwise(F.array().cast("array<string>")))
        met = met.withColumn("omitted", F.col("omitted") + (F.when(F.col("fine"), F.col("refs") - F.size("new")).otherwise(0) if every else 0))
        state = saved(met.select("root", F.concat("queue", "new").alias("queue"), "bytes", "steps", "omitted"))
    seen = F.transform("steps", lambda s: s.url)
    return state.withColumn("queue", F.filter("queue", lambda u: ~F.array_contains(seen, u)))


def sitemap_inventory(roots: DataFrame, docs: DataFrame, max_docs: int = 5, max_bytes: int = 8_000_000) -> DataFrame:
    """SM-2: (root, url, position, bytes, error, urls, omitted, all_urls) breadth first from each root.

    At most `max_docs` documents are scheduled. A child of another origin takes a place and is an error, so is one that
    is not there, fails (its children are not followed), is malformed, or passes what is left of the root's
    `max_bytes`. When these are used up, the rest of the queue has the error `unvisited` and no position. `omitted`
    counts the root's child references that found no place, `all_urls` its different page entries.
    """
    read = saved(parsed(docs, max_bytes))
    documents = read.where("kind = 'document'").select("url", "status", "bytes", "reject", "refs", "heads")
    outside = lambda root, url: F.when(~F.coalesce(X.same_origin(root, url), F.lit(False)), "outside_origin")
    state = saved(_visits(roots.select("root").distinct(), documents, max_docs, max_bytes, max_bytes, outside, lambda s: F.coalesce("heads", F.array().cast("array<string>")), False))
    rest = F.transform("queue", lambda u: F.struct(u.alias("url"), F.lit(None).cast("long").alias("bytes"), F.lit("unvisited").alias("error")))
    rows = state.select("root", F.posexplode(F.concat("steps", rest)).alias("i", "s"), F.size("steps").alias("n"))
    rows = rows.select("root", "s.url", F.when(F.col("i") < F.col("n"), F.col("i") + 1).alias("position"), "s.bytes", "s.error")
    fine = rows.where("error IS NULL").select("root", "url")
    pages, children = (read.where(F.col("kind") == k).groupBy("url", "loc").agg(F.count("*").alias("n")) for k in ("page", "child"))
    urls = pages.groupBy("url").agg(F.count("*").alias("urls"))
    every = fine.join(pages, "url").groupBy("root").agg(F.count_distinct("loc").alias("all_urls"))
    scheduled = rows.select("root", F.col("url").alias("loc"), F.lit(True).alias("placed"))
    left = fine.join(children, "url").join(scheduled, ["root", "loc"], "left").where("placed IS NULL").groupBy("root").agg(F.sum("n").alias("omitted"))
    out = rows.join(urls, "url", "left").join(left, "root", "left").join(every, "root", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("root", "url", "position", "bytes", "error", F.when(F.isnull("error"), F.coalesce("urls", F.lit(0))).alias("urls"), zero("omitted"), zero("all_urls"))


def sitemap_coverage(inventory: DataFrame) -> DataFrame:
    """SM-3."""
    out = inventory.groupBy("root").agg(F.count_if(F.isnull("error")).alias("documents"), F.count_if(F.isnotnull("position") & F.isnotnull("error")).alias("errors"), F.count_if(F.isnull("position")).alias("unvisited"), F.max("all_urls").alias("urls"), F.max("omitted").alias("omitted"))
    return out.withColumn("complete", (F.col("errors") == 0) & (F.col("omitted") == 0) & (F.col("unvisited") == 0))


def crawl_sitemaps(roots: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None, cap: int = 5000, max_docs: int = 5, each: int = 2_000_000, max_bytes: int = 8_000_000):
    """SM-5: (urls, visits): (root, url, pos) of at most `cap` different page entries a root, resolved, and a row a root
    with `steps` (url, bytes, error), omitted_documents and omitted_urls.

    `verdicts` are (url, reason) of the documents that a crawler may not fetch. Children are resolved and queued as often
    as they are named, while queue and visited documents are fewer than `max_docs`.
    """
    read = saved(parsed(docs, each))
    entries = read.where("kind <> 'document'").withColumn("to", X.resolve_url(F.col("loc"), F.col("url"))).where("to IS NOT NULL")
    entries = saved(entries.select("url", "kind", "pos", "to"))
    near = entries.where("kind = 'child'").groupBy("url").agg(F.count("*").alias("refs"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "to"))), 1, HEADS).alias("heads"))
    documents = read.where("kind = 'document'").select("url", "status", "bytes", "reject").join(near, "url", "left")
    documents = documents.select("url", "status", "bytes", "reject", F.coalesce("refs", F.lit(0)).alias("refs"), F.transform(F.coalesce("heads", F.array().cast("array<struct<pos:int,to:string>>")), lambda h: h.to).alias("heads"))
    if verdicts is None:
        denied = documents.withColumn("reason", F.lit(None).cast("string"))
    else:
        denied = documents.join(verdicts.select("url", "reason"), "url", "left")
    denied = denied.withColumn("reject", F.coalesce("reason", "reject")).drop("reason")
    outside = lambda root, url: F.when(~F.coalesce(X.same_origin(root, url), F.lit(False)), "outside_origin")
    state = saved(_visits(roots.select("root").distinct(), denied, max_docs, max_bytes, each, outside, lambda s: F.coalesce("heads", F.array().cast("array<string>")), True))
    fine = state.select("root", F.posexplode("steps").alias("at", "s")).where("s.error IS NULL").select("root", "at", "s.url")
    met = fine.join(entries.where("kind = 'page'"), "url").select("root", "to", F.struct("at", "pos").alias("first"))
    met = met.groupBy("root", "to").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    place = ranked(met, [F.asc("root"), F.asc("first"), F.asc("to")], "place")
    start = place.groupBy("root").agg(F.min("place").alias("start"))
    place = place.join(start, "root").withColumn("pos", (F.col("place") - F.col("start") + 1).cast("int"))
    over = place.where(F.col("pos") > cap).groupBy("root").agg(F.sum("n").alias("omitted_urls"))
    visits = state.withColumn("omitted_documents", F.col("omitted") + F.size("queue")).join(over, "root", "left")
    return place.where(F.col("pos") <= cap).select("root", F.col("to").alias("url"), "pos"), visits.select("root", "steps", "omitted_documents", F.coalesce("omitted_urls", F.lit(0)).alias("omitted_urls"))


def crawl_sitemap_urls(roots: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None, **limits) -> DataFrame:
    """The URLs of SM-5 alone."""
    return crawl_sitemaps(roots, docs, verdicts, **limits)[0]
