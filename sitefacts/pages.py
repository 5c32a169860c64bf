"""Page content (PG-1..12). One pass over each body emits what it holds, in order; everything else is columns of it.

A fetch is (run_id, seq, url, status, content_type, x_robots_tag, location, body); further columns are kept. A null
body holds nothing. A body beyond `max_bytes` is not parsed in part: it counts as null, with the error size_limit.
"""

from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as X

HELD = """title string, h1 array<string>, bases array<string>, jsonld array<string>,
metas array<struct<name: string, property: string, content: string>>,
links array<struct<rel: string, href: string, hreflang: string>>,
anchors array<struct<href: string, rel: string, text: string>>,
images array<struct<src: string, alt_present: boolean, alt: string, in_noscript: boolean, width: string, height: string, role: string, aria_hidden: string>>"""
SKIP = {"script", "style", "template"}
_TEXTS = pa.list_(pa.string())
_ROWS = lambda texts, flags=(): pa.list_(pa.struct([(n, pa.bool_() if n in flags else pa.string()) for n in texts.split()]))
HELD_ARROW = pa.struct([("title", pa.string()), ("h1", _TEXTS), ("bases", _TEXTS), ("jsonld", _TEXTS), ("metas", _ROWS("name property content")), ("links", _ROWS("rel href hreflang")), ("anchors", _ROWS("href rel text")),
    ("images", _ROWS("src alt_present alt in_noscript width height role aria_hidden", ("alt_present", "in_noscript")))])
PIECE = 2_000_000  # bytes of bodies that are held as Python objects at once


class _Page(HTMLParser):
    """Texts stay undecoded; attributes are decoded by the parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out = {"title": None, "h1": [], "bases": [], "jsonld": [], "metas": [], "links": [], "anchors": [], "images": []}
        self.open, self.noscript, self.ld, self.anchor, self.head = None, 0, None, None, None

    def handle_starttag(self, tag, attrs):
        a, out = {}, self.out
        for k, v in attrs:
            a.setdefault(k, v)
        if tag == "title":
            self.open, out["title"] = "title", out["title"] or ""
        elif tag == "h1":
            self.head = []
        elif tag == "base" and a.get("href") is not None:
            out["bases"].append(a["href"])
        elif tag == "meta":
            out["metas"].append({"name": a.get("name"), "property": a.get("property"), "content": a.get("content")})
        elif tag == "link":
            out["links"].append({"rel": a.get("rel"), "href": a.get("href"), "hreflang": a.get("hreflang")})
        elif tag == "a" and a.get("href") is not None:
            self.anchor = {"href": a["href"], "rel": a.get("rel"), "text": ""}
            out["anchors"].append(self.anchor)
        elif tag == "img":
            out["images"].append({"src": a.get("src"), "alt_present": "alt" in a, "alt": (a["alt"] or "") if "alt" in a else None, "in_noscript": self.noscript > 0,
                                  "width": a.get("width"), "height": a.get("height"), "role": a.get("role"), "aria_hidden": a.get("aria-hidden")})
        elif tag == "noscript":
            self.noscript += 1
        elif tag == "script" and (a.get("type") or "").strip().lower() == "application/ld+json":
            self.ld = []

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == "title":
            self.open = None
        elif tag == "a":
            self.anchor = None
        elif tag == "noscript":
            self.noscript = max(0, self.noscript - 1)
        elif tag == "h1" and self.head is not None:
            self.out["h1"].append(" ".join(unescape("".join(self.head)).split()))
            self.head = None
        elif tag == "script" and self.ld is not None:
            if (text := "".join(self.ld)).strip():
                self.out["jsonld"].append(text)
            self.ld = None

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif self.cdata_elem in SKIP:
            return
        elif self.open == "title":
            self.out["title"] += data
        if self.anchor is not None:
            self.anchor["text"] += data
        if self.head is not None:
            self.head.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def held(body):
    p = _Page()
    p.feed(body or "")
    p.close()
    for a in p.out["anchors"]:
        a["text"] = " ".join(unescape(a["text"]).split())
    return p.out


def bound_body(fetches: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """SRC-4: no part of a body over the bound is kept."""
    over = F.coalesce(F.octet_length("body") > max_bytes, F.lit(False))
    error = F.col("error") if "error" in fetches.columns else F.lit(None).cast("string")
    return fetches.withColumn("error", F.when(over, "size_limit").otherwise(error)).withColumn("body", F.when(~over, F.col("body")))


def held_array(bodies: pa.Array) -> pa.Array:
    """What each body holds. A piece of the bodies at a time becomes Python objects, so a batch takes little more memory
    than its own bytes and those of the result."""
    done, rows, size = [pa.array([], HELD_ARROW)], [], 0
    for body in bodies:
        body = body.as_py()
        rows.append(held(body))
        size += len(body or "")
        if size >= PIECE or len(rows) >= 500:
            done.append(pa.array(rows, HELD_ARROW))
            rows, size = [], 0
    return pa.concat_arrays([*done, pa.array(rows, HELD_ARROW)])


def observed(fetches: DataFrame, html_only: bool = False) -> DataFrame:
    """The fetches with `page`, what the body holds. With html_only other answers than 2xx HTML hold nothing."""
    @F.arrow_udf(HELD)
    def run(body: pa.Array) -> pa.Array:
        return held_array(body)

    wanted = F.col("body")
    if html_only:
        wanted = F.when((F.col("status") >= 200) & (F.col("status") < 300) & F.lower("content_type").contains("text/html"), F.col("body"))
    return fetches.withColumn("parsed", wanted.isNotNull()).withColumn("page", run(wanted))


def meta(name: str):
    return F.filter("page.metas", lambda m: F.lower(F.trim(m["name"])) == name)


def page_metadata(seen: DataFrame) -> DataFrame:
    """PG-1, 5, 10, 12: title undecoded, last description, last canonical with its fragment, hreflang, warnings."""
    base = F.get("page.bases", F.lit(0))
    odd = F.coalesce(base.rlike(r"(?i)^\s*(data|javascript):"), F.lit(False))
    rows = seen.withColumn("canonical_raw", F.try_element_at(F.filter("page.links", lambda x: (x.rel == "canonical") & (F.trim(x.href) != "")), F.lit(-1)).href)
    rows = rows.withColumn("to", X.resolve_first(F.when(~odd, base), F.col("url"), F.array("canonical_raw"), True, False))
    rows = rows.withColumns({"base_try": F.col("to.base"), "canonical": F.col("to.first")}).withColumn("base", F.coalesce("base_try", "url"))
    description = F.try_element_at(meta("description"), F.lit(-1)).content
    robots = F.transform(F.filter("page.metas", lambda m: F.lower(m["name"]).isin("robots", "googlebot") & (m.content != "")), lambda m: F.concat(F.lower(m["name"]), F.lit(": "), m.content))
    title = F.trim("page.title")
    warnings = F.array_compact(F.array(
        F.when(base.isNotNull() & odd, "base_ignored"), F.when(base.isNotNull() & ~odd & F.isnull("base_try"), "base_malformed"),
        F.when(F.col("canonical_raw").isNotNull() & F.isnull("canonical"), "canonical_malformed")))
    return rows.select("run_id", "seq", "url", F.when(title != "", title).alias("title"), description.alias("description"), X.code_points(description).alias("description_length"),
        "canonical", "base", robots.alias("robots"), X.sha256(F.col("body")).alias("sha256"), X.byte_len(F.col("body")).alias("bytes"), warnings.alias("warnings"), "page")


def crawl_metadata(seen: DataFrame) -> DataFrame:
    """PG-2: title decoded, first resolvable canonical without fragment; `seen` comes from observed(html_only=True)."""
    canonicals = F.transform(F.filter("page.links", lambda x: x.rel == "canonical"), lambda x: x.href)
    rows = seen.withColumn("to", X.resolve_first(F.get("page.bases", F.lit(0)), F.col("url"), canonicals)).withColumns({"base": F.coalesce("to.base", "url"), "canonical": F.col("to.first")})
    title = F.trim(X.decode_entities(F.col("page.title")))
    robots = F.transform(F.filter("page.metas", lambda m: F.lower(m["name"]).isin("robots", "googlebot")), lambda m: F.concat(F.lower(m["name"]), F.lit(": "), F.coalesce(m.content, F.lit(""))))
    description = F.try_element_at(meta("description"), F.lit(-1)).content
    return rows.select("run_id", "seq", "url", "status", "content_type", "x_robots_tag", "location", "base", "parsed", F.when(title != "", title).alias("title"),
        F.when(description != "", description).alias("description"), "canonical", robots.alias("robots"), X.sha256(F.col("body")).alias("sha256"), X.byte_len(F.col("body")).alias("bytes"), "page")


def social(seen: DataFrame, kind: str) -> DataFrame:
    """PG-3 (`og`) and PG-4 (`twitter`): in document order, repeats kept, names lower-cased."""
    name = F.lower(F.coalesce(*(["page_meta.property", "page_meta.name"] if kind == "og" else ["page_meta.name", "page_meta.property"])))
    rows = seen.select("run_id", "seq", "url", F.posexplode("page.metas").alias("at", "page_meta")).withColumn("property", name)
    return rows.where(F.col("property").startswith(f"{kind}:")).select("run_id", "seq", "url", "at", "property", F.col("page_meta.content").alias("content"))


def hreflang(meta_rows: DataFrame) -> DataFrame:
    """PG-5 of page_metadata rows: resolved, null with a warning where the reference is malformed."""
    links = F.filter("page.links", lambda x: F.array_contains(F.split(F.lower(F.trim(x.rel)), r"\s+"), "alternate") & (x.hreflang != "") & (x.href != ""))
    rows = meta_rows.select("run_id", "seq", "url", "base", F.posexplode(links).alias("pos", "x"))
    to = X.resolve_url(F.col("x.href"), F.col("base"), True, False)
    return rows.select("run_id", "seq", "url", "pos", F.col("x.hreflang").alias("lang"), F.col("x.href").alias("raw"), to.alias("href")).withColumn("warning", F.when(F.isnull("href"), "alternate_malformed"))


def structured_data(seen: DataFrame) -> DataFrame:
    """PG-6: a row for each JSON-LD block."""
    return seen.select("run_id", "seq", "url", F.posexplode("page.jsonld").alias("pos", "raw")).withColumn("valid_json", X.valid_json(F.col("raw")))


def images(seen: DataFrame, cap: int = 200) -> DataFrame:
    """PG-7: ordinary images, then those in noscript; at most `cap` a page, with the number omitted."""
    ordered = F.concat(F.filter("page.images", lambda i: ~i.in_noscript), F.filter("page.images", lambda i: i.in_noscript))
    return seen.select("run_id", "seq", "url", F.greatest(F.size(ordered) - cap, F.lit(0)).alias("omitted"), F.posexplode(F.slice(ordered, 1, cap)).alias("pos", "i")).select("run_id", "seq", "url", "pos", "i.*", "omitted")


def image_alt_summary(seen: DataFrame) -> DataFrame:
    """PG-8: all images of each page by the state of their ALT text."""
    n = lambda f: F.size(F.filter("page.images", f)).cast("long")
    return seen.select("run_id", "seq", "url", F.size("page.images").cast("long").alias("images"), n(lambda i: ~i.alt_present).alias("missing"),
        n(lambda i: i.alt_present & (F.trim(i.alt) == "")).alias("empty"), n(lambda i: F.trim(i.alt) != "").alias("meaningful"))


def anchors(seen: DataFrame, max_links: int = 500) -> DataFrame:
    """PG-9: href as written, rel, the first 200 characters of the text; at most `max_links` a page."""
    return seen.select("run_id", "seq", "url", F.greatest(F.size("page.anchors") - max_links, F.lit(0)).alias("omitted"), F.posexplode(F.slice("page.anchors", 1, max_links)).alias("pos", "a")).select(
        "run_id", "seq", "url", "pos", F.col("a.href").alias("href"), F.col("a.rel").alias("rel"), F.trim(F.substring("a.text", 1, 200)).alias("text"), "omitted")


def seo_fields(seen: DataFrame, items: int = 200, chars: int = 4000) -> DataFrame:
    """PG-11: list-valued fields with raw forms, cut to `items` values of `chars` characters, and whether cut."""
    cut = lambda c: F.transform(F.slice(c, 1, items), lambda x: F.substring(x, 1, chars))
    fields = {
        "titles": F.when(F.col("page.title").isNotNull(), F.array(F.col("page.title"))).otherwise(F.array().cast("array<string>")),
        "descriptions": F.transform(F.filter(meta("description"), lambda m: m.content.isNotNull()), lambda m: m.content),
        "canonicals": F.transform(F.filter("page.links", lambda x: F.array_contains(F.split(F.lower(F.trim(x.rel)), r"\s+"), "canonical") & x.href.isNotNull()), lambda x: x.href),
        "robots": F.transform(F.filter("page.metas", lambda m: F.lower(m["name"]).isin("robots", "googlebot") & m.content.isNotNull()), lambda m: F.concat(F.lower(m["name"]), F.lit(": "), m.content)),
        "h1": F.col("page.h1"), "json_ld": F.col("page.jsonld"), "links": F.transform("page.anchors", lambda a: a.href), "link_texts": F.transform("page.anchors", lambda a: a.text),
    }
    over = F.lit(False)
    for c in fields.values():
        over = over | (F.size(c) > items) | F.exists(c, lambda x: F.length(x) > chars)
    return seen.select("run_id", "seq", "url", *[cut(c).alias(n) for n, c in fields.items()], over.alias("truncated"))
