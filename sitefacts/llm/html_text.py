"""Main text of web pages by a site style tree.

The pages of a host are merged into a tree: a node is its parent, its tag and its class and id words. A node's entropy
importance is 0.1 of the diversity of its presentation (the shape of its blocks) and 0.9 of the diversity of its
content over the host's different pages: 1 if each page has its own, 0 if all have the same. Marks (article and menu
tags, class words, roles) are a prior. That of an article weighs as much as `prior` pages of evidence, so what enough
pages repeat inside their articles goes. That of a menu, footer or advert weighs four fifths whatever the evidence,
for such branches do differ from page to page. An unmarked node has only the entropy, and importance 1 while its host
has fewer than `least` pages with it; beside a marked article it weighs as boilerplate. The content of a branch holds
that of its children, so a branch is at least as diverse as any of them: it goes when all its text nodes are below
`threshold`. Every page is parsed once. Time is linear in the length of a page, however deep its tags nest. Null or
empty html has no text, an empty table no rows. Repeated rows keep their rows and count once as evidence. A null url
is the host ''. Further columns are ignored.
"""

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import shared_dir

# Names of HTML elements, and class words of boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter noscript output picture progress q rp rt ruby s samp script select small source span strike strong style sub sup svg textarea time tt u var wbr".split())
NOISE_TAGS = set("head nav footer aside form script style noscript template iframe object svg canvas select button textarea dialog menu audio video".split())
NOISE_WORDS = set("ad ads advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice newsletter subscribe subscription popup modal comment comments disqus social share sharing related login signup widget".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert dialog".split())
OWN_WORDS = set("article post entry content".split())
CLOSES_P = set("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
BARRIERS = set("td th table button object template".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}


def words_of(attrs):
    return set(re.split(r"[^a-z]+", f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))


def mark_of(tag, attrs, inside):
    names, role = words_of(attrs), (attrs.get("role") or "").lower()
    if tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody":
        return "noise" if names & {"comment", "comments"} else "main"
    if tag in ("html", "body"):
        return None
    if tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return "noise"
    if tag == "header":
        return None if inside == "main" else "noise"
    return "noise" if names & NOISE_WORDS and not (names & OWN_WORDS and not names & {"comment", "comments"}) else None


class _Blocks(HTMLParser):
    """Blocks (node, mark, text) in page order; noise inside an article stays noise.

    An element of the stack is (tag, node, mark, number of open p's up to the next barrier).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.parts, self.at, self.open = [], [], [], None, Counter()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((*self.at, text))
        self.parts, self.at = [], None

    def here(self):
        return self.stack[-1][1:3] if self.stack else (0, None)

    def close_to(self, k):
        if any(e[0] not in INLINE for e in self.stack[k:]) or self.here()[1] != (self.stack[k - 1][2] if k else None):
            self.flush()
        self.open.subtract(e[0] for e in self.stack[k:])
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        while tag in CLOSES_P and self.stack and self.stack[-1][3]:
            self.close_to(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == "p"))
        shut, stop = CLOSES.get(tag, ((), ()))
        while any(self.open[t] for t in shut):
            k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] in shut or self.stack[k][0] in stop)
            if self.stack[k][0] in stop:
                break
            self.close_to(k)
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        a, (node, inside) = dict(attrs), self.here()
        mark = "noise" if inside == "noise" else mark_of(tag, a, inside) or inside
        if mark != inside and tag in INLINE:
            self.flush()
        if not (tag in INLINE and mark == inside):
            node = number(str(node), tag, *sorted(words_of(a)))
        ps = 0 if tag in BARRIERS else (self.stack[-1][3] if self.stack else 0) + (tag == "p")
        self.stack.append((tag, node, mark, ps))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open[tag]:
            k = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag)
            if tag in INLINE and any(e[0] not in INLINE for e in self.stack[k + 1:]):
                del self.stack[k]
                self.open[tag] -= 1
            else:
                self.close_to(k)
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        here = self.here()
        if self.at is not None and self.at[1] != here[1]:
            self.flush()
        if self.at is None:
            self.at = here
        self.parts.append(data)


def number(*parts):
    return xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "replace")) - 2**63


def blocks(html):
    """(node number, mark, text): unmarked blocks beside a marked article are `beside`."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    main = any(m == "main" for _, m, _ in p.blocks)
    out = [(node, m or ("beside" if main else ""), text) for node, m, text in p.blocks]
    return [(number(str(node), m), m, text) for node, m, text in out]


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with their blocks and, for each node, what it holds on the page."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 64):
                some = b.iloc[at:at + 64]
                every, nodes = [], []
                for html in some.html:
                    found, by = blocks(html), {}
                    for node, mark, text in found:
                        by.setdefault((node, mark), []).append(text)
                    every.append([{"node": n, "text": t} for n, _, t in found])
                    nodes.append([{"node": n, "mark": m, "content": number(*texts), "style": number(*(str(len(t.split())) for t in texts))} for (n, m), texts in by.items()])
                yield pd.DataFrame({"page_id": some.page_id.astype("Int64"), "url": some.url, "host": some.host, "page": some.page, "blocks": every, "nodes": nodes})

    return pages.select("page_id", "url", "host", "page", "html").mapInPandas(run, "page_id long, url string, host string, page long, blocks array<struct<node: long, text: string>>, nodes array<struct<node: long, mark: string, content: long, style: long>>")


def importance(seen: DataFrame, least: int = 3, prior: int = 6) -> DataFrame:
    """(host, node, mark, importance) from the entropy of contents and styles over a host's different pages."""
    once = seen.groupBy("host", "node", "mark", "page").agg(F.min("content").alias("content"), F.min("style").alias("style"))
    kinds = once.select("host", "node", "mark", F.explode(F.array(F.struct(F.lit("content").alias("kind"), F.col("content").alias("v")), F.struct(F.lit("style").alias("kind"), F.col("style").alias("v")))).alias("x"))
    counts = kinds.groupBy("host", "node", "mark", "x.kind", "x.v").agg(F.count("*").alias("c"))

    def diverse(kind):  # 1 - sum(c ln c) / (m ln m)
        c = F.when(F.col("kind") == kind, F.col("c"))
        return F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(F.sum(c * F.ln(c)), F.sum(c) * F.ln(F.sum(c)))), F.lit(1.0))

    per = counts.groupBy("host", "node", "mark").agg(F.sum(F.when(F.col("kind") == "content", F.col("c"))).alias("m"), diverse("content").alias("content"), diverse("style").alias("style"))
    entropy = F.when(F.col("m") < least, F.lit(1.0)).otherwise(0.1 * F.col("style") + 0.9 * F.col("content"))
    weighed = F.when(F.col("mark") == "", entropy).when(F.col("mark") == "main", (prior + F.col("m") * entropy) / (prior + F.col("m"))).otherwise(0.2 * entropy)
    return per.select("host", "node", "mark", weighed.alias("importance"))


def extract(pages: DataFrame, threshold: float = 0.4, broadcast_nodes: int = 200_000, least: int = 3, prior: int = 6) -> DataFrame:
    """page_id, url, text of every page. The removed branches are broadcast if few, else joined page by page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"))
    out = shared_dir(pages.sparkSession)
    parsed(rows.withColumn("page", F.xxhash64("html"))).write.parquet(out)
    pages = pages.sparkSession.read.parquet(out)
    seen = pages.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*")
    low = importance(seen, least, prior).where(F.col("importance") < threshold).select("host", "node").checkpoint()
    if low.count() <= broadcast_nodes:
        gone = low.groupBy("host").agg(F.collect_set("node").alias("gone"))
        met = pages.join(F.broadcast(gone), "host", "left")
    else:
        gone = seen.select("host", "page", "node").distinct().join(low, ["host", "node"]).groupBy("host", "page").agg(F.collect_set("node").alias("gone"))
        met = pages.join(gone, ["host", "page"], "left")
    kept = F.when(F.isnull("gone"), F.col("blocks")).otherwise(F.filter("blocks", lambda b: ~F.array_contains("gone", b.node)))
    return met.select("page_id", "url", F.concat_ws("\n\n", F.transform(kept, lambda b: b.text)).alias("text"))


def op7_html_extraction(spark, sf_dir) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
