"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask selects token offsets of a window; the others are ignored. Selected tokens are hashed for every window
of benchmark and documents; equal hashes are hits. Around a hit, the item is laid along the document and the
equal tokens counted: at least `similarity` of the item must agree. Tokens are lower-cased runs of letters and
digits. Items of up to `SHORT` tokens are cut into one run more than the tokens that may differ, so one run always
agrees and no link is missed; longer ones are sought by the masks. Items without tokens, null and empty texts have
no links; repeated rows link alike. Further columns are ignored.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import shared_dir

MASKS = [(0, 1, 3, 4, 6), (0, 2, 3, 5, 6)]
SHORT = 15


def runs(n, similarity):
    """(offset, length) of the runs of a short item."""
    parts = n - math.ceil(similarity * n - 1e-9) + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b]


def tokens(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def windows(words, masks, first=0):
    """An array of (i, h): every window's start and the hash of its selected tokens."""
    span = max(map(max, masks)) + 1
    at = F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(F.array().cast("array<int>"))

    def hashed(k, mask):
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(F.lit(k), *[F.get(words, i + o) for o in mask]).alias("h")))

    return F.flatten(F.array(*[hashed(k, m) for k, m in enumerate(masks, first)]))


def candidates(docs: DataFrame, items: DataFrame, masks, broadcast_rows, similarity) -> DataFrame:
    """(key, found): for each text with hits, by its hash, the distinct (item_id, n, start) to verify."""
    sizes = [r.n for r in items.select(F.size("item").alias("n")).where(f"n BETWEEN 1 AND {SHORT}").distinct().collect()]  # SHORT rows at most
    lengths = sorted({w for n in sizes for _, w in runs(n, similarity)})
    whole = {w: (lambda words, w=w: windows(words, [tuple(range(w))], len(masks) + w)) for w in lengths}
    given = [F.when(F.size("item") > SHORT, windows(F.col("item"), masks))]
    for n in sizes:  # windows are in order of their starts
        given.append(F.when(F.size("item") == n, F.array(*[F.get(whole[w](F.col("item")), F.lit(o)) for o, w in runs(n, similarity)])))
    seeds = items.where("size(item) > 0").select("item_id", F.size("item").alias("n"), F.explode(F.coalesce(*given)).alias("b")).select("item_id", "n", F.col("b.h").alias("h"), F.col("b.i").alias("q"))
    words = docs.select(F.xxhash64("text").alias("key"), tokens(F.col("text")).alias("words"))
    every = F.concat(windows(F.col("words"), masks), *[whole[w](F.col("words")) for w in lengths])
    hashed = words.select("key", F.explode(every).alias("d")).select("key", F.col("d.i").alias("i"), F.col("d.h").alias("h"))
    hits = hashed.join(F.broadcast(seeds) if seeds.count() <= broadcast_rows else seeds, "h")
    return hits.groupBy("key").agg(F.collect_set(F.struct("item_id", "n", (F.col("i") - F.col("q")).alias("start"))).alias("found"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, masks=MASKS, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens): pairs whose overlap is verified.

    Only hits leave the first pass; the second cuts the passages beside them out of the texts. Seeds, items and
    texts with hits are broadcast up to `broadcast_rows` of each (and 100 times as many words or hits in their arrays),
    and joined by a shuffle beyond.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("text <> ''")
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item"))

    def side(df, values):
        """Broadcast if its rows and what their arrays hold are few."""
        rows, held = df.agg(F.count("*"), F.coalesce(F.sum(values), F.lit(0))).first()
        return F.broadcast(df) if rows <= broadcast_rows and held <= 100 * broadcast_rows else df

    found = candidates(docs, items, masks, broadcast_rows, similarity).checkpoint()
    met = docs.withColumn("key", F.xxhash64("text")).join(side(found, F.size("found")), "key").select("doc_id", "found", tokens(F.col("text")).alias("words"))
    cut = F.transform("found", lambda c: F.struct(c.item_id.alias("item_id"), F.greatest(F.lit(0), -c.start).alias("skip"),
        F.slice("words", F.greatest(F.lit(0), c.start) + 1, c.n + F.least(F.lit(0), c.start)).alias("part")))
    parts = met.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.item_id", "c.skip", "c.part")
    laid = F.zip_with("part", F.slice("item", F.col("skip") + 1, F.size("part")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    same = parts.join(side(items, F.size("item")), "item_id").select("doc_id", "item_id", F.size(F.filter(laid, lambda x: x)).cast("long").alias("matched"), F.size("item").cast("long").alias("item_tokens"))
    return same.where(F.col("matched") >= similarity * F.col("item_tokens")).groupBy("doc_id", "item_id", "item_tokens").agg(F.max("matched").alias("matched"))


def op3_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
