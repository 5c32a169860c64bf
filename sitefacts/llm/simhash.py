"""SimHash near-duplicates: sharded BK-trees and connected components.

Of any b blocks of a fingerprint, two fingerprints within `radius` bits agree in at least b - radius. So every choice
of that many blocks is a table, each value in it a shard, and links are sought in the BK-tree of every shard, whose
edges are followed only within the radius. b grows with the number of fingerprints, so that shards stay small. A
shard of over `most` fingerprints is cut into parts, and each part's tree meets each other part alone, so no task
holds more than two parts. Trees meet their queries by a shuffle on the shard: a broadcast would pass all
fingerprints through the driver. Null or empty text: fingerprint zero, linked like any other. Repeated rows keep
their rows. A null doc_id takes part in links but never names a component (which is null if all its ids are). An
empty table has no rows. Further columns are ignored.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import shared_dir


def fingerprint_of(h) -> int:
    """A bit is 1 if set in over half of these 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text, size=4) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data, lens = b" ".join(words), np.fromiter(map(len, words), np.int64)
    ends = np.cumsum(lens + 1) - 1
    k = min(size, len(words))
    starts, stops = (ends - lens)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    return fingerprint_of(np.array([xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, stops)], "<u8"))


def _fingerprints(batches):
    for b in batches:
        yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "fp": np.array([fingerprint(t) for t in b.text], "<u8").view("<i8")})


class BKTree:
    """Children of a node are keyed by their distance from it; a node lists the items with its fingerprint."""

    def __init__(self):
        self.root, self.children, self.items = None, {}, {}

    def add(self, x, item):
        if x in self.items:
            self.items[x].append(item)
            return
        self.items[x], self.children[x] = [item], {}
        if self.root is None:
            self.root = x
            return
        at = self.root
        while (d := (at ^ x).bit_count()) in self.children[at]:
            at = self.children[at][d]
        self.children[at][d] = x

    def near(self, x, radius):
        """(distance, items) of every node within the radius."""
        todo = [self.root] if self.root is not None else []
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                yield d, self.items[at]
            if kids := self.children[at]:
                todo += [c for e, c in kids.items() if d - radius <= e <= d + radius]


def groups(batches, keys):
    """Runs of rows with equal keys, as frames; rows come sorted by them."""
    held = []
    for b in batches:
        if not len(b):
            continue
        values = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        if held and (held[-1][keys].to_numpy()[-1] != values[0]).any():
            yield pd.concat(held)
            held = []
        for low, high in zip(cuts[:-2], cuts[1:-1]):
            if held:
                yield pd.concat([*held, b.iloc[low:high]])
                held = []
            elif high - low > 1:  # a row alone has no partner
                yield b.iloc[low:high]
        held.append(b.iloc[cuts[-2]:])
    if held:
        yield pd.concat(held)


def parts(shards: DataFrame, names: list, most: int) -> DataFrame:
    """Rows of shards with at least two rows, dealt to pairs of parts (i, j): i makes the tree, j asks it."""
    weight = F.sum("n") / 1000 if "n" in shards.columns else F.lit(0)
    sizes = shards.groupBy(*names).agg(F.count("*").alias("n_"), weight.alias("w_")).where("n_ > 1").select(*names, F.ceil(F.greatest("n_", "w_") / most).alias("cuts"))
    cut = shards.join(sizes, names).withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("cuts")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("role", (F.col("own") != F.col("i")).cast("int"))
    return met.drop("own", "other", "cuts")


def together(met: DataFrame, names: list) -> DataFrame:
    return met.repartition(*names, "i", "j").sortWithinPartitions(*names, "i", "j", "role", "fp")


def meetings(frame, radius):
    """(row, distance, rows of the tree) of every query of one pair of parts."""
    tree, one = BKTree(), frame.i.iloc[0] == frame.j.iloc[0]
    for row, fp, role in zip(range(len(frame)), frame.fp.to_numpy().view("<u8").tolist(), frame.role.tolist()):
        if one or role == 1:
            for d, items in tree.near(fp, radius):
                yield row, d, items
        if one or role == 0:
            tree.add(fp, row)


def _forest(names, radius, batches):
    """A spanning forest of each pair of parts: at most as many links as rows."""
    for frame in groups(batches, [*names, "i", "j"]):
        fps, up = frame.fp.tolist(), list(range(len(frame)))

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        links = []
        for row, _, items in meetings(frame, radius):
            a, b = top(row), top(items[0])
            if a != b:
                up[a] = b
                links.append((fps[row], fps[items[0]]))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) rows to (node, root) by alternating large-star and small-star, a checkpoint a round."""
    edges, before = links.select("a", "b").where("a <> b").distinct().checkpoint(), None
    while True:
        both = edges.union(edges.select("b", "a"))
        m = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = down.join(m, "a").select(F.explode(F.array(F.struct(F.col("a").alias("n"), "m"), F.struct(F.col("b").alias("n"), "m"))).alias("x")).select(F.col("x.n").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` with the columns of their key's only row in `table`. Keys of over 1/1000 of the rows, of which there
    are at most 1000, are joined by broadcast, the others by a shuffle, so no key fills a task."""
    names, total = [c for c in table.columns if c != key], rows.count()
    hot = rows.groupBy(key).count().where(F.col("count") > max(1, total / 1000)).select(key).join(table, key)
    hot = hot.select(F.col(key), F.struct(*names).alias("hot_"))
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.where("hot_ IS NULL").drop("hot_").join(table, key, "left")
    return met.where("hot_ IS NOT NULL").select(*rows.columns, *[F.col(f"hot_.{c}").alias(c) for c in names]).unionByName(cold)


def named(each: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, component, component_id): the least key and doc_id of each key's component; `each` has key and least."""
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    met = each.join(every, F.col("key") == F.col("node"), "left").select("key", "least", F.col("root").alias("component"))
    linked = met.where("component IS NOT NULL").checkpoint()
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    alone = met.where("component IS NULL").select("key", F.col("key").alias("component"), F.col("least").alias("component_id"))
    return alone.unionByName(look_up(linked, least, "component").select("key", "component", "component_id"))


def block_masks(n: int, most: int, radius: int) -> list:
    """The tables for n fingerprints: bits that two fingerprints within the radius share in at least one of them."""
    blocks = next(b for b in range(radius + 1, radius + 9) if n >> 64 * (b - radius) // b <= most or b == radius + 8)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(kept) for kept in combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_duplicates(docs: DataFrame, radius: int = 4, most: int = 4000, masks: list | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    spark, out = docs.sparkSession, shared_dir(docs.sparkSession)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_fingerprints, "doc_id long, fp long").write.parquet(out)
    fps = spark.read.parquet(out)
    each = fps.groupBy(F.col("fp").alias("key")).agg(F.min("doc_id").alias("least")).checkpoint()
    masks = masks or block_masks(each.count(), most, radius)
    shard = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("key").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])).alias("s")
    shards = each.select("key", F.col("key").alias("fp"), shard).select("key", "fp", "s.table", "s.value")
    names = ["table", "value"]
    links = together(parts(shards, names, most), names).mapInPandas(lambda it: _forest(names, radius, it), "a long, b long")
    least = named(each, components(links)).checkpoint()
    return look_up(fps, least.select(F.col("key").alias("fp"), "component_id"), "fp")


def op5_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
