"""Near copies by SimHash BK-trees with exact verification of every link.

A text is its set of `size`-word shingles (lower-cased, split at white space; the whole text if shorter). Two texts
are linked if the Jaccard similarity of their sets is at least `similarity`. Candidates: `orders` random orders of
shingles each put a text into the shard of its two least ones, which two texts of similarity 0.8 share with
probability 0.64 an order (0.998 for six); a shard's BK-tree holds 64-bit fingerprints of all shingles of its texts,
and over 0.999 of such texts are within `radius` 20 of them and agree in 40 of 64 least hash values. So a link is
missed with a probability of about 0.004. All further candidates are verified by exact similarity where they are
found, once, unless the task knows them to be connected already; only a spanning forest leaves a task. So a group of
copies costs no pairs, and a group of texts that are alike but not similar costs comparisons in memory, no rows. A
shard of over `most` texts or `most` * 1000 shingles is cut into parts that meet pair by pair. Texts of equal words
(also null and empty ones) are copies. Repeated rows keep their rows; null doc_ids never name a component; an empty
table has no rows; further columns are ignored.
"""

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .packing import shared_dir
from .simhash import components, fingerprint_of, groups, look_up, meetings, named, parts, together

SEEDS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text, size=5):
    """(hash of the words, sorted distinct hashes of their shingles; none wanted if size is 0)"""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0, np.zeros(0, np.int64)
    data, lens = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    if not size:
        return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(data, 7)))), lens
    ends, k = np.cumsum(lens + 1) - 1, min(size, len(words))
    starts, stops = (ends - lens)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    h = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts, stops)], "<u8").view("<i8")
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(data, 7)))), np.unique(h)


def samples(sh, orders):
    """A number for the two least shingles of every order."""
    out, values = [], sh.view(np.uint64)
    for seed in SEEDS[:orders]:
        mixed = values * seed
        mixed ^= mixed >> np.uint64(29)
        out.append(xxhash.xxh3_64_intdigest(np.sort(np.partition(mixed, 1)[:2] if len(mixed) > 2 else mixed).tobytes()) - 2**63)
    return out


def least_values(sh):
    """The highest byte of the least of the shingles' hashes by each of 64 functions."""
    out = np.full(len(SEEDS), ~np.uint64(0))
    for i in range(0, len(sh), 2048):
        np.minimum(out, (sh[i:i + 2048].view(np.uint64)[:, None] * SEEDS).min(axis=0), out=out)
    return xxhash_bytes(out)


def xxhash_bytes(values):
    """A byte of each value, spread evenly."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


@tidy
def _sketches(size, orders, batches):
    for b in batches:
        for i in range(0, len(b), 500):
            rows = []
            for doc_id, text in zip(b.doc_id[i:i + 500], b.text[i:i + 500]):
                key, sh = shingles(text, size)
                rows.append((doc_id, key, len(sh), fingerprint_of(sh.view("<u8")) if len(sh) else 0, samples(sh, orders) if len(sh) else [], least_values(sh)))
            out = pd.DataFrame(rows, columns=["doc_id", "key", "n", "fp", "samples", "least"]).astype({"doc_id": "Int64"})
            yield out.assign(fp=out.fp.to_numpy("<u8").view("<i8"))


@tidy
def _sets(size, orders, batches):
    for b in batches:
        for i in range(0, len(b), 100):
            some = [shingles(t, size)[1] for t in b.text[i:i + 100]]
            yield pd.DataFrame({"key": b.key[i:i + 100].to_numpy(), "samples": [samples(sh, orders) for sh in some], "sh": some})


def likely(frame, radius, similarity):
    """(row, rows of the tree, the nearest first) where fingerprint, size and least values allow the similarity."""
    agree, n = math.ceil(len(SEEDS) * (similarity - 0.18)), frame.n.to_numpy()
    least = np.frombuffer(b"".join(frame.least), np.uint8).reshape(-1, len(SEEDS))

    def kept(row, found):
        at = np.array([x for _, items in sorted(found, key=lambda f: f[0]) for x in items])
        at = at[np.minimum(n[at], n[row]) >= similarity * np.maximum(n[at], n[row]) - 1e-9]
        return at[(least[at] == least[row]).sum(axis=1) >= agree]

    last, found = None, []
    for row, d, items in meetings(frame, radius):
        if row != last and found:
            yield last, kept(last, found)
            found = []
        last = row
        found.append((d, items[:]))
    if found:
        yield last, kept(last, found)


@tidy
def _plausible(names, radius, similarity, batches):
    """The rows that have a likely partner in their shard."""
    for frame in groups(batches, [*names, "i", "j"]):
        some = np.zeros(len(frame), bool)
        for row, at in likely(frame, radius, similarity):
            some[at] = True
            some[row] |= len(at) > 0
        if some.any():
            yield frame[some]


@tidy
def _forest(names, radius, similarity, batches):
    """Verified links of each pair of parts, a spanning forest of them."""
    for frame in groups(batches, [*names, "i", "j"]):
        key, n, k, sets, up, links = frame.key.tolist(), frame.n.tolist(), frame.k.iloc[0], frame.sh.tolist(), list(range(len(frame))), []
        samples = np.array(frame.samples.tolist())

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for row, at in likely(frame, radius, similarity):
            if k and len(at):  # the pair's first common shard alone decides
                at = at[~(samples[at, :k] == samples[row, :k]).any(axis=1)]
            for x in at.tolist():
                if (a := top(row)) != (b := top(x)):
                    same = len(np.intersect1d(sets[row], sets[x], assume_unique=True))
                    if same >= math.ceil(similarity * (n[row] + n[x] - same) - 1e-9):
                        up[a] = b
                        links.append((key[row], key[x]))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])


def text_key(column):
    """A hash of the text's words."""
    @F.pandas_udf("long")
    def key(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, 0)[0] for t in text], dtype="int64")

    return key(column)


def met_by(rows: DataFrame, keys: DataFrame, bits: int = 26) -> DataFrame:
    """Rows whose key is among `keys`. A broadcast bitmap of 2**bits hash values (2**(bits-6) rows at most, whatever
    the data) lets most other rows drop out before the join shuffles them."""
    h = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    words = keys.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("set"))
    some = rows.withColumn("h", h).withColumn("word", F.shiftright("h", 6)).join(F.broadcast(words), "word")
    some = some.where(F.expr("shiftrightunsigned(set, cast(h & 63 as int)) & 1 = 1")).select(*rows.columns)
    return some.join(keys, "key", "left_semi")


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, orders: int = 6, radius: int = 20, most: int = 4000) -> DataFrame:
    """The rows' doc_id, key of the text, component (its least key) and component_id (its least doc_id)."""
    spark, out, names = docs.sparkSession, shared_dir(docs.sparkSession), ["k", "sample"]
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda it: _sketches(size, orders, it), "doc_id long, key long, n long, fp long, samples array<long>, least binary").write.parquet(out)
    rows = spark.read.parquet(out)
    each = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
    shards = rows.where("n > 0").dropDuplicates(["key"]).select("key", "n", "fp", "least", F.posexplode("samples").alias("k", "sample"))
    dealt = together(parts(shards, names, most), names)
    met = dealt.mapInPandas(lambda it: _plausible(names, radius, similarity, it), dealt.schema).checkpoint()
    texts = met_by(docs.select(text_key("text").alias("key"), "text"), met.select("key").distinct()).dropDuplicates(["key"])
    sets = texts.mapInPandas(lambda it: _sets(size, orders, it), "key long, samples array<long>, sh array<long>")
    links = together(met.join(sets, "key"), names).mapInPandas(lambda it: _forest(names, radius, similarity, it), "a long, b long")
    ids = named(each, components(links)).checkpoint()
    return look_up(rows.select("doc_id", "key"), ids, "key")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of every component: the one with the least doc_id, nulls last, then the least key."""
    ids = near_copies(docs, **how).checkpoint()
    first = ids.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "key")).alias("w")).select("w.doc_id", "w.key")
    again = ids.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key", F.lit(True).alias("again"))
    same = lambda x, y: x.doc_id.eqNullSafe(y.doc_id) & (x.key == y.key)
    first = first.join(again, same(first, again), "left").select(first.doc_id, first.key, F.coalesce("again", F.lit(False)).alias("again")).checkpoint()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"))

    def kept(again):
        some = first.where(F.col("again") == again)
        return rows.join(some, same(rows, some), "left_semi")

    return kept(False).unionByName(kept(True).dropDuplicates(["doc_id", "key"])).select("row.*")
