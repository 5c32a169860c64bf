"""Target-distribution importance resampling on hashed n-grams, their CRCs from prefixes.

A text is lower-cased (A-Z only), cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` and joined by single spaces.
One scan of this stream stores the running CRC before and after each word. With crc(AB) = shift(crc(A), |B|) ^ crc(B),
where shift multiplies by x^(8 |B|) over GF(2), the CRC of any run of words B follows from the prefixes A and AB
without reading B again. All texts of a batch share one stream; a prefix before a text cancels out like any other.

Weights compare the bucket counts of all documents with those of the target. Scores add Gumbel noise from a hash of
doc_id, so the highest scores are a sample without replacement in proportion to exp(weight). Two scans of the texts;
only one number a bucket (a parameter) passes through the driver, and ranks come from range partitions.

Null and empty texts have no features: weight 0. A null doc_id hashes as the empty string and ranks last among equal
scores. Repeated rows count as often as they occur and are drawn one by one. Very long texts are read whole;
memory grows with the longest text, not with a batch. Without documents there are no rows; without a target all of t and T are 0. Further columns
are ignored.
"""

import hashlib
import math
import re
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.ranks import ranked
from sitefacts.workdir import shared_dir

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
POLYNOMIAL = 0xEDB88320


def _tables(column):
    """Four tables of 256 entries that apply the linear map with these 32 images of single bits."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return [np.bitwise_xor.reduce(np.where(bits, column[8 * k:8 * k + 8], 0), axis=1).astype(np.uint32) for k in range(4)]


def _apply(tables, x):
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shifts():
    """Maps by 1, 2, 4, ... zero bytes; each is the one before it applied twice."""
    column = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(8):
        column = (column >> 1) ^ np.where(column & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out = []
    for _ in range(40):
        tables = _tables(column)
        out.append(tables)
        column = _apply(tables, column)
    return out


SHIFTS = _shifts()


def shift(crc, n):
    """The CRCs moved past `n` more bytes."""
    crc, n = crc.astype(np.uint32, copy=True), n.copy()
    for tables in SHIFTS:
        odd = (n & 1).astype(bool)
        if odd.any():
            crc[odd] = _apply(tables, crc[odd])
        n >>= 1
        if not n.any():
            return crc
    return crc


def _step(crc, piece):
    return zlib.crc32(piece, crc)


def grams(texts, most: int = 1, size: int = 1 << 22):
    """(index of the text, CRC) of every run of 1 to `most` words, as arrays of bounded length; one scan a text."""
    words, owner, length = [], [], 0
    for i, t in enumerate(texts):
        found = WORD.findall(t.encode("utf-8", "replace").lower()) if t else []
        words += found
        owner.append((i, len(found)))
        length += len(t or "")
        if length >= size:
            yield from _crcs(words, owner, most)
            words, owner, length = [], [], 0
    yield from _crcs(words, owner, most)


def _crcs(words, owner, most):
    if not words:
        return
    pieces = [b" "] * (2 * len(words))
    pieces[::2] = words
    running = np.fromiter(accumulate(pieces, _step, initial=0), np.uint32, len(pieces) + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1  # of each word in the stream
    starts = np.concatenate([[0], ends[:-1] + 1])
    before, after = running[:-1:2], running[1::2]
    doc = np.repeat(*np.array(owner).T)
    for n in range(1, most + 1):
        a, b = slice(0, max(0, len(words) - n + 1)), slice(n - 1, None)
        whole = doc[a] == doc[b]
        crc = after[b] ^ shift(before[a], ends[b] - starts[a])
        yield (doc[a], crc) if n == 1 else (doc[a][whole], crc[whole])


def bucket_counts(texts: DataFrame, buckets: int, most: int) -> np.ndarray:
    """Features of the column `text` by bucket; every task adds up its own before the shuffle."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc in grams(b.text, most):
                total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the documents) a bucket."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of `docs`."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most)))

    def score(batches):
        for b in batches:
            n, features, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for i, (doc, crc) in enumerate(grams(b.text, most)):
                got = np.bincount(doc, minlength=len(b))
                n += got if i % most == 0 else 0  # runs of one word come first
                features += got
                weight += np.bincount(doc, weights=gain.value[crc % buckets], minlength=len(b)).astype(np.int64)  # exact below 2^53
            extra = np.array([noise("" if pd.isna(d) else d, seed) for d in b.name], np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "n_words": n, "n_features": features, "weight": weight, "score": weight + extra})

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    return rows.mapInPandas(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **settings) -> DataFrame:
    """The same rows with `rank`: 1, 2, ... for the highest scores of documents of enough words, null if not drawn."""
    out = shared_dir(docs.sparkSession)
    weigh(docs, target, **settings).write.parquet(out)  # the texts are not scanned again for the bounds of the ranges
    rows = docs.sparkSession.read.parquet(out).withColumn("fit", F.col("n_words") >= least_words)
    order: list[Column] = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = ranked(rows, order, "place")
    drawn = percent * placed.where("fit").count() // 100
    return placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place", "fit")


def op13_importance_resampling(spark, sf_dir) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["text"])))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# A CRC bit by bit, table first: every distinct word is hashed whole, without prefixes.
ORACLE = r"""
WITH bit AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS l FROM bit),
runs AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS MATERIALIZED (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM runs)),
crcs AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda j:
    16 * (CAST(instr('0123456789ABCDEF', x[2 * j + 1]) AS BIGINT) - 1) + CAST(instr('0123456789ABCDEF', x[2 * j + 2]) AS BIGINT) - 1)),
    lambda c, y: xor(c >> 8, l[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, tab),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs JOIN crcs USING (w) GROUP BY bucket),
sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, sums),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM runs JOIN crcs USING (w) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
h AS (SELECT doc_id, '0123456789abcdef' AS hexes, sha256('2024:' || doc_id) AS x FROM documents),
scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda j: CAST(instr(hexes, x[j]) AS BIGINT) - 1)), lambda a, b: a * 16 + b) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM h LEFT JOIN d USING (doc_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fits FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fits // 100 THEN place END AS rank FROM placed"""
