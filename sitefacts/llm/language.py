"""Language identification with a bit-sliced Bloom filter: a slot holds one bit a language.

The bits of an n-gram's slots are ANDed to the set of languages that contain it. Per language the hits are
counted, corrected by the share of filled slots (false positives), and the largest rate decides; ties go to
the first language by name. Fitting reads at most `most` labelled rows a language, chosen by hash, and keeps
n-grams seen in at least a `share` of them, one at least. Null texts and texts without a letter: `und`, score 0. With no
labelled rows every text is `und`. A slot has as
many 64-bit words as the languages need. Further columns are ignored.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N, SLOTS, HASHES = 4, 1 << 18, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LETTER = re.compile(r"[^\W\d_]")


def grams(text):
    """A 64-bit number for every run of N bytes of the lower-cased letters."""
    b = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - N + 1), np.uint64)
    for i in range(N):
        out = out * np.uint64(257) + b[i:len(b) - N + 1 + i]
    return out


class Filter:
    def __init__(self, by_language):
        self.names = sorted(by_language)
        self.table = np.zeros((-(-len(self.names) // 64), SLOTS), np.uint64)
        for i, name in enumerate(self.names):
            for slot in self.slots(np.array(sorted(by_language[name]), np.uint64)):
                self.table[i // 64, slot] |= np.uint64(1 << i % 64)
        filled = [((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.names))]
        self.false = np.array(filled) ** len(HASHES)

    @staticmethod
    def slots(g):
        return [((g * np.uint64(h)) >> np.uint64(46)).astype(np.int64) for h in HASHES]

    def predict(self, text):
        if not text or not LETTER.search(text) or not self.names:
            return "und", 0.0
        g = grams(text)
        bits = np.full((len(self.table), len(g)), ~np.uint64(0))
        for slot in self.slots(g):
            bits &= self.table[:, slot]
        hits = np.array([int(((bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.names))])
        rate = np.clip((hits / max(1, len(g)) - self.false) / np.maximum(1e-9, 1 - self.false), 0, 1)
        k = int(rate.argmax())
        return self.names[k], float(rate[k])


def fit(docs: DataFrame, most: int = 300, share: float = 0.05) -> Filter:
    rows = docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2) & F.col("lang").isNotNull())
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    first = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= most).select("doc_id").distinct()
    seen, texts = {}, Counter()
    once = rows.join(F.broadcast(first), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    for r in once.select("lang", "text").toLocalIterator():  # at most `most` a language
        texts[r.lang] += 1
        seen.setdefault(r.lang, Counter()).update(np.unique(grams(r.text or "")).tolist())
    return Filter({k: [g for g, n in c.items() if n >= share * texts[k]] or list(c) for k, c in seen.items()})


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return docs.withColumn("g", guess("text")).select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).alias("held_out"), "g.lang_pred", "g.score")


def op9_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
