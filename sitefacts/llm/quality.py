"""Quality by compression: zstandard dictionaries of good and bad labelled chunks.

A text is cut into chunks and each is compressed with the good, the bad and no dictionary. The features are sizes
only: (bad - good) / (bad + good) over the text, its least value over the chunks, and the three compressed shares
of the length, the last also for the text as a whole. A logistic curve calibrates them. Fitting reads at most
`most` labelled rows a class, `per_row` chunks of each, chosen by hash; every text is scored whole. Null and
empty texts get the curve's value at the mean of the training rows. With one class or none the score is 0.5. A
doc_id with several labels counts as bad if any says so. Further columns are ignored.
"""

import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1024


def chunks(text):
    data = (text or "").encode("utf-8", "replace")
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


class Scorer:
    def __init__(self, good=b"", bad=b""):
        self.good, self.bad, self.weights, self.mean, self.scale, self.made = good, bad, np.zeros(7), np.zeros(6), np.ones(6), None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def features(self, text):
        if self.made is None:
            plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
            self.made = [*(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (self.good, self.bad)), plain]
        parts = chunks(text)
        if not parts:
            return self.mean
        sizes = np.array([[len(c.compress(x)) for c in self.made] for x in parts], float)
        apart, both, n = sizes[:, 1] - sizes[:, 0], sizes[:, 1] + sizes[:, 0], sum(map(len, parts))
        whole = len(self.made[2].compress(b"".join(parts)))
        return np.array([apart.sum() / both.sum(), (apart / both).min(), *(sizes.sum(axis=0) / n), whole / n])

    def score(self, text):
        x = (self.features(text) - self.mean) / self.scale if self.good and self.bad else np.zeros(6)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ x, -30, 30))))


def logistic(X, y, w, ridge=0.5):
    """Weighted ridge regression by Newton steps, halved until the loss falls."""
    def loss(b):
        z = X @ b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + ridge * (b @ b) / 2

    beta = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        step = np.linalg.solve((X * (w * p * (1 - p))[:, None]).T @ X + ridge * np.eye(len(beta)), X.T @ (w * (y - p)) - ridge * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-6:
            step = step / 2
        beta = beta + step
    return beta


def fit(docs: DataFrame, labels: DataFrame, most: int = 600, per_row: int = 4, dictionary: int = 110_000) -> Scorer:
    """Of the rows chosen in each class, one half gives the dictionaries, the other the curve.

    A dictionary holds `per_row` chunks of each text, picked by hash, and of these as many as `dictionary` bytes
    take, again by hash. Texts are cut and measured by tasks; only chunks and features reach the driver. If a doc_id
    has several texts, the least one counts.
    """
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.where(train & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    halves = []
    for q in (0, 1):
        ids = [r.doc_id for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
        ids.sort(key=lambda d: zlib.crc32(str(d).encode()))
        halves.append((ids[:len(ids) // 2], ids[len(ids) // 2:]))
    if not all(some for half in halves for some in half):
        return Scorer()

    def texts(ids):
        return docs.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))

    def content(ids):
        def cut(batches):
            for b in batches:
                yield pd.DataFrame({"chunk": [c for t in b.text for c in sorted(chunks(t), key=zlib.crc32)[:per_row]]})

        picked, room = [], dictionary
        for c in sorted((bytes(r.chunk) for r in texts(ids).mapInPandas(cut, "chunk binary").collect()), key=lambda c: (zlib.crc32(c, 1), c)):
            if len(c) < room:
                picked.append(c)
                room -= len(c) + 1
        return b"\n".join(picked)

    s = Scorer(content(halves[1][0]), content(halves[0][0]))
    if not s.good or not s.bad:
        return Scorer()

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "f": [list(s.features(t)) if t else None for t in b.text]})

    held = [(q, r.f) for q in (0, 1) for r in sorted(texts(halves[q][1]).mapInPandas(measured, "doc_id long, f array<double>").collect(), key=lambda r: r.doc_id) if r.f]
    if len({q for q, _ in held}) < 2:
        return Scorer()
    raw, y = np.array([f for _, f in held]), np.array([q for q, _ in held], float)
    s.mean, s.scale, s.made = raw.mean(axis=0), raw.std(axis=0) + 1e-9, None
    n = [max(1, (y == k).sum()) for k in (0, 1)]
    w = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    s.weights = logistic(np.column_stack([np.ones(len(y)), (raw - s.mean) / s.scale]), y, w / w.mean())
    return s


def classify(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_classifier(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
