"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Every stage but the last returns the columns of its input, whatever further ones there are. Null and empty texts and
repeated rows go through; an empty table gives an empty one. Rows are told apart by doc_id and text.
"""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from sitefacts.llm import decontaminate, nearcopies, packing, pii, quality


def whole(docs):
    """The rows as one struct, beside doc_id and text, so that operators' columns can't clash with them."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def good(spark, docs, sf_dir):
    """Documents that the classifier predicts good."""
    scorer = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(whole(docs), scorer).where("predicted = 1").select("row.*")


def one_of_each(spark, docs, sf_dir):
    """One row of each group of near copies, that with the least doc_id (null last)."""
    return nearcopies.one_of_each(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents without a verified overlap with a benchmark item; two texts of one doc_id are judged apart."""
    named = whole(docs).withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    found = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return named.join(found, named.doc_id.eqNullSafe(found.doc_id), "left_anti").select("row.*")


def masked(spark, docs, sf_dir):
    """All documents, found spans replaced by their kind; n_chars follows where there is such a column."""
    out = pii.redact(docs)
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def packed(spark, docs, sf_dir):
    """Pieces of all documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("pii", masked), ("packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), packing.shared_dir(spark)
    for name, stage in STAGES:
        out = f"{base}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
