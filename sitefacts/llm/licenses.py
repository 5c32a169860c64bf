"""License scan by canonical digest: whole texts, blocks and lines are normalised and their SHA-256 looked up by joins.

Only blocks and lines that begin with the first words of a known text are normalised whole.

Case, punctuation, white space, copyright lines and equivalent spellings fall away. `license` is that of the whole
text; `notices` lists, sorted and parted by commas, the licences of single lines and of blocks between blank lines.
Null and empty texts have neither, nor have texts that hold a licence amid a line. Repeated rows keep their rows;
further columns are ignored.
"""

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workdir import saved

# Short licence statements and spellings that count as the same.
KNOWN = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
]
TEXTS = Path(__file__).parent / "license_texts"
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("copyright holder", "copyright owner"), ("sublicence", "sublicense")]
HEAD = r"[\p{L}\p{N}]++(?:[^\p{L}\p{N}]++[\p{L}\p{N}]++){0,2}+"


def replaced(rows: DataFrame, name: str, marks, pattern: str, to: str) -> DataFrame:
    """Column `name` after a replacement; only values that hold one of `marks`, as each match does, meet the pattern."""
    value = F.col(name)
    held = reduce(or_, [value.contains(m) for m in marks])
    return rows.withColumn(name, F.when(held, F.regexp_replace(value, pattern, to)).otherwise(value))


def lowered(rows: DataFrame, name: str) -> DataFrame:
    """Column `name` in lower case without copyright lines; null becomes empty."""
    rows = rows.withColumn(name, F.lower(F.coalesce(F.col(name), F.lit(""))))
    return replaced(rows, name, ("copyright", "(c)", "©"), r"(?m)^\W*(copyright|\(c\)|©).*$", " ")


def worded(rows: DataFrame, name: str) -> DataFrame:
    """Column `name`, lowered, as words parted by single spaces, of equivalent spellings one: the canonical form."""
    rows = rows.withColumn(name, F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")))
    for a, b in SPELLINGS:
        rows = replaced(rows, name, (a,), rf"\b{a}\b", b)
    return rows


def headed(rows: DataFrame, name: str) -> DataFrame:
    """`head`, the first three words of lowered column `name`, canonical: equal forms have equal heads, as no spelling adds or drops a word."""
    return worded(rows.withColumn("head", F.regexp_extract(name, HEAD, 0)), "head")


def digested(rows: DataFrame, name: str) -> DataFrame:
    """`digest`, of the canonical form of lowered column `name`; never null, so no join tests that and computes it twice."""
    return worded(rows, name).withColumn("digest", F.coalesce(F.sha2(name, 256), F.lit("")))


def known(spark) -> DataFrame:
    """license, text: the full texts, the permission text of MIT without its title, and the notices."""
    full = [(p.stem, p.read_text("utf-8", "replace")) for p in sorted(TEXTS.glob("*.txt"))]
    bare = [(n, t.split("\n", 1)[1]) for n, t in full if n == "MIT"]
    return spark.createDataFrame(full + bare + KNOWN, "license string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license, notices of every row; `known` has license and text, and joins without a hint: it is written, so Spark knows its size."""
    table = digested(headed(lowered(known.select("license", "text"), "text"), "text"), "text")
    table = saved(table.groupBy("digest").agg(F.min("license").alias("license"), F.min("head").alias("head")))
    rows = digested(lowered(docs.select("doc_id", F.sha2("text", 256).alias("key"), "text"), "text"), "text")
    parts = F.array_union(F.split("text", r"\R"), F.split("text", r"\R[ \t]*\R"))
    parts = docs.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), F.explode(parts).alias("part")).where("part <> ''")
    parts = headed(lowered(parts, "part"), "part").join(table.select("head").distinct(), "head")  # most parts end here
    found = digested(parts, "part").select("key", "digest").join(table.select("digest", "license"), "digest")
    found = found.groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("notices"))
    rows = rows.select("doc_id", "key", "digest").join(table.select("digest", "license"), "digest", "left")
    return rows.join(found, "key", "left").select("doc_id", "digest", "license", "notices")


def op4_license_scan(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known(spark))
