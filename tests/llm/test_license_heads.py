"""The licence scan normalises a line or block only if its first words begin a known text, with the same rows as without that."""

import random

from pyspark.sql import functions as F

PIECES = ["copyright", "Copyright (c) 2020 A", "(C)", "©", "copyright holder", "Copyright Holders", "licence", "LICENCED", "sublicence", "élicence", "licencé", "license", "the", "MIT", "a_b", "ΑΣ", "Σ", "İ", "ﬁ", "привет", "😀", "𝒜", "5", "-", " ", "  ", "\t", "\n", "\r\n", "\r", "\n \t\n", "\n\n", "\x0b", "\f", "\x85", "\u2028", "\u2029", "\u0301"]


def plain(text):
    from sitefacts.llm import licenses as x
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^\W*(copyright|\(c\)|©).*$", " ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for a, b in x.SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.sha2(out, 256)


def plain_scan(docs, known):
    """Whole texts, lines and blocks, each normalised and looked up."""
    names = {}
    for digest, name in known.select(plain(F.col("text")), "license").collect():
        names[digest] = min(name, names.get(digest, name))
    parts = F.concat(F.split("text", r"\R"), F.split("text", r"\R[ \t]*\R"))
    found = {}
    for i, digest in docs.select("doc_id", F.explode(parts).alias("part")).where("part <> ''").select("doc_id", plain(F.col("part"))).collect():
        if digest in names:
            found.setdefault(i, set()).add(names[digest])
    return {(i, d, names.get(d), ",".join(sorted(found[i])) if i in found else None) for i, d in docs.select("doc_id", plain(F.col("text"))).collect()}


def test_only_parts_with_a_known_beginning_are_normalised(spark):
    from sitefacts.llm import licenses as x
    docs = spark.createDataFrame([(1, "Some words.\nMore words")], "doc_id long, text string")
    lines = x.scan(docs, x.known(spark))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in lines if "Filter" in line and "regexp_replace" in line]  # would do the work twice
    digests, joins, made = ([i for i, line in enumerate(lines) if all(w in line for w in words)] for words in (("AS digest", "part#"), ("Join Inner, (head",), ("Generate",)))
    assert len(digests) == len(joins) == len(made) == 1 and digests < joins < made  # a plan reads from its end


def test_odd_texts_have_the_rows_of_a_plain_scan(spark):
    from sitefacts.llm import licenses as x
    draw = random.Random(7)
    texts = ["".join(draw.choice(PIECES) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate([None, "", "---", "© x\n---", *texts])), "doc_id long, text string")
    known = spark.createDataFrame([(f"L{i % 40:02}", t) for i, t in enumerate(["".join(draw.choice(PIECES) + draw.choice([" ", "\n"]) for _ in range(draw.randint(1, 4))) for _ in range(600)] + texts[:60])], "license string, text string")
    want = plain_scan(docs, known)
    assert sum(r[2] is not None for r in want) > 100 and sum(r[3] is not None for r in want) > 500
    assert {tuple(r) for r in x.scan(docs, known).collect()} == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # a known table too large to be sent to every task
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert {tuple(r) for r in x.scan(docs, known).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
