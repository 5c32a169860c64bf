"""Prefix CRCs against zlib, and the whole draw against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode("utf-8", "replace").lower())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 -.éß漢\n", max_size=60)), max_size=8), st.integers(1, 4), st.sampled_from([1, 40, 1 << 22]))
def test_prefixes_give_the_crc_of_every_run(texts, most, size):
    from sitefacts.llm import importance
    got = Counter((int(d), int(c)) for doc, crc in importance.grams(texts, most, size) for d, c in zip(doc, crc))
    want = Counter((i, zlib.crc32(b" ".join(w[j:j + n]))) for i, w in enumerate(map(words, texts)) for n in range(1, most + 1) for j in range(len(w) - n + 1))
    assert got == want


def plain(docs, target, buckets, percent):
    def count(texts):
        return Counter(zlib.crc32(w) % buckets for t in texts for w in words(t))

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        own = [zlib.crc32(w) % buckets for w in words(text)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[:percent * len(fit) // 100]
    left = Counter(rows) - Counter(drawn)
    return sorted([(*r, i) for i, r in enumerate(drawn, 1)] + [(*r, None) for r in left.elements()], key=repr)


def test_draw_equals_plain_version(spark):
    from sitefacts.llm import importance
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = importance.op13_importance_resampling(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, 10_000, 10)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5


def test_edge_rows(spark):
    from sitefacts.llm import importance
    docs = [(None, None), (None, "alpha " * 25), (1, ""), (1, "beta " * 30), (2, "beta " * 30), (2, "beta " * 30), (3, "- . !"), (4, "x " * 300_000)]
    df = spark.createDataFrame([(*d, "s", 0.5, "r") for d in docs], "doc_id long, text string, score string, weight double, rank string")
    bench = spark.createDataFrame([(1, "beta gamma"), (2, None)], "item_id long, text string")
    got = importance.resample(df, bench, percent=60).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain(docs, ["beta gamma", None], 10_000, 60)
    assert sorted(map(tuple, got), key=repr) == want
    assert importance.resample(df.limit(0), bench).count() == 0 and importance.resample(df, bench.limit(0)).count() == len(docs)
    more = importance.weigh(df, bench, buckets=97, most=3).where("doc_id = 3 OR doc_id = 4").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_features) for r in more] == [(0, 0), (300_000, 899_997)]
