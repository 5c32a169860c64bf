"""Nulls, empty and long texts, repeats, empty tables and clashing columns."""

import time

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, key string, fp string, component string"


def rows():
    base = [(None, None), (None, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (1, "quite another text under the same number"), (2, ""), (2, ""), (3, "one two three four five six"), (4, "x " * 30_000)]
    return [(d, t, None if i % 3 else "en", None if i % 2 else "s", 0.25, "k", "f", "c") for i, (d, t) in enumerate(base)]


def test_chat_machine_judges_turn_order(spark):
    from sitefacts.llm import chat
    turns = {1: ["system", "user", "assistant"], 2: ["user"], 3: ["assistant", "user"], 4: ["user", "user"], 5: ["system"], 6: ["user", "robot"], 7: [None], 8: ["user", "assistant", "system"]}
    df = spark.createDataFrame([(c, i, r, None if c == 2 else "t", "x") for c, rs in turns.items() for i, r in enumerate(rs)] + [(2, 1, "assistant", "same", "x"), (2, 1, "assistant", "same", "x")], "conv_id long, turn int, role string, text string, valid string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False}
    assert [(t.role, t.text) for t in got[2].turns] == [("user", ""), ("assistant", "same"), ("assistant", "same")] and got[2].loss_text == "samesame"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_stages_keep_rows_and_columns(spark):
    import corpus_pipeline as p
    docs = spark.createDataFrame(rows(), DOCS)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        got = sorted(((r.doc_id, r.text, r.score, r.key) for r in out.collect()), key=repr)
        if name == "near_duplicates":
            assert [g[:2] for g in got] == sorted([(None, "alpha beta gamma delta epsilon"), (1, rows()[2][1]), (1, rows()[3][1]), (2, ""), (4, "x " * 30_000)], key=repr)
        elif name != "quality":
            assert got == sorted(((r[0], r[1], r[4], r[5]) for r in rows()), key=repr), name
        assert all(g[2:] == (0.25, "k") for g in got)
    assert p.packed(spark, docs, SF).count() >= len(rows())


def test_simhash_rows(spark):
    from sitefacts.llm import simhash
    docs = spark.createDataFrame(rows(), DOCS)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert len(got) == len(rows()) and (3, 1) in got and got.count((2, 2)) == 2 and (None, None) in got and (None, 2) in got
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_others_on_edge_rows(spark):
    from sitefacts.llm import decontaminate, language, licenses, media, pii, quality
    docs = spark.createDataFrame(rows(), DOCS)
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.matched) for r in found.collect()) == [(1, 1, 6), (3, 1, 6)]
    assert decontaminate.contaminated(docs, bench, broadcast_rows=0).count() == 2 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert language.identify(docs, language.fit(docs)).count() == len(rows()) and language.identify(docs, language.fit(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"
    assert licenses.scan(docs, licenses.known(spark)).count() == len(rows()) and licenses.scan(docs.limit(0), licenses.known(spark)).count() == 0
    assert pii.detect(docs).count() == len(rows()) and pii.detect(docs.limit(0)).count() == 0
    assert media.sequences(docs.withColumnRenamed("text", "html")).count() == len(rows())


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "@", "1" * 1_000_000 + ".", "@" + "a.b" * 300_000, "+" + "(1" * 500_000, "1.1.1" * 200_000])
def test_long_runs_take_linear_time(text):
    from sitefacts.llm import pii
    began = time.time()
    pii.find(text)
    assert time.time() - began < 10


def test_quality_fits_on_long_labelled_texts(spark):
    from sitefacts.llm import quality
    good, bad = "the quick brown fox jumps over the lazy dog and runs home. ", "zq$ xx## buy 99 kkk!! "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * (700 if i < 4 else 20 + i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
