"""The composed grammar against a plain enumeration, and accuracy on rows that the labels learned from leave out."""

import itertools
import random

import pytest

SF = "/root/testdata/sf0.01"


def plain_weight(symbols):
    """The greatest sum over all choices, each insult or threat judged by looking at the whole clause."""
    from sitefacts.llm import toxicity as t
    told, quoted = [], 0
    for s, _ in symbols:
        told.append(quoted)
        quoted = 1 if s == "R" else 1 - quoted if s == "Q" else quoted
    total = 0.0
    for i, (s, value) in enumerate(symbols):
        if s not in "IT":
            continue
        if told[i]:
            total += value * t.FACTORS[s + "'"]
        elif any(x == "N" for x, _ in symbols[max(0, i - t.REACH):i]):
            total += value * t.FACTORS[s + "-"]
        else:
            near = any(x == "Y" for x, _ in symbols[max(0, i - t.NEAR):i + t.NEAR + 1])
            total += value * t.FACTORS[s + "+" * near]
    return total


@pytest.mark.parametrize("seed", range(20))
def test_composition_equals_a_look_at_the_clause(seed):
    from sitefacts.llm import toxicity as t
    rng = random.Random(seed)
    for _ in range(200):
        symbols = [(s, rng.choice([1.0, 2.5]) if s in "IT" else 0.0) for s in rng.choices("oooYNRQIT", k=rng.randrange(14))]
        assert abs(t.best(symbols)[0] - plain_weight(symbols)) < 1e-9, symbols


def test_every_short_clause():
    from sitefacts.llm import toxicity as t
    for word in itertools.product("oYNRQI", repeat=4):
        symbols = [(s, 1.0 if s == "I" else 0.0) for s in word]
        assert abs(t.best(symbols)[0] - plain_weight(symbols)) < 1e-9


def test_clauses_not_words_are_scored():
    from sitefacts.llm import toxicity as t
    lexicon = t.Lexicon({"idiot": (0.0, 2.0), "scum": (1.0, 2.0)})

    def weigh(text):
        return [(round(c[2], 3), c[3]) for c in lexicon.clauses(text)[0]]

    assert weigh("you are an idiot.") == [(2.8, ["I+"])] and weigh("that idiot over there by the wall. you go") == [(2.0, ["I"])]
    assert weigh("you are not an idiot") == [(0.5, ["I-"])] and weigh("she said you are an idiot") == [(1.0, ["I'"])]
    assert weigh('the word "idiot" has roots') == [(1.0, ["I'"])] and weigh("i will kill you") == [(3.0, ["T+"])]
    assert weigh("scummy people; idiotic, scum") == [(1.0, ["I"]), (2.0, ["I"])] and lexicon.clauses("a clean text") == ([], 0)
    start, end, *_ = lexicon.clauses("fine here.\nyou scum! bye")[0][0]
    assert "fine here.\nyou scum! bye"[start:end] == "you scum!"


def test_held_out_rows(spark):
    from sitefacts.llm import toxicity
    got = toxicity.op11_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    caught = [r.predicted for r in got if r.toxic == 1]
    assert len(got) > 500 and sum(caught) / len(caught) > 0.9
    assert sum(r.predicted for r in got if r.toxic == 0) / len(got) < 0.01


def test_labels_of_held_out_rows_and_other_columns_have_no_say(spark):
    from pyspark.sql import functions as F

    from sitefacts.llm import toxicity
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs.withColumn("lang", F.lit(x)).withColumn("toxic", F.lit(x)), l) for x, l in (("a", labels), ("b", turned)))
    assert a.lexicon.stems == b.lexicon.stems
    texts = [r.text for r in docs.select("text").limit(200).collect()]
    assert [round(a.score(t), 2) for t in texts] == [round(b.score(t), 2) for t in texts]


def test_edge_rows(spark):
    from sitefacts.llm import toxicity
    rows = [(None, None), (None, "you idiot"), (1, ""), (2, "idiot " * 200_000), (2, "you idiot"), (2, "you idiot")]
    df = spark.createDataFrame([(*r, 0.1, "c") for r in rows], "doc_id long, text string, toxic double, clauses string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.classify(df, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.text == "you idiot"}) == 1
    assert {r.predicted for r in out if not r.text} == {0} and {r.predicted for r in out if r.text == "you idiot"} == {1}
    assert toxicity.classify(df.limit(0), toxicity.fit(df.limit(0), labels.limit(0))).count() == 0
    assert [len(r.clauses) for r in toxicity.matches(df.drop("clauses"), model).orderBy("text").collect()] == [0, 0, 1, 1, 1, 1]
