import zlib

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def test_chat_matches_sql(spark):
    from sitefacts.llm import chat
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = chat.op2_chat_formatting(spark, SF)
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({chat.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(theirs)


def test_packing_is_gapless_and_exact(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    from sitefacts.llm import packing
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op10_packing(spark, SF).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(ends[s] == 4096 for s in range(max(ends)))
    for doc, text in texts.items():
        ids, at = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_words_give_whole_text_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    from sitefacts.llm import packing
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), packing.Words(path, most=2000)
    odd = ["a\x01b \x01 c", "<|endoftext|> x<|startoftext|>.", "\u00c9 e\u0301. \u03a3\u0391\u03a3. \u0130i \ufb01 it's. don't'll!!  a\tb\r\nc  ", "I'S.'S 'LL. x'. x's, it's.", "", "   ", ".", "..,!!", "\u2260. a\u0301. \u0301 b", 'k = "9f62"### ok".']
    con = duckdb.connect()
    texts = [t or "" for (t,) in con.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    for text in odd + texts:
        assert words.texts([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_simhash_against_all_pairs(spark):
    from sitefacts.llm import simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    ids, up = sorted(want), {d: d for d in want}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (want[i] ^ want[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    expected = {d: (f"{want[d]:016x}", top(d)) for d in ids}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash_near_dedup(spark, SF).collect()} == expected
    for how in ({"most": 3}, {"most": 3, "masks": simhash.block_masks(10**9, 4000, 4)}):
        cut = simhash.near_duplicates(docs, **how).collect()
        assert {r.doc_id: r.component_id for r in cut} == {d: c for d, (_, c) in expected.items()}
    one = spark.sql("SELECT xxhash64('a b c d') AS h").first().h % 2**64
    assert simhash.fingerprint("A b\nc  D") == one


def test_near_duplicate_stage_against_all_pairs(spark):
    import random
    import corpus_pipeline
    rng, texts = random.Random(5), [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for n, changed in [(100, 1), (100, 2), (200, 2), (200, 4), (400, 8), (100, 4), (100, 6)]:
        for _ in range(8):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            near = list(words)
            for i in rng.sample(range(n), changed):
                near[i] = "changed"
            texts += [" ".join(words), " ".join(near).upper()]
    line = "one very common line of eight words here"
    texts += [f"{line} " * 6 + " ".join(f"v{rng.randrange(5000)}" for _ in range(12)) for _ in range(60)] + ["", None, " ", "a b", "A  b", "a c"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * (same := len(x & sets[j])) >= 4 * (len(x) + len(sets[j]) - same):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()}
    assert kept == {i for i in up if top(i) == i}


def test_quality_held_out(spark):
    from sitefacts.llm import quality
    sf = SF.replace("0.001", "0.01")
    want = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(want[r.doc_id], r.predicted) for r in quality.op6_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in want]
    assert np.mean([a == b for a, b in got]) > 0.9


def test_pii_patterns(spark):
    import re
    from sitefacts.llm import pii
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii.luhn(d), "phone": lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15}
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in [*texts, "a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 0256.1.1.1 300.1.1.1", ""]:
        want = sorted(((m.start(), m.end(), k) for k in rx for m in re.finditer(rx[k], t) if ok[k](m.group())), key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert pii.base_spans(t) == want


def test_pii_finds_spans_between_many_base_spans(spark):
    import random
    from sitefacts.llm import pii
    secret, phone = "0123456789abcdef0123456789abcdef", "(999) 555-9999"
    mails = [f"user{i}@example.com and" for i in range(60)]
    text = " ".join([*mails[:30], f"password: {secret} then {phone} again", *mails[30:]])
    base, more = pii.find(text)
    assert len(base) == 60 and {(text[s:e], k) for s, e, k in more} == {(secret, "secret"), (phone, "phone")}
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert f"secret:{text.index(secret)}:" in pii.detect(docs).first().spans
    masked = pii.redact(docs).first().text
    assert secret not in masked and "555-9999" not in masked and masked.count("[email]") == 60
    rng = random.Random(1)
    for _ in range(300):
        words = [m.span() for m in pii.WORD.finditer("".join(rng.choice("ab  ") for _ in range(60)))]
        taken = sorted((s, s + rng.randint(1, 9), "x") for s in rng.sample(range(60), rng.randint(0, 8)))
        assert pii.untouched(words, taken) == [not any(a < e and s < b for s, e, _ in taken) for a, b in words]


def test_decontamination_finds_substituted_items_both_ways(spark):
    from sitefacts.llm import decontaminate as d
    item = " ".join(f"w{i}" for i in range(20))
    near = item.replace("w5 ", "x ").replace("w15 ", "y ")
    far = " ".join(f"w{i}" if i % 2 else "z" for i in range(20))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, near.upper()), (3, far), (4, None), (5, ""), (1, f"a b {item} c")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, None), (7, "short")], "item_id long, text string")
    for bound in (100_000, 0):
        got = {(r.doc_id, r.item_id, r.matched) for r in d.contaminated(docs, bench, broadcast_rows=bound).collect()}
        assert got == {(1, 9, 20), (2, 9, 18)}


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:2] == ["doc_id", "start"] and rows.select("doc_id").distinct().count() > 100


def test_language_held_out(spark):
    from sitefacts.llm import language
    sf = SF.replace("0.001", "0.01")
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r.lang_pred == want[r.doc_id] for r in language.op9_language_id(spark, sf).collect() if r.held_out]
    assert np.mean(got) > 0.9
    assert language.Filter({"xx": [1]}).predict("12 !") == ("und", 0.0) == language.Filter({}).predict(None)


def test_license_scan(spark):
    from sitefacts.llm import licenses as x
    docs = spark.createDataFrame([(1, "RELEASED under the MIT licence\nCopyright 2020 A"), (2, "Released under the MIT License. And more"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in x.scan(docs, spark.createDataFrame(x.KNOWN, "license string, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None}


def test_license_scan_finds_full_texts_and_lines(spark):
    from sitefacts.llm import licenses as x
    mit, gpl = [(x.TEXTS / f"{n}.txt").read_text() for n in ("MIT", "GPL-3.0")]
    rows = [(1, "Copyright (c) 2020 A\n\n" + mit.split("\n", 1)[1].upper()), (2, gpl.replace("\n", "\r\n")), (3, "Some words.\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0.\nmore"), (3, "see: Released under the MIT License."), (None, None)]
    got = x.scan(spark.createDataFrame(rows, "doc_id long, text string"), x.known(spark)).collect()
    assert {(r.doc_id, r.license, r.notices) for r in got} == {(1, "MIT", None), (2, "GPL-3.0", None), (3, None, "CC-BY-NC-4.0,MIT"), (3, None, None), (None, None, None)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {r.doc_id for r in docs.collect() if r.text and {t for _, t in x.KNOWN} & set(r.text.split("\n"))}
    found = x.op4_license_scan(spark, SF).where("notices IS NOT NULL")
    assert lines and {r.doc_id for r in found.collect()} == lines


def test_decontamination_finds_every_substitution_in_short_items(spark):
    from itertools import combinations
    from sitefacts.llm import decontaminate as d
    docs, want = [], set()
    for n in (1, 3, 5, 6, 7, 10, 15):
        for m in range(n - (4 * n + 4) // 5 + 2):
            for gone in combinations(range(n), m):
                docs.append((len(docs), "a b " + " ".join("x" if i in gone else f"t{n}w{i}" for i in range(n)) + " c"))
                if 5 * (n - m) >= 4 * n:
                    want.add((len(docs) - 1, n, n - m))
    bench = spark.createDataFrame([(n, " ".join(f"t{n}w{i}" for i in range(n))) for n in (1, 3, 5, 6, 7, 10, 15)] + [(99, "?!")], "item_id long, text string")
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id, r.matched) for r in found.collect()} == want


def test_language_rare_and_many(spark):
    from sitefacts.llm import language
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{i:02}" for i in range(65)]
    model = language.Filter({n: language.grams(f"{letters[i // 26] * 3}{letters[i % 26] * 3}").tolist() for i, n in enumerate(names)})
    assert model.predict("cccmmm") == ("l64", 1.0) and model.predict("aaaaaa")[0] == "l00"
    for n in (10, 14, 16, 20, 30):
        rows = [(i, f"common {letters[i % 26] * 4}{letters[i // 26] * 4}", "xx") for i in range(2 * n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        fitted = df.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2").limit(n)
        assert language.fit(fitted).predict("bbbb")[1] > 0.3
