import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def stream(rows):
    """Pieces in order, checked to be gapless in every sequence."""
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert not ends or all(ends.get(s) == max(ends.values()) for s in range(max(ends)))
    return ends


def test_targets_hold_while_queues_last(spark):
    from sitefacts.llm import packing
    word = {"a": "cat ", "b": "dog ", "c": "sun ", "d": "sky "}
    docs = [(i, word[s] * (30 + i % 50), s) for i, s in enumerate("aabbccdd" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    source, targets, window = {i: s for i, _, s in docs}, {"a": 0.5, "b": 0.3, "c": 0.2}, 100
    found = {}
    for queues in (1024, 2):
        rows = packing.pack(df, tokenizer(), window=window, targets=targets, max_queues=queues).collect()
        stream(rows)
        found[queues] = sorted(map(tuple, rows))
    assert found[1024] == found[2]
    left = {s: sum(r.length for r in rows if source[r.doc_id] == s) for s in "abcd"}
    seq = 0
    while all(left[s] >= 60 for s in "abc"):
        held = {s: sum(r.length for r in rows if r.sequence_id == seq and source[r.doc_id] == s) for s in "abcd"}
        assert held["d"] == 0 and all(abs(held[s] - 100 * targets[s]) <= len(targets) for s in targets), (seq, held)
        left = {s: left[s] - held[s] for s in left}
        seq += 1
    assert seq > 20
    assert max(r.sequence_id for r in rows if source[r.doc_id] != "d") <= min(r.sequence_id for r in rows if source[r.doc_id] == "d")


@pytest.mark.parametrize("queues", [1024, 0])
def test_many_sources_nulls_and_repeats(spark, queues):
    from sitefacts.llm import packing
    rows = [(i, f"word{i} " * (i % 7), f"s{i}") for i in range(1100)] + [(None, "x y", None), (5, None, None), (5, None, None), (5, "", "s1")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, part string")
    got = packing.pack(df, tokenizer(), window=64, max_queues=queues).collect()
    ends = stream(got)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer())
    assert sum(ends.values()) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert sum(r.doc_id is None for r in got) >= 1 and packing.pack(df.limit(0), tokenizer(), max_queues=queues).count() == 0


def test_shared_folder_is_demanded_on_a_cluster():
    from types import SimpleNamespace as N
    from sitefacts.llm import packing
    cluster = N(conf=N(get=lambda *a: None), sparkContext=N(master="spark://x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        packing.shared_dir(cluster)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from sitefacts.llm import packing
    w = packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not w.by_word and w.texts(["Hello  world. It's"])[0] == np.array(w.tok.encode("Hello  world. It's", add_special_tokens=False).ids, "<u4").tobytes()


def test_a_word_is_kept_once_for_all_its_capitals_and_punctuation():
    from sitefacts.llm import packing
    w = packing.Words(tokenizer())
    w.texts([f"{c}{e}" for c in ("qatzu", "Qatzu", "QATZU", "qATZU") for e in ("", ".", ",", "!", "?!", "...")])
    assert len(w.new) == 1 + 6  # the letters and six tails, one of them empty


def test_columns_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    from sitefacts.llm import packing
    letters = [chr(i) for i in range(1, 0x250)]
    odd = [None, "", " ", "\n\n.", "a\x01b \x01 c. \x01.", "x" * 3000 + "!!!", "a" * 70_000, "İi. İ. x\u0958. \ufb1d, ẞß? ﬁ é é. Ǆ ǆ, µ. ª! ́. x́.", "it's. don't'll!! 3.5 a1. 1a. a.b. .a #a# (ab)  a. a .   b."]
    texts = odd + [f"x{c}. {c}y, {c} {c}. .{c} Q{c}Q!" for c in letters] + [" ".join(f"{c}a{c}?!" for c in letters)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok, w = Tokenizer.from_file(public_tokenizers.path(name)), packing.Words(public_tokenizers.path(name), most=300)
        want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in texts]
        for kind in (pa.string(), pa.large_string()):
            for size in (1, 7, len(texts)):
                got = [x for i in range(0, len(texts), size) for x in w.column(pa.array(texts, kind).slice(i, size), want[0]).to_pylist()]
                assert got == want
            w.forget(100)


def test_batches_are_cut_by_bytes():
    import pyarrow as pa
    from sitefacts.llm import packing
    texts = [None, "aa", "a" * 50, "", "a", "é" * 4, "a" * 9, None]
    b = pa.record_batch({"text": pa.array(texts), "doc_id": pa.array(range(len(texts)))})
    got = [p["text"].to_pylist() for p in packing._by_bytes(b, 10)]
    assert sum(got, []) == texts and all(got) and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in got)
    assert [p for b in (b.slice(0, 0), b.slice(2, 3)) for p in map(len, packing._by_bytes(b, 10))] == [1, 2]
