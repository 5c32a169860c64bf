"""Mixture-controlled packing by deficit round-robin over source queues.

Every queue s has a target weight W_s (default: its tokens, so that all queues last to the end). After r rounds it
has given min(T_s, floor(r * window * W_s / sum(W))) of its T_s tokens: the fraction left over is its deficit,
carried to later rounds, windows and partitions in closed form, so that in a round a queue that lasts is within one
token of its target. A queue that is empty leaves its share to the others in their proportion. The rounds follow one
another in one stream, cut at every `window` tokens, so only the last sequence may be short; a window's ends shift
against the rounds by less than one token a queue. Null text: only the end id. A null source is the queue ''.
Sources without a
target follow when all others are empty, in proportion to their tokens. Null doc_ids are kept. Repeated
rows are packed as often as they occur. Empty tables give no pieces. Further columns are ignored.
"""

import json
import math
import os
import struct
import tempfile
import unicodedata
import uuid
import zlib
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import tidy

TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
RUNS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("round", pa.int64()), ("within", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
LATE = 1 << 40  # added to the rounds of queues without a target
# Fixed value: the pattern of the tokenizers whose words Words may encode one by one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def shared_dir(spark) -> str:
    """A new path in the session's checkpoint folder; in local mode that folder may be made here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


class Words:
    """Ids of words: two generations of `most` words within a task, the older dropped; `forget` leaves a worker process the
    tokenizers and the words that came first, which are mostly the frequent ones.

    A token never spans white space, and none spans a letter and the punctuation after it, so words are encoded
    once each, without it. Words of letters only go many in one string through the bare model, where each ends with
    an end-of-word token; others go between marks through the whole tokenizer; words with the mark itself alone.
    Texts are split, their different words found and these words' ids put in place as Arrow columns, so Python handles
    a word once for all texts of a piece. Tokenizers of another kind encode whole texts.
    """

    MARK, ENDS, KNOWN_LETTERS = "\x01", ".,;:!?$%&*#()", "ɏ"
    # Letters that have one small letter of this kind and are their own normal form.
    COMMON = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and (c.isascii() or c >= "À") and c != "İ")

    def __init__(self, path, most=500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.path, self.most, self.tok, self.new, self.old = path, most, Tokenizer.from_file(path), {"": b""}, {}
        spec = json.loads(self.tok.to_str())
        self.by_word = PATTERN in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\") and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            (self.mark,) = self.ids(self.MARK)
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
            self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    def ids(self, text):
        return self.tok.encode(text, add_special_tokens=False).ids

    def parts(self, word):
        if word.isascii() and word.isalpha():
            return (word.lower(),)
        core = word.rstrip(self.ENDS)
        if len(core) == len(word) or not core or not unicodedata.normalize("NFC", core[-1]).lower()[-1].isalpha():  # a letter may come apart
            return (word.lower() if word.isascii() else self.lowered(word),)
        return (core.lower() if core.isascii() else self.lowered(core), word[len(core):])

    def lowered(self, word):
        low = unicodedata.normalize("NFC", word)
        return low.lower() if low.isalpha() and max(low) <= self.KNOWN_LETTERS else word

    def plain(self, part):
        return part.isalpha() and (part.isascii() or max(part) <= self.KNOWN_LETTERS and part == part.lower() and unicodedata.is_normalized("NFC", part))

    def joined(self, tok, parts, sep):
        for i in range(0, len(parts), 256):
            some = parts[i:i + 256]
            yield some, np.array(tok.encode_batch_fast([sep.join(some)], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, parts):
        out, plain, rest = {}, [], []
        for p in parts:
            if p.isascii() and p.isalpha() or self.plain(p):
                plain.append(p)
            elif self.MARK in p:
                out[p] = np.array(self.ids(p), "<u4").tobytes()
            else:
                rest.append(p)
        for some, ids in self.joined(self.bare, plain, " "):
            raw, low = ids.tobytes(), 0
            for w, cut in zip(some, (np.flatnonzero(self.last[ids]) + 1).tolist(), strict=True):
                out[w], low = raw[4 * low:4 * cut], cut
        for some, ids in self.joined(self.tok, rest, f" {self.MARK} "):
            raw, low = ids.tobytes(), 0
            for w, cut in zip(some, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                out[w], low = raw[4 * low:4 * cut], cut + 1
        return out

    def learn(self, missing):
        """Adds these words, which are not in `new`."""
        words = []
        for w in missing:
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                words.append(w)
        split = [self.parts(w) for w in words]
        fresh = {p for parts in split for p in parts}.difference(self.new)
        self.new.update(self.encode(list(fresh)))
        for w, parts in zip(words, split):
            self.new[w] = self.new[parts[0]] if len(parts) == 1 else b"".join([self.new[p] for p in parts])

    def forget(self, most=100_000):
        self.new, self.old = dict(islice(self.new.items(), most)), {}

    def texts(self, texts):
        return self.column(pa.array(texts, pa.string())).to_pylist()

    def found(self, words, learn):
        """Ids of an Arrow column of words, each different one looked up or learned once."""
        words = words.dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.new.get, different))
        if None in ids:
            learn([w for w, i in zip(different, ids) if i is None])
            ids = list(map(self.new.get, different))
        return pa.array(ids, pa.binary()).take(words.indices)

    def learn_letters(self, missing):
        """The same as `learn` for words of small common letters."""
        words = [w for w in missing if w not in self.old]
        if len(words) < len(missing):
            self.new.update((w, self.old[w]) for w in missing if w in self.old)
        for some, ids in self.joined(self.bare, words, " "):
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            self.new.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def words(self, words):
        """Ids of an Arrow column of words; common letters and the punctuation after them are looked up apart."""
        tails = pc.utf8_ltrim(words, characters=self.COMMON)
        common = pc.and_(pc.equal(pc.utf8_rtrim(tails, characters=self.ENDS), ""), pc.not_equal(tails, words))
        some, rest = words.filter(common), words.filter(pc.invert(common))
        letters = self.found(pc.utf8_lower(pc.utf8_rtrim(some, characters=self.ENDS)), self.learn_letters)
        ids = pc.binary_join_element_wise(letters, self.found(tails.filter(common), self.learn), pa.scalar(b"", pa.binary()))
        common = common.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([ids, self.found(rest, self.learn)]).take(pa.array(np.where(common, np.cumsum(common), len(some) + np.cumsum(~common)) - 1))

    def column(self, texts, end=b""):
        """Ids of an Arrow column of texts (null: empty), each with `end` after them, as a binary column."""
        texts = texts.fill_null("")
        if not self.by_word:
            return pa.array([np.array(self.ids(t), "<u4").tobytes() + end for t in texts.to_pylist()], pa.binary())
        if len(self.new) > self.most:
            self.new, self.old = {"": b""}, self.new
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy()) + np.arange(len(texts))  # places of `end` among all words
        at = np.full(len(words) + len(texts), len(words.dictionary), np.int32)
        at[np.delete(np.arange(len(at)), ends)] = words.indices.to_numpy()
        ids = pa.concat_arrays([self.words(words.dictionary), pa.array([end], pa.binary())]).take(pa.array(at))
        _, offsets, data = ids.buffers()
        cuts = np.frombuffer(offsets, np.int32, len(ids) + 1)[np.concatenate([[0], ends + 1])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.tobytes()), data])


@lru_cache(maxsize=1)
def _loaded(path):
    return Words(path)


def _by_bytes(b, most=4 << 20):
    """The rows of a batch in pieces of some `most` bytes of text; a longer text is a piece alone."""
    ends, first = np.cumsum(pc.binary_length(b["text"]).fill_null(0).to_numpy()), 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, most + (ends[first - 1] if first else 0), "right")))
        yield b.slice(first, last - first)
        first = last


@tidy
def _tokenise(path, end_id, batches):
    words = _loaded(path)
    part, used, end = TaskContext.get().partitionId(), {}, struct.pack("<I", end_id)
    for b in batches:
        for some in _by_bytes(b):
            ids = words.column(some["text"], end)
            n, at = pc.divide(pc.binary_length(ids), 4).to_pylist(), []
            for source, m in zip(some["source"].to_pylist(), n):
                at.append(used.get(source, 0))
                used[source] = at[-1] + m
            yield pa.RecordBatch.from_arrays([some["doc_id"], some["source"].cast(pa.string()), pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), ids], schema=TOKENS)
    words.forget()


def round_of(j, weight, total, window):
    """The first round after which a queue has given more than j tokens."""
    return ((j + 1) * total - 1) // (weight * window)


def given(r, weight, total, window, tokens):
    return min(tokens, r * window * weight // total)


class Layout:
    """Places of all queues' tokens, for a bounded number of queues."""

    def __init__(self, tokens, weights, window, first=0):
        self.names, self.window, self.first = sorted(tokens), window, first
        self.T, self.W = [int(tokens[s]) for s in self.names], [int(weights[s]) for s in self.names]
        self.total, self.rounds = sum(self.W), {}

    def round(self, r):
        """(first place of the round, tokens given before it, places of the queues in the round)"""
        if r not in self.rounds:
            if len(self.rounds) > 2000:
                self.rounds.clear()
            low = [given(r, w, self.total, self.window, t) for w, t in zip(self.W, self.T)]
            high = [given(r + 1, w, self.total, self.window, t) for w, t in zip(self.W, self.T)]
            self.rounds[r] = low, high, list(accumulate((b - a for a, b in zip(low, high)), initial=self.first + sum(low)))
        return self.rounds[r]


def _pieces(layouts, window, batches):
    index = {s: (p, i) for p in layouts for i, s in enumerate(p.names)}
    for b in batches:
        for first in range(0, b.num_rows, 256):
            some, rows = b.slice(first, 256).to_pydict(), []
            for doc_id, source, at, n, ids in zip(*(some[c] for c in ("doc_id", "source", "first", "n", "ids"))):
                (p, s), j, end = index[source], at, at + n
                while j < end:
                    low, high, place = p.round(round_of(j, p.W[s], p.total, window))
                    pos = place[s] + j - low[s]
                    take = min(end, high[s], j + window - pos % window) - j
                    x = j - at
                    rows.append((doc_id, x, take, zlib.crc32(ids[4 * x:4 * (x + take)]), n, pos // window, pos % window))
                    j += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=PIECES)


def _runs(window, batches):
    """A row for every round in which a document gives tokens; weights come with the rows."""
    for b in batches:
        for first in range(0, b.num_rows, 128):
            some, rows = b.slice(first, 128).to_pydict(), []
            for doc_id, source, at, n, ids, weight, total, tokens, late in zip(*(some[c] for c in ("doc_id", "source", "first", "n", "ids", "weight", "total", "tokens", "late"))):
                j, end, weight, total = at, at + n, int(weight), int(total)
                while j < end:
                    r = round_of(j, weight, total, window)
                    take, x = min(end, given(r + 1, weight, total, window, tokens)) - j, j - at
                    rows.append((doc_id, source, r + late * LATE, j - given(r, weight, total, window, tokens), x, take, n, ids[4 * x:4 * (x + take)]))
                    j += take
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUNS.types)], schema=RUNS)


def _cut(window, batches):
    for b in batches:
        rows = []
        for doc_id, pos, start, n, doc_tokens, ids in zip(*(b.to_pydict()[c] for c in ("doc_id", "pos", "start", "length", "doc_tokens", "ids"))):
            x = 0
            while x < n:
                take = min(n - x, window - (pos + x) % window)
                rows.append((doc_id, start + x, take, zlib.crc32(ids[4 * x:4 * (x + take)]), doc_tokens, (pos + x) // window, (pos + x) % window))
                x += take
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=PIECES)


def _many_queues(placed: DataFrame, window: int) -> DataFrame:
    """The same layout for any number of queues: places are running sums over the rounds' runs, in Spark."""
    runs = placed.mapInArrow(lambda it: _runs(window, it), "doc_id long, source string, round long, within long, start long, length long, doc_tokens long, ids binary")
    runs.write.parquet(out := shared_dir(placed.sparkSession))
    runs = placed.sparkSession.read.parquet(out)
    grants = runs.groupBy("round", "source").agg(F.sum("length").alias("m"))  # a round has at most a window's tokens and one a queue
    inside = grants.withColumn("before", F.sum("m").over(Window.partitionBy("round").orderBy("source")) - F.col("m"))
    block = F.floor(F.col("round") / 10_000)
    rounds = grants.groupBy("round").agg(F.sum("m").alias("m")).withColumn("block", block)
    rounds = rounds.withColumn("in_block", F.sum("m").over(Window.partitionBy("block").orderBy("round")) - F.col("m"))
    blocks = rounds.groupBy("block").agg(F.sum("m").alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("first"))  # a row for 10,000 windows
    base = rounds.join(blocks, "block").select("round", (F.col("first") + F.col("in_block")).alias("base"))
    places = inside.join(base, "round").select("round", "source", (F.col("base") + F.col("before")).alias("place"))
    met = runs.join(places, ["round", "source"]).withColumn("pos", F.col("place") + F.col("within"))
    return met.select("doc_id", "pos", "start", "length", "doc_tokens", "ids").mapInArrow(lambda it: _cut(window, it), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, targets: dict | None = None, max_queues: int = 1024, small: int = 500_000) -> DataFrame:
    """Pieces of every document. `targets` maps sources to token shares (any positive numbers).

    Up to `max_queues` sources their totals go to the tasks, which place pieces alone; beyond, the same places are
    computed by running sums in Spark, which shuffles the ids once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("source"))
    out = shared_dir(spark)
    docs.mapInArrow(lambda it: _tokenise(tokenizer, end_id, it), "doc_id long, source string, part long, at long, n long, ids binary").write.parquet(out)
    tok = spark.read.parquet(out)
    sums = tok.groupBy("part", "source").agg(F.sum("n").alias("m"))
    totals = sums.groupBy("source").agg(F.sum("m").alias("tokens"))
    shares = {q: Fraction(w).limit_denominator(10**6) for q, w in (targets or {}).items() if w > 0}
    scale = math.lcm(*(f.denominator for f in shares.values()))
    known = spark.createDataFrame([(q, str(f * scale)) for q, f in shares.items()], "source string, weight string")
    weighed = totals.join(known, "source", "left").select("source", "tokens", F.coalesce("weight", F.col("tokens").cast("string")).alias("weight"), F.isnull("weight").cast("int").alias("late"))
    base = sums.withColumn("base", F.sum("m").over(Window.partitionBy("source").orderBy("part")) - F.col("m")).drop("m")
    few = weighed.limit(max_queues + 1).collect()
    if len(few) > max_queues:
        grand = weighed.groupBy("late").agg(F.sum(F.col("weight").cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("total"))
        base = base.join(weighed.join(F.broadcast(grand), "late"), "source")  # two rows
    if base.count() <= small:  # a row a task and source; beyond that the ids are shuffled
        base = F.broadcast(base)
    placed = tok.join(base, ["part", "source"]).withColumn("first", F.col("at") + F.col("base"))
    if len(few) > max_queues:
        return _many_queues(placed.select("doc_id", "source", "first", "n", "ids", "weight", "total", "tokens", "late"), window)
    layouts, first = [], 0
    for late in (0, 1):
        some = [r for r in few if r.late == late]
        layouts.append(Layout({r.source: r.tokens for r in some}, {r.source: r.weight for r in some}, window, first))
        first += sum(r.tokens for r in some)
    return placed.select("doc_id", "source", "first", "n", "ids").mapInArrow(lambda it: _pieces(layouts, window, it), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
