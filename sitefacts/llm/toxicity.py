"""Toxicity by a weighted finite-state grammar over clauses.

Four transducers rewrite the classes of a clause's words: reported speech (after a reporting verb, or inside quotation
marks), negation (within three words), targets (a person within four words before or after, guessed and confirmed by
the automaton) and a scorer that gives each resulting class a factor. They are composed once. A lexicon of word stems
feeds the result: insults, whose weights are learned, and threats. A clause weighs as much as its best path; words
outside a path that matches weigh nothing.

The lexicon is learned from the labelled rows: a stem is a whole word, or the beginning of several longer ones; its weight
is the lower confidence bound of the log odds that a toxic text holds it. A text's features come from its clauses: the
log of their sum, the heaviest, the log of the sum per 100 words, and the share of clauses that match. A logistic
curve over them is fitted across two folds, so that no text is measured by stems learned from it or a near copy.

Fitting reads at most `most` labelled rows a class, chosen by hash; every text is scored whole. A doc_id with several
labels counts as toxic if any says so; of its texts the least counts. Near copies among the sample count once. Null
and empty texts get the curve's value at no match. With one class or none the fixed words and a fixed curve decide.
Repeated rows get equal scores; an empty table gives no rows. Further columns are ignored and kept.
"""

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import takewhile

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.workdir import shared_dir

from .quality import logistic

# Function words of the grammar in four languages, and words that are insults before any label is seen.
TARGETS = set("you your yours you're u ur he she they him her them his their these those du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas vosotros".split())
NEGATIONS = set("not no never neither nor cannot nicht kein keine nie niemals ne pas jamais non nunca jamás ni".split())
REPORTS = set("said says wrote writes called calls claimed claims told quoted quote sagte sagt nannte schrieb behauptet dit disait écrit appelé dijo dice llamó escribió".split())
THREATS = set("kill hurt beat shoot stab destroy murder strangle burn töten umbringen verprügeln erschießen tuer frapper tirer matar golpear disparar".split())
INSULTS = set("idiot idiots moron morons scum loser losers stupid worthless pathetic disgusting trash clown fool trottel abschaum dummkopf imbécile crétin ordure idiota imbécil basura".split())
FACTORS = {"I": 1.0, "I+": 1.4, "I-": 0.25, "I'": 0.5, "T": 0.3, "T+": 1.5, "T-": 0.2, "T'": 0.4}
GIVEN = 2.0  # the weight of words that no label speaks about
CURVE = np.array([-3.0, 1.0, 0.5, 0.5, 1.0])

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
WORD = re.compile(r"[^\W\d_]+")
OTHERS = "oYNRQ"
NEAR = 4  # words between a target and what is aimed at it
REACH = 3  # words that a negation reaches


class Transducer:
    """arcs: {(state, symbol): [(output, weight, next state)]}."""

    def __init__(self, start, arcs, final):
        self.start, self.arcs, self.final = start, arcs, final


def compose(a: Transducer, b: Transducer) -> Transducer:
    """First `a`, then `b` on its output; weights add."""
    start, arcs, final = (a.start, b.start), {}, set()
    symbols, todo, seen = {s for _, s in a.arcs}, [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        p, q = todo.pop()
        if p in a.final and q in b.final:
            final.add((p, q))
        for s in symbols:
            for mid, w, p2 in a.arcs.get((p, s), ()):
                for out, v, q2 in b.arcs.get((q, mid), ()):
                    arcs.setdefault(((p, q), s), []).append((out, w + v, (p2, q2)))
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
    return Transducer(start, arcs, final)


def reported() -> Transducer:
    arcs = {}
    for state in (0, 1):
        for s in "oYNIT":
            arcs[state, s] = [(s + "'" if state and s in "IT" else s, 0.0, state)]
        arcs[state, "R"] = [("R", 0.0, 1)]
        arcs[state, "Q"] = [("Q", 0.0, 1 - state)]
    return Transducer(0, arcs, {0, 1})


def negated() -> Transducer:
    arcs = {}
    for left in range(REACH + 1):
        for s in (*"oYRQIT", "I'", "T'"):
            arcs[left, s] = [(s + "-" if left and s in ("I", "T") else s, 0.0, max(0, left - 1))]
        arcs[left, "N"] = [("N", 0.0, REACH)]
    return Transducer(0, arcs, set(range(REACH + 1)))


def targeted() -> Transducer:
    """A state is (words since a target, words left to one that was promised)."""
    arcs = {}
    for ago in range(NEAR + 1):
        for due in range(NEAR + 1):
            later = (max(0, ago - 1), due - 1)
            for s in (*"oNRQ", "I'", "T'", "I-", "T-"):
                if due != 1:
                    arcs[(ago, due), s] = [(s, 0.0, (later[0], max(0, later[1])))]
            arcs[(ago, due), "Y"] = [("Y", 0.0, (NEAR, 0))]
            for s in "IT":
                if due != 1:
                    after = (later[0], max(0, later[1]))
                    arcs[(ago, due), s] = [(s + "+", 0.0, after)] if ago else [(s, 0.0, after), (s + "+", 0.0, (0, after[1] or NEAR))]
    return Transducer((0, 0), arcs, {(ago, 0) for ago in range(NEAR + 1)})


def scorer() -> Transducer:
    return Transducer(0, {(0, s): [(s, FACTORS.get(s, 0.0), 0)] for s in (*OTHERS, *FACTORS)}, {0})


def numbered(t: Transducer) -> Transducer:
    """The same with small numbers as states."""
    at = {t.start: 0}
    for (p, _), ways in t.arcs.items():
        for q in (p, *(w[2] for w in ways)):
            at.setdefault(q, len(at))
    return Transducer(0, {(at[p], s): [(o, w, at[q]) for o, w, q in ways] for (p, s), ways in t.arcs.items()}, {at[q] for q in t.final if q in at})


GRAMMAR = numbered(compose(compose(compose(reported(), negated()), targeted()), scorer()))


def best(symbols):
    """(weight, outputs of insults and threats) of the best path; `symbols` are (class, value)."""
    now = {GRAMMAR.start: (0.0, None)}
    for s, value in symbols:
        then = {}
        for state, (weight, path) in now.items():
            for out, factor, to in GRAMMAR.arcs.get((state, s), ()):
                w = weight + value * factor
                if to not in then or w > then[to][0]:
                    then[to] = (w, (path, out) if value else path)
        now = then
    weight, path = max((now[q] for q in now if q in GRAMMAR.final), key=lambda p: p[0], default=(0.0, None))
    outs = []
    while path:
        path, out = path
        outs.append(out)
    return weight, outs[::-1]


def kind(word):
    if word in TARGETS:
        return "Y"
    if word in NEGATIONS or word.endswith(("n't", "n’t")):
        return "N"
    return "R" if word in REPORTS else "Q" if word in "\"“”„«»" else "o"


class Lexicon:
    """stems: {text: (weight as the beginning of a longer word, weight as a whole word)}, 0 for neither."""

    def __init__(self, stems):
        self.stems, self.made = stems, None

    def __getstate__(self):
        return {"stems": self.stems, "made": None}

    def hits(self, text):
        """{start: (class, weight)} of the words that are insults or threats."""
        if self.made is None:
            self.made = ahocorasick.Automaton()
            for stem, weights in (self.stems | {w: None for w in THREATS}).items():
                self.made.add_word(stem, (len(stem), weights))
            self.made.make_automaton()
        found = {}
        for end, (n, weights) in self.made.iter(text):
            start = end - n + 1
            if start and text[start - 1].isalpha():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalpha()
            got = (("T", GIVEN) if whole else None) if weights is None else ("I", weights[whole])
            if got and got[1] > 0 and (start not in found or got[1] > found[start][1]):
                found[start] = got
        return found

    def clauses(self, text):
        """[(start, end, weight, outputs)] of the clauses of a lower-cased text that match, and the number of all."""
        found = self.hits(text) if text else {}
        if not found:
            return [], 0
        cuts = [0, *(m.end() for m in CLAUSE.finditer(text)), len(text)]
        out = []
        for i in sorted({bisect_right(cuts, at) - 1 for at in found}):
            symbols, plain = [], 0
            for m in TOKEN.finditer(text, cuts[i], cuts[i + 1]):
                s = found.get(m.start()) or (kind(m.group()), 0.0)
                plain = plain + 1 if s[0] == "o" else 0
                if plain <= NEAR + 1:  # all counters have run out by then
                    symbols.append(s)
            weight, outs = best(symbols)
            if weight > 0:
                out.append((cuts[i], cuts[i + 1], weight, outs))
        return out, len(cuts) - 1

    def features(self, text):
        matched, n = self.clauses(text)
        if not matched:
            return np.zeros(4)
        weights = [c[2] for c in matched]
        return np.array([math.log1p(sum(weights)), max(weights), math.log1p(100 * sum(weights) / (1 + text.count(" "))), len(matched) / n])


class Model:
    def __init__(self, lexicon, beta):
        self.lexicon, self.beta = lexicon, beta

    def score(self, text):
        z = self.beta[0] + self.beta[1:] @ self.lexicon.features((text or "").lower())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def stems(text, longest=12):
    """Distinct (stem, whole) of a lower-cased text: words, and beginnings of at least three letters."""
    out = set()
    for w in set(WORD.findall(text)):
        if len(w) >= 3:
            out.add((w[:64], 1))
            out.update((w[:k], 0) for k in range(3, min(len(w), longest + 1)))
    return out


def sketch(text):
    """The least hash of three words in a row: near copies mostly share it."""
    words = WORD.findall(text)
    return min((zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may be learned from."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    return labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sampled(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """toxic, fold, text (lower-cased) of the rows to learn from, written once."""
    spark = docs.sparkSession
    some = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    ids = F.broadcast(some[0].union(some[1]))  # 2 * most rows at most
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def told(batches):
        for b in batches:
            low = [(t or "").lower() for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "toxic": b.toxic, "sketch": [sketch(t) for t in low], "text": low})

    one = texts.mapInPandas(told, "doc_id long, toxic int, sketch long, text string").groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    out = shared_dir(spark)
    one.select("toxic", (F.col("sketch") % 2).alias("fold"), "row.text").write.parquet(out)
    return spark.read.parquet(out)


def fit(docs: DataFrame, labels: DataFrame, most: int = 2_000, least_docs: int = 4, z: float = 1.64, threshold: float = 0.7) -> Model:
    """Only stems above `threshold` and four numbers a sampled text reach the driver."""
    known = learnable(labels)
    rows = sampled(docs, known, most)
    n = {(r.toxic, r.fold): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}

    def counted(batches):
        total = Counter()
        for b in batches:
            for toxic, fold, text in zip(b.toxic, b.fold, b.text):
                total.update((s, w, toxic, fold) for s, w in stems(text))
        for i in range(0, len(total), 100_000):
            part = list(total.items())[i:i + 100_000]
            yield pd.DataFrame([(*k, c) for k, c in part], columns=["stem", "whole", "toxic", "fold", "n"])

    def of(toxic, fold):
        return F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold), F.col("n")).otherwise(0))

    counts = rows.mapInPandas(counted, "stem string, whole int, toxic int, fold int, n long").groupBy("stem", "whole").agg(*[of(t, f).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)])
    heard = counts.where(F.col("n10") + F.col("n11") >= least_docs).where((F.col("n10") + F.col("n11")) * max(1, n.get((0, 0), 0) + n.get((0, 1), 0)) > (F.col("n00") + F.col("n01")) * max(1, n.get((1, 0), 0) + n.get((1, 1), 0)))
    given = counts.where(F.col("stem").isin(sorted(INSULTS)) & (F.col("whole") == 1))
    heard = heard.union(given).distinct().collect()
    words = sorted((r.stem, r.n10 + r.n11) for r in heard if r.whole)

    def one_word(r):  # half of the texts that hold this beginning hold one and the same word
        first = bisect_right(words, (r.stem, 0))
        return any(2 * k >= r.n10 + r.n11 for w, k in takewhile(lambda p: p[0].startswith(r.stem), words[first:]))

    heard = [r for r in heard if r.whole or not one_word(r)]

    def lexicon(folds):
        totals = [sum(n.get((t, f), 0) for f in folds) for t in (0, 1)]
        out = {w: [0.0, GIVEN] for w in INSULTS}
        for r in heard:
            b, a = (sum(r[f"n{t}{f}"] for f in folds) for t in (0, 1))
            weight = math.log((a + 0.5) / (totals[1] + 1)) - math.log((b + 0.5) / (totals[0] + 1)) - z * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if r.stem in INSULTS and r.whole and a + b >= least_docs or a >= least_docs and weight > threshold:
                out.setdefault(r.stem, [0.0, 0.0])[r.whole] = max(0.0, weight)
        return Lexicon({s: tuple(w) for s, w in out.items()})

    if {t for t, _ in n} != {0, 1}:
        return Model(Lexicon({w: (0.0, GIVEN) for w in INSULTS}), CURVE)
    across = [lexicon([1]), lexicon([0])]  # a fold is measured by the stems of the other

    def measured(batches):
        for b in batches:
            yield pd.DataFrame({"toxic": b.toxic, "f": [across[f].features(t).tolist() for f, t in zip(b.fold, b.text)]})

    got = sorted((r.toxic, r.f) for r in rows.mapInPandas(measured, "toxic int, f array<double>").collect())
    X, y = np.array([[1.0, *f] for _, f in got]), np.array([float(t) for t, _ in got])
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    w = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    return Model(lexicon([0, 1]), logistic(X, y, w / w.mean()))


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def matches(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `clauses`: start, end (code points of the lower-cased text), weight and outputs of every match."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,weight:double,outputs:array<string>>>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "weight", "outputs"), c)) for c in shared.value.lexicon.clauses((t or "").lower())[0]] for t in text])

    return docs.withColumn("clauses", run("text"))


def op11_toxicity(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
