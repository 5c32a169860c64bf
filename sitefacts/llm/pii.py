"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds whole spans beside them.

Base matches follow fixed rules and always stay. Around words with a digit, and after words that announce a secret,
the model of `spans` chooses boundaries and types (secret, phone, account, birth) of segments that overlap no base
match; all other words stay outside. Time is linear in the length of a text. Null text is empty, and redact leaves it
null. Repeated rows keep their rows, an empty table has none; further columns are ignored by detect and kept by redact.
"""

import bisect
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
DIGIT = re.compile(r"[0-9]+")
ADDED = ["secret", "account", "birth"]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out, end = [], 0
    if "@" in text:
        for m in LOCAL.finditer(text):
            if d := DOMAIN.match(text, m.end()):
                if (start := max(m.start(), end)) < m.end() - 1:
                    out.append((start, d.end(), "email"))
                    end = d.end()
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def untouched(words, taken):
    """For each word whether no span overlaps it; both are in order of their starts, so one merge decides."""
    free, i, end = [], 0, 0
    for a, b in words:
        while i < len(taken) and taken[i][0] < b:
            end = max(end, taken[i][1])
            i += 1
        free.append(end <= a)
    return free


def windows(text):
    """Stretches of text around hot words: those with a digit, and three words from one that announces a secret on. A
    window holds a word before and after, and hot words with at most two others between them share it."""
    low = text.lower()
    keyed = any(s in low for s in S.STEMS)
    if not keyed and not DIGIT.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    hot = [False] * len(words)
    i = 0
    for m in DIGIT.finditer(text):  # runs and words are in order, so one merge decides
        while words[i][1] <= m.start():
            i += 1
        hot[i] = True
    if keyed:
        starts = [a for a, _ in words]
        for m in S.KEYED.finditer(text):
            i = bisect.bisect_right(starts, m.start()) - 1
            hot[i:i + 3] = [True] * len(hot[i:i + 3])
    out, i = [], 0
    while i < len(words):
        if not hot[i]:
            i += 1
            continue
        high = i
        while high + 1 < len(words) and any(hot[high + 1:high + 4]):
            high += 1
        low_word, high_word = max(0, i - 1), min(len(words) - 1, high + 1)
        out.append((words[low_word][0], words[high_word][1]))
        i = high + 2
    return out


def added_spans(text, taken, weights):
    tokens = [[m.span() for m in S.TOKEN.finditer(text, a, b)] for a, b in windows(text)]
    free = untouched([t for ts in tokens for t in ts], taken)
    out, at = [], 0
    for ts in tokens:
        out += S.decode(text, ts, free[at:at + len(ts)], weights)
        at += len(ts)
    return out


def find(text, weights=None):
    """(base spans, added spans); `weights` are those of spans.fit()."""
    text = text or ""
    base = base_spans(text) if any(c in text for c in "0123456789@") else []
    return base, added_spans(text, base, weights or S.fit())


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], [*KINDS, *ADDED].index(s[2]))))


def detect(docs: DataFrame) -> DataFrame:
    weights = S.fit()

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                base, more = find(text, weights)
                n = [sum(k == x[2] for x in base) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with every found span replaced by its kind in brackets."""
    weights = S.fit()

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            base, more = find(t, weights)
            out, at = [], 0
            for s, e, k in sorted(base + more, key=lambda s: (s[0], -s[1])):
                if s >= at:
                    out += [t[at:s], f"[{k}]"]
                at = max(at, e)
            return "".join([*out, t[at:]])
        return text.map(one, na_action="ignore")

    return docs.withColumn("text", masked("text"))


def op8_pii(spark, sf_dir) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
