"""Edits against a plain search over whole strings, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

SF = "/root/testdata/sf0.001"
MOVES = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def best(rows):
    """(cost, audit, [(role, text)]) by search; rows are (role, text, fault)."""
    @lru_cache(None)
    def go(i, state, inserts):
        out = [(0, "", ())] if i == len(rows) and state in "0a" else []
        options = []
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", state, None, i + 1))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if (state, role[:1]) in MOVES:
                    options.append((late, "K", MOVES[state, role[:1]], (role, text), i + 1))
                options += [(late + 1, "R", MOVES[state, r[0]], (r, text), i + 1) for r in ("user", "assistant") if (state, r[0]) in MOVES]
        if inserts < 3:
            options += [(5, "I", MOVES[state, r[0]], (r, ""), i) for r in ("user", "assistant") if (state, r[0]) in MOVES]
        for cost, letter, to, row, at in options:
            rest = go(at, to, inserts + 1 if at == i else 0)
            if rest:
                out.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))
        return min(out, default=None)

    import sys
    sys.setrecursionlimit(10_000)
    return go(0, "0", 0)


def plain(turns):
    """The contract by plain Python; turns are (conv_id, turn, role, text)."""
    convs, out = {}, []
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
        rows += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, told = set(), []
        for _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            told.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "fine" if shown[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit, fixed = best(tuple(told))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        faults = [f for _, _, f in told]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def made(seed, n, convs=40):
    rng = random.Random(seed)
    texts = [None, "", " \t", "Yes.", "No", "Why?  ", "x.y", " ", "Grüße!", "...", "a b c."]
    ids = [None, *range(convs)]
    return [(rng.choice(ids), rng.choice([None, -3, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_edits_of_random_rows(seed):
    from sitefacts.llm import repair
    rng = random.Random(seed)
    for _ in range(20):
        rows = [(rng.choice(["system", "user", "assistant", "other"]), "t", rng.choice(["fine", "fine", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(12))]
        codes = [["fine", "blank", "duplicate", "truncated"].index(f) * 4 + ["s", "u", "a", "o"].index(r[0]) for r, _, f in rows]
        assert repair.repair(codes) == best(tuple(rows))[:2]
        reps = [rng.randrange(1, 4) if c // 4 in (1, 2) else 1 for c in codes]
        many = [c for c, n in zip(codes, reps) for _ in range(n)]
        assert repair.repair(codes, reps) == repair.repair(many)


def test_query_equals_plain_version(spark):
    from sitefacts.llm import repair
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.op12_structure_repair(spark, SF).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("most", [1, 3, 65_536])
def test_nulls_ties_repeats_and_small_blocks(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    from sitefacts.llm import repair
    rows = made(most, 600) + made(7, 150, convs=1) + [(9, 1, "user", "Yes.")] * 20 + [(2**60 + 1, 5, "user", "Big.")]
    df = spark.createDataFrame([(*r, 0.5, "c", "x", 1) for r in rows], "conv_id long, turn long, role string, text string, lives double, code string, reps string, digest int")
    cut = repair.blocks
    monkeypatch.setattr(repair, "blocks", lambda small: cut(small, most))
    damaged = repair.damaged(df)
    got = repair.reports(damaged, F.col("lives"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    if most == 3:
        texts = {}
        for r in repair.repaired_turns(damaged, F.col("lives")).collect():
            texts.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
        sha = {c: hashlib.sha256("\n".join(t for _, t in sorted(v)).encode()).hexdigest() for c, v in texts.items()}
        assert sha == {r[0]: r[-1] for r in plain(rows) if r[-1] != hashlib.sha256().hexdigest()}
        assert repair.reports(df.limit(0)).count() == 0


def test_long_conversation_takes_blocks_and_linear_time():
    from sitefacts.llm import repair
    rng = random.Random(1)
    codes = [rng.randrange(16) for _ in range(200_000)]
    cost, audit = repair.repair(codes)
    value = {"K": 0, "R": 1, "D": 2, "I": 5}
    kept = [(c, e) for c, e in zip(codes, audit.replace("I", ""))]
    assert len(kept) == len(codes) and cost == sum(value[e] for e in audit) + sum(5 for c, e in kept if e != "D" and c // 4 == 3)
