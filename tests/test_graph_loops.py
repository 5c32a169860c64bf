"""Long chains, loops, and random graphs against plain Python."""

import random

import pytest

from sitefacts import graph

SCHEMA = "run_id string, seq long, pos int, from string, to string, kind string, rel string"


def url(x):
    return f"https://s.example/{x}"


def test_chain_of_5000_and_loop_of_1000(spark):
    rows = [("r", i, 0, url(f"c{i}"), url(f"c{i + 1}"), "redirect", None) for i in range(5000)]
    rows += [("r", i, 0, url(f"l{i}"), url(f"l{(i + 1) % 1000}"), "redirect", None) for i in range(1000)] + [("r", i, 0, url(f"t{i}"), url(f"t{i + 1}" if i < 9 else "l500"), "redirect", None) for i in range(10)]
    got = {r.start: (r.final, r.termination, r.hops) for r in graph.redirect_chains(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("r", url("c5000"))], "run_id string, url string")).collect()}
    assert all(got[url(f"c{i}")] == (url("c5000"), "observed_destination", 5000 - i) for i in range(5000))
    assert all(got[url(f"l{i}")] == (url(f"l{i}"), "loop", 1000) for i in range(1000))
    assert all(got[url(f"t{i}")] == (url("l500"), "loop", 1010 - i) for i in range(10)) and len(got) == 6010


def plain_chain(start, step, fetched):
    path, at = [start], step[start]
    while True:
        if at is None:
            return None, "invalid_target", len(path), path
        if at in path:
            return at, "loop", len(path), [*path, at]
        if not at.startswith("https://s.example/"):
            return at, "outside_origin", len(path), [*path, at]
        if at not in step:
            return at, "observed_destination" if at in fetched else "unfetched", len(path), [*path, at]
        path.append(at)
        at = step[at]


@pytest.mark.parametrize("seed", range(2))
def test_random_redirects_and_depths(spark, seed):
    rng = random.Random(seed)
    names = [url(i) for i in range(120)]
    step = {n: rng.choice([*rng.sample(names, 12), None, "https://other.example/x"]) for n in names if rng.random() < 0.6}
    fetched = set(rng.sample(names, 60))
    rows = [("r", i, 0, f, t, "redirect", None) for i, (f, t) in enumerate(step.items())]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(150)]
    df = spark.createDataFrame(rows + [("r", 999, i, f, t, "link", None) for i, (f, t) in enumerate(links)], SCHEMA)
    got = {r.start: (r.final, r.termination, r.hops, r.path) for r in graph.redirect_chains(df, spark.createDataFrame([("r", u) for u in fetched], "run_id string, url string"), paths=True).collect()}
    assert got == {s: plain_chain(s, step, fetched) for s in step}
    costs = [(f, t, 1) for f, t in links] + [(f, t, 0) for f, t in step.items() if t]
    want = {names[0]: 0, names[1]: 0}
    for _ in range(len(names) + 1):
        for f, t, c in costs:
            if f in want and want[f] + c < want.get(t, 10**9):
                want[t] = want[f] + c
    seeds = spark.createDataFrame([("r", names[0]), ("r", names[1]), ("r", names[1])], "run_id string, url string")
    assert {r.url: r.depth for r in graph.depths(df, seeds).collect()} == want
    assert graph.depths(df.limit(0), seeds).count() == 2 and graph.redirect_chains(df.limit(0), seeds).count() == 0
