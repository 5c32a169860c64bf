"""The rule index against regular expressions over all pairs, size bounds, and a file of many rules."""

import random
import re

from sitefacts import functions as X
from sitefacts import robots

FILES = "origin string, path string, status int, body string"


def matches(rule, path):
    rule, path = X.robots_norm_text(rule), X.robots_norm_text(path)
    body = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
    return bool(rule) and re.match("(?s)" + body + (r"\Z" if rule.endswith("$") else ""), path) is not None


def test_random_patterns_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choices(letters, k=rng.randrange(n)))
    rules = list(dict.fromkeys([("allow" if rng.random() < 0.4 else "disallow", "/" * (rng.random() < 0.8) + word("ab/*$%", 7) + "$" * (rng.random() < 0.3)) for _ in range(150)]))
    rules = [r for r in rules if r[1]]
    body = "User-agent: *\n" + "\n".join(f"{t}: {p}" for t, p in rules)
    paths = list({"/" + word("ab/$%", 9) for _ in range(300)})
    files = spark.createDataFrame([("o", "/robots.txt", 200, body)], FILES)
    got = {r.path: (r.allowed, r.rule) for r in robots.robots_verdicts(spark.createDataFrame([("o", p) for p in paths], "origin string, path string"), robots.lines(files), ["x"]).collect()}
    for p in paths:
        met = [(len(X.robots_norm_text(r)), t == "allow", i if t == "allow" else -i, r) for i, (t, r) in enumerate(rules) if matches(r, p)]
        want = max(met) if met else (0, True, 0, None)
        assert got[p] == (want[1], want[3]), (p, got[p], want)


def test_many_rules_and_paths_make_few_pairs(spark):
    body = "User-agent: *\n" + "\n".join(f"Disallow: /{i:05}/" for i in range(10_000))
    files = spark.createDataFrame([("o", "/robots.txt", 200, body)], FILES)
    urls = spark.range(200_000).selectExpr("'o' AS origin", "concat('/', lpad(cast(id % 20000 AS string), 5, '0'), '/', id) AS path")
    got = robots.robots_verdicts(urls, robots.lines(files), ["x"]).groupBy("allowed").count().collect()
    assert {r.allowed: r["count"] for r in got} == {True: 100_000, False: 100_000}


def test_bounds_and_failures_are_issues(spark):
    files = spark.createDataFrame([("big", "/robots.txt", 200, "User-agent: *\nAllow: /\n" + "#" * 600_000), ("down", "/robots.txt", 503, "x"), ("busy", "/robots.txt", 429, None), ("gone", "/robots.txt", 404, "User-agent: *\nDisallow: /")], FILES)
    rows = robots.lines(files)
    assert {(r.origin, r.line, r.issue) for r in robots.robots_issues(rows).collect()} == {("big", None, "body_over_limit"), ("down", None, "status_503"), ("busy", None, "status_429")}
    asked = spark.createDataFrame([(o, "/") for o in ("big", "down", "busy", "gone")], "origin string, path string")
    assert {r.origin: r.allowed for r in robots.robots_verdicts(asked, rows, ["x"]).collect()} == {"big": False, "down": False, "busy": False, "gone": True}
