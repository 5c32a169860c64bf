"""The replay of a crawl against one site at a time in plain Python, and its single rules."""

import random
from collections import deque

from sitefacts import crawl

SITE = "https://s.example/"
EDGES = "run_id string, seq long, pos int, from string, to string, kind string, rel string"
PAGES = "run_id string, url string, status int, robots array<string>, x_robots_tag string"
U = lambda x: x if x is None or "://" in x else SITE + x


def plain(pages, edges, seeds, listed, denied, blocked, max_pages, max_depth, max_hops, include_query, cap):
    """(rows, pages fetched, known URLs, namings left out, stopped) of one site, fetched page by page."""
    queue, waiting, known, queued, left, out, omitted, stopped = deque(), deque(listed), set(), {}, {}, {}, 0, False

    def offer(url, depth, hop, seed=False):
        nonlocal omitted
        if url in queued:
            return
        if url not in known and len(known) >= cap:
            omitted += 1
            return
        known.add(url)
        checks = [(not url.startswith(SITE), "outside_origin"), (blocked, blocked), (url in denied, "robots_disallow"), (hop > max_hops, "redirect_limit"),
                  ("?" in url and not url.endswith("?") and not seed and not include_query, "query_not_selected"), (depth > max_depth, "depth_limit")]
        why = next((r for bad, r in checks if bad), None)
        if why:
            left.setdefault(url, why)
        else:
            queued[url] = depth, hop
            queue.append(url)

    for url in seeds:
        offer(url, 0, 0, True)
    while len(out) < max_pages and not stopped:
        while waiting and not queue:
            offer(waiting.popleft(), 0, 0)
        if not queue:
            break
        url = queue.popleft()
        depth, hop = queued[url]
        out[url] = depth, hop, len(out) + 1, None
        status, nofollow = pages.get(url, (None, False))
        stopped = status == 429
        for to, kind, rel in [] if stopped else edges.get(url, []):
            if to and (kind == "redirect" or kind == "link" and not nofollow and "nofollow" not in (rel or "")):
                offer(to, depth + (kind == "link"), 0 if kind == "link" else hop + 1)
    last = "rate_limited" if stopped else "page_limit"
    for url in [*left, *queued, *waiting]:
        if url not in out:
            out[url] = None, None, None, last if url in queued else left.get(url, last)
    return out, sum(p is not None for _, _, p, _ in out.values()), len(known), omitted, stopped


def made(seed):
    r = random.Random(seed)
    names = [U(f"p{i}" + ("?q=1" if r.random() < .1 else "")) for i in range(r.choice((8, 25, 60)))] + ["https://other.example/x"]
    pages = {n: (429 if r.random() < .02 else 200, r.random() < .08) for n in names if r.random() < .9}
    edges = {n: [(r.choice(names + [None]), "redirect" if r.random() < .15 else "canonical" if r.random() < .1 else "link", r.choice((None, "", "nofollow" if r.random() < .3 else "me"))) for _ in range(r.choice((0, 1, 3, 6)))] for n in names}
    return pages, edges, r.sample(names, 2), r.sample(names, r.choice((0, 4, len(names) // 2))), set(r.sample(names, len(names) // 8)), r.choice([None] * 9 + ["robots_unreachable"])


def test_random_sites(spark):
    sites = {f"r{i}": made(i) for i in range(40)}
    frame = spark.createDataFrame
    pages = frame([(k, u, st, ["robots: nofollow"] if nf else [], None) for k, s in sites.items() for u, (st, nf) in s[0].items()], PAGES)
    edges = frame([(k, 0, i, u, to, kind, rel) for k, s in sites.items() for u, es in s[1].items() for i, (to, kind, rel) in enumerate(es)], EDGES)
    seeds = frame([(k, SITE, u, i) for k, s in sites.items() for i, u in enumerate(s[2])], "run_id string, site string, url string, pos int")
    listed = frame([(k, u, i + 1) for k, s in sites.items() for i, u in enumerate(s[3])], "run_id string, url string, pos int")
    denied = frame([(k, u) for k, s in sites.items() for u in s[4]], "run_id string, url string")
    blocked = frame([(k, s[5]) for k, s in sites.items() if s[5]], "run_id string, reason string")
    for policy in ((4, 3, 5, False, 5000), (3, 1, 0, True, 6)):
        rows, runs = crawl.replay(pages, edges, seeds, listed, denied, blocked, *policy)
        got = {k: {} for k in sites}
        for x in rows.collect():
            assert x.url not in got[x.run_id]
            got[x.run_id][x.url] = x.depth, x.hop, x.place, x.reason
        sums = {x.run_id: (x.pages, x.discovered, x.omitted_urls, x.halted) for x in runs.collect()}
        for k, s in sites.items():
            want, *counts = plain(*s, *policy)
            assert got[k] == want, (k, policy)
            assert sums[k] == tuple(counts), (k, policy)


def test_rules_one_by_one(spark):
    frame = spark.createDataFrame
    pages = frame([("r", U("a"), 200, [], None), ("r", U("b"), 200, [], "nofollow"), ("q", U("a"), 429, [], None)], PAGES)
    edges = frame([(k, 0, i, U(f), U(t), kind, None) for k in "rq" for i, (f, t, kind) in enumerate([("a", "b", "link"), ("a", "gone", "redirect"), ("b", "never", "link"), ("a", "c?x=1", "link"), ("a", "d?", "link"), ("a", "no", "link")])], EDGES)
    seeds = frame([(k, SITE, U("a")) for k in "rq"], "run_id string, site string, url string")
    files = frame([("https://s.example", "/robots.txt", 200, "User-agent: *\nDisallow: /no")], "origin string, path string, status int, body string")
    urls = edges.select("run_id", edges["to"].alias("url"))
    denied, blocked = crawl.robots_policy(seeds.select("run_id", "site"), urls, files, "Pagesbot")
    listed = frame([("r", U("z"), 1), ("q", U("z"), 1)], "run_id string, url string, pos int")
    rows, runs = crawl.replay(pages, edges, seeds, listed, denied, blocked, max_pages=5)
    got = {(x.run_id, x.url[len(SITE):]): (x.place, x.depth, x.hop, x.reason) for x in rows.collect()}
    assert got == {("r", "a"): (1, 0, 0, None), ("r", "b"): (2, 1, 0, None), ("r", "gone"): (3, 0, 1, None), ("r", "d?"): (4, 1, 0, None), ("r", "z"): (5, 0, 0, None), ("r", "c?x=1"): (None, None, None, "query_not_selected"),
        ("r", "no"): (None, None, None, "robots_disallow"), ("q", "a"): (1, 0, 0, None), ("q", "z"): (None, None, None, "rate_limited")}
    states = {x.run_id: x for x in crawl.coverage(rows, runs, pages).collect()}
    assert not states["r"].complete and (states["r"].not_in_archive, states["r"].skipped) == (3, 2) and states["q"].halted and not states["q"].complete
    _, down = crawl.robots_policy(seeds.select("run_id", "site"), urls, files.selectExpr("origin", "path", "503 status", "body"), "Pagesbot")
    assert {x.reason for x in down.collect()} == {"robots_unreachable"}


def test_complete_runs_and_none(spark):
    frame = spark.createDataFrame
    pages, edges = frame([("r", U("a"), 200, [], None), ("r", U("b"), 200, [], None)], PAGES), frame([("r", 0, 0, U("a"), U("b"), "link", None)], EDGES)
    seeds = frame([("r", SITE, U("a"))], "run_id string, site string, url string")
    rows, runs = crawl.replay(pages, edges, seeds)
    assert crawl.coverage(rows, runs, pages).first().complete
    assert not crawl.coverage(rows, runs, pages, frame([("r", 1)], "run_id string, faults long")).first().complete
    rows, runs = crawl.replay(pages, edges, seeds.limit(0))
    assert rows.count() == 0 and crawl.coverage(rows, runs, pages).count() == 0
