"""Strict reading, and both ways to expand sitemap indexes against a plain queue."""

import random

import pytest

from sitefacts import sitemaps

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
ONE = "<url><loc>a</loc></url>"


@pytest.mark.parametrize("body, want", [
    ("<urlset/>", []), (f"<urlset {NS}>{ONE}</urlset>", ["a"]), (f"<?xml version='1.0' encoding='latin-1'?><urlset>{ONE}</urlset>", ["a"]), ("<urlset><url><loc> a&amp;b\n</loc></url></urlset>", ["a&b"]),
    ("<urlset><url><loc>https://e.x/&#x61;?a=1&#38;b=2&amp;l=&#x1F600;</loc></url><url><loc><![CDATA[x<y&z]]></loc></url></urlset>", ["https://e.x/a?a=1&b=2&l=😀", "x<y&z"]),
    ("<sitemapindex><sitemap><loc>a</loc><lastmod>1</lastmod><lastmod>2</lastmod></sitemap></sitemapindex>", ["a"]), ("<urlset><url><loc>a</loc><priority>1</priority><image>x<b/></image></url></urlset>", ["a"]),
    (f'<urlset {NS} xmlns:i="urn:i"><url><i:loc>b</i:loc><i:loc><i:x/></i:loc><loc>a</loc></url></urlset>', ["a"]), (f'<urlset {NS} xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>a</s:loc></s:url></urlset>', ["a"]), ("<urlset>text<url>text<loc>a</loc></url></urlset>", ["a"]),
    ('<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"/>', "unsupported_sitemap"), ("<feed/>", "invalid_sitemap"), ('<urlset xmlns="urn:x"/>', "invalid_sitemap"), (None, "invalid_sitemap"), ("", "invalid_sitemap"), ("\ud800", "invalid_sitemap"), ("\x00", "invalid_sitemap"),
    ("<urlset><x><loc>a</loc></x></urlset>", "invalid_sitemap"), ("<urlset><foo/></urlset>", "invalid_sitemap"), ("<urlset><sitemap><loc>a</loc></sitemap></urlset>", "invalid_sitemap"), ("<urlset><url/></urlset>", "invalid_sitemap"), ("<urlset><url><loc/></url></urlset>", "invalid_sitemap"),
    ("<urlset><url><loc>  </loc></url></urlset>", "invalid_sitemap"), ("<urlset><url><loc>a</loc><loc>b</loc></url></urlset>", "invalid_sitemap"), ("<urlset><url><loc>a<b/></loc></url></urlset>", "invalid_sitemap"), ("<urlset><url><loc>a</loc><lastmod><b/></lastmod></url></urlset>", "invalid_sitemap"),
    ('<!DOCTYPE urlset [<!ENTITY foo "secret">]><urlset/>', "invalid_sitemap"), ("<urlset><url><loc>a&bad;</loc></url></urlset>", "invalid_sitemap"), ("<urlset><url><loc>a</loc></urlset>", "invalid_sitemap"), ("<urlset/><urlset/>", "invalid_sitemap"), ("<urlset><i:url><loc>a</loc></i:url></urlset>", "invalid_sitemap"),
    (f'<urlset {NS} xmlns:i="urn:i"><i:url><loc>a</loc></i:url></urlset>', "invalid_sitemap")])
def test_documents(body, want):
    try:
        assert [loc for _, loc, _ in sitemaps.read_document(body)] == want
    except sitemaps.Rejected as e:
        assert str(e) == want


def test_mutated_documents_never_fail_the_job(spark):
    rng = random.Random(5)
    sound = [f'<?xml version="1.0"?><urlset {NS} xmlns:i="urn:i">' + "".join(f"<url><loc>https://s.example/{i}?a=1&amp;b</loc><lastmod>2024-01-0{i}</lastmod><i:loc>é😀</i:loc></url>" for i in range(1, 4)) + "</urlset>", "<sitemapindex><sitemap><loc><![CDATA[x]]></loc></sitemap><!-- c --></sitemapindex>"]
    parts = ["<", ">", "</", "/>", "&", ";", "&#0;", "&#x110000;", "loc", "url", "<loc>", "</loc>", "<url>", "]]>", "<![CDATA[", "<!--", "-->", "<?x", "\x00", "\x0b", "\ud83d", "i:", "xmlns=''", "﻿", "<!DOCTYPE a>", '"', " "]

    def mutated():
        text = rng.choice(sound)
        for _ in range(rng.randrange(1, 6)):
            i, j = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
            j = min(j, i + rng.randrange(12))
            text = text[:i] + rng.choice([rng.choice(parts), "", text[i:j] * 2]) + text[j:]
        return text

    bodies = [mutated() for _ in range(10_000)]
    for b in bodies:
        try:
            assert all(kind in ("page", "child") and loc for kind, loc, _ in sitemaps.read_document(b))
        except sitemaps.Rejected:
            pass
    docs = spark.createDataFrame([(f"d{i}", 200, b.encode("utf-8", "replace").decode()) for i, b in enumerate(bodies)] + [("null", None, None)], "url string, status int, body string")
    seen = sitemaps.parsed(docs).where("kind = 'document'")
    assert seen.count() == 10_001 and seen.where("reject IS NOT NULL").count() > 5_000


def plain_inventory(root, docs, most, limit):
    queue, scheduled, steps, size, omitted, urls = [root], {root}, [], 0, 0, set()
    while queue and len(steps) < most and size < limit:
        url = queue.pop(0)
        status, body = docs.get(url, (None, None))
        n = len(body or "")
        error = "outside_origin" if not url.startswith("https://s.example/") else "not_fetched" if status is None else "size_limit" if n > limit - size else f"HTTP_{status}" if status != 200 else None
        if not error:
            size += n
            try:
                found = sitemaps.read_document(body)
                for kind, loc, _ in found:
                    if kind == "page":
                        urls.add(loc)
                    elif loc in scheduled:
                        continue
                    elif len(scheduled) >= most:
                        omitted += 1
                    else:
                        scheduled.add(loc)
                        queue.append(loc)
            except sitemaps.Rejected as e:
                error = str(e)
        steps.append((url, error))
    return steps + [(u, "unvisited") for u in queue], omitted, len(urls)


def plain_crawl(root, docs, most, each, limit, cap):
    queue, seen, steps, size, omitted, urls, over = [root], [], [], 0, 0, [], 0
    while queue and len(seen) < most and size < limit:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        status, body = docs.get(url, (None, None))
        n = len(body or "")
        error = "outside_origin" if not url.startswith("https://s.example/") else "not_fetched" if status is None else "size_limit" if n > min(each, limit - size) else None
        if not error:
            size += n
            error = f"HTTP_{status}" if status != 200 else None
        if not error:
            try:
                for kind, loc, _ in sitemaps.read_document(body):
                    if kind == "page":
                        if loc not in urls:
                            if len(urls) >= cap:
                                over += 1
                            else:
                                urls.append(loc)
                    elif len(queue) + len(seen) >= most:
                        omitted += 1
                    else:
                        queue.append(loc)
            except sitemaps.Rejected as e:
                error = str(e)
        steps.append((url, error))
    return steps, omitted + len(queue), urls, over


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_to_expand_equal_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"https://s.example/{i}.xml" for i in range(14)] + ["https://t.example/0.xml"]
    docs = {}
    for n in names[:12] + names[14:]:
        if rng.random() < 0.6:
            body = "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in rng.choices(names, k=rng.randrange(1, 7))) + "</sitemapindex>"
        else:
            body = rng.choice(["<urlset>" + "".join(f"<url><loc>https://s.example/p{rng.randrange(20)}</loc></url>" for _ in range(rng.randrange(9))) + "</urlset>"] * 4 + ["<bad"])
        docs[n] = (rng.choice([200, 200, 200, 200, 404]), body)
    roots = list(docs)
    df = spark.createDataFrame([(u, s, b) for u, (s, b) in docs.items()], "url string, status int, body string")
    at = spark.createDataFrame([(r,) for r in roots], "root string")
    limit = 700
    got = {}
    for r in sitemaps.sitemap_inventory(at, df, max_bytes=limit).collect():
        got.setdefault(r.root, []).append(r)
    for root in roots:
        if not root.startswith("https://s.example/"):
            continue
        steps, omitted, urls = plain_inventory(root, docs, 5, limit)
        rows = sorted(got[root], key=lambda r: (r.position is None, r.position))
        n = sum(e != "unvisited" for _, e in steps)
        assert [(r.url, r.error) for r in rows[:n]] == steps[:n] and sorted((r.url, r.error) for r in rows[n:]) == sorted(steps[n:]), root
        assert {(r.omitted, r.all_urls) for r in rows} == {(omitted, urls)}, root
    inside = [r for r in roots if r.startswith("https://s.example/")]
    urls, visits = sitemaps.crawl_sitemaps(at.where("root LIKE 'https://s.%'"), df, cap=6, each=400, max_bytes=limit)
    seen, visits = {}, {r.root: r for r in visits.collect()}
    for r in urls.orderBy("root", "pos").collect():
        seen.setdefault(r.root, []).append(r.url)
    for root in inside:
        steps, omitted, pages, over = plain_crawl(root, docs, 5, 400, limit, 6)
        assert [(s.url, s.error) for s in visits[root].steps] == steps and seen.get(root, []) == pages, root
        assert (visits[root].omitted_documents, visits[root].omitted_urls) == (omitted, over), root


def test_coverage_and_large_index(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://s.example/{i}.xml</loc></sitemap>" for i in range(20_000)) + "</sitemapindex>"
    docs = spark.createDataFrame([("https://s.example/i.xml", 200, index)] + [(f"https://s.example/{i}.xml", 200, "<urlset/>") for i in range(9)] + [("https://s.example/one.xml", 200, f"<urlset>{ONE}</urlset>")], "url string, status int, body string")
    roots = spark.createDataFrame([("https://s.example/i.xml",), ("https://s.example/one.xml",)], "root string")
    got = {r.root[-5:]: r for r in sitemaps.sitemap_coverage(sitemaps.sitemap_inventory(roots, docs)).collect()}
    assert (got["i.xml"].documents, got["i.xml"].omitted, got["i.xml"].unvisited, got["i.xml"].complete) == (5, 19_996, 0, False)
    assert (got["e.xml"].documents, got["e.xml"].urls, got["e.xml"].complete) == (1, 1, True)
    none = spark.createDataFrame([], "root string")
    assert sitemaps.sitemap_inventory(none, docs).count() == 0 and sitemaps.crawl_sitemap_urls(none, docs).count() == 0
    assert {m[0] for m in sitemaps.future_lastmods(sitemaps.sitemap_entries(spark.createDataFrame([("u", 200, "<urlset><url><loc>a</loc><lastmod>2099-01-01T0</lastmod><lastmod>2001</lastmod></url></urlset>")], "url string, status int, body string")), "2030-01-01").collect()} == {"2099-01-01T0"}
