import hashlib
import html as H
import re
import zlib

SF = "/root/testdata/sf0.001"


def test_media_round_trip(spark):
    from sitefacts.llm import media
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = media.op1_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = texts[r.doc_id]
        p += b"\xff" * ((-len(p)) % 576 if p else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        stored = b"P5\n576 %d\n255\n" % (len(p) // 576) + p
        assert (r.media_bytes, r.media_sha256, r.caption) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{r.n_bytes} bytes")


def test_sequences_stay_aligned(spark):
    from sitefacts.llm import media
    page = '<p>One</p><figure><img src="sha256:AB"><figcaption>A &amp; b</figcaption></figure><p>Two <img src="sha256:cd" alt="c"> three</p>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    facts = spark.createDataFrame([("ab", 1, (5,))], "digest string, n long, facts struct<n_samples: long>")
    rows = media.resolve(media.sequences(pages).drop("html"), facts).collect()
    got = sorted((r.page_id, r.item.pos if r.item else None, r.item.kind if r.item else None, r.item.text if r.item else None, r.item.caption if r.item else None, r.facts.n_samples if r.facts else None) for r in rows if r.page_id == 1)
    assert got == [(1, 0, "text", "One", None, None), (1, 1, "media", None, "A & b", 5), (1, 2, "text", "Two", None, None), (1, 3, "media", None, "c", None), (1, 4, "text", "three", None, None)]
    assert sorted(r.page_id for r in rows if r.item is None) == [2, 3]


def test_media_nulls_and_extra_columns(spark, tmp_path):
    from sitefacts.llm import media
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "é" * 288, "x")], "doc_id long, text string, digest string")
    got = media.resolve(media.sequences(media.store(docs, str(tmp_path / "m")).select("doc_id", "n_bytes", "html")).drop("html"), media.describe(spark.read.parquet(str(tmp_path / "m")))).collect()
    assert sorted((r.n_bytes, r.facts.n_samples) for r in got) == [(0, 576)] * 3 + [(576, 576)]


def test_article_of_every_page(spark):
    from sitefacts.llm import html_text
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op7_html_extraction(spark, SF).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id]).group(1)
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_style_tree_removes_what_a_site_repeats(spark):
    from sitefacts.llm import html_text
    page = "<body><div class=top>Our site</div><div class=text><p>Own words {0} &lt;x&gt; of<br>page {0}<p>More {0}</div><div class=x>Reader says</div></body>"
    rows = [(i, f"https://A.example/{i}", page.format(i)) for i in range(5)]
    rows += [(9, "https://one.example/", "<div>Only page</div>"), (10, None, None), (11, "x", ""), (12, "https://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (200_000, 0):
        got = {r.page_id: r.text for r in html_text.extract(pages.withColumn("host", html_text.F.lit("clash")), broadcast_nodes=bound).collect()}
        want = {i: f"Own words {i} <x> of page {i}\n\nMore {i}" for i in range(5)}
        assert got == want | {9: "Only page", 10: "", 11: "", 12: want[0]}


def test_html_marks():
    from sitefacts.llm import html_text
    h = "<nav>m</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<ul><li>x<li>y</ul><div class='comment-list'>c</div><aside>s</aside><p>z<span class=ad>buy</span>w</article>tail<footer>f</footer>"
    assert [t for _, m, t in html_text.blocks(h) if m == "main"] == ["T", "a bc", "x", "y", "z", "w"]


def test_style_tree_judges_marked_articles_and_unmarked_menus(spark):
    from sitefacts.llm import html_text
    page = "<ul class=top><li>Home<li>About us</ul><article><h1>Title {0}</h1><p>Own words {0}</p><p class=legal>All rights kept by Us Ltd</p></article>"
    bare = "<ul class=top><li>Home<li>About us</ul><div class=text><p>Body {0} of its own</div>"
    rows = [(i, f"https://marked.example/{i}", page.format(i)) for i in range(20)] + [(100 + i, f"https://bare.example/{i}", bare.format(i)) for i in range(8)]
    rows += [(200, "https://few.example/", page.format(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[i] == f"Title {i}\n\nOwn words {i}" for i in range(20))
    assert all(got[100 + i] == f"Body {i} of its own" for i in range(8))
    assert got[200] == "Title 0\n\nOwn words 0\n\nAll rights kept by Us Ltd"
    assert html_text.extract(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    import time
    from sitefacts.llm import html_text
    began = time.time()
    for opening in ("<div class=x>", "<p><table><tr><td>", "<b>", "<li>", "<ul><li>"):
        assert html_text.blocks(opening * 20_000 + "deep")[-1][2] == "deep"
    assert time.time() - began < 20
