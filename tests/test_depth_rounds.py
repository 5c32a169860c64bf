"""Depths take a round for each step of a shortest way, redirects included."""

from sitefacts import graph


def test_rounds(spark, monkeypatch):
    url = "https://s.example/{}".format
    rows = [("r", i, 0, url(i), url(i + 1), "redirect" if i % 2 else "link") for i in range(6)] + [("r", 9, 0, url(0), url(3), "link"), ("r", 9, 1, url(9), url(0), "link")]
    written = []
    plain = graph.saved
    monkeypatch.setattr(graph, "saved", lambda rows: written.append(1) or plain(rows))
    df = spark.createDataFrame(rows, "run_id string, seq long, pos int, from string, to string, kind string")
    got = graph.depths(df, spark.createDataFrame([("r", url(0))], "run_id string, url string")).collect()
    assert {r.url: r.depth for r in got} == {url(0): 0, url(1): 1, url(2): 1, url(3): 1, url(4): 1, url(5): 2, url(6): 2} and len(got) == 7
    assert len(written) <= 7  # the ways, the seeds, four rounds and the empty one
