"""Captures of a URL that was fetched twice are paired fetch by fetch."""

from sitefacts import queries

SF = "/root/testdata/sf0.001"


def twice(spark, path, tables=("pages",)):
    """A copy of sf0.001 in which every page is there again under another page_id, with the same url."""
    for t in tables:
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows.unionByName(rows.withColumn("page_id", rows.page_id + 1000)).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def same(spark, sf, name):
    run, sql = queries.QUERIES[name]
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    df = run(spark, sf)
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, theirs)) and theirs


def test_capture_diff(spark, tmp_path):
    same(spark, twice(spark, tmp_path), "capture_diff")


def test_document_diff(spark, tmp_path):
    same(spark, twice(spark, tmp_path), "document_diff")
