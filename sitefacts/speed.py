"""Speed records (SRC-8, 9, SP-1..5) and the comparison of captures (DF-1..4). No record is unknown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRIC = "struct<histogram:array<struct<start:string,`end`:string,density:double>>,percentiles:struct<p75:string>,fractions:map<string,double>>"


def crux_records(bodies: DataFrame) -> DataFrame:
    """SRC-8: `bodies` has `body`, a JSON record; the metric map stays a map."""
    v = F.try_parse_json("body")
    g = lambda p, k: F.try_variant_get(v, p, k)
    day = lambda p: F.make_date(g(f"{p}.year", "int"), g(f"{p}.month", "int"), g(f"{p}.day", "int"))
    return bodies.select(g("$.record.key.url", "string").alias("url"), g("$.record.key.origin", "string").alias("origin"), g("$.record.key.formFactor", "string").alias("form_factor"), g("$.record.metrics", f"map<string,{METRIC}>").alias("metrics"),
        day("$.record.collectionPeriod.firstDate").alias("first_date"), day("$.record.collectionPeriod.lastDate").alias("last_date"))


def field_metrics(records: DataFrame) -> DataFrame:
    """SP-1."""
    return records.select("url", "origin", "form_factor", "first_date", "last_date", F.explode("metrics").alias("metric", "m")).select("url", "origin", "form_factor", "first_date", "last_date", "metric", F.col("m.percentiles.p75").alias("p75"))


def histogram(records: DataFrame) -> DataFrame:
    """SP-2: bins in order; fractions are bins with a label instead of bounds."""
    rows = records.select("url", "origin", "form_factor", F.explode("metrics").alias("metric", "m"))
    bins = rows.select("url", "origin", "form_factor", "metric", F.posexplode("m.histogram").alias("bin", "h")).select("url", "origin", "form_factor", "metric", "bin", F.lit(None).cast("string").alias("label"), F.col("h.start").alias("low"), F.col("h.end").alias("high"), F.col("h.density").alias("density"))
    none = F.lit(None)
    parts = rows.select("url", "origin", "form_factor", "metric", F.explode("m.fractions").alias("label", "density")).select("url", "origin", "form_factor", "metric", none.cast("int").alias("bin"), "label", none.cast("string").alias("low"), none.cast("string").alias("high"), "density")
    return bins.unionByName(parts)


def history(rows: DataFrame) -> DataFrame:
    """SP-3: rows hold periods array<struct<first_date,last_date>> and metrics map<string,struct<p75s array, densities
    array<array<double>>>>; one row per period and metric, nulls kept."""
    m = rows.select("url", "origin", "form_factor", "periods", F.explode("metrics").alias("metric", "m"))
    z = m.select("url", "origin", "form_factor", "metric", F.posexplode(F.arrays_zip(F.col("periods").alias("period"), F.col("m.p75s").alias("p75"), F.col("m.densities").alias("densities"))).alias("period_no", "z"))
    return z.select("url", "origin", "form_factor", "metric", "period_no", F.col("z.period.first_date").alias("first_date"), F.col("z.period.last_date").alias("last_date"), F.col("z.p75").alias("p75"), F.col("z.densities").alias("densities"))


def lab_results(bodies: DataFrame) -> DataFrame:
    """SRC-9."""
    v = F.try_parse_json("body")
    g = lambda p, k: F.try_variant_get(v, p, k)
    audit = "struct<score:double,numericValue:double,numericUnit:string,details:struct<overallSavingsMs:double,overallSavingsBytes:double>>"
    return bodies.select(g("$.id", "string").alias("url"), g("$.lighthouseResult.configSettings.formFactor", "string").alias("strategy"), g("$.lighthouseResult.categories", "map<string,struct<score:double>>").alias("categories"), g("$.lighthouseResult.audits", f"map<string,{audit}>").alias("audits"),
        g("$.lighthouseResult.runWarnings", "array<string>").alias("run_warnings"), g("$.loadingExperience.metrics", "map<string,struct<percentile:double,category:string,distributions:array<struct<min:double,max:double,proportion:double>>>>").alias("field"))


def lab_audits(results: DataFrame) -> DataFrame:
    """SP-4: scores of categories and audits with their value and savings."""
    none = F.lit(None)
    a = results.select("url", "strategy", F.explode("categories").alias("id", "c")).select("url", "strategy", F.lit("category").alias("kind"), "id", F.col("c.score").alias("score"), none.cast("double").alias("value"), none.cast("string").alias("unit"), none.cast("double").alias("savings_ms"), none.cast("double").alias("savings_bytes"))
    b = results.select("url", "strategy", F.explode("audits").alias("id", "x")).select("url", "strategy", F.lit("audit").alias("kind"), "id", F.col("x.score").alias("score"), F.col("x.numericValue").alias("value"), F.col("x.numericUnit").alias("unit"), F.col("x.details.overallSavingsMs").alias("savings_ms"), F.col("x.details.overallSavingsBytes").alias("savings_bytes"))
    return a.unionByName(b)


def lab_field(results: DataFrame) -> DataFrame:
    """SP-5."""
    rows = results.select("url", "strategy", F.explode("field").alias("metric", "f")).select("url", "strategy", "metric", "f.percentile", "f.category", F.posexplode("f.distributions").alias("bin", "d"))
    return rows.select("url", "strategy", "metric", "percentile", "category", "bin", F.col("d.min").alias("low"), F.col("d.max").alias("high"), F.col("d.proportion").alias("proportion"))


CAPTURE_FIELDS = ["titles", "descriptions", "canonicals", "robots", "h1", "json_ld", "links", "link_texts"]


def capture_diff(a: DataFrame, b: DataFrame, key=("url",)) -> DataFrame:
    """DF-1: for each pair of captures and field equal, different or unavailable. Captures are seo_fields rows (url, ...,
    truncated). Those with the same `key`, which has the url, are a pair; name more of it where a url was captured twice."""
    side = lambda df, p: df.select(*key, F.struct(*CAPTURE_FIELDS, "truncated").alias(p))
    met = side(a, "a").join(side(b, "b"), [*key], "full")
    gone = F.isnull("a") | F.isnull("b") | F.coalesce(F.col("a.truncated") | F.col("b.truncated"), F.lit(False))
    one = lambda f: F.struct(F.lit(f).alias("field"), F.when(gone, "unavailable").when(F.to_json(F.struct(F.col(f"a.{f}"))) == F.to_json(F.struct(F.col(f"b.{f}"))), "equal").otherwise("different").alias("result"))
    return met.select("url", F.explode(F.array(*map(one, CAPTURE_FIELDS))).alias("x")).select("url", "x.field", "x.result")


def document_diff(a: DataFrame, b: DataFrame, key=("url",)) -> DataFrame:
    """DF-2: status and X-Robots-Tag of two captures of a document; `key` as in capture_diff."""
    x, y = a.select(*key, F.struct("status", "x_robots_tag").alias("a")), b.select(*key, F.struct("status", "x_robots_tag").alias("b"))
    one = lambda f: F.struct(F.lit(f).alias("field"), F.when(F.isnull("a") | F.isnull("b"), "unavailable").when(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), "equal").otherwise("different").alias("result"))
    return x.join(y, [*key], "full").select("url", F.explode(F.array(one("status"), one("x_robots_tag"))).alias("x")).select("url", "x.field", "x.result")


def target_document(captures: DataFrame) -> DataFrame:
    """DF-3: the last document whose URL is the final one without fragment; null if the history was cut.

    `documents` is array<struct<url, status, x_robots_tag>> in order.
    """
    same = F.filter("documents", lambda d: d.url == F.regexp_replace("final_url", "#.*$", ""))
    return captures.withColumn("document", F.when(~F.col("history_truncated"), F.try_element_at(same, F.lit(-1))))


def overall_status(captures: DataFrame, diffs: DataFrame) -> DataFrame:
    """DF-4: partial if a capture is not ok or cut or a comparison unavailable."""
    a = captures.groupBy("url").agg(F.bool_or((F.col("status") != "ok") | F.col("truncated")).alias("bad"))
    b = diffs.groupBy("url").agg(F.bool_or(F.col("result") == "unavailable").alias("gone"))
    return a.join(b, "url", "full").select("url", F.when(F.coalesce("bad", F.lit(True)) | F.coalesce("gone", F.lit(True)), "partial").otherwise("ok").alias("status"))
