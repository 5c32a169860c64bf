"""Comparison of two periods or snapshots (CP-1..9). What one side lacks is listed, never filled with zero."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as X
from .ranks import first_of_each
from .workdir import saved

STATUSES = ("compared", "limited", "incompatible", "unsupported", "unavailable")


def deltas(before: DataFrame, after: DataFrame, keys: list) -> DataFrame:
    """CP-4: both sides hold keys, metric, raw text and maybe is_number. Common keys with raw values, delta and percent.

    A delta is null where a side is no safe number or the difference leaves the safe range; a percent is null for a
    baseline of zero.
    """
    on = [*keys, "metric"]
    number = lambda df: X.safe_number(F.col("raw"), F.col("is_number") if "is_number" in df.columns else None)
    a, b = before.select(*on, F.col("raw").alias("before_raw"), number(before).alias("x")), after.select(*on, F.col("raw").alias("after_raw"), number(after).alias("y"))
    d = F.when(F.abs(F.col("y") - F.col("x")) <= X.SAFE, F.col("y") - F.col("x"))
    met = a.join(b, on).withColumn("delta", d)
    return met.select(*on, "before_raw", "after_raw", "delta", F.round(F.try_divide(F.lit(100.0) * F.col("delta"), F.when(F.col("x") != 0, F.col("x"))), 6).alias("percent"))


def only_in(here: DataFrame, there: DataFrame, keys: list) -> DataFrame:
    """CP-5: rows whose keys the other side lacks."""
    return here.join(there.select(*keys).distinct(), keys, "left_anti")


def cap(rows: DataFrame, groups: list, order: list, most: int = 100) -> DataFrame:
    """CP-6: the first rows of each group in key order, with the number omitted."""
    out = first_of_each(rows, groups, order, most, "place_", "total_")
    return out.withColumn("omitted", F.greatest(F.col("total_") - most, F.lit(0)).cast("long")).drop("place_", "total_")


def pair(before: DataFrame, after: DataFrame, usable_before: DataFrame, usable_after: DataFrame) -> DataFrame:
    """CP-1..3: observations of two snapshots of one site by name, with the reason why a pair can't be compared.

    Sides are (site, name, provider, operation, target, status, n_pages, scope, semantics, start_date, end_date);
    `usable_*` are (site, name) of the reports without a violation.
    """
    cols = ["provider", "operation", "target", "status", "n_pages", "scope", "semantics", "start_date", "end_date"]
    side = lambda df, p, use: df.select("site", "name", *[F.col(c).alias(f"{p}_{c}") for c in cols]).withColumn(f"{p}_here", F.lit(True)).join(use.select("site", "name", F.lit(True).alias(f"{p}_usable")).distinct(), ["site", "name"], "left")
    met = side(before, "b", usable_before).join(side(after, "a", usable_after), ["site", "name"], "full")
    differs = lambda *names: F.exists(F.array(*[~F.col(f"b_{n}").eqNullSafe(F.col(f"a_{n}")) for n in names]), lambda x: x)
    length = lambda p: F.date_diff(F.col(f"{p}_end_date"), F.col(f"{p}_start_date"))
    broken = lambda p: (F.col(f"{p}_status") == "error") | (F.coalesce(f"{p}_n_pages", F.lit(0)) == 0)
    status = F.when(F.isnull("b_here") | F.isnull("a_here"), "unavailable").when(differs("provider", "operation", "target"), "incompatible").when(F.col("b_operation") != "report", "unsupported")
    status = status.when(broken("b") | broken("a"), "unavailable").when(F.isnull("b_usable") | F.isnull("a_usable") | differs("scope", "semantics"), "incompatible")
    status = status.when((length("b") != length("a")) | (F.col("b_end_date") >= F.col("a_start_date")), "incompatible").otherwise("compared")
    return met.select("site", "name", status.alias("status"))


def compare_snapshots(pairs: DataFrame, before: DataFrame, after: DataFrame, limits: DataFrame, most: int = 100):
    """CP-4..7: (statuses, changes, only before, only after). Sides are normalised rows (site, name, keys, metric,
    raw); `limits` is (site, name) of reports with a limitation.

    A pair is `limited` by a limitation of either side, by a shown row without a delta, and by common rows over `most`;
    keys of one side only are counted, but limit nothing. Pairs and changes, which every result reads, are saved.
    """
    pairs = saved(pairs)
    fine = pairs.where("status = 'compared'").select("site", "name")
    b, a = before.join(fine, ["site", "name"], "left_semi"), after.join(fine, ["site", "name"], "left_semi")
    key, order = ["site", "name", "keys"], [F.to_json("keys"), "metric"]
    changes, gone, new = saved(deltas(b, a, key)), only_in(b, a, key), only_in(a, b, key)
    shown = saved(cap(changes, ["site", "name", "metric"], order, most))
    stats = changes.groupBy("site", "name").agg(F.count_distinct("keys").alias("common"))
    lost = shown.where("delta IS NULL").select("site", "name", F.lit(True).alias("lost")).distinct()
    sizes = gone.unionByName(new).groupBy("site", "name").agg(F.count_distinct("keys").alias("others"))
    out = pairs.join(stats, ["site", "name"], "left").join(lost, ["site", "name"], "left").join(sizes, ["site", "name"], "left").join(limits.select("site", "name", F.lit(True).alias("limited")).distinct(), ["site", "name"], "left")
    bad = F.coalesce("limited", F.lit(False)) | F.coalesce("lost", F.lit(False)) | (F.coalesce("common", F.lit(0)) > most)
    statuses = out.withColumn("status", F.when((F.col("status") == "compared") & bad, "limited").otherwise(F.col("status"))).select("site", "name", "status", "common", "others")
    return statuses, shown, cap(gone, ["site", "name", "metric"], order, most), cap(new, ["site", "name", "metric"], order, most)


def comparison_summary(statuses: DataFrame) -> DataFrame:
    """CP-8: a count for each status; a status that no pair has counts zero of the pairs there are."""
    return statuses.groupBy("site").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def source_identity(documents: DataFrame) -> DataFrame:
    """CP-9: hash of the canonical JSON and the times of each input."""
    v = F.try_parse_json("body")
    return documents.select("snapshot_id", F.sha2(X.canonical_json(v), 256).alias("sha256"), F.try_variant_get(v, "$.startedAt", "string").alias("started_at"), F.try_variant_get(v, "$.finishedAt", "string").alias("finished_at"))
