"""Assessment of snapshots (AS-1..15) over normalised report rows and site configuration."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as X
from . import reports as R
from .ranks import first_of_each

# Dimensions, metrics and scope of the reports of a standard snapshot.
SEARCH_SUITE = [[], ["page"], ["query"], ["date"]]
ANALYTICS_SUITE = [
    (["hostName"], ["sessions", "screenPageViews"], "all-hostnames"), (["sessionDefaultChannelGroup", "sessionSourceMedium"], ["sessions", "engagedSessions"], "production"), (["eventName"], ["eventCount", "keyEvents"], "production"),
    (["landingPagePlusQueryString", "sessionSource"], ["sessions", "engagedSessions"], "production-organic"), (["eventName"], ["eventCount", "keyEvents"], "production-organic"), (["landingPagePlusQueryString", "sessionSource", "eventName"], ["eventCount"], "production-organic")]
# What to do about a finding.
NEXT_CHECKS = {
    "no-success-events": "Name the visitor action that counts and make sure that it is tracked.", "success-events-unverified": "Compare each event with a real visit and with the provider's reports.",
    "key-event-metadata-unavailable": "Read the key-event settings of the property.", "key-event-metadata-partial": "Read the remaining pages of the key-event settings.", "key-event-metadata-unusable": "Read the key-event settings again, for the configured property.",
    "configured-key-events": "Compare the settings with the events that were observed.", "report-unavailable": "Collect this report; that it is missing says nothing about activity.", "report-unusable": "Look at the saved report and collect one that fits.",
    "organic-landing-events": "Read events beside the traffic of their landing page; counts are not sessions.", "other-hostnames": "Keep reports filtered to the production host.", "event-findings-capped": "Raise the limit or read the report for the other events.",
    "reported-key-event": "Look up what triggers the event.", "excluded-key-event": "Look up what triggers the event, and keep it out of results.", "configured-event-not-observed": "Check period, host and coverage before the tracking.",
    "success-event-not-observed": "Check coverage, period and filters, then a real visit.", "provider-incomplete": "Look at the saved error or paging before relying on what is missing."}


def with_next_checks(findings: DataFrame) -> DataFrame:
    """Findings with what to do about each."""
    texts = F.create_map(*[F.lit(x) for kv in NEXT_CHECKS.items() for x in kv])
    return findings.withColumn("next_check", F.try_element_at(texts, F.col("finding")))


def finding(df: DataFrame, kind: str, level: str, subject="site", value=None) -> DataFrame:
    return df.select("site", F.lit(kind).alias("finding"), F.lit(level).alias("level"), F.col(subject).cast("string").alias("subject"), (F.lit(None).cast("string") if value is None else F.col(value).cast("string")).alias("value"))


def assessment_tables(rows: DataFrame, groups: list, keys: list, metric: str, most: int = 10) -> DataFrame:
    """AS-1: per report the first rows by its first metric, unparseable last, then by key; observed and displayed counts."""
    value = X.safe_number(F.col(metric).cast("string"))
    out = first_of_each(rows, groups, [F.desc_nulls_last(value), *keys], most, "place", "observed")
    return out.withColumn("displayed", F.least(F.col("observed"), F.lit(most)).cast("long"))


def standard_suite(config: DataFrame) -> DataFrame:
    """The reports that a snapshot of each site should hold: (site, name, provider, target, dims, metrics, scope, timed).

    `config` is (site, search_property, analytics_property); a site without a property has no reports of that provider.
    """
    rows = [("search", d, [], "search-property") for d in SEARCH_SUITE] + [("analytics", d, m, s) for d, m, s in ANALYTICS_SUITE]
    suite = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.array(*map(F.lit, d)).cast("array<string>").alias("dims"), F.array(*map(F.lit, m)).cast("array<string>").alias("metrics"), F.lit(s).alias("scope")) for p, d, m, s in rows])).alias("r")
    out = config.select("site", "search_property", "analytics_property", suite).select("site", "r.*", F.when(F.col("r.provider") == "search", F.col("search_property")).otherwise(F.col("analytics_property")).alias("target")).where("target IS NOT NULL")
    return out.withColumn("name", R.observation_name(F.col("provider"), F.col("dims"), F.col("scope") == "production-organic")).withColumn("timed", F.arrays_overlap("dims", F.array(F.lit("date"), F.lit("hour"))))


def scope_label():
    """AS-2."""
    return F.when(F.col("provider") == "search", "search-property").when(~F.col("host_filtered"), "all-hostnames").when(F.col("organic"), "production-organic").otherwise("production")


def expected_reports(expected: DataFrame, observations: DataFrame) -> DataFrame:
    """AS-3: reports of the suite that are missing, failed or empty; those by date or hour are not asked for."""
    due = expected.where("NOT timed") if "timed" in expected.columns else expected
    met = due.join(observations.select("site", "name", "status", "n_pages"), ["site", "name"], "left")
    return finding(met.where("status IS NULL OR status = 'error' OR coalesce(n_pages, 0) = 0"), "report-unavailable", "unknown", "name")


def suite_mismatches(suite: DataFrame, reports: DataFrame) -> DataFrame:
    """AS-4: (site, name, rule) of reports unlike the suite: another provider or target, other dimensions or metrics, or
    property totals that were not aggregated by property. `reports` is (site, name, provider, target, dims, metrics,
    aggregation)."""
    r = reports.select("site", "name", F.col("provider").alias("p"), F.col("target").alias("t"), F.col("dims").alias("d"), F.col("metrics").alias("m"), "aggregation")
    met = suite.where("NOT timed").join(r, ["site", "name"])
    search = F.col("provider") == "search"
    rules = {"other-target": ~(F.col("p").eqNullSafe(F.col("provider")) & F.col("t").eqNullSafe(F.col("target"))), "other-scope": ~F.col("d").eqNullSafe(F.col("dims")) | ~search & ~F.col("m").eqNullSafe(F.col("metrics")),
             "not-by-property": search & (F.size("dims") == 0) & ~F.col("aggregation").eqNullSafe(F.lit("byProperty"))}
    return met.select("site", "name", F.explode(F.array_compact(F.array(*[F.when(c, r) for r, c in rules.items()]))).alias("rule"))


def unusable_reports(violations: DataFrame) -> DataFrame:
    """AS-4: a finding for each report that broke a rule, with the first of them; violations are (site, name, rule)."""
    return finding(violations.groupBy("site", "name").agg(F.min("rule").alias("rule")), "report-unusable", "unknown", "name", "rule")


def configured(config: DataFrame, key_events: DataFrame, most: int = 20) -> DataFrame:
    """AS-5..7: success events and key-event metadata of the sites with an analytics property.

    `key_events` is (site, key_events, incomplete). That no success event is configured is to be checked, that
    configured ones are not verified is a fact; only missing metadata leave something unknown.
    """
    met = config.where("analytics_property IS NOT NULL").join(key_events, "site", "left")
    some = F.coalesce(F.size("success_events"), F.lit(0)) > 0
    odd = F.exists("key_events", lambda e: F.coalesce(F.trim(e), F.lit("")) == "")
    listed = met.where(F.isnotnull("key_events") & ~odd).withColumn("shown", F.concat_ws(",", F.slice("key_events", 1, most)))
    out = finding(met.where(~some), "no-success-events", "check").unionByName(finding(met.where(some).withColumn("n", F.size("success_events")), "success-events-unverified", "fact", "site", "n"))
    out = out.unionByName(finding(met.where("key_events IS NULL"), "key-event-metadata-unavailable", "unknown"))
    out = out.unionByName(finding(met.where("incomplete AND key_events IS NOT NULL"), "key-event-metadata-partial", "unknown"))
    out = out.unionByName(finding(met.where(odd), "key-event-metadata-unusable", "unknown"))
    return out.unionByName(finding(listed, "configured-key-events", "fact", "site", "shown"))


def landing_note(observations: DataFrame) -> DataFrame:
    """AS-8."""
    return finding(observations.where("name = 'analytics.organic-landing-events'"), "organic-landing-events", "fact", "name")


def other_hostnames(census: DataFrame, config: DataFrame, most: int = 10) -> DataFrame:
    """AS-9: hosts besides the production host with a positive metric; `census` is (site, host, sessions, views)."""
    rows = census.join(config.select("site", "production_host"), "site").where("host <> production_host AND (sessions > 0 OR views > 0)")
    return finding(assessment_tables(rows, ["site"], ["host"], "sessions", most), "other-hostnames", "fact", "host", "sessions")


def reported_key_events(events: DataFrame, config: DataFrame, most: int = 10) -> DataFrame:
    """AS-10: events with a positive key-event count; excluded ones apart; a note where the list is cut."""
    rows = events.where("key_events > 0").join(config.select("site", "excluded_events"), "site", "left")
    shown = assessment_tables(rows, ["site"], ["event_name"], "key_events", most)
    excluded = F.coalesce(F.array_contains("excluded_events", F.col("event_name")), F.lit(False))
    out = finding(shown.where(~excluded), "reported-key-event", "fact", "event_name", "key_events").unionByName(finding(shown.where(excluded), "excluded-key-event", "check", "event_name", "key_events"))
    return out.unionByName(finding(shown.where("observed > displayed").groupBy("site").agg(F.max(F.col("observed") - F.col("displayed")).alias("omitted")), "event-findings-capped", "fact", "site", "omitted"))


def not_observed(wanted: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """AS-11 (configured-event-not-observed, a fact) and AS-12 (success-event-not-observed, which leaves the outcome
    unknown); `wanted` is (site, event_name)."""
    level = "unknown" if kind == "success-event-not-observed" else "fact"
    return finding(wanted.select("site", "event_name").distinct().join(events.select("site", "event_name"), ["site", "event_name"], "left_anti"), kind, level, "event_name")


def provider_incomplete(observations: DataFrame) -> DataFrame:
    """AS-13."""
    return finding(observations.where("status <> 'ok'"), "provider-incomplete", "unknown", "name", "status")


def result_status(findings: DataFrame, tables_complete: DataFrame, snapshots: DataFrame) -> DataFrame:
    """AS-14: partial with an unknown finding, an incomplete table or a snapshot that is not ok.

    `tables_complete` is (site, complete), `snapshots` (site, status).
    """
    a = findings.groupBy("site").agg(F.bool_or(F.col("level") == "unknown").alias("unknown"))
    b = tables_complete.groupBy("site").agg(F.bool_and("complete").alias("complete"))
    met = snapshots.join(a, "site", "left").join(b, "site", "left")
    bad = F.coalesce("unknown", F.lit(False)) | ~F.coalesce("complete", F.lit(False)) | (F.col("status") != "ok")
    return met.select("site", F.when(bad, "partial").otherwise("ok").alias("status"))
