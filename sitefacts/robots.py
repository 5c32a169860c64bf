"""Robots policy (RB-1..10) and the crawler registry (SRC-10) for many origins at once.

Files are (origin, path, status, body). Verdicts join rules by origin, group and the text before
their first wildcard. Agents are a list the caller gives (a registry has some dozens).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import functions as X

RULES = ("allow", "disallow")


def in_force(files: DataFrame, max_bytes: int = 512_000) -> DataFrame:
    """RB-4: 5xx and 429 forbid everything, other 4xx allow everything, else the body counts. A body over the bound is not
    read, and what it allows is unknown: everything is forbidden. `note` says why a file itself was not used."""
    blocked, large = (F.col("status") >= 500) | (F.col("status") == 429), (F.col("status") < 400) & (F.octet_length("body") > max_bytes)
    body = F.when(blocked | large, "User-agent: *\nDisallow: /").when(F.col("status") >= 400, "").otherwise(F.coalesce("body", F.lit("")))
    note = F.when(blocked, F.concat(F.lit("status_"), F.col("status").cast("string"))).when(large, "body_over_limit")
    return files.where("path = '/robots.txt'").withColumn("note", note).withColumn("body", body)


def lines(files: DataFrame, max_bytes: int = 512_000) -> DataFrame:
    """The lines with a directive, numbered from 1, and the number of the group they belong to (0: none yet)."""
    text = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    rows = in_force(files, max_bytes).select("origin", "note", F.posexplode(F.split("body", r"\r?\n")).alias("at", "raw")).withColumn("text", F.translate(text, "\t", " ")).withColumn("text", F.trim("text")).where("text <> ''")
    directive, value = F.lower(F.trim(F.regexp_extract("text", r"^([^:]*):", 1))), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    rows = rows.select("origin", "note", (F.col("at") + 1).alias("line"), F.contains("text", F.lit(":")).alias("colon"), directive.alias("directive"), value.alias("value"))
    kind = F.when((F.col("directive") == "user-agent") & (F.col("value") != ""), "agent").when(F.col("directive").isin(*RULES), "rule")
    order = Window.partitionBy("origin").orderBy("line")  # a body is bounded, so are its lines
    rows = rows.withColumn("kind", kind).withColumn("before", F.last("kind", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # A rule before any agent belongs to no group and so opens none.
    starts = (F.col("kind") == "agent") & F.coalesce(F.col("before") == "rule", F.lit(True))
    return rows.withColumn("group_no", F.sum(F.when(starts, 1).otherwise(0)).over(order))


def robots_agents(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'agent'").select("origin", "group_no", "line", F.col("value").alias("agent"))


def robots_rules(rows: DataFrame) -> DataFrame:
    """RB-1: rules with their group, type and path."""
    return rows.where("kind = 'rule' AND group_no > 0").select("origin", "group_no", "line", F.col("directive").alias("type"), F.col("value").alias("path"))


def robots_issues(rows: DataFrame) -> DataFrame:
    """RB-2: what could not be used, with line numbers; without one, why the file itself was not."""
    issue = F.when(~F.col("colon"), "missing_colon").when((F.col("directive") == "user-agent") & (F.col("value") == ""), "empty_user_agent")
    issue = issue.when(F.col("directive").isin(*RULES) & (F.col("group_no") == 0), "rule_before_user_agent").when((F.col("directive") == "sitemap") & (F.col("value") == ""), "empty_sitemap")
    whole = rows.where("note IS NOT NULL AND line = 1").select("origin", F.lit(None).cast("int").alias("line"), F.col("note").alias("issue"))
    return rows.where("note IS NULL").select("origin", "line", issue.alias("issue")).where("issue IS NOT NULL").unionByName(whole)


def robots_sitemaps(rows: DataFrame) -> DataFrame:
    """RB-3."""
    return rows.where("directive = 'sitemap' AND value <> ''").select("origin", "line", F.col("value").alias("sitemap"))


def pattern_matches() -> Column:
    """Whether `plain`, which begins with parts[0], matches the other `parts` in order, the last at its end if `anchored`.

    Each part is taken at its first place after the one before it, which never has to be taken back.
    """
    last = F.element_at("parts", -1)
    after = F.expr("""aggregate(filter(CASE WHEN size(parts) = 1 THEN array() WHEN anchored THEN slice(parts, 2, size(parts) - 2) ELSE slice(parts, 2, size(parts) - 1) END, p -> p <> ''),
        length(parts[0]) + 1, (at, p) -> CASE WHEN at > 0 AND locate(p, plain, at) > 0 THEN locate(p, plain, at) + length(p) ELSE 0 END)""")
    whole = F.when(F.size("parts") == 1, F.col("plain") == F.get("parts", F.lit(0))).otherwise(F.endswith("plain", last) & (F.length("plain") - F.length(last) + 1 >= after))
    return F.when(F.col("anchored"), (after > 0) & whole).otherwise(after > 0)


def robots_verdicts(urls: DataFrame, rows: DataFrame, agents: list) -> DataFrame:
    """RB-5, RB-6: for each (origin, path) and agent: allowed, the group's label and the rule that decides.

    All groups that name the agent count, else all of `*`; the longest pattern wins, allow on a tie. Among equal
    allows the last is reported, among equal disallows the first. Without a group or a match: allowed.
    """
    named = robots_agents(rows).withColumn("name", F.lower("agent"))
    asked = urls.select("origin", "path").distinct().withColumn("agent", F.explode(F.array(*map(F.lit, agents))))
    known = named.select("origin", F.col("name").alias("own"), F.lit(True).alias("found")).distinct()
    asked = asked.join(known, (asked.origin == known.origin) & (F.lower(asked.agent) == known.own), "left").select(asked.origin, "path", "agent", F.when(F.col("found"), F.lower("agent")).otherwise(F.lit("*")).alias("name"))
    labels = named.groupBy("origin", "name").agg(F.max_by("agent", "line").alias("label"))
    rules = named.select("origin", "name", "group_no").distinct().join(robots_rules(rows), ["origin", "group_no"])
    rules = rules.select("origin", "name", "line", "type", F.col("path").alias("pattern"), X.robots_norm(F.col("path")).alias("normal")).where("normal <> ''")
    rules = rules.withColumn("anchored", F.col("normal").endswith("$")).withColumn("parts", F.split(F.regexp_replace("normal", r"\$\z", ""), r"\*", -1)).withColumn("prefix", F.get("parts", F.lit(0)))
    # A path meets the rules whose text before the first wildcard it begins with: one key for each length there is.
    lengths = rules.select("origin", "name", F.length("prefix").alias("n")).distinct()
    paths = asked.select("path").distinct().withColumn("plain", X.robots_norm(F.col("path")))
    keyed = asked.join(paths, "path").join(lengths, ["origin", "name"]).where(F.col("n") <= F.length("plain")).withColumn("prefix", F.expr("substring(plain, 1, n)"))
    met = keyed.join(rules, ["origin", "name", "prefix"]).where(pattern_matches())
    allow = F.col("type") == "allow"
    best = met.groupBy("origin", "path", "agent").agg(F.max(F.struct(F.length("normal").alias("n"), allow.alias("allow"), F.when(allow, F.col("line")).otherwise(-F.col("line")).alias("tie"), "pattern")).alias("best"))
    out = asked.join(labels, ["origin", "name"], "left").join(best, ["origin", "path", "agent"], "left")
    return out.select("origin", "path", "agent", F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("label").alias("robots_group"), F.col("best.pattern").alias("rule"))


def crawler_registry(table: DataFrame) -> DataFrame:
    """SRC-10: `table` has one column `body`, a JSON object of token to facts."""
    rows = table.select(F.explode(F.from_json("body", "map<string,struct<operator:string,respect:string,`function`:string,description:string>>")).alias("token", "x"))
    plain = F.regexp_replace("x.operator", r"\[([^\]]*)\]\([^)]*\)", "$1")
    respect = F.when(F.lower("x.respect").startswith("yes"), "yes").when(F.lower("x.respect").startswith("no"), "no").otherwise("unclear")
    return rows.select("token", F.coalesce(F.when(plain != "", plain), F.lit("Unknown")).alias("operator"), F.coalesce("x.function", F.lit("Unknown")).alias("category"), respect.alias("respect"), F.col("x.description").alias("description"))


def ai_crawler_audit(rows: DataFrame, registry: DataFrame, agents: list) -> DataFrame:
    """RB-7 (and RB-8 with a single agent): the verdict at / for every token; `agents` are the registry's tokens."""
    roots = rows.select("origin").distinct().withColumn("path", F.lit("/"))
    out = robots_verdicts(roots, rows, agents)
    return out.join(registry, out.agent == registry.token, "left").select("origin", F.col("agent").alias("name"), "operator", "category", "allowed")


def llms_presence(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """RB-9: status and size of the two well-known files. Only 2xx counts as read; a file that is not there is no warning,
    one over the bound or without an answer is."""
    some = files.where(F.col("path").isin("/llms.txt", "/llms-full.txt"))
    size = F.octet_length("body").cast("long")
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    fine = ok & F.coalesce(size <= max_bytes, F.lit(False))
    return some.select("origin", "path", "status", F.when(fine, size).alias("bytes"), F.when(F.isnull("status"), "unavailable").when(ok & ~fine, "too_large").alias("warning"))


def robots_report(files: DataFrame, registry: DataFrame, agents: list) -> DataFrame:
    """RB-10: one row per origin."""
    rows = lines(files)
    base = files.select("origin").distinct()
    parts = [robots_issues(rows).groupBy("origin").agg(F.count("*").alias("issues")), robots_sitemaps(rows).groupBy("origin").agg(F.array_sort(F.collect_set("sitemap")).alias("sitemaps")),
             robots_verdicts(base.withColumn("path", F.lit("/")), rows, ["Googlebot"]).select("origin", F.col("allowed").alias("googlebot_allowed")),
             ai_crawler_audit(rows, registry, agents).groupBy("origin").agg(F.count_if(~F.col("allowed")).alias("crawlers_blocked")),
             llms_presence(files).groupBy("origin").agg(F.count("bytes").alias("llms_files"))]
    for part in parts:
        base = base.join(part, "origin", "left")
    return base
