"""URL filter: allow and block rules by host, and a tree of path templates for the rest.

A path's variable segments (numbers, long identifiers, and positions whose values hardly repeat)
become wildcards.  Each host has a tree of such templates, and the host "*" pools all hosts.  Urls
that a rule decides are the labels.  Along the path from the root of the "*" tree down to the url's
own template, a branch whose share of blocked urls does not differ from what its parent expects is
merged with its siblings (it takes the parent's value); another one moves the estimate by its counts,
smoothed with the parent's value as prior.  A template is rejected when the estimate is over 1/2.

A null url, or one without "://", has an empty host and path; no rule fits it, and it is judged like
any other by its (empty) template.  Equal urls get equal verdicts.  Without any labelled url every
estimate is the prior, and everything is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.llm.registry import query, table

# (verdict, rule): host and path prefix.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# Weight of the parent's value, in urls, and the deviation (in standard errors) below which branches merge.
PRIOR_WEIGHT, MERGE_Z = 4.0, 1.96
# Values of one position that make it variable, if each is met fewer than MEAN_VISITS times.
VALUES, MEAN_VISITS = 20, 2.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        fits.append((here, rule, verdict))
    pick = lambda i: F.coalesce(*[F.when(f[0], F.lit(f[i])) for f in fits], F.lit(None).cast("string"))
    return pick(1), pick(2)


def template(path: Column) -> Column:
    """All segments of a path, with variable ones as wildcards."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    shape = lambda s: (F.when(s.rlike("^[0-9]+$"), F.lit("*"))
                       .when(s.rlike("^[0-9]+\\.[A-Za-z0-9]+$"), F.concat(F.lit("*."), F.regexp_extract(s, "\\.([A-Za-z0-9]+)$", 1)))
                       .when(s.rlike("[0-9]") & (F.length(s) >= 12), F.lit("*")).otherwise(s))
    return F.transform(segments, shape)


def judge(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict, template and blocked (the estimate) to every row.

    Existing columns of these names are replaced.  Only counts per (host, template) are shuffled
    before the join, after a first sum in each task, so a host of any size is no hot key there."""
    names = ["host", "path", "rule", "verdict", "template", "blocked"]
    host, path = host_and_path(F.col(f"`{url}`"))
    own = [c for c in df.columns if c not in names or c == url]
    rows = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(own)], host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said}).withColumn("raw", template(F.col("path")))
    counts = rows.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("said").alias("known"),
                                             F.count_if(F.col("said") == "block").alias("bad"))
    estimates = _estimates(_generalised(counts))
    joined = rows.join(estimates, (rows["host"] == estimates["t_host"]) & (rows["raw"] == estimates["t_raw"]), "left")
    blocked = F.coalesce("blocked", F.lit(0.0))
    verdict = F.coalesce("said", F.when(blocked > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(own)], "host", "path", "rule", verdict.alias("verdict"),
                         F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), blocked.alias("blocked"))


def _generalised(counts: DataFrame) -> DataFrame:
    """Templates whose positions of many, hardly repeated values are wildcards too."""
    levels = counts.select("host", "raw", "n", F.posexplode("raw").alias("at", "value"))
    spread = (levels.groupBy("host", "at", "value").agg(F.sum("n").alias("n"))
              .groupBy("host", "at").agg(F.count("*").alias("values"), F.sum("n").alias("n"))
              .where((F.col("values") >= VALUES) & (F.col("n") < MEAN_VISITS * F.col("values")))
              .groupBy("host").agg(F.collect_set("at").alias("wild")))
    wide = F.when(F.col("wild").isNull(), F.col("raw")).otherwise(
        F.transform("raw", lambda s, i: F.when(F.array_contains("wild", i), F.lit("*")).otherwise(s)))
    return counts.join(spread, "host", "left").withColumn("template", wide)


def _estimates(counts: DataFrame) -> DataFrame:
    """The share of blocked urls that each (host, raw template) is believed to have."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template")), lambda k: F.slice("template", 1, k))
    nodes = (counts.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
             .select("host", "known", "bad", F.explode(prefixes).alias("prefix")))
    per_host = nodes.groupBy("host", "prefix").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    pooled = (per_host.groupBy("prefix").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
              .select(F.lit("*").alias("tree"), "prefix", "known", "bad"))
    stats = per_host.select(F.concat(F.lit("="), "host").alias("tree"), "prefix", "known", "bad").unionByName(pooled)
    # each template asks for its prefixes in both trees, and folds them from the root down
    wanted = (counts.select("host", "template").distinct()
              .select("host", "template", F.explode(prefixes).alias("prefix"))
              .select("host", "template", "prefix", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "host"))).alias("tree")))
    found = (wanted.join(stats, ["tree", "prefix"])
             .groupBy("host", "template").agg(F.array_sort(F.collect_list(
                 F.struct((F.col("tree") != "*").alias("own"), F.size("prefix").alias("depth"), "known", "bad"))).alias("path_stats")))

    def step(p, s):
        known, bad = s["known"].cast("double"), s["bad"].cast("double")
        deviation = F.abs(bad - known * p)
        alike = (known == 0) | (deviation <= MERGE_Z * F.sqrt(known * F.greatest(p * (1 - p), F.lit(0.01))))
        return F.when(alike, p).otherwise((bad + PRIOR_WEIGHT * p) / (known + PRIOR_WEIGHT))

    valued = found.select("host", "template", F.aggregate("path_stats", F.lit(0.5).cast("double"), step).alias("p"),
                          F.aggregate("path_stats", F.lit(0).cast("bigint"), lambda a, s: a + s["known"]).alias("evidence"))
    keyed = counts.select("host", "raw", "template").join(valued, ["host", "template"])
    return keyed.select(F.col("host").alias("t_host"), F.col("raw").alias("t_raw"), "template",
                        F.when(F.col("evidence") > 0, F.col("p")).otherwise(F.lit(0.0)).alias("blocked"))


@query("op8_path_templates")
def op8_path_templates(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "template", "blocked")
