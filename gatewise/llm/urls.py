"""Operator 1: URL filter by a path-template tree per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatewise.llm.common import ascii_lower
from gatewise.session import staged

# Fixed values: (verdict, host, start of the path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without ``://``."""
    found = F.instr(url, "://") > 0
    rest = F.substr(url, F.instr(url, "://") + 3)
    return (F.when(found, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise(""), F.when(found, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string and its verdict; NULL where none does."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        best, verdict = F.when(fits, F.lit(domain + start)).otherwise(best), F.when(fits, F.lit(kind)).otherwise(verdict)
    return best, verdict


def segment_shape(segment: Column) -> Column:
    """Generalise segments that look variable: numbers, hexadecimal ids, dates, long slugs. File extensions stay."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1)
    extension = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 2)
    kind = (F.when(stem.rlike(r"^[0-9]+$"), "*n").when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "*d")
            .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "*x").when(stem.rlike(r"[0-9]") & (F.char_length(stem) >= 6), "*a").when(F.size(F.split(stem, "[-_]")) >= 4, "*s"))
    return F.when(kind.isNotNull(), F.concat(kind, extension)).otherwise(segment)


def merge_level(shapes: DataFrame, depth: int, z: float, like: float) -> DataFrame:
    """``shapes`` with like inner nodes below one parent under one name at ``depth``: ``+1`` for the group of the largest, ``+2`` for the next ones.

    Two nodes are like when their distributions of child segments overlap by ``like`` at least, which needs no labels, and, if both
    have labelled urls, their bad shares do not differ (two-proportion test at ``z``). A node without labels whose like nodes differ in
    their bad shares stays alone. A parent has few nodes, as rare segments are ``*`` by then, so pairs of them are few too.
    """
    prefix, key = F.array_join(F.slice("segments", 1, depth), "/"), ["host", "prefix"]
    segment = F.get("segments", F.lit(depth))
    inner = shapes.where(F.size("segments") > depth + 1).select("host", prefix.alias("prefix"), segment.alias("segment"), F.get("segments", F.lit(depth + 1)).alias("child"), "n", "labelled", "bad")
    children = inner.groupBy(*key, "segment", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    nodes = children.groupBy(*key, "segment").agg(F.sum("n").alias("size"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    parts = staged(children.select(*key, "segment", "child", "n").join(nodes, [*key, "segment"]).withColumn("part", F.col("n") / F.col("size")).drop("n"))
    other = parts.select(*key, "child", *(F.col(c).alias(f"other_{c}") for c in ("segment", "size", "labelled", "bad", "part")))
    pairs = parts.join(other, [*key, "child"]).where("segment <> other_segment").groupBy(*key, "segment", "size", "labelled", "bad", "other_segment", "other_size", "other_labelled", "other_bad")
    apart = differs(F.col("labelled"), F.col("bad"), F.col("labelled") + F.col("other_labelled"), F.col("bad") + F.col("other_bad"), z)
    pairs = staged(pairs.agg(F.sum(F.least("part", "other_part")).alias("overlap")).where((F.col("overlap") >= like) & ~F.coalesce(apart, F.lit(False))))
    around = pairs.groupBy(*key, "segment").agg(F.sum("other_labelled").alias("all_labelled"), F.sum("other_bad").alias("all_bad"))
    torn = pairs.where("labelled = 0").join(around, [*key, "segment"]).where(differs(F.col("other_labelled"), F.col("other_bad"), F.col("all_labelled"), F.col("all_bad"), z)).select(*key, "segment").distinct()
    pairs = pairs.join(torn, [*key, "segment"], "left_anti").join(torn.withColumnRenamed("segment", "other_segment"), [*key, "other_segment"], "left_anti")
    # the largest among its like nodes leads a group; any other node joins the largest leader that it is like
    largest = pairs.groupBy(*key, "segment", "size").agg(F.max(F.struct("other_size", "other_segment")).alias("most"))
    leaders = staged(largest.where(F.struct("size", "segment") > F.struct(F.col("most.other_size"), F.col("most.other_segment")))
                     .select(*key, F.col("segment").alias("other_segment"), F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("size"), "segment")).alias("number")))
    joined = pairs.join(leaders, [*key, "other_segment"]).groupBy(*key, "segment").agg(F.min("number").alias("number"))
    merged = joined.unionAll(leaders.select(*key, F.col("other_segment").alias("segment"), "number"))
    merged = merged.select(*(F.col(c).alias(f"_{c}") for c in (*key, "segment", "number")))
    there = (F.col("host") == F.col("_host")) & (prefix == F.col("_prefix")) & (segment == F.col("_segment")) & (F.size("segments") > depth + 1)
    renamed = F.transform("segments", lambda s, k: F.when(k == depth, F.concat(F.lit("+"), F.col("_number").cast("string"))).otherwise(s))
    return staged(shapes.join(merged, there, "left").select("host", "shape", "n", "labelled", "bad", F.when(F.col("_number").isNotNull(), renamed).otherwise(F.col("segments")).alias("segments")))


def differs(labelled: Column, bad: Column, all_labelled: Column, all_bad: Column, z: float) -> Column:
    """Whether the bad share differs from that of the rest of ``all``; NULL when one of them has no labels."""
    rest_n, rest_bad = all_labelled - labelled, all_bad - bad
    pooled = all_bad / F.nullif(all_labelled, F.lit(0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(labelled, F.lit(0)) + 1 / F.nullif(rest_n, F.lit(0))))
    return F.abs(bad / F.nullif(labelled, F.lit(0)) - rest_bad / F.nullif(rest_n, F.lit(0))) > z * spread


def inherited(shapes: DataFrame, prior: float, pull: float) -> DataFrame:
    """``(host, template, inherited)``: what the nodes above a template tell, folded from the host down. A node's smoothed bad share
    counts by the part of its urls that is labelled; for the rest the share from above stands."""
    above = shapes.select("host", "template", "n", "labelled", "bad", F.explode(F.sequence(F.lit(1), F.greatest(F.size("segments") - 1, F.lit(1)))).alias("depth"), "segments")
    above = above.withColumn("prefix", F.array_join(F.slice("segments", 1, F.col("depth")), "/"))
    nodes = above.groupBy("host", "depth", "prefix").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    path = above.select("host", "template", "depth", "prefix").distinct().join(nodes, ["host", "depth", "prefix"])
    path = path.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "labelled", "bad"))).alias("path"))  # bounded by one path
    def step(share: Column, node: Column) -> Column:
        seen = node["labelled"] / node["n"]
        return seen * (node["bad"] + pull * share) / (node["labelled"] + pull) + (1 - seen) * share
    return path.select("host", "template", F.aggregate("path", F.lit(float(prior)), step).alias("inherited"))


def judge_urls(pages: DataFrame, rules=RULES, min_share: float = 0.02, many: int = 8, pull: float = 4.0, z: float = 1.96, purity: float = 0.9, like: float = 0.8) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, template_purity``.

    Urls under a rule are the labelled examples (block is the bad class). Per host, paths become shapes by the look of their
    segments; then at every depth where a host has more than ``many`` different segments, those with less than ``min_share`` of the
    host's urls become ``*``: that gives the template tree. From the deepest level up, inner nodes below one parent with like child
    segments become one node (``merge_level``), labelled or not. Among the last branches below one parent, those whose bad share does not
    differ from the parent's remaining branches (two-proportion test at ``z``) share their evidence. A template is rejected when its
    smoothed purity ``(bad + pull * above) / (labelled + pull)`` reaches ``purity``; ``above`` comes down from the nodes above
    (``inherited``), at the host from the bad share of all labelled urls, held under the limit.

    All statistics are counts of (host, shape), combined before the shuffle, so a host with a third of all urls is a few rows.
    NULL urls and those without ``://`` have an empty host and path, no rule, and are allowed like any template without evidence.
    Repeated rows and NULL ids are kept. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    placed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    shape = F.array_join(F.transform(F.split("path", "/"), segment_shape), "/")
    placed = placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"), shape.alias("shape"))
    shapes = staged(placed.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("rule_verdict").alias("labelled"), F.count_if(F.col("rule_verdict") == "block").alias("bad")))

    parts = shapes.select("host", "shape", "n", F.posexplode(F.split("shape", "/")).alias("depth", "segment"))
    segments = parts.groupBy("host", "depth", "segment").agg(F.sum("n").alias("n"))
    levels = segments.groupBy("host", "depth").agg(F.sum("n").alias("level_n"), F.count("*").alias("kinds"))
    variable = segments.join(levels, ["host", "depth"]).where((F.col("kinds") > many) & (F.col("n") < min_share * F.col("level_n"))).select("host", "depth", "segment", F.lit(True).alias("variable"))
    named = parts.join(variable, ["host", "depth", "segment"], "left").withColumn("segment", F.when(F.col("variable"), "*").otherwise(F.col("segment")))
    named = named.groupBy("host", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "segment"))), lambda s: s["segment"]), "/").alias("template"))  # bounded by one path
    shapes = staged(shapes.join(named, ["host", "shape"]).select("host", "shape", "n", "labelled", "bad", F.split("template", "/").alias("segments")))
    # only levels where some parent has two inner nodes can merge
    inner = shapes.where(F.size("segments") > 2).select("host", "segments", F.explode(F.sequence(F.lit(1), F.size("segments") - 2)).alias("depth"))
    inner = inner.groupBy("host", "depth", F.array_join(F.slice("segments", 1, F.col("depth")), "/").alias("prefix")).agg(F.min(F.get("segments", F.col("depth"))).alias("low"), F.max(F.get("segments", F.col("depth"))).alias("high"))
    for depth in sorted((r["depth"] for r in inner.where("low < high").select("depth").distinct().collect()), reverse=True):
        shapes = merge_level(shapes, depth, z, like)
    shapes = staged(shapes.withColumn("template", F.array_join("segments", "/")).withColumn("parent", F.regexp_extract("template", r"^(.*)/[^/]*$", 1)))

    # a branch is judged against the rest of its parent's labelled urls
    branches = shapes.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    parents = branches.groupBy("host", "parent").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    both = branches.join(parents, ["host", "parent"])
    merged = F.coalesce(~differs(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad"), z), F.lit(False))
    both = both.withColumn("branch", F.when(merged, "").otherwise(F.col("template")))
    pools = both.groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("pool_n"), F.sum("bad").alias("pool_bad"))
    bad, labelled = shapes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    prior = min(bad / labelled if labelled else 0.0, 0.5 * purity)
    above = inherited(shapes, prior, pull)
    judged = both.join(pools, ["host", "parent", "branch"]).join(above, ["host", "template"]).select("host", "template", ((F.col("pool_bad") + pull * F.col("inherited")) / (F.col("pool_n") + pull)).alias("template_purity"))
    judged = shapes.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", "template", "template_purity")

    learned = F.when(F.col("template_purity") >= purity, "block").otherwise("allow")
    return placed.join(judged, ["host", "shape"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "template", "template_purity")
