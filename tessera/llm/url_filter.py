"""URL verdicts from rules and from a path-template tree.

Rules (host and path prefix) decide the urls they fit, and label them. The rest goes by templates: per host, the tree
of path segments is walked level by level. Children that are numbers, hexadecimal ids or both with a file extension
become one wildcard, and so do all children of a node whose children are mostly different. Elsewhere children that carry
labels and whose share of blocked urls doesn't differ from that of their labelled siblings together (two-proportion z
test) merge into the wildcard; the others keep their names. A node's purity is its share of blocked labels, smoothed
towards its parent's, the root's towards its domain's (the last two names of the host) and that towards the share over
all labels; so a branch without labels has the evidence of what it hangs from. A template is rejected if its purity
reaches a threshold.

Each level is one aggregate over (host, prefix, segment), summed before it is shuffled, and others over its children, so
a host with a third of all urls costs no task more than its distinct segments. Both sides of the joins are written
tables, which lets adaptive execution split hot keys. Urls that are alone in their node leave the walk: what is left of
their path is a chain, whose names and purities follow at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Segments that vary by their form alone.
VARIABLE = r"\A([0-9]+|[0-9a-fA-F-]{8,})(\.[A-Za-z0-9]+)?\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


COUNTS = ["_n", "_labelled", "_blocked"]


def smoothed(blocked: Column, labelled: Column, smoothing: float, towards: Column) -> Column:
    return (blocked + F.lit(smoothing) * towards) / (labelled + F.lit(smoothing))


def roots(urls: DataFrame, scratch: Scratch, smoothing: float) -> DataFrame:
    """host, template (empty) and purity of each host's root."""
    total = urls.agg(F.sum("_labelled").alias("n"), F.sum("_blocked").alias("b")).first()
    prior = F.lit((total["b"] or 0) / total["n"] if total["n"] else 0.0)
    hosts = urls.groupBy("host").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("_domain", F.substring_index("host", ".", -2))
    hosts = scratch.save(hosts, "hosts")
    domains = hosts.groupBy("_domain").agg(smoothed(F.sum("_blocked"), F.sum("_labelled"), smoothing, prior).alias("_up"))
    hosts = hosts.join(scratch.save(domains, "domains"), "_domain")
    return scratch.save(hosts.select("host", F.lit("").alias("template"), smoothed(F.col("_blocked"), F.col("_labelled"), smoothing, F.col("_up")).alias("purity")), "pure0")


def templates(urls: DataFrame, scratch: Scratch, fanout: int, spread: float, z: float, smoothing: float) -> DataFrame:
    """Of distinct (host, path) with counts _n, _labelled, _blocked: host, path, template and purity."""
    pure = roots(urls, scratch, smoothing)
    state = urls.withColumns({"_segs": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit("")})
    state = scratch.save(state.withColumn("_left", F.when(F.size("_segs") == 0, 0)), "level0")
    ended = []

    def end(state: DataFrame, pure: DataFrame, level: int) -> None:
        """Urls that end at this level (_left 0) or are alone in their node, with _left more segments."""
        done = state.where("_left is not null").join(pure, ["host", "template"])
        names = F.transform(F.slice("_segs", level + 1, F.greatest("_left", F.lit(1))), lambda s: F.when(s.rlike(VARIABLE), "/*").otherwise(F.concat(F.lit("/"), s)))
        purity = F.aggregate(F.sequence(F.lit(1), "_left"), F.col("purity"), lambda up, _: smoothed(F.col("_blocked"), F.col("_labelled"), smoothing, up))
        more = F.col("_left") > 0
        ended.append(done.select("host", "path", F.when(more, F.concat("template", F.array_join(names, ""))).otherwise(F.col("template")).alias("template"), F.when(more, purity).otherwise(F.col("purity")).alias("purity")))

    level = 0
    while True:
        end(state, pure, level)
        state = state.where("_left is null").drop("_left").withColumn("_seg", F.get("_segs", F.lit(level)))
        kids = state.groupBy("host", "template", "_seg").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count(F.lit(1)).alias("_urls"))
        kids = scratch.save(kids, f"kids{level}")
        if not kids.limit(1).count():
            break
        nodes = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_kids"), *[F.sum(c).alias(f"{c}_all") for c in COUNTS])
        nodes = scratch.save(nodes.join(pure, ["host", "template"]), f"nodes{level}")
        variable = F.col("_seg").rlike(VARIABLE) | (F.col("_kids") >= fanout) & (F.col("_kids") >= spread * F.col("_n_all"))
        p = F.try_divide("_blocked_all", "_labelled_all")
        error = F.sqrt(F.try_divide(p * (1 - p), F.col("_labelled")))
        alike = (F.col("_labelled") > 0) & (F.col("_labelled") < F.col("_labelled_all")) & (F.abs(F.try_divide("_blocked", "_labelled") - p) <= z * error)
        named = F.concat("template", F.lit("/"), F.when(variable | F.coalesce(alike, F.lit(False)), "*").otherwise(F.col("_seg")))
        names = scratch.save(kids.join(nodes, ["host", "template"]).select("host", "template", "_seg", named.alias("_named"), "_labelled", "_blocked", "_urls", "purity"), f"names{level}")
        sums = names.groupBy("host", F.col("_named").alias("template")).agg(F.sum("_labelled").alias("_l"), F.sum("_blocked").alias("_b"), F.sum("_urls").alias("_urls"), F.first("purity").alias("_up"))
        sums = scratch.save(sums.select("host", "template", "_urls", smoothed(F.col("_b"), F.col("_l"), smoothing, F.col("_up")).alias("purity")), f"pure{level + 1}")
        pure = sums.drop("_urls")
        level += 1
        lone = sums.where("_urls = 1").select("host", F.col("template").alias("_named"), F.lit(True).alias("_lone"))
        grown = state.join(names.select("host", "template", "_seg", "_named").join(lone, ["host", "_named"], "left"), ["host", "template", "_seg"])
        left = F.when(F.col("_lone") | (F.size("_segs") == level), F.size("_segs") - level)
        state = scratch.save(grown.withColumn("_left", left).drop("template", "_seg", "_lone").withColumnRenamed("_named", "template"), f"level{level}")
        scratch.drop(f"kids{level - 1}", f"nodes{level - 1}", f"names{level - 1}")
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return scratch.save(out, "judged")


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    fanout: int = 8,
    spread: float = 0.2,
    z: float = 1.96,
    smoothing: float = 4.0,
    threshold: float = 0.6,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity (smoothed share of blocked labels).

    Reads page_id and url only, so other columns may have any name. A null or empty url, or one without ://, has empty
    host, path and template. A very long url is walked whole: levels end where no two different urls of a host share a
    node. Without any label no url is rejected. Repeated rows each get their row; a null page_id stays null; an empty
    table gives an empty result. Among rules of equal length the one given later wins.
    """
    scratch = Scratch(spark, "urls")
    rows = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = F.col("_rule").isNotNull()
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n"), F.sum(labelled.cast("long")).alias("_labelled"), F.sum(F.coalesce(F.col("_rule.verdict") == "block", F.lit(False)).cast("long")).alias("_blocked"))
    judged = templates(scratch.save(urls, "urls"), scratch, fanout, spread, z, smoothing)
    own = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "template", "purity")
