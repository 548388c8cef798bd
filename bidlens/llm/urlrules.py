"""URL filters: rules on hosts and path prefixes, matched by a sort-merge range join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, "(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_extract(rest, "(?s)^[^/?#]*(.*)$", 1), "^[^?#]*", 0)
    return host, path


def reverse_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (verdict, rule) as intervals: reversed host, path prefix and the stack of enclosing rules.

    ``rule`` is host plus path. All paths that start with a rule's path form one interval in sorted order, and two
    intervals of a host are nested or disjoint. ``stack`` lists the rule and those around it, innermost first. A
    repeated rule counts once; of two verdicts for one rule block wins. Null or empty hosts fit nothing.
    """
    cut = F.instr("rule", "/")
    base = (
        rules.where(cut > 1)
        .select(
            reverse_host(lower_ascii(F.substring_index("rule", "/", 1))).alias("rhost"),
            F.expr("substring(rule, instr(rule, '/'))").alias("start"), "rule", "verdict",
        )
        .groupBy("rhost", "start").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))
    )
    heads = base.select(
        "rhost", "start", F.explode(F.sequence(F.lit(1), F.length("start"))).alias("n")
    ).select("rhost", "start", F.expr("substring(start, 1, n)").alias("around"))
    outer = base.select("rhost", F.col("start").alias("around"), "rule", "verdict")
    level = F.struct(F.length("around").alias("n"), F.col("around").alias("start"), "rule", "verdict")
    stacks = heads.join(outer, ["rhost", "around"]).groupBy("rhost", "start").agg(
        F.sort_array(F.collect_list(level), asc=False).alias("stack")
    )
    return stacks


def match_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule text wins, ties go to
    the host with more labels. Each url becomes one point per suffix of its host (``org``, ``org.example``, ...), so a
    rule's interval lies within one reversed host. Rule starts and points are swept in path order: the last rule start
    before a point brings its stack, and the innermost rule of the stack that still holds the point is the match.
    Hosts with many points are split into parts of equal share (at most one part per shuffle partition) and only
    their rules are repeated. Null and odd urls get the default; repeated rows stay; an empty table gives no rows;
    columns of ``pages`` other than the four results are kept, clashing ones replaced.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stacks = rule_table(rules)
    host, path = url_parts(F.col(url))
    urls = pages.select(host.alias("host"), path.alias("path")).groupBy("host", "path").agg(F.count("*").alias("rows"))
    labels = F.split("host", "\\.")
    depth = F.size(labels)
    points = (
        urls.where(F.col("host") != "")
        .select("host", "path", labels.alias("labels"), F.explode(F.sequence(F.lit(1), depth)).alias("k"))
        .select("host", "path", F.array_join(F.reverse(F.expr("slice(labels, size(labels) - k + 1, k)")), ".").alias("rhost"))
        .where(F.startswith("path", F.lit("/")))
    )
    hosts = stacks.groupBy("rhost").agg(F.count("*").alias("rules"))
    counts = points.groupBy("rhost").agg(F.count("*").alias("n")).join(hosts, "rhost")
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(total)).select(  # one row
        "rhost", F.greatest(F.lit(1), F.ceil(F.col("n") * parts / F.col("total"))).cast("int").alias("parts")
    )
    spread = points.join(shares, "rhost").select(
        "rhost", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"),
        F.col("path").alias("at"), F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
    )
    starts = stacks.join(shares, "rhost").select(
        "rhost", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("start").alias("at"),
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    sweep = Window.partitionBy("rhost", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.filter("stack", lambda r: F.startswith(F.col("path"), r["start"]))
    found = (
        spread.unionByName(starts)
        .repartition("rhost", "part")  # not by rhost alone, as the joins left it
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where((F.col("kind") == 1) & F.col("stack").isNotNull())
        .withColumn("hit", F.try_element_at(held, F.lit(1)))
        .where(F.col("hit").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("hit.rule").alias("len"), F.length("rhost").alias("labels"),
                            F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))).alias("best"))
        .select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = pages.withColumns({"_host": host, "_path": path}).select(*[F.col(f"`{c}`") for c in kept], "_host", "_path")
    return keyed.join(found, ["_host", "_path"], "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
