"""URL filters by a sort-merge range join.

A rule is a host and a path prefix. Hosts are compared by their reversed labels
(``m.example.net`` is ``net.example.m.``), so that a rule covers an interval of keys and
intervals nest. Points and rules are sorted together; the sweep keeps the last rule of each
nesting level as its stack, and those of them that are prefixes of a point are active.
The sweep runs twice: over hosts, then over paths under the active rule hosts.

A rule and what it covers share a group (first label; rule host). A group with many points
is cut into cells, and only its own rules are repeated in them, so a hot host or domain is
spread. Urls are reduced to distinct (host, path) first.

Defined cases: a null url or one without ``://`` has empty host and path; equal rules with
different verdicts block; an empty rule table gives the default verdict everywhere; an empty
page table gives an empty table; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, settled

#: Points of a group that one cell of the sweep takes.
CELL = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.substring(u, F.instr(u, "://") + 3, F.length(u))
    return F.when(F.instr(u, "://") == 0, "").otherwise(
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    )


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.substring(u, F.instr(u, "://") + 3, F.length(u))
    return F.when(F.instr(u, "://") == 0, "").otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: subdomains lie in the interval of their domain."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules from (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _levels(rules: DataFrame) -> DataFrame:
    """Rule keys with their nesting level: how many other rules contain them."""
    heads = rules.select("grp", F.col("key").alias("of"), F.explode(F.sequence(F.lit(0), F.length("key") - 1)).alias("n")).select(
        "grp", "of", F.expr("left(of, n)").alias("key")
    )
    inside = heads.join(rules, ["grp", "key"], "left_semi").groupBy("grp", "of").count()
    return rules.join(inside.withColumnRenamed("of", "key"), ["grp", "key"], "left").select(
        "grp", "key", F.coalesce("count", F.lit(0)).alias("level")
    )


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """The stack of active rules of each point: ``points`` (grp, key, more) with array ``active``.

    ``rules`` are distinct (grp, key); a rule is active where its key starts the point's key
    and the groups are equal. Points without an active rule are left out.
    """
    nested = settled(_levels(rules))
    top = nested.agg(F.max("level")).first()[0]
    if top is None:
        return points.withColumn("active", F.array().cast("array<string>")).where(F.lit(False))
    near = lookup(points, settled(nested.select("grp").distinct()), ["grp"], "left_semi")
    cells = settled(near.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_cells")))
    more = [c for c in points.columns if c not in ("grp", "key")]
    dealt = lookup(near, cells, ["grp"], "inner").withColumn("_cell", F.pmod(F.xxhash64("key", *more), F.col("_cells")).cast("int"))
    copies = lookup(nested, cells, ["grp"], "inner").withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    events = dealt.select("grp", "_cell", "key", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_level"), *more).unionByName(
        copies.select("grp", "_cell", "key", F.lit(0).alias("_kind"), F.col("level").cast("int").alias("_level")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy("grp", "_cell").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.array(*[F.last(F.when(F.col("_level") == v, F.col("key")), ignorenulls=True).over(order) for v in range(top + 1)])
    return (
        events.withColumn("_stack", stack)
        .where(F.col("_kind") == 1)
        .withColumn("active", F.filter("_stack", lambda s: s.isNotNull() & F.col("key").startswith(s)))
        .where(F.size("active") > 0)
        .select("grp", "key", *more, "active")
    )


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct (host, path): host, path, rule, verdict.

    Length is that of host and path together; of equal lengths the longer host wins.
    """
    ruled = settled(
        rules.select(host_key(F.col("host")).alias("hkey"), "host", "path", "verdict")
        .groupBy("hkey", "host", "path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    )
    first = lambda key: F.substring_index(key, ".", 1)
    hosts = ruled.select(first(F.col("hkey")).alias("grp"), F.col("hkey").alias("key")).distinct()
    points = urls.select(host_key(F.col("host")).alias("key"), "host").distinct().select(first(F.col("key")).alias("grp"), "key", "host")
    under = sweep(points, hosts).select("host", F.explode("active").alias("grp"))
    paths = urls.join(under, "host").select("grp", F.concat("grp", F.lit(" "), "path").alias("key"), "host", "path")
    rows = sweep(paths, ruled.select(F.col("hkey").alias("grp"), F.concat("hkey", F.lit(" "), "path").alias("key")).distinct())
    best = rows.select("host", "path", "grp", F.expr("substring(get(active, size(active) - 1), length(grp) + 2)").alias("_path"))
    longest = best.groupBy("host", "path").agg(
        F.max_by(F.struct("grp", "_path"), F.struct(F.length("grp") - 1 + F.length("_path"), F.length("grp"))).alias("_r")
    ).select("host", "path", F.col("_r.grp").alias("hkey"), F.col("_r._path").alias("rpath"))
    texts = settled(ruled.select("hkey", F.col("path").alias("rpath"), F.concat("host", "path").alias("rule"), "verdict"))
    return lookup(longest, texts, ["hkey", "rpath"], "inner").select("host", "path", "rule", "verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, the longest fitting rule (else null) and the verdict of each page."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = match(split.select("host", "path").distinct(), rules)
    return split.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
