"""URL filters: a sort-merge range join of urls with nested host rules, in DataFrame functions only.

A host is turned round (``news.example.net`` to ``net.example.news.``), so that a rule for a host and all its
subdomains is a prefix, and a prefix is an interval of the sorted keys. Urls and rules are dealt to sweeps by top
label and salt; within a sweep both are sorted by key, and each url takes the stack of nested rules that the last
rule before it left open. Rules that have closed since, or whose path does not fit, are taken off the stack, and the
longest that is left decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per ruled host: its key, and the stack of all rules on it and on the hosts it is nested in."""
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("len"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        "path",
        F.col("key").alias("host_key"),
    )
    own = (
        rules.filter("host is not null and host <> '' and path is not null and verdict is not null")
        .withColumn("host", F.translate("host", _UPPER, _LOWER))
        .withColumn("key", host_key(F.col("host")))
        .groupBy("key")
        .agg(F.collect_set(rule).alias("own"))
    )
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    outer = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    nested = own.select("key", F.explode(outer).alias("outer"))
    return (
        nested.join(own.withColumnRenamed("key", "outer"), "outer")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("own")).alias("stack"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow", spread: int | None = None
) -> DataFrame:
    """One row per row of pages: the kept columns, host, path, rule (null: none fits) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the rule
    with the longest host and path wins, among equal ones the later text, then the later verdict. Rules with a null
    or an empty host are left out. A null url, or one without ``://``, has empty host and path and gets the default.
    Rows of one top label are dealt to ``spread`` sweeps by a hash of the row (default: the session's shuffle
    partitions), so no host can fill a task; every sweep gets the rules of its label, ``spread`` copies of each rule.
    Repeated rows each give a row; an empty table gives none. Other columns of pages are neither read nor returned.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(keep):
        raise ValueError(f"these names are results: {sorted(clash)}")
    spread = spread or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_host_path(F.col(url))
    urls = (
        pages.select(*[F.col(c).alias(f"_in_{c}") for c in keep], host.alias("host"), path.alias("path"), F.xxhash64(*keep, url).alias("_h"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("salt", F.pmod("_h", F.lit(spread)).cast("int"))
        .withColumn("is_url", F.lit(1))
        .drop("_h")
    )
    opened = rule_stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("is_url", F.lit(0))
    swept = (
        urls.unionByName(opened, allowMissingColumns=True)
        .withColumn("top", _top(F.col("key")))
        .withColumn(
            "open",
            F.last("stack", ignorenulls=True).over(
                Window.partitionBy("top", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .filter("is_url = 1")
    )
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["host_key"]) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select(
        *[F.col(f"_in_{c}").alias(c) for c in keep],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
