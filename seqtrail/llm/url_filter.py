"""URL rules as intervals of reversed-host keys, met by a sorted sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrail.llm.common import cut, fold_case

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return fold_case(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a comma: ``example.net`` is ``net,example,``.

    A host and all its subdomains are then exactly the keys that start with the host's key,
    an interval of the sorted keys; intervals of two hosts are nested or disjoint.
    """
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def rule_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and ``stack``, the rules active just after that key.

    That is the rules of the host itself and of every host whose interval encloses it, as
    found by an equality join on the key's label prefixes. ``rules`` has action, host, path.
    """
    own = rules.select(
        host_key(fold_case(F.coalesce("host", F.lit("")))).alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            F.col("action"),
            host_key(fold_case(F.col("host"))).alias("under"),
            F.col("path").alias("path"),
        ).alias("one"),
    ).filter("one.rule is not null")
    nodes = own.groupBy("key").agg(F.collect_set("one").alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), ",")
    ends = F.sequence(F.lit(1), F.size(labels))
    prefixes = F.transform(ends, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), ","), F.lit(",")))
    return (
        nodes.select(F.col("key").alias("at"), F.explode(prefixes).alias("key"))
        .join(nodes, "key")
        .groupBy(F.col("at").alias("key"))
        .agg(F.flatten(F.collect_list("own")).alias("stack"))
    )


def judge(
    pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    Rule hosts and urls are sorted together by key and swept: the last rule host at or
    before a url tells the stack of enclosing rules, of which those whose interval holds the
    url's key and whose path starts the url's path are active. The longest (host and path
    together, then host) wins; equal rules with two actions: the lesser action text, so
    allow before block. Urls that no rule fits get ``otherwise``.

    The sweep is cut into slices of the sorted order, page ids breaking ties, so that a
    url repeated in a third of all rows is spread too; a slice starts with the last rule
    host of the earlier slices. Null urls and urls without ``://`` have empty host and path,
    and no rule. Repeated rows and null ids stay as they are; other columns are ignored.
    An empty rule table leaves every url to ``otherwise``.
    """
    spark = pages.sparkSession
    urls = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("key", host_key(F.col("host")))
    nodes = rule_nodes(rules)
    events = urls.select("key", F.lit(1).alias("turn"), "path", "page_id", "host").unionByName(
        nodes.select("key", F.lit(0).alias("turn"), "stack"), allowMissingColumns=True
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "turn", "path", "page_id"]
    swept = cut(events.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()))
    so_far = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per slice that holds a rule host: no more rows than slices.
    last = swept.filter("turn = 0").groupBy("slice").agg(F.max_by("stack", "key").alias("last"))
    ids = spark.range(parts).select(F.col("id").cast("int").alias("slice"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ids.join(last, "slice", "left").select("slice", F.last("last", True).over(before).alias("carried"))
    top = F.coalesce(F.last("stack", True).over(so_far), "carried")
    met = swept.join(F.broadcast(carried), "slice").select("*", top.alias("top")).filter("turn = 1")
    active = F.filter(
        "top", lambda r: F.startswith(F.col("key"), r["under"]) & F.startswith(F.col("path"), r["path"])
    )
    longest = F.element_at(
        F.array_sort(
            active,
            lambda a, b: F.when(
                a["size"] != b["size"], b["size"] - a["size"]
            ).when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
            .when(a["action"] < b["action"], -1).when(a["action"] > b["action"], 1).otherwise(0),
        ),
        1,
    )
    # An array without items has no first item; element_at would fail on it in ANSI mode.
    best = F.when(F.size(active) > 0, longest)
    return met.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict")
    )


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (action, host, path)."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")
