"""URL filter by a sort-merge range join over reversed-host keys.

A host is written backwards, label by label, with a closing dot: ``a.example.org`` becomes
``org.example.a.``. The hosts a rule fits are then one interval of keys, and the intervals of a rule
list are nested or apart. Sorting the interval ends gives elementary intervals, each with the stack
of rules active on it. Addresses are sorted by the same key, and a running maximum over the sorted
sequence hands every address the last interval end before it, and with it the stack. The longest
rule of the stack whose path starts the address's path decides.

Only DataFrame functions are used. The sweep is distributed: addresses and interval ends are range
partitioned by (key, path, id), so one host may fill many partitions; each partition runs its own
window, and the state at its start is carried over from the last end in the partitions before it,
which is one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import table
from pairlens.session import cut_lineage, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _tail(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_tail(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``(key, stack)``: the rules active from each interval end on, longest first.

    ``rules`` has (verdict, host, path). An interval ends just before its key with the last dot
    replaced by the next character. Each end is looked up among its own ancestors (the rule hosts
    that are leading labels of it), so the work is rules times labels and not rules squared.
    """
    opens = rules.withColumn("key", host_key(F.col("host")))
    ends = opens.select("key").union(
        opens.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")))
    ).distinct()
    labels = F.split(F.expr("rtrim('/', rtrim('.', key))"), r"\.", -1)
    depth = F.when(F.col("key").endswith("/"), F.size(labels) - 1).otherwise(F.size(labels))
    ancestors = ends.select(
        "key",
        F.explode_outer(
            F.when(
                depth > 0,
                F.transform(
                    F.sequence(F.lit(1), depth),
                    lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")),
                ),
            )
        ).alias("above"),
    )
    rule = F.concat("host", "path")
    active = opens.select(
        F.col("key").alias("above"),
        F.struct(
            F.length(rule).alias("length"), F.col("path"), rule.alias("rule"), F.col("verdict")
        ).alias("entry"),
    )
    return (
        ancestors.join(active, "above", "left")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("entry"), asc=False).alias("stack"))
    )


def judge(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    default: str = DEFAULT_VERDICT,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Every row's host, path, deciding rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting
    rule (host and path together) wins, of equally long ones the one with the greater text. Null
    addresses and those without ``://`` have an empty host and path and get the default verdict
    with a null rule. Repeated rows stay repeated. Other columns are not read.
    """
    spark = pages.sparkSession
    url = F.col(url_column)
    addresses = pages.select(
        F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    if not rules:
        return addresses.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    ends = rule_stacks(listed).select(
        F.col("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"),
        F.lit("").alias("host"), F.lit("").alias("path"), "stack",
    )
    rows = addresses.select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path",
        F.lit(None).cast(ends.schema["stack"].dataType).alias("stack"),
    )
    order = ["key", "kind", "path", "page_id"]
    ranged = cut_lineage(
        ends.unionByName(rows).repartitionByRange(shuffle_partitions(spark), *order)
    ).withColumn("part", F.spark_partition_id())
    carried = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        ranged.select("part").distinct().join(carried, "part", "left")
        .select("part", F.last("last", ignorenulls=True).over(before).alias("entry"))
    )
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stack = F.coalesce(F.last("stack", ignorenulls=True).over(running), F.col("entry"))
    fitting = F.filter("active", lambda e: F.col("path").startswith(e["path"]))
    return (
        ranged.join(start, "part", "left")
        .withColumn("active", stack)
        .where("kind = 1")
        .withColumn("hit", F.get(fitting, F.lit(0)))
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        )
    )


def op10_url_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS tail
  FROM pages
), b AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(tail, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(tail, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM a
), r(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT b.*, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM b LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
