"""URL filter: sort-merge range join of hosts with rule intervals, swept with a stack of nested rules.

Reversing the labels of a host (``a.example.org`` becomes ``org.example.a.``) turns "this host and all its
subdomains" into one key interval, ``[org.example., org.example/)``, because ``/`` follows ``.``. Intervals of
two hosts are nested or apart, so sweeping the sorted keys needs a stack only. Each interval end is a boundary
row that carries the stack from there on; urls and boundaries are range-partitioned and sorted together, and
every url takes the last boundary before it. A partition that starts inside an interval gets the stack from the
last boundary of the partitions before it.

Everything is DataFrame code. The range key ends in a hash of url and id, so one host may hold any share of the
rows: it is spread over as many partitions as it needs.

Defined results: a null url or one without ``://`` has empty host and path and no rule; a url without a path
(``http://example.org``) has the empty path, which no rule path starts; rows that repeat are judged one by one;
an empty table gives an empty result; columns other than the two named are not read, so their names don't
matter. Rules with a null or empty host are left out. The stack at a boundary holds the rules of a host and its
parent hosts, so one host's rules must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shuffle_partitions, table

#: Host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, action string")


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from key on, until the next boundary, the rules in the stack are active."""
    rules = rules.filter(F.coalesce(F.length("rule_host"), F.lit(0)) > 0).select(
        "rule_host", F.coalesce("rule_path", F.lit("")).alias("rule_path"), "action"
    )
    labels = F.split("host", r"\.")
    owners = (
        rules.select(F.col("rule_host").alias("host"))
        .distinct()
        .withColumn("labels", labels)
        .withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels") - i + 1), "."))))
    )
    entry = F.struct("rule_host", "rule_path", "action")
    stacks = owners.join(rules, owners["above"] == rules["rule_host"]).groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("stack"))
    opened = stacks.select(host_key(F.col("host")).alias("key"), "stack")
    rest = F.filter("stack", lambda r: r["rule_host"] != F.col("host"))
    closed = stacks.select(F.concat(F.rtrim(host_key(F.col("host")), F.lit(".")), F.lit("/")).alias("key"), rest.alias("stack"))
    return opened.unionByName(closed)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict): the longest rule whose host covers the url's and whose path starts the url's."""
    spark = pages.sparkSession
    marks = boundaries(rules)
    stack_type = marks.schema["stack"].dataType
    points = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("path", "id").alias("tie"), "id", "host", "path", F.lit(None).cast(stack_type).alias("stack")
    )
    events = points.unionByName(
        marks.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    )
    # The table fixes which partition a row is in, however often later stages run.
    dealt = materialize(events.repartitionByRange(shuffle_partitions(spark), "key", "kind", "tie").withColumn("part", F.spark_partition_id()), "url-sweep")
    ends = dealt.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before)["stack"].alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").join(carried, "part", "left")
    fits = F.filter(F.coalesce("top", "carried"), lambda r: F.col("path").startswith(r["rule_path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("size"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["action"].alias("action"))))
    return swept.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_frame(spark))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT row_number() OVER () AS rn, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT rn, arg_max(struct_pack(rule := rule_host || rule_path, action := action),
                     struct_pack(size := length(rule_host) + length(rule_path), rule := rule_host || rule_path)) AS b
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rn)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, '{DEFAULT_VERDICT}') AS verdict
FROM u LEFT JOIN best USING (rn)
"""

QUERIES = {"op10_url_filter": op10_url_filter}
SQL = {"op10_url_filter": ORACLE}
