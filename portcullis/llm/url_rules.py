"""URL filters as a sort-merge range join, in DataFrame functions alone.

A host's labels are reversed and closed by a separator that sorts before all else in a host, so a
rule's host and its subdomains are one interval of keys, and the intervals of two rules are nested or
apart. Rules and urls are sorted together by key; the sweep keeps a stack of the rules last passed,
one place for each depth (number of labels). A rule on the stack is active while its key is a prefix
of the url's: what was left behind fails that test and counts as popped. Of the active rules whose
path starts the url's path, the one with the longest text wins (of equals the longer host, then
block); where none is left the url has the default verdict.

The urls are dealt round to buckets, so a host with any share of the urls makes no large task. The
rules go to every bucket: rules x buckets small rows, for rule lists far smaller than the urls.

Null urls and those without ``://`` have an empty host and path and the default verdict, like those
that no rule fits. Repeated urls are judged each. Other columns pass through; a clashing name gets
the result under a name with underscores before it. Without rules every url has the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import new_column

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\x01"
#: Buckets for each shuffle partition, so that partitions get about as many.
SPREAD = 4
# The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """``www.example.net`` -> net, example, www, each closed by the separator."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEPARATOR), F.lit(SEPARATOR))


def judge(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict; ``rules`` has host, path and verdict."""
    spark = urls.sparkSession
    buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = rules.where("host is not null and path is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
    passed = (
        usable.withColumn("key", key_of(F.col("host")))
        .withColumn("depth", F.size(F.split("host", r"\.", -1)))
        .groupBy("key", "depth")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        (-F.length(F.concat("host", "path"))).alias("order"),
                        (-F.length("host")).alias("host_order"),
                        F.when(F.col("verdict") == "block", 0).otherwise(1).alias("block_first"),
                        F.concat("host", "path").alias("rule"),
                        "path",
                        "verdict",
                    )
                )
            ).alias("entries")
        )
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    )
    depths = [r["depth"] for r in usable.select(F.size(F.split("host", r"\.", -1)).alias("depth")).distinct().orderBy("depth").collect()]
    names = {n: new_column(urls, n) for n in ("host", "path", "rule", "verdict")}
    if not depths:
        judged = urls.withColumns({names["host"]: host_of(F.col(url_column)), names["path"]: path_of(F.col(url_column))})
        return judged.withColumns({names["rule"]: F.lit(None).cast("string"), names["verdict"]: F.lit(default)})
    swept = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).select(
        "*", key_of(F.col("host")).alias("key"), (F.monotonically_increasing_id() % buckets).cast("int").alias("bucket"), F.lit(True).alias("is_url")
    )
    together = swept.unionByName(passed.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("bucket").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = F.struct("key", "entries")
    stack = {f"stack{d}": F.last(F.when(~F.col("is_url") & (F.col("depth") == d), slot), ignorenulls=True).over(order) for d in depths}
    active = F.flatten(
        F.array(*[F.when(F.startswith("key", F.col(f"{s}.key")), F.col(f"{s}.entries")).otherwise(F.expr("filter(array(), x -> false)").cast(passed.schema["entries"].dataType)) for s in stack])
    )
    best = F.array_min(F.filter(active, lambda e: F.startswith(F.col("path"), e["path"])))
    return (
        together.select("row", "host", "path", "key", "is_url", *[c.alias(n) for n, c in stack.items()])
        .where("is_url")
        .withColumn("best", best)
        .select(
            *[F.col(f"row.`{c}`").alias(c) for c in urls.columns],
            F.col("host").alias(names["host"]),
            F.col("path").alias(names["path"]),
            F.col("best.rule").alias(names["rule"]),
            F.coalesce("best.verdict", F.lit(default)).alias(names["verdict"]),
        )
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT s.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM split s JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
  GROUP BY s.page_id
)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f USING (page_id)
"""
