"""URL filters by a sort-merge range join over reversed-host keys (DataFrame functions only).

A rule ``(verdict, host, path)`` fits the URLs of its host and of all subdomains whose path
starts with the rule's path. Seen from one host, the paths a rule fits are an interval of the
sorted keys ``reversed host, /, path``, and intervals of one host are nested or disjoint. Rules
become two events, the start and the end of their interval; URLs become points, one for each
number of host labels that some rule has. A sorted sweep over points and events gives every
point the innermost open rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_COLUMNS = "verdict string, host string, path string"


def url_host(url: Column) -> Column:
    """The host after the first ``://``, A-Z in lower case; empty without one."""
    return F.translate(_part(url, r"^[\s\S]*?://([^/?#]*)"), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return _part(url, r"^[\s\S]*?://[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def _labels(host: Column) -> Column:
    """Labels from the last to the first; none for an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def _key(labels: Column, path: Column) -> Column:
    """Bytes that sort by reversed host, then path; a host holds no ``/``, so the two can't run into each other."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def rule_events(rules: DataFrame) -> DataFrame:
    """``(key, kind, open)``: where the innermost open rule changes, and to which.

    Equal rules count once, a block before an allow. The stack of open rules is swept per host:
    ``level`` is the height of the stack, a rule's end brings back the last rule that was opened
    one level below, which in a family of nested intervals is the one that encloses it.
    """
    rules = (
        rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .filter("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", _labels(F.col("host")))
        .withColumn("key", _key(F.col("labels"), F.col("path")))
        .withColumn("rule", F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length")))
    )
    end = F.concat("key", F.unhex(F.lit("FF")))  # above all that begin with the key: no UTF-8 byte is FF
    events = rules.select(
        "host",
        F.explode(
            F.array(
                F.struct(F.col("key").alias("key"), F.lit(1).alias("step"), F.col("rule").alias("rule")),
                F.struct(end.alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(rules.schema["rule"].dataType).alias("rule")),
            )
        ).alias("e"),
    ).select("host", "e.*")
    order = Window.partitionBy("host").orderBy("key")
    height = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("level", height)  # of what is open after the event
    slot = Window.partitionBy("host", "level").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("key", F.last("rule", ignorenulls=True).over(slot).alias("open"))


def judge_urls(
    urls: DataFrame, rules: DataFrame, *, row: str = "page_id", url: str = "url", default: str = "allow",
    partitions: int | None = None,
) -> DataFrame:
    """``(<row>, host, path, rule, verdict)`` for every row of ``urls``.

    The longest fitting rule (host and path together; of equal length, that with the longer host)
    decides, without one ``default`` does. Null URLs and URLs without ``://`` have an empty host and
    path and fit no rule. Rows with equal values each give a row; null row ids stay null. Rules with an empty
    or null host are ignored, a null path means all paths. Other columns of ``urls`` are not read.

    Points and events are dealt out together in ranges of the key, with the row number as the last
    sort key, so that a host or URL with a third of all rows covers as many ranges as its share.
    What is open where a range starts comes from the last event of the ranges before it: one
    row for each range, whatever the input. The dealt points are a table in the shared folder, so that both see the
    same ranges. Rules are nested per host, and one host's rules are swept by one task.
    """
    spark = urls.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.select("verdict", "host", "path")
    count = F.size(_labels(F.translate("host", UPPER, LOWER)))
    depths = [r[0] for r in rules.filter("host <> ''").select(count.alias("n")).distinct().collect()]
    pages = urls.select(
        F.monotonically_increasing_id().alias("at"),
        F.col(row).alias("row"),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    ).withColumn("labels", _labels(F.col("host")))
    # One point for each depth at which rules can fit; depth 0 only keeps the row.
    fits = F.filter(F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>"), lambda d: d <= F.size("labels"))
    points = pages.withColumn("depth", F.explode(F.concat(F.array(F.lit(0)), fits)))
    key = F.when(F.col("depth") > 0, _key(F.slice("labels", 1, F.greatest("depth", F.lit(1))), F.col("path"))).otherwise(F.unhex(F.lit("")))
    points = points.select(key.alias("key"), F.lit(1).alias("kind"), "at", "row", "host", "path", "depth")
    events = rule_events(rules)
    both = events.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("at"), "open"
    ).unionByName(points, allowMissingColumns=True)
    # Written once: the sweep and the carry-over must see the same ranges, and each exchange samples its own bounds.
    placed = cut_lineage(both.repartitionByRange(partitions, "key", "kind", "at").withColumn("part", F.spark_partition_id()), "url_ranges")
    # A struct around the open rule tells "nothing is open" from "no event yet".
    event = F.when(F.col("kind") == 0, F.struct("open"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("event", F.last(event, ignorenulls=True).over(sweep)).filter("kind = 1")
    last = placed.filter("kind = 0").groupBy("part").agg(F.max_by(F.struct("open"), "key").alias("carried"))
    # One row for each range that holds an event: at most `partitions` rows.
    starts = (
        spark.range(partitions)
        .select(F.col("id").cast("int").alias("part"))
        .join(F.broadcast(last), "part", "left")
        .withColumn("carried", F.last("carried", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    )
    rule = F.coalesce("event", "carried")["open"]
    found = swept.join(F.broadcast(starts), "part", "left").select("at", "row", "host", "path", rule.alias("found"))
    ranked = F.struct(F.length("found.rule").alias("length"), "found.host_length", "found.rule", "found.verdict")
    return (
        found.groupBy("at", "row", "host", "path")
        .agg(F.max(F.when(F.col("found").isNotNull(), ranked)).alias("best"))
        .select(F.col("row").alias(row), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame(rules, RULE_COLUMNS)
