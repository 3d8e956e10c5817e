"""States and summaries: rule tests, audits, shared patterns, classifier replies, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules


def transition(status: Column, action: Column) -> Column:
    """The status of a rule test after an action: only a shadow rule can be promoted; any can be retired."""
    return F.when((action == "promote") & (status == "shadow"), "promoted").when(action == "retire", "retired").otherwise(status)


def query_log(log: DataFrame, hook: str | None = None, tool: str | None = None, since: str | None = None, until: str | None = None, last: int = 100) -> DataFrame:
    """The last rows of a log that fit, bounds included."""
    for column, value in (("hook", hook), ("tool", tool)):
        log = log.where(F.col(column) == value) if value is not None else log
    log = log.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else log
    log = log.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else log
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(last)


def audit_summary(files: DataFrame, events: DataFrame, writes: DataFrame) -> DataFrame:
    """One row: tracked and modified files, events, memory writes and blocked ones."""
    a = files.agg(F.count("*").alias("files"), F.count_if(F.col("modified_count") > 0).alias("modified"))
    b = events.agg(F.count("*").alias("events"))
    c = writes.agg(F.count("*").alias("writes"), F.count_if(~F.col("passed")).alias("blocked"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def classifier_summary(matches: Column) -> Column:
    """(injection, confidence, severity) of an array of (intent, confidence); unknown intents don't count."""
    known = F.create_map(*[F.lit(x) for kv in rules.INTENTS.items() for x in kv])
    own = F.filter(matches, lambda m: m["intent"].isin(*rules.INTENTS))
    return F.struct(F.exists(own, lambda m: m["confidence"] >= 0.6).alias("injection"), F.coalesce(F.array_max(F.transform(own, lambda m: m["confidence"])), F.lit(0.0)).alias("confidence"), F.coalesce(F.array_max(F.transform(own, lambda m: F.coalesce(F.try_element_at(known, m["intent"]), F.lit(7)))), F.lit(0)).alias("severity"))


def shared_stats(patterns: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row: known patterns, contributions, those of the last hour of the table, the last one's time."""
    latest = contributions.agg(F.max("ts").alias("as_of"))
    recent = contributions.join(F.broadcast(latest)).agg(F.count("*").alias("contributions"), F.count_if(F.col("ts") > F.col("as_of") - F.expr("INTERVAL 1 HOUR")).alias("last_hour"), F.max("ts").alias("last"))
    return patterns.agg(F.count("*").alias("patterns")).join(F.broadcast(recent))


def record(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A detection's two consequences: its log row, and the events of its domain's reputation (severity 5 where unknown)."""
    blocked = (F.col("hook") == "pre-fetch") | (F.col("max_severity") >= 8)
    events = detections.where("url IS NOT NULL").select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("domain"), "ts", "id", F.coalesce("max_severity", F.lit(5)).alias("severity"), F.lit("detection").alias("kind"), blocked.alias("blocked"))
    return detections, events


def sample_evenly(seeds: DataFrame, n: int, order: str) -> DataFrame:
    """n seeds at even distances in order. Seeds are few: one window."""
    from pyspark.sql import Window

    rows = seeds.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1).withColumn("__m", F.count("*").over(Window.partitionBy()))
    chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.col("__m").cast("int")) - 1), lambda i: F.floor(i * F.col("__m") / F.least(F.lit(n), F.col("__m"))))
    return rows.where(F.array_contains(chosen, F.col("__i").cast("long"))).drop("__i", "__m")
