"""Detection reports: aggregations of the detection log. Each takes and returns DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.numbers import long_sum, ratio


def fp_rate_by_detector(feedback: DataFrame) -> DataFrame:
    """Share of false positives by detector, four decimals."""
    out = feedback.groupBy("detector").agg(F.count("*").alias("total"), F.count_if(F.col("feedback_type") == "false_positive").alias("false_positives"))
    return out.withColumn("fp_rate", ratio("false_positives", "total", 4))


def latency_by_layer(detections: DataFrame) -> DataFrame:
    out = detections.where("latency_ms IS NOT NULL").groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))
    return out


def pattern_frequency_daily(detections: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return detections.where("layer <> 'fatal_error'").groupBy(day.alias("day"), "hook").agg(F.count("*").alias("n"))


def top_tools(detections: DataFrame, k: int = 20) -> DataFrame:
    out = detections.where("tool IS NOT NULL").groupBy("tool").agg(F.count("*").alias("n"), F.round(F.avg("max_severity"), 2).alias("avg_severity"), F.max("max_severity").alias("max_severity"))
    return out.orderBy(F.desc("n"), "tool").limit(k)


def top_urls(detections: DataFrame, k: int = 20) -> DataFrame:
    out = detections.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"), F.max("max_severity").alias("max_severity"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.orderBy(F.desc("n"), "url").limit(k)


def volume_hourly(detections: DataFrame, hours: int = 168) -> DataFrame:
    """The latest hours that have rows: total, severe and failed."""
    hour = F.date_format("ts", "yyyy-MM-dd'T'HH:00")
    out = detections.groupBy(hour.alias("hour")).agg(F.count("*").alias("total"), F.count_if(F.col("max_severity") >= 7).alias("severe"), F.count_if(F.col("layer") == "fatal_error").alias("errors"))
    return out.orderBy(F.desc("hour")).limit(hours)


def exploded_findings(detections: DataFrame) -> DataFrame:
    """One row for each finding named in the JSON list `findings`."""
    return detections.withColumn("finding", F.explode(F.from_json("findings", "array<string>")))


def detector_hits(detections: DataFrame) -> DataFrame:
    return exploded_findings(detections).groupBy("finding").agg(F.count("*").alias("hits"))


def since(rows: DataFrame, days: float) -> DataFrame:
    """Rows of the last days before the table's own latest time, so that results don't hang on the clock."""
    latest = rows.agg(F.max("ts").alias("as_of"))  # one row
    return rows.join(F.broadcast(latest)).where(F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(86400.0 * days))).drop("as_of")


def recent_feedback(feedback: DataFrame, days: float = 7) -> DataFrame:
    return since(feedback, days).groupBy("detector", "feedback_type").agg(F.count("*").alias("n"))


def overrides(feedback: DataFrame, least: int = 5, days: float = 1) -> DataFrame:
    """Detectors that users overrode `least` times or more of late."""
    return since(feedback.where("user_action = 'override'"), days).groupBy("detector").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def feedback_pivot(feedback: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("feedback_type") == kind)
    out = feedback.groupBy("detector").agg(of("false_positive").alias("fp"), of("false_negative").alias("fn"), of("confirmed_true").alias("tp"), F.count("*").alias("total"))
    return out.withColumn("fp_rate", ratio("fp", "total", 4))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row a table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def per_minute_peak(scans: DataFrame, width: str = "minute") -> DataFrame:
    by = scans.groupBy(F.date_trunc(width, "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return by.agg(F.max("n").alias("peak"), F.count("*").alias("buckets"))


def health_buckets(scans: DataFrame, width: str = "hour") -> DataFrame:
    """Counts by decision, nearest-rank percentiles of latency, majority vote, last queue depth."""
    of = lambda d: F.count_if(F.col("decision") == d)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)")
    return scans.groupBy(F.date_trunc(width, "ts").alias("bucket")).agg(
        F.count("*").alias("scans"), of("block").alias("blocks"), of("warn").alias("warns"), of("pass").alias("passes"), of("error").alias("errors"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"),
        (F.avg(F.col("available").cast("double")) > 0.5).alias("available"), F.max_by("queue_depth", F.struct("ts", "id")).alias("queue_depth"),
    )


def health_report(buckets: DataFrame, seconds: int = 3600) -> DataFrame:
    out = buckets.agg(
        long_sum("scans").alias("scans"), long_sum("blocks").alias("blocks"), long_sum("warns").alias("warns"), long_sum("errors").alias("errors"),
        F.round(F.avg("p50"), 4).alias("avg_p50"), F.round(F.avg("p95"), 4).alias("avg_p95"), F.max("p99").alias("max_p99"),
        F.round(100 * F.avg(F.col("available").cast("double")), 2).alias("uptime_pct"), F.max("queue_depth").alias("max_queue"), F.count("*").alias("buckets"),
    )
    found = F.round(100 * (F.col("blocks") + F.col("warns")) / F.nullif(F.col("scans"), F.lit(0)), 2)
    return out.withColumn("detection_rate", found).withColumn("scans_per_s", F.round(F.col("scans") / (F.col("buckets") * seconds), 6))


def severity_profile(detections: DataFrame, key: Column | str = "hook") -> DataFrame:
    """Most severe, number and whether clean, by key."""
    return detections.groupBy(key).agg(F.max("max_severity").alias("max_severity"), F.count("*").alias("n"), (F.max("max_severity") == 0).alias("clean"))
