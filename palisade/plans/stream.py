"""Streaming queries of the catalogue: the table is read as a stream to its end, and what the stream gave is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import scratch
from palisade.sources.tables import EVENTS, SCANS
from palisade.streaming import pipelines

QUERIES, ORACLE = {}, {}


def events_stream(s, d) -> DataFrame:
    shape = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(shape).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def finished(rows: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, and returns its output table, which the driver holds: for a row an hour or host."""
    name = "stream_" + uuid.uuid4().hex
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)


def written(rows: DataFrame) -> DataFrame:
    """As finished, for outputs that grow with the input: tasks append them to files in the shared folder, beside their state."""
    path = scratch(rows.sparkSession, "stream")
    query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")


def scans_of(events: DataFrame) -> DataFrame:
    severity = F.least(F.lit(10), F.floor(F.col("value") / 30))
    decision = F.when(F.col("event_type") == "error", "error").when(severity >= 9, "block").when(severity >= 7, "warn").otherwise("pass")
    return events.select(F.col("event_id").alias("id"), "ts", decision.alias("decision"), F.col("value").alias("latency"))


def stream_health(s, d):
    out = finished(pipelines.health(scans_of(events_stream(s, d)), "1 hour"), "complete")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


QUERIES["stream_health_windows"] = stream_health
ORACLE["stream_health_windows"] = f"WITH {EVENTS}, {SCANS} SELECT date_trunc('hour', ts) AS bucket, count(*) AS scans, count(*) FILTER (decision = 'block') AS blocks, count(*) FILTER (decision = 'warn') AS warns, count(*) FILTER (decision = 'pass') AS passes, count(*) FILTER (decision = 'error') AS errors, round(avg(latency), 4) AS avg_latency FROM scans GROUP BY 1"


def stream_trust(s, d):
    ev = events_stream(s, d)
    kind = F.when(F.col("event_type") == "error", "blocked").when(F.least(F.lit(10), F.floor(F.col("value") / 30)) >= 7, "flagged").otherwise("clean")
    rows = ev.select(F.concat(F.lit("r"), F.col("user_id") % 12).alias("host"), F.col("event_id").alias("id"), kind.alias("kind"))
    return finished(pipelines.trust(rows), "update")


QUERIES["stream_trust_state"] = stream_trust
ORACLE["stream_trust_state"] = f"""WITH {EVENTS}, i AS (SELECT 'r' || (user_id % 12) AS host, event_id AS id, CASE WHEN event_type = 'error' THEN -0.15 WHEN least(10, floor(value / 30)) >= 7 THEN -0.05 ELSE 1 END::DOUBLE AS x FROM ev),
l AS (SELECT host, count(*) AS n, list(x ORDER BY id) AS xs FROM i GROUP BY 1) SELECT host, n, round(list_reduce(xs, lambda a, e: CASE WHEN e = 1 THEN greatest(a, least(0.8, a + 0.001)) ELSE greatest(0, a + e) END, 0.5::DOUBLE), 6) AS score FROM l"""


def stream_sessions(s, d):
    ev = events_stream(s, d)
    sensitivity = F.when(F.col("value") >= 150, "high").when(F.col("value") >= 60, "medium").otherwise("low")
    return written(pipelines.sessions(ev.select("user_id", "ts", sensitivity.alias("sensitivity")))).withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES["stream_sessions"] = stream_sessions
