"""Streaming forms of the operators: windows with watermarks, keyed state, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as UTC instants, which watermarks need."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def health(scans: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of decisions and the mean latency, by window. scans: ts, decision, latency."""
    of = lambda d: F.count_if(F.col("decision") == d)
    by = event_time(scans).withWatermark("ts", late).groupBy(F.window("ts", width))
    out = by.agg(F.count("*").alias("scans"), of("block").alias("blocks"), of("warn").alias("warns"), of("pass").alias("passes"), of("error").alias("errors"), F.round(F.avg("latency"), 4).alias("avg_latency"))
    return out.select(F.col("window.start").alias("bucket"), "scans", "blocks", "warns", "passes", "errors", "avg_latency")


def overrides(feedback: DataFrame, least: int = 5, width: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Detectors overridden `least` times or more, in sliding windows."""
    rows = event_time(feedback).where("user_action = 'override'").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, slide), "detector").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "detector", "n")


def resolved(pending: DataFrame, replies: DataFrame, minutes: int = 5) -> DataFrame:
    """Pending detections with the reply that came within `minutes`: an interval join of two streams, bounded by watermarks."""
    a = event_time(pending).withWatermark("ts", "10 minutes").select("token", F.col("ts").alias("asked"))
    b = event_time(replies).withWatermark("ts", "10 minutes").select(F.col("token").alias("__t"), F.col("ts").alias("answered"), "reply")
    near = F.expr(f"__t = token AND answered >= asked AND answered <= asked + INTERVAL {minutes} MINUTES")
    return a.join(b, near).drop("__t")


TRUST = "host string, n long, score double"


def trust_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The fold of operators.reputation.trust as state: a host's count and score."""
    n, score = state.get if state.exists else (0, 0.5)
    rows = pd.concat(list(batches)).sort_values("id") if not state.hasTimedOut else None
    if rows is None:
        state.remove()
        return
    for kind in rows["kind"]:
        n += 1
        score = max(score, min(0.8, score + 0.001)) if kind == "clean" else max(0.0, score - (0.05 if kind == "flagged" else 0.15))
    state.update((n, score))
    yield pd.DataFrame({"host": [key[0]], "n": [n], "score": [round(score, 6)]})


def trust(interactions: DataFrame) -> DataFrame:
    """host, n, score after each batch; state is two numbers a host, so the busiest host needs no more memory than others."""
    return interactions.groupBy("host").applyInPandasWithState(trust_step, TRUST, "n long, score double", "update", GroupStateTimeout.NoTimeout)


SESSION = "user_id long, start timestamp, n long, high long"


def session_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sessions by gaps of 30 minutes and more; a session is given out when it has ended."""
    gap = pd.Timedelta(minutes=30)
    start, last, n, high = state.get if state.exists else (0, 0, 0, 0)
    out = []
    done = lambda: out.append((key[0], pd.Timestamp(start, unit="us"), n, high))
    if state.hasTimedOut:
        done()
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, sensitive in zip(rows["ts"], rows["sensitivity"], strict=True):
            at = ts.value // 1000
            if n and at - last >= gap.value // 1000:
                done()
                n, high = 0, 0
            start, last, n, high = (at if not n else start), at, n + 1, high + (sensitive == "high")
        state.update((start, last, n, high))
        state.setTimeoutTimestamp(max(last // 1000 + 30 * 60_000, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["user_id", "start", "n", "high"])


def sessions(actions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user_id, start, n, high: ended sessions. State is four numbers a user and ends with the session."""
    rows = event_time(actions).withWatermark("ts", late).select("user_id", "ts", "sensitivity")
    return rows.groupBy("user_id").applyInPandasWithState(session_step, SESSION, "start long, last long, n long, high long", "append", GroupStateTimeout.EventTimeTimeout)


def write_once(rows: DataFrame, path: str, checkpoint: str):
    """A sink that a repeated batch doesn't write twice: each batch overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
