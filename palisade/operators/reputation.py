"""Reputation of domains and endpoints: folds over ordered events with clamped steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the two folds.
WEIGHTS = ((9, 0.3), (7, 0.2), (5, 0.1), (1, 0.05))
CLEAN, FALSE_POSITIVE, BLOCK_AT, FLAG_AT, HALF_LIFE_DAYS = 0.005, 0.15, 0.95, 0.8, 30.0


def weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for least, w in reversed(WEIGHTS):
        out = F.when(severity >= least, F.lit(w)).otherwise(out)
    return out


def reputation(events: DataFrame) -> DataFrame:
    """domain, score, auto_block, n, max_severity. events: domain, ts, id, severity, kind (detection, clean, false_positive).

    Steps depend on the score so far (both ends are clamped), so a domain's events are folded in order, in one row's array. An
    event is 28 bytes; a domain with more than some 10 million events should be folded by the streaming operator instead.
    """
    each = F.struct(F.col("ts"), F.col("id"), F.col("severity").cast("double").alias("severity"), F.col("kind"))
    by = events.groupBy("domain").agg(F.array_sort(F.collect_list(each)).alias("list"), F.count("*").alias("n"), F.max("severity").alias("max_severity"))
    first = F.get(F.col("list"), F.lit(0))["ts"]

    def step(a: Column, e: Column) -> Column:
        days = F.floor((F.unix_micros(e["ts"].cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86400000000)
        up = F.least(F.lit(1.0), a["score"] + weight(e["severity"]) * F.pow(F.lit(0.5), days / HALF_LIFE_DAYS))
        down = F.greatest(F.lit(0.0), a["score"] - F.when(e["kind"] == "clean", CLEAN).otherwise(FALSE_POSITIVE))
        score = F.when(e["kind"] == "detection", up).otherwise(down)
        return F.struct(score.alias("score"), F.when(e["kind"] == "clean", a["block"]).otherwise(score >= BLOCK_AT).alias("block"))

    start = F.struct(F.lit(0.5).alias("score"), F.lit(False).alias("block"))
    out = by.withColumn("end", F.aggregate("list", start, step))
    return out.select("domain", F.round("end.score", 6).alias("score"), F.col("end.block").alias("auto_block"), "n", "max_severity")


def summary(found: DataFrame) -> DataFrame:
    s = F.col("score")
    return found.agg(F.count("*").alias("domains"), F.count_if("auto_block").alias("blocked"), F.count_if((s >= FLAG_AT) & (s < BLOCK_AT)).alias("suspicious"), F.count_if(s < 0.5).alias("trusted"), F.round(F.avg("score"), 4).alias("avg_score"))


def action(visits: DataFrame, found: DataFrame) -> DataFrame:
    """What to do with each visit, by its domain's reputation; unknown domains are allowed at 0.5."""
    out = visits.join(found.select("domain", "score", "auto_block"), "domain", "left")
    score = F.coalesce("score", F.lit(0.5))
    says = F.when(F.coalesce("auto_block", F.lit(False)) | (score >= BLOCK_AT), "block").when(score >= FLAG_AT, "flag").otherwise("allow")
    return out.withColumn("score", score).withColumn("action", says).drop("auto_block")


def trust(interactions: DataFrame, trusted: tuple[str, ...] = ()) -> DataFrame:
    """host, score, flag_rate, tier. interactions: host, id, kind (clean, flagged, blocked)."""
    each = F.struct("id", "kind")
    by = interactions.groupBy("host").agg(F.array_sort(F.collect_list(each)).alias("list"), F.count("*").alias("n"), F.count_if(F.col("kind") != "clean").alias("bad"))
    known = F.col("host").isin(*trusted) if trusted else F.lit(False)

    def step(a: Column, e: Column) -> Column:
        up = F.when(known, a).otherwise(F.greatest(a, F.least(F.lit(0.8), a + 0.001)))
        return F.when(e["kind"] == "clean", up).otherwise(F.greatest(F.lit(0.0), a - F.when(e["kind"] == "flagged", 0.05).otherwise(0.15)))

    score = F.aggregate("list", F.when(known, F.lit(0.9)).otherwise(F.lit(0.5)), step)
    out = by.withColumn("score", score)
    tier = F.when(F.col("score") < 0.1, "block").when(F.col("score") < 0.3, "warn").otherwise("ok")
    return out.select("host", "n", F.round("score", 6).alias("score"), F.round(F.col("bad") / F.col("n"), 4).alias("flag_rate"), tier.alias("tier"))
