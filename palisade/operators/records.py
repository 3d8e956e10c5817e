"""Rows that the engine itself writes: verdicts of users, audits of memory writes, rule tests, thresholds and their history; and
what it reads of models' replies."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import predicates as pr
from palisade.functions.text import numbered_lines
from palisade.operators.tuning import DEFAULT, adjustments

#: What a user did, by the kind of verdict, where nothing is said; characters of a text that an audit keeps.
ACTIONS = {"false_positive": "manual", "false_negative": "report", "confirmed_true": "confirm"}
PREVIEW = 200
#: A term's group, by the first pattern that it holds. Fixed values.
TERM_GROUPS = (
    ("override", "ignore|disregard|override|bypass|forget|supersede|void|rescind|revoke|obsolete"), ("persona", "prompt|system|persona|roleplay|jailbreak|unrestricted|uncensored|mode"),
    ("authority", "admin|authorized|permission|compliance|regulatory|audit"), ("rlhf", "helpful|genuinely|truly|prioritize|arbitrary|alignment"),
    ("exfiltration", "exfiltrat|transmit|endpoint|webhook|credential|apikey|token|password|secret"), ("memory", "remember|henceforth|always|persist|memorize|implant"),
    ("imperative", "must|should|shall|obey|comply|execute|behave|require"), ("vocabulary", "ai|assistant|model|claude|gpt|llm|safety|guardrail|filter"),
    ("evasion", "base64|encode|decode|rot13|cipher|obfuscat|hidden"), ("social", "urgent|emergency|critical|please|kindly|deadline"), ("boundary", "previous|prior|initial|original|new|updated|hereafter"),
)


def given(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or null of a kind where rows lack it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def verdicts(rows: DataFrame, kind: str) -> DataFrame:
    """Feedback rows of one kind (ACTIONS), from whatever is known; what passed unseen has no detection."""
    action = F.coalesce(F.nullif(given(rows, "user_action"), F.lit("")), F.lit(ACTIONS[kind]))
    detection = given(rows, "detection_id", "long") if kind != "false_negative" else F.lit(None).cast("long")
    texts = {c: F.nullif(given(rows, c), F.lit("")) for c in ("hook", "detector", "content_hash", "notes")}
    severity = F.nullif(given(rows, "severity", "long"), F.lit(0).cast("long"))
    return rows.select(given(rows, "ts", "timestamp").alias("ts"), detection.alias("detection_id"), F.lit(kind).alias("feedback_type"), texts["hook"].alias("hook"), texts["detector"].alias("detector"), severity.alias("severity"), action.alias("user_action"), texts["content_hash"].alias("content_hash"), texts["notes"].alias("notes"))


def false_positives(detections: DataFrame, reports: DataFrame) -> DataFrame:
    """Feedback rows for reports (ts, detection_id, notes) that name a detection: its hook, first finding and severity."""
    first = F.get(F.from_json("findings", "array<string>"), F.lit(0))
    own = detections.select(F.col("id").alias("detection_id"), "hook", first.alias("detector"), F.col("max_severity").alias("severity"))
    return verdicts(reports.select("ts", "detection_id", "notes").join(own, "detection_id"), "false_positive")


def memory_audit(results: DataFrame) -> DataFrame:
    """The audit's rows of memory checks (ts, source, passed, risk_score, flags, text): the text's beginning only."""
    return results.select("ts", "source", F.col("passed").cast("int").alias("passed"), "risk_score", F.to_json(F.coalesce("flags", F.array().cast("array<string>"))).alias("flags"), F.left(F.coalesce("text", F.lit("")), F.lit(PREVIEW)).alias("content_preview"))


def rule_tests(rules: DataFrame, now: Column) -> DataFrame:
    """New rule tests (name, description, rule_type, rule_config) begin as shadows."""
    return rules.select("name", F.coalesce("description", F.lit("")).alias("description"), "rule_type", "rule_config", F.lit("shadow").alias("status"), now.alias("created_at"))


# ---------------------------------------------------------------- thresholds
def current(history: DataFrame) -> DataFrame:
    """detector, threshold: the latest of each detector's."""
    return history.groupBy("detector").agg(F.max_by("new_threshold", F.struct("ts", "run")).alias("threshold"))


def tuned(stats: DataFrame, history: DataFrame) -> DataFrame:
    """Adjustments from where each detector stands now, so that runs add up; DEFAULT for one that was never moved."""
    own = stats.join(current(history), "detector", "left")
    return adjustments(own, F.coalesce("threshold", F.lit(DEFAULT)))


def history_rows(found: DataFrame, run: int, now: Column) -> DataFrame:
    """What a run appends to the history."""
    return found.select(now.alias("ts"), F.lit(run).cast("long").alias("run"), "detector", F.coalesce("threshold", F.lit(DEFAULT)).alias("old_threshold"), "new_threshold", F.col("total").alias("samples"), "posterior")


# ---------------------------------------------------------------- terms, seeds and endpoints
def term_group(term: Column) -> Column:
    return reduce(lambda out, kv: F.when(term.rlike(kv[1]), kv[0]).otherwise(out), reversed(TERM_GROUPS), F.lit("other"))


def variants(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with `variant`: a row a line that a model gave."""
    return replies.withColumn("variant", F.explode(numbered_lines(F.col(reply)))).drop(reply)


def bypasses(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Variants (with score) that a detector lets pass; those that it could not score are left out."""
    return scored.where(F.col("score") < threshold)


def sampled(seeds: DataFrame, n: int, seed: int) -> DataFrame:
    """n seeds by chance, the same ones for the same seed and partitions."""
    return seeds.orderBy(F.rand(seed)).limit(n)


def recent(metrics: DataFrame, minutes: int = 60) -> DataFrame:
    """The last minutes' rows, the latest first."""
    return metrics.orderBy(F.desc("minute")).limit(minutes)


def active_endpoints(spark: SparkSession, environment: dict[str, str] | None = None) -> DataFrame:
    """variable, url, host, kind, trusted: the endpoints that the environment names."""
    known = os.environ if environment is None else environment
    rows = spark.createDataFrame([(v, known[v]) for v in pr.ENDPOINT_VARIABLES if known.get(v)], "variable string, url string")
    kind = pr.endpoint(F.col("url"))
    return rows.select("variable", "url", pr.endpoint_host(F.col("url")).alias("host"), kind.alias("kind"), pr.trusted_endpoint(kind).alias("trusted"))
