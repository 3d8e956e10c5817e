"""The catalogue's analytics queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import reports, reputation, tuning
from palisade.sources import tables as t
from palisade.sources.tables import ACTIONS, DETECTIONS, EVALUATIONS, EVENTS, FEEDBACK, SCANS

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


D = f"WITH {DETECTIONS} "
FB = f"WITH {EVENTS}, {FEEDBACK} "

add("ingest_normalize", lambda s, d: t.detections(s, d).drop("k"), D + "SELECT id, ts, hook, tool, layer, max_severity, latency_ms, url, findings FROM detections")
add("fp_rate_by_detector", lambda s, d: reports.fp_rate_by_detector(t.feedback(s, d)), FB + "SELECT detector, count(*) AS total, count(*) FILTER (feedback_type = 'false_positive') AS false_positives, round(CAST(count(*) FILTER (feedback_type = 'false_positive') AS DOUBLE) / nullif(count(*), 0), 4) AS fp_rate FROM feedback GROUP BY 1")
add("latency_by_layer", lambda s, d: reports.latency_by_layer(t.detections(s, d)), D + "SELECT layer, count(*) AS n, round(avg(latency_ms), 1) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms FROM detections WHERE latency_ms IS NOT NULL GROUP BY 1")
add("pattern_frequency_daily", lambda s, d: reports.pattern_frequency_daily(t.detections(s, d)), D + "SELECT strftime(ts, '%Y-%m-%d') AS day, hook, count(*) AS n FROM detections WHERE layer <> 'fatal_error' GROUP BY 1, 2")
add("top_tools", lambda s, d: reports.top_tools(t.detections(s, d)), D + "SELECT tool, count(*) AS n, round(avg(max_severity), 2) AS avg_severity, max(max_severity) AS max_severity FROM detections GROUP BY 1 ORDER BY n DESC, tool LIMIT 20")
add("top_urls", lambda s, d: reports.top_urls(t.detections(s, d)), D + "SELECT url, count(*) AS n, max(max_severity) AS max_severity, min(ts) AS first_seen, max(ts) AS last_seen FROM detections WHERE url IS NOT NULL GROUP BY 1 ORDER BY n DESC, url LIMIT 20")
add("volume_hourly", lambda s, d: reports.volume_hourly(t.detections(s, d)), D + "SELECT strftime(ts, '%Y-%m-%dT%H:00') AS hour, count(*) AS total, count(*) FILTER (max_severity >= 7) AS severe, count(*) FILTER (layer = 'fatal_error') AS errors FROM detections GROUP BY 1 ORDER BY hour DESC LIMIT 168")
add("detector_hits_exploded", lambda s, d: reports.detector_hits(t.detections(s, d)), D + "SELECT finding, count(*) AS hits FROM (SELECT unnest(from_json(findings, '[\"VARCHAR\"]')) AS finding FROM detections) GROUP BY 1")
add("recent_feedback", lambda s, d: reports.recent_feedback(t.feedback(s, d)), FB + "SELECT detector, feedback_type, count(*) AS n FROM feedback WHERE ts >= (SELECT max(ts) FROM feedback) - INTERVAL 7 DAY GROUP BY 1, 2")
add("override_having", lambda s, d: reports.overrides(t.feedback(s, d), 2), FB + ", o AS (SELECT * FROM feedback WHERE user_action = 'override') SELECT detector, count(*) AS n FROM o WHERE ts >= (SELECT max(ts) FROM o) - INTERVAL 1 DAY GROUP BY 1 HAVING count(*) >= 2")
add("feedback_summary", lambda s, d: reports.feedback_pivot(t.feedback(s, d)), FB + "SELECT detector, count(*) FILTER (feedback_type = 'false_positive') AS fp, count(*) FILTER (feedback_type = 'false_negative') AS fn, count(*) FILTER (feedback_type = 'confirmed_true') AS tp, count(*) AS total, round(CAST(count(*) FILTER (feedback_type = 'false_positive') AS DOUBLE) / nullif(count(*), 0), 4) AS fp_rate FROM feedback GROUP BY 1")

STATS = ", stats AS (SELECT detector, count(*) FILTER (feedback_type = 'confirmed_true') AS tp, count(*) FILTER (feedback_type = 'false_positive') AS fp, count(*) FILTER (feedback_type = 'false_negative') AS fn, count(*) AS total FROM feedback GROUP BY 1 HAVING count(*) >= 20)"
add("tuning_adjustments", lambda s, d: tuning.adjustments(tuning.tuning_stats(t.feedback(s, d))), FB + STATS + """, dir AS (SELECT *, CAST(CASE WHEN fp / total > 0.5 AND total >= 40 THEN 1 WHEN fp / total > 0.3 AND total >= 20 THEN 0.5 WHEN fn > tp THEN -1 WHEN tp / total > 0.9 THEN -0.3 ELSE 0 END AS DOUBLE) AS direction, (tp + 2.0) / (tp + fp + 4.0) AS p FROM stats),
n AS (SELECT *, round(greatest(0.2, least(0.95, 0.5 + sign(direction) * least(abs(direction * 0.15 * abs(0.5 - CAST(p AS DOUBLE))), 0.15))), 6) AS new_threshold FROM dir)
SELECT detector, tp, fp, fn, total, direction, round(CAST(p AS DOUBLE), 6) AS posterior, new_threshold FROM n WHERE abs(new_threshold - 0.5) >= 0.001""")
add("beta_posterior", lambda s, d: tuning.posteriors(tuning.tuning_stats(t.feedback(s, d))), FB + STATS + "SELECT detector, tp, fp, round(CAST(tp + 2 AS DOUBLE) / (tp + fp + 4), 6) AS mean, round(greatest(0, CAST(tp + 2 AS DOUBLE) / (tp + fp + 4) - 1.96 * sqrt(CAST((tp + 2) * (fp + 2) AS DOUBLE) / (CAST(tp + fp + 4 AS DOUBLE) * (tp + fp + 4) * (tp + fp + 5)))), 6) AS lower FROM stats")

AB = f"WITH {EVENTS}, {FEEDBACK}, {EVALUATIONS}"
MATRIX = """, m AS (SELECT test_id, count(*) AS total, count(*) FILTER (would_fire AND production_fired) AS both, count(*) FILTER (would_fire AND NOT production_fired) AS shadow_only, count(*) FILTER (NOT would_fire AND production_fired) AS production_only, count(*) FILTER (NOT would_fire AND NOT production_fired) AS neither, count(*) FILTER (would_fire) AS fires FROM ab_evaluations GROUP BY 1),
r AS (SELECT *, round(CAST(fires AS DOUBLE) / nullif(total, 0), 4) AS fire_rate, round(CAST(shadow_only AS DOUBLE) / nullif(total, 0), 4) AS additional_rate FROM m) """
add("ab_confusion", lambda s, d: tuning.confusion(t.ab_evaluations(s, d)), AB + MATRIX + "SELECT * FROM r")
add("ab_recommendation", lambda s, d: tuning.recommendation(tuning.confusion(t.ab_evaluations(s, d))), AB + MATRIX + "SELECT test_id, total, fire_rate, additional_rate, CASE WHEN total < 50 THEN 'insufficient_data' WHEN additional_rate > 0.10 THEN 'retire' WHEN additional_rate < 0.02 AND fire_rate > 0.01 THEN 'promote' WHEN additional_rate < 0.05 THEN 'promising' ELSE 'monitor' END AS recommendation FROM r")
add("ab_feedback_left_join", lambda s, d: tuning.against_feedback(t.ab_evaluations(s, d), t.feedback(s, d)), AB + " SELECT test_id, count(*) AS pairs, count(*) FILTER (would_fire AND feedback_type = 'false_positive') AS fires_false_positive, count(*) FILTER (would_fire AND feedback_type = 'confirmed_true') AS fires_confirmed_true, count(*) FILTER (would_fire AND feedback_type = 'false_negative') AS fires_false_negative, count(*) FILTER (feedback_type IS NULL) AS unjudged FROM ab_evaluations e LEFT JOIN feedback f ON e.content_hash = f.content_hash GROUP BY 1")
SHADOW = [("override_words", "regex", r"(?i)ignore\s+all"), ("long_text", "threshold", ("n_chars", 2000)), ("any_marker", "signature", ("[system]", "debug mode"))]
add("ab_shadow_eval", lambda s, d: tuning.shadow_evaluation(t.planted(s, d).withColumn("n_chars", F.length("text")), SHADOW).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("fires").alias("fires")), f"""WITH {t.PLANTED} SELECT rule, count(*) AS n, count(*) FILTER (fires) AS fires FROM (
SELECT 'override_words' AS rule, regexp_matches(text, '(?i)ignore\\s+all') AS fires FROM planted UNION ALL SELECT 'long_text', length(text) >= 2000 FROM planted UNION ALL SELECT 'any_marker', contains(lower(text), '[system]') OR contains(lower(text), 'debug mode') FROM planted) GROUP BY 1""")


def visits(s, d):
    kind = F.when((F.col("id") % 10 == 0), "false_positive").when(F.col("max_severity") > 0, "detection").otherwise("clean")
    return t.detections(s, d).where("url IS NOT NULL").select(F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("domain"), "ts", "id", F.col("max_severity").alias("severity"), kind.alias("kind"))


# A fold over ordered lists: the states are exact in both engines, rounded to six decimals.
FOLD = """, v AS (SELECT regexp_extract(url, 'https?://([^/:]+)', 1) AS domain, ts, id, CAST(max_severity AS DOUBLE) AS severity, CASE WHEN id % 10 = 0 THEN 'false_positive' WHEN max_severity > 0 THEN 'detection' ELSE 'clean' END AS kind FROM detections WHERE url IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS rn, min(ts) OVER (PARTITION BY domain) AS first_ts, count(*) OVER (PARTITION BY domain) AS n, max(severity) OVER (PARTITION BY domain) AS top FROM v WINDOW w AS (PARTITION BY domain ORDER BY ts, id)),
w AS (SELECT *, CASE WHEN severity >= 9 THEN 0.3::DOUBLE WHEN severity >= 7 THEN 0.2 WHEN severity >= 5 THEN 0.1 WHEN severity >= 1 THEN 0.05 ELSE 0 END * pow(0.5, floor((epoch_us(ts) - epoch_us(first_ts)) / 86400000000) / 30.0) AS up FROM o),
l AS (SELECT domain, n, CAST(top AS BIGINT) AS max_severity, list({'kind': kind, 'up': up} ORDER BY rn) AS xs FROM w GROUP BY ALL),
f AS (SELECT domain, n, max_severity, list_reduce(xs, lambda a, e: CASE WHEN e.kind = 'detection' THEN {'kind': CASE WHEN least(1, a.up + e.up) >= 0.95 THEN 'true' ELSE 'false' END, 'up': least(1, a.up + e.up)} WHEN e.kind = 'clean' THEN {'kind': a.kind, 'up': greatest(0, a.up - 0.005)} ELSE {'kind': CASE WHEN greatest(0, a.up - 0.15) >= 0.95 THEN 'true' ELSE 'false' END, 'up': greatest(0, a.up - 0.15)} END, {'kind': 'false', 'up': 0.5::DOUBLE}) AS z FROM l),
rep AS (SELECT domain, round(z.up, 6) AS score, z.kind = 'true' AS auto_block, n, max_severity FROM f) """
add("reputation_fold", lambda s, d: reputation.reputation(visits(s, d)), D + FOLD + "SELECT * FROM rep")
add("reputation_summary", lambda s, d: reputation.summary(reputation.reputation(visits(s, d))), D + FOLD + "SELECT count(*) AS domains, count(*) FILTER (auto_block) AS blocked, count(*) FILTER (score >= 0.8 AND score < 0.95) AS suspicious, count(*) FILTER (score < 0.5) AS trusted, round(avg(score), 4) AS avg_score FROM rep")
add("reputation_action", lambda s, d: reputation.action(visits(s, d).select("domain", "id"), reputation.reputation(visits(s, d).where("id % 3 <> 0"))).groupBy("action").agg(F.count("*").alias("n")), D + FOLD.replace("WHERE url IS NOT NULL)", "WHERE url IS NOT NULL AND id % 3 <> 0)", 1) + ", a AS (SELECT CASE WHEN coalesce(auto_block, false) OR coalesce(score, 0.5) >= 0.95 THEN 'block' WHEN coalesce(score, 0.5) >= 0.8 THEN 'flag' ELSE 'allow' END AS action FROM detections x LEFT JOIN rep ON regexp_extract(x.url, 'https?://([^/:]+)', 1) = rep.domain WHERE url IS NOT NULL) SELECT action, count(*) AS n FROM a GROUP BY 1")

HB = f"WITH {EVENTS}, {SCANS}, b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS scans, count(*) FILTER (decision = 'block') AS blocks, count(*) FILTER (decision = 'warn') AS warns, count(*) FILTER (decision = 'pass') AS passes, count(*) FILTER (decision = 'error') AS errors, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, quantile_disc(latency, 0.99) AS p99, avg(CAST(available AS INT)) > 0.5 AS available, arg_max(queue_depth, (ts, id)) AS queue_depth FROM scans GROUP BY 1) "
add("health_minute_percentiles", lambda s, d: reports.health_buckets(t.scans(s, d)), HB + "SELECT * FROM b")
add("health_report", lambda s, d: reports.health_report(reports.health_buckets(t.scans(s, d))), HB + "SELECT CAST(sum(scans) AS BIGINT) AS scans, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(warns) AS BIGINT) AS warns, CAST(sum(errors) AS BIGINT) AS errors, round(avg(p50), 4) AS avg_p50, round(avg(p95), 4) AS avg_p95, max(p99) AS max_p99, round(100 * avg(CAST(available AS INT)), 2) AS uptime_pct, max(queue_depth) AS max_queue, count(*) AS buckets, round(100.0::DOUBLE * (sum(blocks) + sum(warns)) / nullif(sum(scans), 0), 2) AS detection_rate, round(CAST(sum(scans) AS DOUBLE) / (count(*) * 3600), 6) AS scans_per_s FROM b")
add("peak_per_minute", lambda s, d: reports.per_minute_peak(t.scans(s, d)), f"WITH {EVENTS}, {SCANS} SELECT max(n) AS peak, count(*) AS buckets FROM (SELECT date_trunc('minute', ts) AS b, count(*) AS n FROM scans GROUP BY 1)")
add("table_counts", lambda s, d: reports.table_counts(detections=t.detections(s, d), feedback=t.feedback(s, d), ab_evaluations=t.ab_evaluations(s, d)), AB + ", " + DETECTIONS.split("FROM events), ", 1)[1] + " SELECT 'detections' AS name, count(*) AS n FROM detections UNION ALL SELECT 'feedback', count(*) FROM feedback UNION ALL SELECT 'ab_evaluations', count(*) FROM ab_evaluations")
add("severity_by_hook", lambda s, d: reports.severity_profile(t.detections(s, d)), D + "SELECT hook, max(max_severity) AS max_severity, count(*) AS n, max(max_severity) = 0 AS clean FROM detections GROUP BY 1")


def interactions(s, d):
    return t.events(s, d).select(F.concat(F.lit("r"), F.col("user_id") % 12).alias("host"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "blocked").when(F.least(F.lit(10), F.floor(F.col("value") / 30)) >= 7, "flagged").otherwise("clean").alias("kind"))


add("router_trust_fold", lambda s, d: reputation.trust(interactions(s, d), ("r3",)), f"""WITH {EVENTS}, i AS (SELECT 'r' || (user_id % 12) AS host, event_id AS id, CASE WHEN event_type = 'error' THEN 'blocked' WHEN least(10, floor(value / 30)) >= 7 THEN 'flagged' ELSE 'clean' END AS kind FROM ev),
l AS (SELECT host, count(*) AS n, count(*) FILTER (kind <> 'clean') AS bad, list(CASE kind WHEN 'clean' THEN CASE WHEN host = 'r3' THEN 0.0 ELSE 1.0 END WHEN 'flagged' THEN -0.05 ELSE -0.15 END::DOUBLE ORDER BY id) AS xs FROM i GROUP BY 1),
f AS (SELECT *, list_reduce(xs, lambda a, e: CASE WHEN e = 1 THEN greatest(a, least(0.8, a + 0.001)) WHEN e = 0 THEN a ELSE greatest(0, a + e) END, CASE WHEN host = 'r3' THEN 0.9 ELSE 0.5 END::DOUBLE) AS score FROM l)
SELECT host, n, round(score, 6) AS score, round(CAST(bad AS DOUBLE) / n, 4) AS flag_rate, CASE WHEN score < 0.1 THEN 'block' WHEN score < 0.3 THEN 'warn' ELSE 'ok' END AS tier FROM f""")
__all__ = ["ORACLE", "QUERIES", "ACTIONS"]
