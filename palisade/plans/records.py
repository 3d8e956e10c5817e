"""Queries of signed replies, feedback records, thresholds, chunks, terms and disagreeing models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import nested, rules
from palisade.functions import text as tx
from palisade.operators import detectors as det
from palisade.operators import integrity, records, sessions, signatures, tuning, vectors
from palisade.sources import tables as t
from palisade.sources.tables import ACTIONS, DETECTIONS, EVENTS, sql_text

QUERIES, ORACLE = {}, {}
KEY = b"fragment-key"


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


# ---------------------------------------------------------------- signed replies
def replies(s, d):
    """Bodies of one number, signed by turns: not at all, by a stranger, with a right hash, with another reply's, in the body."""
    n, turn = F.col("event_id"), F.col("event_id") % 5
    body = F.concat(F.lit('{"n": '), n, F.lit(', "b": [1.50, 2e3, true], "a": "x"}'))
    own = F.concat(F.lit('{"a":"x","b":[1.5,2000,true],"n":'), n, F.lit("}"))
    headers = F.create_map(F.lit("X-Provider-Signature"), F.when(turn.isin(1, 2, 3), "c2ln"), F.lit("x-provider-NAME"), F.when(turn == 1, "stranger").otherwise("known"), F.lit("X-Provider-Content-Hash"), F.when(turn == 2, F.sha2(own, 256)).otherwise(F.sha2("props", 256)))
    signed = F.concat(F.lit('{"_signature": {"signature": "c2ln", "provider": "known"}, "n": '), n, F.lit("}"))
    return t.events(s, d).select("event_id", headers.alias("headers"), F.when(turn == 4, signed).otherwise(body).alias("body"), F.lit("n").alias("nonce"))


def signed(s, d):
    found = signatures.verify(replies(s, d), ("known",), lambda provider, payload, sig: payload.endswith('"request_nonce":"n"}') & F.contains(payload, F.lit('"content_hash":"')))
    return found.groupBy("status").agg(F.count("*").alias("n"), F.count_if("tampered").alias("tampered"))


add("provider_signatures", signed, """WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'unknown_provider' WHEN 3 THEN CASE WHEN sha256(props) = sha256('{"a":"x","b":[1.5,2000,true],"n":' || event_id || '}') THEN 'verified' ELSE 'hash_mismatch' END ELSE 'verified' END AS status FROM events)
SELECT status, count(*) AS n, count(*) FILTER (status IN ('hash_mismatch', 'signature_invalid')) AS tampered FROM r GROUP BY 1""")


def body_hashes(s, d):
    body = F.concat(F.lit('{ "z": "'), "event_type", F.lit('", "id": '), "event_id", F.lit(', "a": [0.10, -0.0, 1e21, 1E-7, 12.0, null]}'))
    return t.events(s, d).select("event_id", F.sha2(nested.canonical_body_column(body), 256).alias("sha"))


add("canonical_hash", body_hashes, """SELECT event_id, sha256('{"a":[0.1,0,1e+21,1e-7,12,null],"id":' || event_id || ',"z":"' || event_type || '"}') AS sha FROM events""")


def fragments(s, d):
    rows = t.events(s, d).select("event_id", "ts", F.col("props").alias("text"))
    mac = tx.hmac_sha256(KEY, F.col("text"))
    rows = rows.withColumn("sig", F.when(F.col("event_id") % 3 == 0, mac).when(F.col("event_id") % 3 == 1, F.concat(mac, F.lit("0"))))
    now = rows.agg(F.max("ts").alias("__now"))
    return integrity.recent_fragments(rows.join(F.broadcast(now)), KEY, F.col("__now"), minutes=24 * 60).select("event_id")


add("memory_fragments", fragments, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND event_id % 3 <> 1")

# ---------------------------------------------------------------- feedback and thresholds
def reports(s, d):
    return t.events(s, d).where("event_id % 11 = 0").select("ts", (F.col("event_id") * 2).alias("detection_id"), F.when(F.col("k") % 2 == 0, "seen").alias("notes"))


add("feedback_false_positives", lambda s, d: records.false_positives(t.detections(s, d), reports(s, d)).drop("content_hash"), f"WITH {DETECTIONS}, r AS (SELECT ts, event_id * 2 AS detection_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'seen' END AS notes FROM events WHERE event_id % 11 = 0) SELECT r.ts, r.detection_id, 'false_positive' AS feedback_type, d.hook, json_extract_string(d.findings, '$[0]') AS detector, nullif(d.max_severity, 0) AS severity, 'manual' AS user_action, r.notes FROM r JOIN detections d ON d.id = r.detection_id")


def two_runs(s, d):
    stats = tuning.tuning_stats(t.feedback(s, d))
    start = s.createDataFrame([], "ts timestamp, run long, detector string, new_threshold double")
    now = F.lit("2024-01-01").cast("timestamp")
    first = records.history_rows(records.tuned(stats, start), 1, now)
    second = records.history_rows(records.tuned(stats, first.select("ts", "run", "detector", "new_threshold")), 2, now)
    return first.unionByName(second).select("run", "detector", F.round("old_threshold", 6).alias("old_threshold"), F.round("new_threshold", 6).alias("new_threshold"))


RUNS = """WITH f AS (SELECT 'det_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 12) AS detector, CASE WHEN value >= 150 THEN 'c' WHEN value < 20 THEN 'n' ELSE 'p' END AS t FROM events WHERE event_id % 4 = 0),
s AS (SELECT detector, CAST(count(*) FILTER (t = 'c') AS DOUBLE) AS tp, CAST(count(*) FILTER (t = 'p') AS DOUBLE) AS fp, CAST(count(*) FILTER (t = 'n') AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS total FROM f GROUP BY 1 HAVING count(*) >= 20),
g AS (SELECT *, CASE WHEN fp / total > 0.5 AND total >= 40 THEN 1.0 WHEN fp / total > 0.3 AND total >= 20 THEN 0.5 WHEN fn > tp THEN -1.0 WHEN tp / total > 0.9 THEN -0.3 ELSE 0.0 END::DOUBLE AS way, (tp + 2) / (tp + fp + 4) AS posterior FROM s),
m AS (SELECT detector, sign(way) * least(abs(way * 0.15::DOUBLE * abs(0.5::DOUBLE - posterior)), 0.15::DOUBLE) AS delta FROM g),
a AS (SELECT 1 AS run, detector, 0.5::DOUBLE AS old_threshold, round(greatest(0.2::DOUBLE, least(0.95::DOUBLE, 0.5::DOUBLE + delta)), 6) AS new_threshold, delta FROM m),
a1 AS (SELECT * FROM a WHERE abs(new_threshold - old_threshold) >= 0.001::DOUBLE),
b AS (SELECT 2 AS run, m.detector, coalesce(a1.new_threshold, 0.5::DOUBLE) AS old_threshold, round(greatest(0.2::DOUBLE, least(0.95::DOUBLE, coalesce(a1.new_threshold, 0.5::DOUBLE) + m.delta)), 6) AS new_threshold FROM m LEFT JOIN a1 USING (detector))
SELECT CAST(run AS BIGINT) AS run, detector, old_threshold, new_threshold FROM a1 UNION ALL SELECT CAST(run AS BIGINT), detector, old_threshold, new_threshold FROM b WHERE abs(new_threshold - old_threshold) >= 0.001::DOUBLE"""
add("threshold_history", two_runs, RUNS)

# ---------------------------------------------------------------- chunks, terms, lines
digest = lambda c: (F.size(c).cast("long").alias("chunks"), F.sha2(F.array_join(c, "|"), 256).alias("digest"))
add("embedding_chunks", lambda s, d: t.load(s, d, "documents").select("doc_id", tx.chunks(F.col("text")).alias("c")).select("doc_id", *digest("c")), r"""WITH w AS (SELECT doc_id, list_filter(list_transform(range(1, greatest(1, length(text)) + 1, 80), lambda i: trim(substring(text, i, 200), chr(32) || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 30) AS a, regexp_extract_all(text, '[^.!?\n]+[.!?\n]+') AS s FROM documents),
p AS (SELECT doc_id, a || list_filter(list_transform(s, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))) || list_transform(range(1, len(s)), lambda i: trim(array_to_string(s[i:i + 2], ' '), chr(32) || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 30 AND length(x) < 500) AS l FROM w),
k AS (SELECT doc_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS l FROM p) SELECT doc_id, len(l) AS chunks, sha256(array_to_string(l, '|')) AS digest FROM k""".replace("\\n", "\n"))
add("analysis_chunks", lambda s, d: t.load(s, d, "documents").select("doc_id", tx.analysis_chunks(F.col("text")).alias("c")).select("doc_id", *digest("c")), "WITH w AS (SELECT doc_id, list_filter(list_transform(range(1, greatest(1, length(text)) + 1, 150), lambda i: trim(substring(text, i, 300), chr(32) || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 30) AS l FROM documents) SELECT doc_id, len(l) AS chunks, sha256(array_to_string(l, '|')) AS digest FROM w")
LEXICON = ", ".join(f"({sql_text(k)}, {float(v)}::DOUBLE)" for k, v in rules.LEXICON.items())
add("top_terms", lambda s, d: t.planted(s, d).select("doc_id", F.posexplode(det.top_terms(F.col("text"))).alias("rank", "t")).select("doc_id", F.col("rank").cast("long").alias("rank"), "t.term", "t.weight"), f"WITH {t.PLANTED}, l(term, idf) AS (VALUES {LEXICON}), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z]+') AS ws FROM planted), c AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS term FROM w), g AS (SELECT doc_id, term, round(CAST(count(*) AS DOUBLE) / any_value(total) * any_value(idf), 9) AS weight FROM c JOIN l USING (term) GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) - 1 AS rank, term, weight FROM g QUALIFY rank < 8")
add("term_groups", lambda s, d: s.createDataFrame(list(rules.LEXICON.items()), "term string, idf double").groupBy(records.term_group(F.col("term")).alias("kind")).agg(F.count("*").alias("n"), F.max("term").alias("last")), f"WITH l(term, idf) AS (VALUES {LEXICON}) SELECT CASE " + " ".join(f"WHEN regexp_matches(term, {sql_text(p)}) THEN '{k}'" for k, p in records.TERM_GROUPS) + " ELSE 'other' END AS kind, count(*) AS n, max(term) AS last FROM l GROUP BY 1")


def variants(s, d):
    own = t.load(s, d, "benchmark").select("item_id", F.concat(F.lit("1. "), "text", F.lit("\n2) short\n 3. third\n10.  a variant of item "), "item_id").alias("reply"))
    scored = records.variants(own).withColumn("score", F.length("variant") % 10 / 10)
    return records.bypasses(scored)


add("seed_variants", variants, "WITH v AS (SELECT item_id, unnest(list_transform(string_split('1. ' || text || chr(10) || '2) short' || chr(10) || ' 3. third' || chr(10) || '10.  a variant of item ' || item_id, chr(10)), lambda x: trim(regexp_replace(x, '^[0-9]+[.)][ ]*', '')))) AS variant FROM benchmark) SELECT item_id, variant, length(variant) % 10 / 10.0::DOUBLE AS score FROM v WHERE length(variant) > 15 AND length(variant) < 500 AND length(variant) % 10 < 5")

# ---------------------------------------------------------------- disagreeing models, sessions
def disagreeing(s, d):
    own = t.load(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    docs = t.load(s, d, "documents").join(own, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "vector")
    seeds = t.load(s, d, "benchmark").join(own, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("seed_id"), "text", "vector")
    return vectors.disagreement(docs, seeds).select("doc_id", F.round("score", 7).alias("score"), "suspicious", "by_vector", "by_trigrams")


GRAMS = "(SELECT {0}, count(*) AS n, g FROM (SELECT {0}, unnest(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))) AS g FROM (SELECT {0}, regexp_replace(lower(text), '\\s+', ' ', 'g') AS x FROM {1})) GROUP BY ALL)"
add("model_disagreement", disagreeing, f"""WITH d AS (SELECT doc_id, text, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id), b AS (SELECT item_id, text, CAST(embedding AS DOUBLE[]) AS w FROM benchmark JOIN embeddings ON item_id = vec_id),
dg AS {GRAMS.format("doc_id", "d")}, bg AS {GRAMS.format("item_id", "b")}, dn AS (SELECT doc_id, sqrt(sum(n * n)) AS s FROM dg GROUP BY 1), bn AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM bg GROUP BY 1),
dot AS (SELECT doc_id, item_id, CAST(sum(dg.n * bg.n) AS DOUBLE) AS p FROM dg JOIN bg USING (g) GROUP BY 1, 2),
c AS (SELECT d.doc_id, b.item_id, round(list_cosine_similarity(v, w), 6) AS x, round(coalesce(p / (dn.s * bn.s), 0), 6) AS y FROM d CROSS JOIN b LEFT JOIN dot USING (doc_id, item_id) LEFT JOIN dn USING (doc_id) LEFT JOIN bn USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, item_id) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, item_id) AS j FROM c),
m AS (SELECT doc_id, max(x) AS x, max(y) AS y, 1 - CAST(count(*) FILTER (i <= 5 AND j <= 5) AS DOUBLE) / 5 AS far FROM r GROUP BY 1),
z AS (SELECT *, least(1.0::DOUBLE, far * 0.3::DOUBLE + abs(y - x) * 0.3::DOUBLE + CASE WHEN y > 0.3::DOUBLE AND x < 0.5::DOUBLE THEN (y - x) * 2 ELSE 0 END * 0.4::DOUBLE) AS score FROM m)
SELECT doc_id, round(score, 7) AS score, score > 0.3::DOUBLE AS suspicious, x AS by_vector, y AS by_trigrams FROM z""")
add("sessions_ttl", lambda s, d: sessions.kept_sessions(t.actions(s, d)).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("n")), f"WITH {EVENTS}, {ACTIONS}, g AS (SELECT user_id, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 AS BIGINT), 1) AS new FROM actions) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1")
add("recent_minutes", lambda s, d: records.recent(t.events(s, d).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))), "SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60")
