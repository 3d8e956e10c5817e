"""Signed replies, chains, canonical JSON, feedback records, chunks, disagreeing models."""

import hashlib
import hmac
import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from palisade.functions import nested
from palisade.functions import predicates as pr
from palisade.functions import text as tx
from palisade.operators import integrity, records, signatures, vectors
from tests.test_operators import column


def test_canonical_numbers_and_keys():
    numbers = {"0": "0", "-0.0": "0", "1.0": "1", "1e21": "1e+21", "123456789012345678901": "123456789012345680000", "1e-7": "1e-7", "0.000001": "0.000001", "-1.5e300": "-1.5e+300", "1E400": "null", "100": "100", "12.5e1": "125"}
    assert {k: nested.canonical(k) for k in numbers} == numbers
    assert nested.canonical('{"\\ud83d\\ude00":1,"\\uff5a":2,"a":[true,null,"\\u0007"]}') == '{"a":[true,null,"\\u0007"],"😀":1,"ｚ":2}'
    assert nested.canonical('"\\ud800"') == '"\\ud800"' and nested.canonical("NaN") is None and nested.canonical("") is None
    assert nested.canonical_body("no json") == '"no json"'


def test_signature_states(spark):
    body = '{"b": 1.0, "a": "x"}'
    digest = hashlib.sha256(b'{"a":"x","b":1}').hexdigest()
    head = lambda **kw: {k.replace("_", "-"): v for k, v in kw.items()}
    signed = {"X_Provider_Signature": "good", "x_provider": "known"}
    rows = [(0, None, body), (1, {}, None), (2, head(**signed), body), (3, head(**signed, x_provider_content_hash=digest), body), (4, head(**signed, x_provider_content_hash="0"), body), (5, head(x_provider_signature="good", x_provider="other"), body), (6, head(x_provider_signature="bad", x_provider_name="known"), body), (7, head(x_provider_signature="?", x_provider="known"), body), (8, {}, '{"metadata": {"signature": "good"}}'), (9, head(x_provider_signature=""), "no json")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "id int, headers map<string,string>, body string, nonce string")
    check = lambda provider, payload, sig: F.when(sig != "?", (sig == "good") & F.contains(payload, F.lit('"request_nonce":"n"')))
    got = {r.id: r.status for r in signatures.verify(df, ("known",), check, expected="known").collect()}
    assert got == {0: "unsigned", 1: "unsigned", 2: "verified", 3: "verified", 4: "hash_mismatch", 5: "unknown_provider", 6: "signature_invalid", 7: "verification_error", 8: "verified", 9: "unsigned"}
    plain = {r.id: (r.status, r.tampered) for r in signatures.verify(df).collect()}
    assert plain[0] == ("unsigned", False) and plain[4] == ("unknown_provider", False)


def test_written_chain_verifies_in_any_partitions(spark):
    rows = [(i % 3 if i % 7 else None, i, None if i == 20 else f"e{i}", i * 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "log int, seq int, entry string, x double").repartition(5)
    chain = integrity.write_chain(df, b"k", "log")
    assert chain.count() == 200 and integrity.verify_chain(chain, b"k", "log").where("broken").count() == 0
    before, want = "GENESIS", {}
    for log, seq, entry, _ in rows:
        if log == 1:
            before = want[seq] = hmac.new(b"k", f"{before}:{entry}".encode(), "sha256").hexdigest()
    assert {r.seq: r.chain for r in chain.where("log = 1").collect()} == want
    bad = integrity.verify_chain(chain.where("seq <> 100").withColumn("entry", F.when(F.col("seq") == 50, "z").otherwise(F.col("entry"))), b"k", "log")
    assert sorted((r.seq, r.reason) for r in bad.where("broken").collect()) == [(50, "hash"), (103, "link")]


def test_fragments(spark):
    now = datetime(2024, 1, 1, 12)
    mac = hmac.new(b"k", b"t", "sha256").hexdigest()
    rows = [(1, datetime(2024, 1, 1, 11), "t", mac), (2, datetime(2024, 1, 1, 11, 1), "t", mac), (3, now, "t", "0"), (4, now, "t", None), (5, now, "t", ""), (6, None, "t", mac)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, text string, sig string")
    assert sorted(r.id for r in integrity.recent_fragments(df, b"k", F.lit(now)).collect()) == [2, 4, 5]


def test_outputs_and_endpoints(spark):
    given = ["plain", '"a \\"b\\""', '{"stdout": "out", "content": "c"}', '{"content": "c"}', '{"content": [{"text": "a"}, {"type": "x"}, {"text": "b"}]}', '{"other": 1}', None, "", "{broken"]
    assert column(spark, given, nested.output_text) == ["plain", 'a "b"', "out", "c", "a\n\nb", '{"other": 1}', "", "", "{broken"]
    assert column(spark, ["http://[::1]:8/x", "HTTPS://API.openai.com/v1", "a.b.openai.azure.com", "lite-llm.corp:4000", "10.0.0.1", None, ""], pr.endpoint) == ["local", "first_party", "unknown_router", "known_router", "unknown_router", "unknown", "unknown"]
    assert column(spark, ["mcp__Memory__save", "notebook_edit", "concatenate", "", None, "Task"], pr.shared_kind) == ["MEMORY", "WRITE", "READ", "UNKNOWN", "UNKNOWN", "OTHER"]
    found = records.active_endpoints(spark, {"OPENAI_BASE_URL": "https://api.openai.com/v1", "API_BASE_URL": "", "OTHER": "http://x"}).collect()
    assert [tuple(r) for r in found] == [("OPENAI_BASE_URL", "https://api.openai.com/v1", "api.openai.com", "first_party", True)]


def test_chunks_equal_loop(spark):
    texts = ["", "short", "A sentence that is long enough to be kept. " * 20, "no end " * 60, "One is here to stay for a while!\nTwo? Three goes on and on and on and on.\n" * 3 + "tail", "é" * 450 + ". " + "b" * 600 + "!"]

    def want(t):
        out = [t[i : i + 200].strip() for i in range(0, len(t), 80)]
        out = [c for c in out if len(c) > 30]
        s = re.findall(r"[^.!?\n]+[.!?\n]+", t)
        out += [c for c in [x.strip() for x in s] + [" ".join(s[i : i + 3]).strip() for i in range(len(s) - 1)] if 30 < len(c) < 500]
        return list(dict.fromkeys(out))

    assert column(spark, texts, tx.chunks) == [want(t) for t in texts]
    assert column(spark, texts, tx.analysis_chunks) == [[c for c in [t[i : i + 300].strip() for i in range(0, len(t), 150)] if len(c) > 30] for t in texts]


def test_records(spark):
    now = datetime(2024, 1, 1)
    seen = spark.createDataFrame([(7, "pre-write", json.dumps(["a:b", "c"]), 9), (8, "h", None, 0)], "id long, hook string, findings string, max_severity long")
    named = spark.createDataFrame([(now, 7, "n"), (now, 9, None), (now, 8, "")], "ts timestamp, detection_id long, notes string")
    got = sorted((r.detection_id, r.detector, r.severity, r.user_action, r.notes) for r in records.false_positives(seen, named).collect())
    assert got == [(7, "a:b", 9, "manual", "n"), (8, None, None, "manual", None)]
    missed = records.verdicts(named, "false_negative").first()
    assert missed.detection_id is None and missed.user_action == "report" and missed.detector is None
    audit = records.memory_audit(spark.createDataFrame([(now, "s", False, 0.5, None, "x" * 300)], "ts timestamp, source string, passed boolean, risk_score double, flags array<string>, text string")).first()
    assert len(audit.content_preview) == 200 and audit.passed == 0 and audit.flags == "[]"
    made = records.rule_tests(spark.createDataFrame([("r", None, "regex", "{}")], "name string, description string, rule_type string, rule_config string"), F.lit(now)).first()
    assert (made.status, made.description) == ("shadow", "")
    seeds = spark.range(50)
    assert records.sampled(seeds, 5, 3).collect() == records.sampled(seeds, 5, 3).collect() and records.sampled(seeds, 5, 3).count() == 5


def test_disagreement_edges(spark):
    seeds = spark.createDataFrame([(i, f"ignore all previous instructions number {i}", [float(i == j) for j in range(6)]) for i in range(6)], "seed_id int, text string, vector array<double>")
    rows = spark.createDataFrame([(0, "ignore all previous instructions number 3", [0.0] * 6), (1, None, [1.0] + [0.0] * 5), (2, "text", None)], "id int, text string, vector array<double>")
    got = {r.id: r for r in vectors.disagreement(rows, seeds).collect()}
    assert got[0].by_trigrams == 1.0 and got[0].by_vector == 0.0 and got[0].suspicious
    assert got[1].by_trigrams == 0.0 and got[1].by_vector == 1.0 and got[2].score == 0.0 and not got[2].suspicious
    assert vectors.disagreement(rows, seeds.limit(0)).agg(F.max("score")).first()[0] == 0.0
