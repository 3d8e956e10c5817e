"""Text detectors: rules and scores per row. Each is an expression over the row, so a scan is one pass without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules, text as tx
from palisade.functions.numbers import clamp, entropy, jaccard
from palisade.functions.patterns import any_gate, fold, gate
from palisade.functions.rules import js
from palisade.functions.rules_languages import LANGUAGES


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---------------------------------------------------------------- rules
FINDING = "array<struct<detector:string,severity:int,count:int>>"


def occurs(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern occurs; low: the text in lower case. It is searched for only where low holds what its matches need."""
    found, may = text.rlike(js(pattern)), gate(low, pattern)
    return found if may is None else may & found


def with_case(text: Column, low: Column, use) -> Column:
    """use(text, low), each computed once and outside the function, so that text may come from an Arrow function."""
    return let(F.struct(text.alias("t"), low.alias("l")), lambda s: use(s["t"], s["l"]))


def injection_findings(text: Column) -> Column:
    """An array of (detector, severity, count): one for each pattern that occurs."""

    def of(text: Column, low: Column) -> Column:
        one = lambda c, s, p: F.struct(F.lit(f"injection:{c}").alias("detector"), F.lit(s).alias("severity"), F.regexp_count(text, F.lit(js(p))).alias("count"))
        return F.array_compact(F.array(*[F.when(occurs(text, low, p), one(c, s, p)) for c, (s, ps) in rules.INJECTION.items() for p in ps]))

    return with_case(text, F.lower(text), of)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [text.rlike(js(p)).cast("int") for p in patterns])


def worst(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["severity"])), F.lit(0))


def comment_findings(text: Column) -> Column:
    """Comments that hold an injection, and their severity."""
    any_of = "|".join(f"(?:{js(p)})" for _, ps in rules.INJECTION.values() for p in ps)
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"<!--[\s\S]*?-->"), F.lit(0)), lambda c: c.rlike(any_of)))


def named(text: Column, table: dict[str, tuple[int, str]], prefix: str) -> Column:
    """Findings of a table of named patterns, one each."""
    one = lambda name, s: F.struct(F.lit(f"{prefix}:{name}").alias("detector"), F.lit(s).alias("severity"), F.lit(1).alias("count"))
    return with_case(text, F.lower(text), lambda text, low: F.array_compact(F.array(*[F.when(occurs(text, low, p), one(name, s)) for name, (s, p) in table.items()])))


def command_findings(command: Column) -> Column:
    """Commands that carry data out; a new git remote counts unless its host is a usual one."""
    host = F.lower(F.regexp_extract(command, js(rules.GIT_REMOTE), 1))
    git = F.when((host != "") & ~host.isin(*rules.GIT_HOSTS), F.array(F.struct(F.lit("command_exfil:git_exfiltration").alias("detector"), F.lit(8).alias("severity"), F.lit(1).alias("count")))).otherwise(F.array().cast(FINDING))
    return F.concat(named(command, rules.COMMAND_EXFIL, "command_exfil"), git)


def bash_findings(command: Column) -> Column:
    """Commands that are refused; give it plain_command_column's text to see through disguises."""
    wrapped = F.when(command.rlike(js(r"\beval\b")), F.array(F.struct(F.lit("bash_guard:eval_execution").alias("detector"), F.lit(8).alias("severity"), F.lit(1).alias("count")))).otherwise(F.array().cast(FINDING))
    substituted = F.when(command.rlike(r"<\(\s*(?:curl|wget)"), F.array(F.struct(F.lit("bash_guard:process_substitution").alias("detector"), F.lit(8).alias("severity"), F.lit(1).alias("count")))).otherwise(F.array().cast(FINDING))
    return F.concat(named(command, rules.BASH_GUARD, "bash_guard"), wrapped, substituted)


def language_findings(text: Column) -> Column:
    """An array of (language, count): patterns that occur, by language."""

    def of(text: Column, folded: Column) -> Column:
        n = lambda ps: sum((occurs(text, folded, "(?iu)" + p).cast("int") for p in ps[1:]), occurs(text, folded, "(?iu)" + ps[0]).cast("int"))
        may = any_gate(folded, ["(?iu)" + p for ps in LANGUAGES.values() for p in ps])
        each = F.array(*[F.struct(F.lit(k).alias("language"), n(ps).alias("count")) for k, ps in LANGUAGES.items()])
        return F.filter(F.when(may, each).otherwise(F.array().cast("array<struct<language:string,count:int>>")), lambda x: x["count"] > 0)

    return with_case(text, fold(text), of)


def few_shot_hits(text: Column) -> Column:
    """Demonstrations of obedience: how many stand in a text."""
    return sum((F.regexp_count(text, F.lit(js(p))) for p in rules.FEW_SHOT[1:]), F.regexp_count(text, F.lit(js(rules.FEW_SHOT[0]))))


def dense_windows(text: Column, size: int = 500, bits: float = 5.5, most: int = 3) -> Column:
    """Offsets of windows whose characters hold more than `bits` of entropy; the first `most`."""
    starts = F.when(F.length(text) > size, F.sequence(F.lit(0), F.length(text) - size - 1, F.lit(size // 2))).otherwise(F.array().cast("array<int>"))
    own = lambda i: entropy(F.transform(counts(F.split(F.substring(text, i + 1, F.lit(size)), "")), lambda c: c.cast("double")), F.lit(float(size)))
    return F.slice(F.filter(starts, lambda i: own(i) > bits), 1, most)


def seed_kind(seed: Column) -> Column:
    out = F.lit("default")
    for kind, pattern in reversed(rules.SEED_KINDS):
        out = F.when(F.lower(seed).rlike(pattern), kind).otherwise(out)
    return out


def hidden_findings(html: Column) -> Column:
    """How many elements that aren't shown hold an injection."""
    any_of = "|".join(f"(?:{js(p)})" for _, ps in rules.INJECTION.values() for p in ps)
    return F.size(F.filter(F.regexp_extract_all(html, F.lit(js(rules.HIDDEN_STYLE)), F.lit(1)), lambda x: x.rlike(any_of)))


def decoded_texts(text: Column, depth: int = 3) -> Column:
    """What base64, hex, percent, UTF-7 and quoted-printable runs decode to in six characters or more, each as often as it occurs,
    and what those hold in turn, to a depth; the text in ROT13 comes last."""
    none = F.array().cast("array<string>")
    #: A decoder, and what a text must hold for it.
    decoders = ((tx.base64_runs, lambda t: t.rlike("[A-Za-z0-9+/]{16}")), (tx.hex_runs, lambda t: t.rlike("[0-9a-fA-F]{20}")), (tx.percent_runs, lambda t: F.contains(t, F.lit("%"))), (tx.utf7_payloads, lambda t: F.contains(t, F.lit("+"))), (tx.quoted_printable_payloads, lambda t: F.contains(t, F.lit("="))))
    one_level = lambda level: F.filter(F.flatten(F.transform(level, lambda t: F.concat(*[F.when(may(t), decode(t)).otherwise(none) for decode, may in decoders]))), lambda d: F.length(d) >= 6)

    def deeper(level: Column, left: int) -> Column:
        # A level is made once, however many deeper ones read it.
        return let(one_level(level), lambda own: F.when(F.size(own) > 0, F.concat(own, deeper(own, left - 1))).otherwise(none)) if left else none

    return F.concat(deeper(F.array(text), depth), F.array(tx.rot13(text)))


def encoded_findings(text: Column) -> Column:
    """Injections within decoded texts, of severity 9 each."""
    found = F.flatten(F.transform(decoded_texts(text), injection_findings))
    return F.transform(found, lambda f: F.struct(F.regexp_replace(f["detector"], "^", "encoded_").alias("detector"), F.lit(9).alias("severity"), f["count"].alias("count")))


def decision(severity: Column, modifier: int = 0) -> Column:
    return F.when(severity >= 9 + modifier, "block").when(severity >= 7 + modifier, "sanitize").when(severity > 0, "warn").otherwise("pass")


def seen(text: Column) -> Column:
    """A text as a reader sees it; only odd ones leave the JVM."""
    odd = text.rlike(r"[^\x20-\x7E\n\r\t]|[&\\]")
    return F.coalesce(tx.preprocess(F.when(odd, text)), text)


def scan(docs: DataFrame, text: str = "text", normalise: bool = True) -> DataFrame:
    """docs with findings, severity and decision. Texts of plain ASCII without references or escapes are normal as they are:
    the Arrow function gets a null in their place."""
    if normalise:
        docs = docs.withColumn("__seen", seen(F.col(text)))
    else:
        docs = docs.withColumn("__seen", F.col(text))
    out = docs.withColumn("findings", injection_findings(F.col("__seen"))).drop("__seen")
    return out.withColumn("severity", worst(F.col("findings"))).withColumn("decision", decision(F.col("severity")))


def url_verdict(url: Column) -> Column:
    """Why a URL is refused; the empty string if it is allowed. The first reason stands."""
    low = F.lower(url)
    back = F.reverse(low)
    known = reduce(lambda a, b: a | b, [F.contains(low, F.lit(d)) | F.contains(low, F.lit(d[::-1])) | F.contains(back, F.lit(d)) for d in rules.BLOCKED_DOMAINS])
    any_of = lambda ps: reduce(lambda a, b: a | b, [low.rlike(js(p)) for p in ps])
    return F.when(low.startswith("data:"), "data_uri").when(known, "blocked_domain").when(any_of(rules.SSRF), "ssrf").when(any_of(rules.ODD_ADDRESS), "odd_address").when(any_of(rules.TUNNELS), "tunnel").otherwise("")


def memory_risk(text: Column, source: Column | None = None, confidence: Column | None = None, agent: Column | None = None) -> Column:
    """Risk of writing a text to memory, three decimals."""
    found = F.size(injection_findings(text)) + reduce(lambda a, b: a + b, [text.rlike(js(p)).cast("int") for _, p in rules.MEMORY])
    severity = F.greatest(worst(injection_findings(text)), *[F.when(text.rlike(js(p)), F.lit(s)).otherwise(F.lit(0)) for s, p in rules.MEMORY])
    risk = F.least(F.lit(1.0), severity / 10)
    risk = F.when(found > 1, F.least(F.lit(1.0), risk + 0.1 * (found - 1))).otherwise(risk)
    risk = risk + F.when(F.length(text) > 5000, 0.1).otherwise(0.0)
    if source is not None and confidence is not None and agent is not None:
        risk = risk + F.when((source == "forgetful") & (confidence < 0.5) & agent.isNull(), 0.15).otherwise(0.0)
    return F.round(risk, 3)


def knowledge_risk(text: Column, domain: Column, educational: tuple[str, ...] = ("cybersecurity", "security", "pentesting", "ctf", "red-team", "ai-safety", "adversarial-ml")) -> Column:
    """Risk of indexing a document, three decimals."""
    findings = injection_findings(text)
    found, severity = F.size(findings), worst(findings)
    risk = F.least(F.lit(1.0), severity / 10)
    risk = F.when(found > 2, F.least(F.lit(1.0), risk + 0.05 * (found - 2))).otherwise(risk)
    discount = domain.isin(*educational) & (severity < 9)
    return F.round(F.when(discount, F.greatest(risk * 0.7, risk - 0.15)).otherwise(risk), 3)


def post_flight(output: Column, context: Column) -> Column:
    """(score, verdict) of a model's output."""
    directives = longest_run(output)
    score = 9 * (hits(output, rules.LEAK) + (directives >= 3).cast("int")) + 7 * hits(output, rules.DRIFT) + 7 * hits(output, rules.ACKNOWLEDGE) + F.when(context.isin(*rules.SUMMARY_CONTEXTS), 5 * hits(output, rules.SUMMARY_ONLY)).otherwise(0)
    verdict = lambda s: F.when(s >= 12, "BLOCK").when(s >= 7, "REDACT").when(s >= 4, "WARN").otherwise("PASS")
    return let(score, lambda s: F.struct(s.cast("long").alias("score"), verdict(s).alias("verdict")))


def longest_run(output: Column) -> Column:
    """The most directive lines in a row; blank lines don't count."""
    lines = F.filter(F.transform(F.split(output, "\n"), F.trim), lambda s: s != "")
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, s: Column) -> Column:
        run = F.when(s.rlike(js(rules.DIRECTIVE_LINE)) & (F.length(s) < 250), a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return F.aggregate(lines, state, step, lambda a: a["most"])


def influence(text: Column, detectors: Column, context: Column) -> Column:
    """An array of (type, confidence, response), surest first."""
    out = []
    for kind, (response, hints, patterns) in rules.INFLUENCE.items():
        by_hint = reduce(lambda a, b: a + b, [hinted(detectors, h) for h in hints])
        by_text = hits(text, patterns)
        base = F.least(by_hint * 0.3, F.lit(0.6)) + F.least(by_text * 0.2, F.lit(0.4))
        sure = F.when(context.isin(*rules.RISKY_CONTEXTS), F.least(base + 0.15, F.lit(1.0))).otherwise(base)
        out.append(F.struct((-F.round(sure, 2)).alias("order"), F.lit(kind).alias("type"), F.when(by_hint + by_text > 0, F.round(sure, 2)).otherwise(0.0).alias("confidence"), F.lit(response).alias("response")))
    return F.array_sort(F.filter(F.array(*out), lambda x: x["confidence"] >= 0.15))


def hinted(detectors: Column, hint: str) -> Column:
    return F.exists(detectors, lambda d: F.contains(d, F.lit(hint)) | F.contains(F.lit(hint), d)).cast("int")


# ---------------------------------------------------------------- scores
def statistical_score(text: Column) -> Column:
    """How much a text addresses and orders a reader: densities of pronouns, modals, imperatives and terms, 1 at most."""

    def of(s: Column) -> Column:
        low, n, own = s["l"], F.size(s["w"]), s["s"]
        orders = F.size(F.filter(own, lambda x: x.rlike(rf"(?i)^ *(?:{rules.IMPERATIVE_FIRST})(?:\s|\z)")))
        density = F.when(F.size(own) > 0, orders / F.size(own)).otherwise(0.0)
        total = 8 * tx.count(low, rules.YOU, low) / n + 6 * tx.count(low, rules.MODALS, low) / n + 4 * density + 10 * tx.count(low, rules.ADDRESSING, low) / n
        return F.when(n < 20, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))

    return let(F.struct(F.lower(text).alias("l"), tx.words(text).alias("w"), tx.sentences(text).alias("s")), of)


def top_terms(text: Column, k: int = 8, lexicon: dict[str, float] | None = None) -> Column:
    """(weight, term) of the k terms of the lexicon that weigh most in a text; on ties by term."""
    lexicon = lexicon or rules.LEXICON
    known = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])

    def of(found: Column) -> Column:
        held = F.filter(found, lambda w: w.isin(*lexicon))
        weigh = lambda h: F.transform(F.array_distinct(h), lambda w: F.struct((-F.round(F.size(F.filter(h, lambda x: x == w)) / F.size(found) * F.element_at(known, w), 9)).alias("o"), w.alias("term")))
        return F.transform(F.slice(F.array_sort(let(held, weigh)), 1, k), lambda s: F.struct((-s["o"]).alias("weight"), s["term"].alias("term")))

    return let(tx.terms(text), of)


def tfidf_score(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Cosine of the text's weighted terms with the lexicon, by coverage; below five terms 0."""
    lexicon = lexicon or rules.LEXICON
    length = sum(w * w for w in lexicon.values()) ** 0.5
    known = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])

    def of(all_terms: Column) -> Column:
        n = F.size(all_terms)
        held = F.filter(all_terms, lambda w: w.isin(*lexicon))

        def score(h: Column) -> Column:
            distinct = F.sort_array(F.array_distinct(h))
            weights = F.transform(distinct, lambda w: F.struct((F.size(F.filter(h, lambda x: x == w)) / n).alias("tf"), F.element_at(known, w).alias("idf")))
            dot = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x["tf"] * x["idf"] * x["idf"])
            norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x["tf"] * x["idf"] * x["tf"] * x["idf"]))
            return F.when((n < 5) | (F.size(h) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), dot / (norm * length) * F.least(F.lit(1.0), F.size(distinct) / 15) * 2.2))

        return let(held, score)

    return let(tx.terms(text), of)


def counts(items: Column) -> Column:
    """How often each item of an array occurs, by sorting: n log n, however many differ."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(starts, lambda b: F.zip_with(b, F.slice(b, 2, 1 << 30), lambda x, y: F.coalesce(y, F.size(s) + 1) - x))

    return F.when(F.size(items) > 0, let(F.sort_array(items), of)).otherwise(F.array().cast("array<int>"))


def repeats(items: Column) -> Column:
    """(k, s): how many different items an array has, and the sum of c log2 c over their counts c; one fold over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("k"), F.lit(0.0).alias("s"))
    ended = lambda a: F.when(a["run"] > 1, a["s"] + a["run"] * F.log2(a["run"].cast("double"))).otherwise(a["s"])

    def step(a: Column, x: Column) -> Column:
        again = F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["k"].alias("k"), a["s"].alias("s"))
        return F.when(x == a["last"], again).otherwise(F.struct(x.alias("last"), F.lit(1).alias("run"), (a["k"] + 1).alias("k"), ended(a).alias("s")))

    return F.aggregate(F.sort_array(items), start, step, lambda a: F.struct(a["k"].alias("k"), ended(a).alias("s")))


def token_entropy(text: Column) -> Column:
    """(entropy, normalised, anomaly, ratio) of a text's words; below 15 words it is normal."""

    def of(w: Column) -> Column:
        def by(c: Column) -> Column:
            n, k = F.size(w), c["k"]
            e = F.when(n > 0, F.log2(n.cast("double")) - c["s"] / n).otherwise(0.0)
            norm = F.when(k > 1, e / F.log2(k.cast("double"))).otherwise(1.0)
            limit = 0.70 * F.least(F.lit(1.0), n / 80) + 0.15
            odd = ((norm < limit) & (n > 25)) | ((k / n < 0.45) & (n > 30))
            few = n < 15
            return F.struct(F.when(few, 0.0).otherwise(F.round(e, 4)).alias("entropy"), F.when(few, 1.0).otherwise(F.round(norm, 4)).alias("normalised"), (~few & odd).alias("anomaly"), F.when(few, 1.0).otherwise(F.round(k / n, 4)).alias("distinct"))

        return let(repeats(w), by)

    return let(tx.words(text, 2), of)


def signal(x: Column, low: float, width: float) -> Column:
    return clamp((x - low) / width, 0, 1)


def structural_score(text: Column) -> Column:
    """Divergence of vocabulary between halves, imperatives, brackets and authority marks, orders to the reader."""

    def of(s: Column) -> Column:
        w, own = s["w"], s["s"]
        n, half = F.size(w), F.floor(F.size(w) / 2).cast("int")
        divergence = 1 - jaccard(F.array_distinct(F.slice(w, F.lit(1), half)), F.array_distinct(F.slice(w, half + 1, F.greatest(n - half, F.lit(0)))))
        m = F.greatest(F.lit(1), F.size(own))
        orders = F.size(F.filter(own, lambda x: x.rlike(rules.STRUCTURAL_IMPERATIVE))) / m
        marks = (tx.count(s["t"], rules.BRACKETS) + 2 * tx.count(s["t"], rules.AUTHORITY, s["l"])) / m
        modal = (tx.count(s["l"], rules.YOU_MODAL, s["l"]) + tx.count(s["l"], rules.YOUR_ROLE, s["l"])) / m
        total = 0.20 * signal(divergence, 0.35, 0.35) + 0.30 * signal(orders, 0.15, 0.45) + 0.20 * signal(marks, 0.5, 2.0) + 0.30 * signal(modal, 0.0, 0.4)
        return F.when(n < 20, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))

    return let(F.struct(text.alias("t"), F.lower(text).alias("l"), tx.words(text, 2).alias("w"), tx.sentences(text).alias("s")), of)


def mutual_information(text: Column) -> Column:
    """How far vocabularies of targets, actions, authority and addressees meet in one text."""

    def of(w: Column) -> Column:
        shares = F.array_sort(F.array(*[F.round(F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in own]))) / len(own), 4) for own in rules.CLUSTERS.values()]), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))

        def score(a: Column) -> Column:
            two = F.get(a, F.lit(0)) * F.get(a, F.lit(1))
            three = two * F.get(a, F.lit(2))
            active = F.size(F.filter(a, lambda x: x >= 0.15))
            return 0.5 * F.least(F.lit(1.0), two / 0.06) + 0.3 * F.least(F.lit(1.0), three / 0.008) + F.when(active >= 3, 0.2).when(active >= 2, 0.1).otherwise(0.0)

        return F.when(F.size(w) < 10, F.lit(0.0)).otherwise(F.least(F.lit(1.0), let(shares, score)))

    return let(F.array_distinct(tx.words(text, 2)), of)


def offline_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the scores that need no model, and their composite."""
    t = F.col(text)
    out = docs.withColumns({"statistical": statistical_score(t), "tfidf": tfidf_score(t), "entropy": token_entropy(t), "structural": structural_score(t)})
    flags = (F.col("tfidf") > 0.25).cast("int") + F.col("entropy.anomaly").cast("int") + (F.col("structural") > 0.35).cast("int") + (F.col("statistical") > 0.3).cast("int")
    bonus = F.when(flags >= 4, 0.18).when(flags >= 3, 0.12).when(flags >= 2, 0.06).otherwise(0.0)
    base = 0.25 * F.col("tfidf") + F.when(F.col("entropy.anomaly"), 0.12).otherwise(0.0) + 0.25 * F.col("structural") + 0.20 * F.col("statistical")
    return out.withColumn("flags", flags).withColumn("composite", F.least(F.lit(1.0), base + bonus)).withColumn("injection", F.col("composite") > 0.35)
