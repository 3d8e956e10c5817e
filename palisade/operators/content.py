"""The scan of a text in its context: every stream of findings, with what matched, in one array a row.

Streams: injections, hidden comments and elements, style tricks, active elements, links, cloaking, invisible characters, PDF and
memory rules, commands that carry data out, paraphrases, faked system messages, orders in other languages, and all of these
orders within decoded texts. A row needs no other row, so a scan is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions import text as tx
from palisade.functions.patterns import any_gate, fold, required
from palisade.functions.rules import js
from palisade.functions.rules_languages import LANGUAGES
from palisade.operators import detectors as det
from palisade.operators.detectors import let, occurs

#: Contexts whose text may be a page.
PAGES = ("web_fetch", "email", "general", "file_read")
FINDING = "array<struct<detector:string,severity:int,count:int,matches:array<string>>>"
#: Matches that a finding carries, and characters of each.
MATCHES, CHARACTERS = 5, 100

#: (detector, severity, pattern, whether all places count) by the contexts that ask for them; None: all contexts. Fixed values.
STREAMS: dict[str, tuple[tuple[str, ...] | None, tuple[tuple[str, int, str, bool], ...]]] = {
    "injection": (None, tuple((f"injection:{c}", s, p, True) for c, (s, ps) in rules.INJECTION.items() for p in ps)),
    "dangerous_html": (PAGES, tuple(("dangerous_html", 7, "(?i)" + p, True) for p in rules.DANGEROUS_HTML)),
    "markdown_injection": (PAGES, tuple(("markdown_injection", 7, "(?i)" + p, True) for p in rules.MARKDOWN)),
    "cloaking": (PAGES, tuple(("cloaking", 6, p, True) for p in rules.CLOAKING)),
    "pdf_injection": (("pdf_read",), tuple(("pdf_injection", 6, "(?i)" + p, True) for p in rules.PDF)),
    "memory_poisoning": (("memory_write",), tuple((f"memory_poisoning:{'behavioral_override' if s == 8 else 'internal_reference'}", s, p, True) for s, p in rules.MEMORY)),
    "memory_security_concept": (("memory_write",), tuple((f"memory_security_concept:{n}", s, p, False) for n, (s, p) in rules.MEMORY_CONCEPTS.items())),
    "command_exfil": (None, tuple((f"command_exfil:{n}", s, p, False) for n, (s, p) in rules.COMMAND_EXFIL.items())),
    "semantic_injection": (None, tuple(("semantic_injection", 7, p, False) for p in rules.SEMANTIC)),
    "fake_system_context": (None, tuple(("fake_system_context", 8, p, False) for p in rules.FAKE_CONTEXT)),
}
#: Streams that read decoded texts too, one step more severe there; injections, which have no severity of their own yet, get 9.
DECODED = ("injection", "semantic_injection", "fake_system_context")
ANY_INJECTION = "|".join(f"(?:{js(p)})" for _, ps in rules.INJECTION.values() for p in ps)


def finding(detector: str | Column, severity: int | Column, count: Column, matches: Column) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    cut = F.transform(F.slice(matches, 1, MATCHES), lambda m: F.left(m, F.lit(CHARACTERS)))
    return F.struct(lit(detector, "string").alias("detector"), lit(severity, "int").alias("severity"), count.cast("int").alias("count"), cut.alias("matches"))


def matched(text: Column, low: Column, rule: tuple[str, int, str, bool]) -> Column:
    """The finding of one rule, or null."""
    detector, severity, pattern, every = rule
    if every:
        found = let(F.regexp_extract_all(text, F.lit(js(pattern)), F.lit(0)), lambda m: finding(detector, severity, F.size(m), m))
    else:
        found = finding(detector, severity, F.lit(1), F.array(F.regexp_extract(text, js(pattern), 0)))
    return F.when(occurs(text, low, pattern), found)


def where_any(low: Column, patterns: list[str], found: Column) -> Column:
    """found, worked out only where the text holds what one of the patterns needs."""
    may = any_gate(low, patterns) if len(patterns) > 30 else None
    return found if may is None else F.when(may, found).otherwise(F.array().cast(FINDING))


def stream(text: Column, low: Column, name: str) -> Column:
    own = STREAMS[name][1]
    return where_any(low, [r[2] for r in own], F.array_compact(F.array(*[matched(text, low, r) for r in own])))


def git_exfil(text: Column) -> Column:
    host = F.lower(F.regexp_extract(text, js(rules.GIT_REMOTE), 1))
    found = finding("command_exfil:git_exfiltration", 8, F.lit(1), F.array(F.regexp_extract(text, js(rules.GIT_REMOTE), 0)))
    # The rule looks ahead at the start of the host's name.
    usual = reduce(lambda a, b: a | b, [host.startswith(h) for h in rules.GIT_HOSTS])
    return F.when((host != "") & ~usual, found)


def comments(text: Column) -> Column:
    bad = F.filter(F.regexp_extract_all(text, F.lit(r"<!--[\s\S]*?-->"), F.lit(0)), lambda c: c.rlike(ANY_INJECTION))
    return F.when(F.contains(text, F.lit("<!--")), let(bad, lambda b: F.when(F.size(b) > 0, finding("html_comment_injection", F.least(F.lit(9), 5 + F.size(b)), F.size(b), F.slice(b, 1, 3)))))


def hidden(text: Column) -> Column:
    """Elements whose style hides them and that hold an injection; one that is hidden in two ways counts twice."""
    each = [F.size(F.filter(F.regexp_extract_all(text, F.lit(js(rf"""(?i)style\s*=\s*["'][^"']*{p}[^"']*["'][^>]*>[^<]*""")), F.lit(0)), lambda m: m.rlike(ANY_INJECTION))) for p in rules.CSS_HIDING]
    count = reduce(lambda a, b: a + b, each)
    note = lambda n: F.array(F.concat(n.cast("string"), F.lit(" hidden element(s) with suspicious content")))
    return F.when(text.rlike(r"(?i)style\s*="), let(count, lambda n: F.when(n > 0, finding("css_hidden_content", F.least(F.lit(9), 6 + n), n, note(n)))))


def style_tricks(original: Column, low: Column) -> Column:
    out = []
    for name, (severity, pattern) in rules.CSS_TRICKS.items():
        n = F.lit(1) if name == "css_fontface_remap" else F.regexp_count(original, F.lit(js(pattern)))
        out.append(F.when(occurs(original, low, pattern), finding(name, severity, n, F.array(F.regexp_extract(original, js(pattern), 0)))))
    return F.array_compact(F.array(*out))


def invisible(original: Column) -> Column:
    n = F.regexp_count(original, F.lit(rules.INVISIBLE))
    bidi = F.regexp_count(original, F.lit(r"[\x{2066}-\x{2069}\x{202A}-\x{202E}]"))
    note = F.array(F.concat((n - bidi).cast("string"), F.lit(" zero-width chars, "), bidi.cast("string"), F.lit(" bidi overrides")))
    return F.when(n > 0, finding("invisible_unicode", F.least(F.lit(8), 3 + n), n, note))


def foreign(text: Column) -> Column:
    """Orders in other languages."""

    def of(text: Column, folded: Column) -> Column:
        patterns = ["(?iu)" + p for ps in LANGUAGES.values() for p in ps]
        one = lambda p: finding("multilingual_injection", 8, F.lit(1), F.array(F.regexp_extract(text, p, 0)))
        each = lambda own: F.array_compact(F.array(*[F.when(occurs(text, folded, p), one(p)) for p in own]))
        # Most texts hold the short literals of a few patterns; those aren't asked for together with the others.
        rare = [p for p in patterns if min(len(x.encode()) for x in required(p)[0]) > 3]
        return F.concat(where_any(folded, rare, each(rare)), each([p for p in patterns if p not in rare]))

    return det.with_case(text, fold(text), of)


def encoded(text: Column) -> Column:
    """Findings of decoded texts."""

    def raised(name: str) -> Callable[[Column], Column]:
        def one(f: Column) -> Column:
            detector = F.concat(F.lit("encoded_"), f["detector"]) if name == "injection" else f["detector"]
            severity = F.lit(9) if name == "injection" else F.least(F.lit(10), f["severity"] + 1)
            return F.struct(detector.alias("detector"), severity.alias("severity"), f["count"].alias("count"), f["matches"].alias("matches"))

        return one

    def of(t: Column) -> Column:
        return let(F.lower(t), lambda low: F.concat(*[F.transform(stream(t, low, name), raised(name)) for name in DECODED]))

    return F.flatten(F.transform(F.filter(det.decoded_texts(text), lambda d: d != text), of))


def content_findings(original: Column, text: Column, context: Column, decode: bool = True) -> Column:
    """All findings: text is what original looks like to a reader."""

    def of(s: Column) -> Column:
        o, t, low, olow, c = s["o"], s["t"], s["low"], s["olow"], s["c"]
        none, pages = F.array().cast(FINDING), c.isin(*PAGES)
        parts = []
        for name, (contexts, _) in STREAMS.items():
            found = stream(t, low, name)
            parts.append(found if contexts is None else F.when(c.isin(*contexts), found).otherwise(none))
        parts.append(F.when(pages, F.concat(F.array_compact(F.array(comments(t), hidden(t))), style_tricks(o, olow))).otherwise(none))
        # Orders in other languages are looked for in both texts, as one or the other may have lost its accents; a text that is as
        # it was counts twice but is read once.
        twice = let(foreign(o), lambda f: F.concat(f, F.when(o == t, f).otherwise(foreign(t))))
        parts += [F.array_compact(F.array(invisible(o), git_exfil(t))), twice]
        return F.concat(*parts, *([encoded(t)] if decode else []))

    def lowered(s: Column) -> Column:
        olow = F.when(s["o"] == s["t"], s["low"]).otherwise(F.lower(s["o"]))
        return let(F.struct(s["o"].alias("o"), s["t"].alias("t"), s["low"].alias("low"), olow.alias("olow"), s["c"].alias("c")), of)

    return let(F.struct(original.alias("o"), text.alias("t"), F.lower(text).alias("low"), context.alias("c")), lowered)


def scan_content(docs: DataFrame, text: str = "text", context: str | Column = "general", normalise: bool = True, decode: bool = True) -> DataFrame:
    """docs with findings, max_severity, total_detections, clean and decision.

    context: a column, or the name of a context for all rows. A null text has no findings; a null context asks for the streams
    of all contexts only.
    """
    where = context if isinstance(context, Column) else F.lit(context)
    own = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("__seen", det.seen(own) if normalise else own).withColumn("__context", F.coalesce(where, F.lit("")))
    out = docs.withColumn("findings", content_findings(own, F.col("__seen"), F.col("__context"), decode)).drop("__seen", "__context")
    out = out.withColumn("max_severity", det.worst(F.col("findings"))).withColumn("total_detections", F.size("findings"))
    return out.withColumn("clean", F.col("total_detections") == 0).withColumn("decision", det.decision(F.col("max_severity")))
