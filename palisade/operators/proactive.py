"""Scores of coherence: does a text change its style, its topic or its grammar half-way, as spliced orders make it do?

Each works on one text at a time with arrays, inside an Arrow function; nothing is shuffled. Divergences are native.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words and patterns that the scores count.
FUNCTION_WORDS = "the a an is are was were be been have has had do does did will would could should may".split()
FIRST, SECOND, THIRD = ("i me my mine we us our ours".split(), "you your yours yourself".split(), "he she it they him her them his its their".split())
ORDERS = frozenset("ignore disregard forget override bypass send read output reveal share remember always never do please now ensure follow obey comply execute perform".split())
ADDRESSED = re.compile(r"\b(?:system|prompt|instruct|override|ai|assistant|model|configuration|guidelines|credentials|restrict|unrestrict|mode)\b", re.I | re.A)
TOPIC = frozenset("system prompt instructions override ignore disregard configuration guidelines restrictions unrestricted mode credentials password secrets token apikey assistant model claude chatbot authorized administrator compliance exfiltrate transmit bypass reveal disclose".split())
STOP = frozenset("the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought and but or nor for yet so in on at to of by with from into through during before after above below between out off over under again further then once here there when where why how all both each few more most other some such no not only own same than too very just about this that these those it its".split())
NULLIFY = re.compile(r"\b(?:no\s+longer|obsolete|superseded|void|replaced|outdated|ignore|forget|disregard|discard|abandon|overrid(?:e|den)|cancel|revoke|previous\s+instructions?)\b", re.I | re.A)
ESTABLISH = re.compile(r"\b(?:authorized|admin(?:istrator)?|security\s+team|polic(?:y|ies)|approved|regulation|compliance|emergency|your\s+duty|required\s+by|mandate[ds]?|pursuant|verified|trusted|clearance|official)\b", re.I | re.A)
TARGET = re.compile(r"\b(?:prompt|config(?:uration)?|credentials?|\.env|instructions?|keys?|secrets?|password|token|authorization)\b", re.I | re.A)
COMMAND = re.compile(r"(?:^|[.;,]\s*|\band\s+|\b(?:please|now|immediately|kindly|just|then)\s+)(?:reveal|show|display|output|send|share|transmit|forward|upload|dump|exfiltrate|extract|provide|give|relay|read|print)\b", re.I | re.A)


def style(words: list[str]) -> tuple[np.ndarray, float, float, float] | None:
    """(distribution, second-person share, imperative share, mean word length) of a segment; None below ten words."""
    if len(words) < 10:
        return None
    text = " ".join(words)
    low = [w.lower() for w in words]
    bare = Counter(re.findall(r"[a-z]+", text.lower()))
    sentences = [s.split() for s in re.split(r"[.!?\n]+", text) if len(s.strip()) > 3] or [[]]
    lengths = np.array([len(s) for s in sentences], float)
    persons = [sum(bare[w] for w in own) for own in (FIRST, SECOND, THIRD)]
    second = persons[1] / max(1, sum(persons))
    orders = sum(bool(s) and s[0].lower() in ORDERS for s in sentences) / max(1, len(sentences))
    letters = float(np.mean([len(w) for w in low]))
    marks = len(re.findall(r'[,;:!?()"-]', text)) / len(words)
    v = np.array([second, orders, letters / 10, marks, lengths.mean() / 30, lengths.std() / 15, *[bare[w] / len(words) for w in FUNCTION_WORDS]])
    return v / (v.sum() or 1.0), second, orders, letters


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon, in bits."""
    m = (p + q) / 2
    part = lambda a: float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return (part(p) + part(q)) / 2


def stylometric(text: str) -> float:
    """How sharply style breaks between neighbouring segments, where the later one addresses a model."""
    words = text.split()
    if len(words) < 75:
        return 0.0
    n = min(8, max(3, len(words) // 25))
    size = len(words) // n
    parts = [words[k * size : (k + 1) * size if k < n - 1 else None] for k in range(n)]
    found = [(style(p), p) for p in parts]
    found = [(s, p) for s, p in found if s is not None]
    jumps, fractures = [0.0], 0
    for (a, _), (b, later) in zip(found, found[1:], strict=False):
        d = divergence(a[0], b[0])
        jumps.append(d)
        shift = abs(a[1] - b[1]) > 0.25 or abs(a[2] - b[2]) > 0.15 or abs(a[3] - b[3]) > 1.5
        fractures += d > 0.20 and shift and bool(ADDRESSED.search(" ".join(later)))
    return min(1.0, 0.8 * min(1.0, max(0.0, (max(jumps) - 0.15) / 0.25)) + 0.2 * (fractures > 1)) if fractures else 0.0


def temporal(text: str) -> float:
    """Spikes of a vocabulary of orders in sliding windows, and ruptures of topic between neighbours."""
    words = [w for w in text.lower().split() if len(w) > 2]
    if len(words) < 90:
        return 0.0
    starts = range(0, len(words) - 29, 15)
    topics = [{w for w in words[s : s + 30] if len(w) > 3 and w not in STOP} for s in starts]
    hits = np.array([sum(w in TOPIC for w in words[s : s + 30]) for s in starts])
    if len(topics) < 3:
        return 0.0
    gaps = np.array([1 - len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(topics, topics[1:], strict=False)])
    spike = min(1.0, hits.max() / 3) if (hits >= 2).any() and (hits == 0).any() else 0.0
    rupture = min(1.0, max(0.0, (gaps.max() - 0.8) / 0.15))
    return float(min(1.0, 0.55 * spike + 0.25 * rupture + 0.10 * min(1.0, gaps.var() / 0.03) + 0.1 * (gaps > 0.85).any()))


def grammar(text: str) -> float:
    """Sequences of sentences that nullify, establish authority and command."""
    sentences = [s for s in re.split(r"(?<=[.!?\n])\s+|\n\s*\n", text) if len(s.strip()) > 5]
    if len(sentences) < 2:
        return 0.0
    n = np.array([bool(NULLIFY.search(s)) for s in sentences])
    e = np.array([bool(ESTABLISH.search(s)) for s in sentences])
    c = np.array([bool(COMMAND.search(s)) and bool(TARGET.search(s)) for s in sentences])
    ahead = lambda flags, i, far: next((j for j in range(i + 1, min(i + far + 1, len(sentences))) if flags[j]), None)
    gaps, full = [], False
    for i in range(len(sentences)):
        if n[i]:
            gaps += [0] if c[i] else []
            j = ahead(c | e, i, 5)
            if j is not None and c[j]:
                gaps.append(j - i)
            elif j is not None and (k := ahead(c, j, 4)) is not None:
                gaps.append(k - i)
                full = True
        elif e[i] and (j := ahead(c, i, 4)) is not None:
            gaps.append(j - i)
    if not gaps:
        return 0.0
    tight = {0: 1.0, 1: 1.0, 2: 0.7, 3: 0.5}.get(min(gaps), 0.3)
    return min(1.0, 0.6 * tight + 0.2 * full + (0.15 if len(gaps) >= 3 else 0.08 if len(gaps) >= 2 else 0.0) + 0.1)


def arrow_scores(f: Callable[[str], float]):  # noqa: ANN201
    """f over batches of texts, as an Arrow function; null counts as empty."""

    def batch(s: pd.Series) -> pd.Series:
        return s.fillna("").map(f).astype(float)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, DoubleType())


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with stylometric, temporal, grammar and their composite; texts of fewer than 80 characters score 0 unseen."""
    t = F.col(text)
    seen = F.when(F.length(t) >= 80, t)
    out = docs.withColumns({"stylometric": arrow_scores(stylometric)(seen), "temporal": arrow_scores(temporal)(seen), "grammar": arrow_scores(grammar)(seen)})
    flags = (F.col("stylometric") > 0.35).cast("int") + (F.col("temporal") > 0.30).cast("int") + (F.col("grammar") > 0.35).cast("int")
    base = (0.20 * F.col("stylometric") + 0.20 * F.col("temporal") + 0.15 * F.col("grammar")) / 0.55
    return out.withColumn("proactive", F.least(F.lit(1.0), base + F.when(flags >= 3, 0.15).when(flags >= 2, 0.08).otherwise(0.0)))


# ---------------------------------------------------------------- native divergences
def shingle_counts(text: Column, n: int) -> Column:
    """(gram, count) of the n-character grams of a text, in lower case with single spaces."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")

    def of(s: Column) -> Column:
        grams = F.when(F.length(s) >= n, F.array_sort(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

        def counted(g: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(g), F.lit(1))), lambda i: (i <= F.size(g)) & ((i == 1) | (F.get(g, i - 1) != F.get(g, i - 2))))
            return F.element_at(F.transform(F.array(starts), lambda b: F.zip_with(b, F.slice(b, 2, 1 << 30), lambda x, y: F.struct(F.get(g, x - 1).alias("gram"), (F.coalesce(y, F.size(g) + 1) - x).cast("double").alias("n")))), 1)

        return F.element_at(F.transform(F.array(grams), counted), 1)

    return F.element_at(F.transform(F.array(low), of), 1)


def bigram_divergence(a: Column, b: Column) -> Column:
    """1 less the Dice coefficient of two texts' bigrams, counted as often as they occur."""

    def of(s: Column) -> Column:
        x, y = F.map_from_entries(s["x"]), s["y"]
        both = F.element_at(F.transform(F.array(x), lambda m: F.aggregate(y, F.lit(0.0), lambda acc, g: acc + F.least(g["n"], F.coalesce(F.try_element_at(m, g["gram"]), F.lit(0.0))))), 1)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, g: acc + g["n"])
        return F.when((F.size(s["x"]) == 0) | (F.size(y) == 0), 1.0).otherwise(1 - 2 * both / (total(s["x"]) + total(y)))

    return F.element_at(F.transform(F.array(F.struct(shingle_counts(a, 2).alias("x"), shingle_counts(b, 2).alias("y"))), of), 1)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Of two arrays of shares, in bits; 1 where their lengths differ."""
    half = lambda a, m: F.aggregate(F.zip_with(a, m, lambda x, y: F.when((x > 0) & (y > 0), x * F.log2(x / y)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    mean = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.when(F.size(p) != F.size(q), 1.0).otherwise((half(p, mean) + half(q, mean)) / 2)


def offline_full(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all scores that need no model and their composite: detectors.offline_scores, with vocabularies' meeting and the
    coherence scores added for texts of 80 characters or more."""
    from palisade.operators.detectors import mutual_information, offline_scores

    out = scores(offline_scores(docs, text).drop("composite", "injection"), text)
    long = F.length(text) >= 80
    out = out.withColumn("mutual", F.when(long, mutual_information(F.col(text))).otherwise(0.0))
    flags = F.col("flags") + (F.col("mutual") > 0.35).cast("int") + (F.col("stylometric") > 0.35).cast("int") + (F.col("temporal") > 0.30).cast("int") + (F.col("grammar") > 0.35).cast("int")
    base = 0.25 * F.col("tfidf") + F.when(F.col("entropy.anomaly"), 0.12).otherwise(0.0) + 0.25 * F.col("structural") + 0.20 * F.col("statistical") + 0.10 * F.col("mutual") + 0.03 * F.col("stylometric") + 0.03 * F.col("temporal") + 0.06 * F.col("grammar")
    bonus = F.when(F.col("flags") >= 4, 0.18).when(F.col("flags") >= 3, 0.12).when(F.col("flags") >= 2, 0.06).otherwise(0.0)
    out = out.withColumn("flags", flags).withColumn("composite", F.least(F.lit(1.0), base + bonus))
    return out.withColumn("injection", F.col("composite") > 0.35)


def cascade(docs: DataFrame, text: str = "text", context: str = "context", contexts: tuple[str, ...] = ("web_fetch", "email", "mcp_external", "pdf_read", "general")) -> DataFrame:
    """docs with `layer` and `decision`: rules first; only texts that pass them, are long enough and come from a listed context
    are scored. The two parts are filtered apart, so that Python functions see the second only."""
    from palisade.operators.detectors import scan

    first = scan(docs, text)
    gate = (F.col("decision") == "pass") & (F.length(text) >= 50) & F.col(context).isin(*contexts)
    known = first.where(~F.coalesce(gate, F.lit(False))).withColumn("layer", F.when(F.col("decision") == "pass", "none").otherwise("regex"))
    rest = offline_full(first.where(gate), text)
    rest = rest.withColumn("decision", F.when(F.col("composite") >= 0.85, "block").when(F.col("injection"), "sanitize").otherwise("pass")).withColumn("layer", F.when(F.col("injection"), "semantic").otherwise("none"))
    return known.select(*docs.columns, "layer", "decision").unionByName(rest.select(*docs.columns, "layer", "decision"))
