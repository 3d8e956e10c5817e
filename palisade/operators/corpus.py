"""Statistics of labelled corpora and feeds: n-gram support, seeds, discriminative weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions import text as tx
from palisade.operators.detectors import let


def feed(records: DataFrame) -> DataFrame:
    """hash, text: labelled attacks of a feed with columns text, prompt, content, input, label, is_injection, class."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "prompt", "content", "input")])
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("label", "is_injection", "class")])
    rows = records.select(text.alias("text"), label.alias("label")).where(F.col("label").isin("injection", "1", "malicious", "true") & (F.length("text") >= 20))
    return rows.select(F.left(F.sha2("text", 256), F.lit(16)).alias("hash"), F.left("text", F.lit(500)).alias("text"))


def ngrams(words: Column) -> Column:
    """Distinct runs of two and three words."""

    def of(w: Column) -> Column:
        runs = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(runs(2), runs(3)))

    return let(words, of)  # split once, not once a run


def ngram_support(texts: DataFrame, k: int = 50, low: float = 0.03, high: float = 0.5) -> DataFrame:
    """The k n-grams that most texts hold, within a band of support: ngram, frequency, pattern."""
    total = texts.agg(F.count("*").alias("total"))
    words = F.split(F.lower("text"), r"\s+")
    by = texts.select(F.explode(ngrams(words)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("frequency"))
    band = (F.col("frequency") >= F.greatest(F.lit(2), F.ceil(F.col("total") * low))) & (F.col("frequency") <= F.ceil(F.col("total") * high))
    out = by.join(F.broadcast(total)).where(band)
    escaped = F.regexp_replace(F.regexp_replace("ngram", r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
    return out.orderBy(F.desc("frequency"), "ngram").limit(k).select("ngram", "frequency", F.round(100 * F.col("frequency") / F.col("total"), 1).alias("pct"), F.concat(F.lit("(?i)"), escaped).alias("pattern"))


def seeds(texts: DataFrame, most: int = 20) -> DataFrame:
    """The shortest text of each of the largest bins; a bin's key is the first three words of over four letters."""
    long = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 4)
    rows = texts.withColumn("bin", F.array_join(F.slice(long, 1, 3), "_"))
    by = rows.groupBy("bin").agg(F.count("*").alias("size"), F.min(F.struct(F.length("text").alias("n"), "id", "text")).alias("best"))
    return by.orderBy(F.desc("size"), "bin").limit(most).select("bin", "size", F.col("best.id").alias("id"), F.col("best.n").cast("long").alias("n_chars"))


def term_weights(docs: DataFrame, least_df: int = 2) -> DataFrame:
    """term, weight: log-odds between attack and benign documents times rarity, scaled to 0.5 and up; only terms for attacks.

    docs: id, text, attack. Terms are counted once a document.
    """
    sizes = docs.agg(F.count_if("attack").alias("ni"), F.count_if(~F.col("attack")).alias("nb"))  # one row
    by = docs.select("attack", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count_if("attack").alias("i"), F.count_if(~F.col("attack")).alias("b"))
    i, b, ni, nb = (F.col(c) for c in ("i", "b", "ni", "nb"))
    odds = F.log(((i + 1) / (ni + 2)) / ((b + 1) / (nb + 2)))
    idf = F.log((ni + nb) / (i + b + 1)) + 1
    raw = by.where(F.col("i") + F.col("b") >= least_df).join(F.broadcast(sizes)).withColumn("raw", F.round(odds * idf, 9)).where("raw > 0")
    top = raw.agg(F.max(F.log1p("raw")).alias("top"))
    return raw.join(F.broadcast(top)).select("term", "i", "b", F.round(0.5 + F.round(F.log1p("raw") / F.col("top") * 6, 9), 1).alias("weight"))


def compare_weights(found: DataFrame, existing: DataFrame, much: float = 1.0) -> DataFrame:
    """(status, n): terms of both with alike or changed weights, new ones and missing ones."""
    both = found.select("term", F.col("weight").alias("a")).join(existing.select("term", F.col("weight").alias("b")), "term", "full_outer")
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.abs(F.col("a") - F.col("b")) > much, "changed").otherwise("alike")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def federated_rules(patterns: DataFrame) -> DataFrame:
    """Up to three rules a shared pattern (tool_sequence, surprise, layers, severity, influence, categories): one that watches a
    surprising sequence, one that moves thresholds where two layers or more found something severe, one that weighs a kind of
    influence. Missing values ask for none."""
    kinds = F.array(
        F.when(F.col("tool_sequence").isNotNull() & (F.col("surprise") >= 0.7), F.lit("behavioral")),
        F.when((F.size("layers") >= 2) & (F.col("severity") >= 7), F.lit("threshold_adjust")),
        F.when((F.coalesce("influence", F.lit("")) != "") & F.col("categories").isNotNull(), F.lit("taxonomy_weight")),
    )
    return patterns.withColumn("rule", F.explode(F.filter(kinds, lambda k: k.isNotNull())))


def keep_latest(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The latest rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
