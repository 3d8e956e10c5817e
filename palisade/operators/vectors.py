"""Embedding operators: nearest seed, decisions, rank overlap. The query side (seeds) is small and stated; all rows are scored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.numbers import cosine

#: Rows of a seed set that is put into the plan.
MOST_SEEDS = 2000


def with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows with the array `seeds`: one array for all, as seeds are few; more than MOST_SEEDS are refused."""
    n = seeds.count()
    if n > MOST_SEEDS:
        raise ValueError(f"{n} seeds; {MOST_SEEDS} at most: score in blocks of seeds")
    held = seeds.agg(F.array_sort(F.collect_list(F.struct("seed_id", "category", "vector"))).alias("seeds"))
    return rows.join(F.broadcast(held))


def nearest_seed(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """vec_id, seed_id, category, similarity: the seed with the largest cosine; on a tie, that with the smallest id."""
    best = F.array_max(F.transform("seeds", lambda s: F.struct(F.round(cosine(F.col("vector"), s["vector"]), 6).alias("sim"), (-s["seed_id"]).alias("order"), s["category"].alias("category"))))
    out = with_seeds(rows, seeds).select("vec_id", best.alias("b"))
    return out.select("vec_id", (-F.col("b.order")).alias("seed_id"), F.col("b.category").alias("category"), F.col("b.sim").alias("similarity"))


def threshold_decision(found: DataFrame, step: float = 0.01, warn: float = 0.2, block: float = 0.3) -> DataFrame:
    """found with `decision`, by the category's own thresholds."""
    own = F.col("category") * step
    says = F.when(F.col("similarity") >= block + own, "block").when(F.col("similarity") >= warn + own, "suspicious").otherwise("benign")
    return found.withColumn("decision", says)


def top_k(similarities: Column, k: int) -> Column:
    return F.transform(F.slice(F.array_sort(similarities), 1, k), lambda s: s["seed_id"])


def rank_overlap(rows: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """vec_id, overlap: the share of the k nearest seeds by the whole vector that the first half of the dimensions gives too."""
    half = lambda v: F.slice(v, F.lit(1), F.floor(F.size(v) / 2).cast("int"))
    near = lambda f: F.transform("seeds", lambda s: F.struct((-F.round(cosine(f(F.col("vector")), f(s["vector"])), 6)).alias("o"), s["seed_id"].alias("seed_id")))
    out = with_seeds(rows, seeds).select("vec_id", top_k(near(lambda v: v), k).alias("a"), top_k(near(half), k).alias("b"))
    return out.select("vec_id", F.round(F.size(F.array_intersect("a", "b")) / k, 4).alias("overlap"))


# ---------------------------------------------------------------- two models against each other
def trigrams(text: str) -> Counter[str]:
    low = re.sub(r"\s+", " ", text.lower())
    return Counter(low[i : i + 3] for i in range(len(low) - 2))


def trigram_cosines(seeds: list[str]) -> Callable[[str], list[float]]:
    """Gives the cosines of a text's counted trigrams with each seed's; 0 where one has none. The seeds' trigrams are an inverted
    index, so that a text looks each of its own up once, however many seeds there are."""
    counted = [trigrams(s) for s in seeds]
    norms = np.array([sum(n * n for n in c.values()) ** 0.5 for c in counted])
    held: dict[str, list[tuple[int, int]]] = {}
    for i, c in enumerate(counted):
        for gram, n in c.items():
            held.setdefault(gram, []).append((i, n))
    row = {gram: i for i, gram in enumerate(held)}
    sizes = np.array([len(x) for x in held.values()], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    pairs = np.array([p for x in held.values() for p in x], dtype=np.int64).reshape(-1, 2)

    def cosines(text: str) -> list[float]:
        own = trigrams(text)
        met = [(row[g], n) for g, n in own.items() if g in row]
        if not met:
            return [0.0] * len(seeds)
        at, times = np.array(met, dtype=np.int64).T
        many = sizes[at]
        places = np.repeat(begins[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        dots = np.bincount(pairs[places, 0], weights=pairs[places, 1] * np.repeat(times, many), minlength=len(seeds))
        size = sum(n * n for n in own.values()) ** 0.5
        return np.round(np.divide(dots, size * norms, out=np.zeros(len(seeds)), where=norms > 0), 6).tolist()

    return cosines


def trigram_similarities(text: Column, seeds: list[str]) -> Column:
    """An array of the cosines with each seed text, by an Arrow function. Null counts as empty."""
    cosines = trigram_cosines(seeds)

    def batch(s: pd.Series) -> pd.Series:
        return s.fillna("").map(cosines)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<double>")(text)


def disagreement(rows: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """rows (text, vector) with `score`, `suspicious`, `by_vector`, `by_trigrams`: how far an embedding and counted trigrams
    disagree on the nearest seeds (seed_id, text, vector; MOST_SEEDS at most). A text whose letters are near a seed while its
    vector isn't weighs most. On ties the seed with the smaller id is nearer; without a vector or seeds the score is 0."""
    held = seeds.orderBy("seed_id").limit(MOST_SEEDS + 1).collect()
    if len(held) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds: score in blocks of seeds")
    vectors = seeds.agg(F.transform(F.array_sort(F.collect_list(F.struct("seed_id", "vector"))), lambda s: s["vector"]).alias("__seeds"))
    out = rows.join(F.broadcast(vectors)).withColumn("__a", F.transform("__seeds", lambda v: F.round(cosine(F.col("vector"), v), 6)))
    out = out.withColumn("__b", trigram_similarities(F.col("text"), [r["text"] or "" for r in held])).drop("__seeds")
    nearest = lambda c: F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("o"), i.alias("i")))), 1, k)
    both = F.size(F.array_intersect(F.transform(nearest("__a"), lambda s: s["i"]), F.transform(nearest("__b"), lambda s: s["i"])))
    out = out.withColumns({"by_vector": F.coalesce(F.array_max("__a"), F.lit(0.0)), "by_trigrams": F.coalesce(F.array_max("__b"), F.lit(0.0)), "__r": 1 - both / k})
    gap = F.col("by_trigrams") - F.col("by_vector")
    fooled = F.when((F.col("by_trigrams") > 0.3) & (F.col("by_vector") < 0.5), gap * 2).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("__r") * 0.3 + F.abs(gap) * 0.3 + fooled * 0.4)
    seen = F.col("vector").isNotNull() & (F.size("__a") > 0)
    return out.withColumn("score", F.when(seen, score).otherwise(0.0)).withColumn("suspicious", F.col("score") > 0.30).drop("__a", "__b", "__r")
