"""Toxicity by maximum-scoring segments.

Training counts, over labelled documents, in how many toxic and clean ones each feature of a word stands: the word itself and
its first 4, 5 and 6 bytes. A feature's weight is its log-odds ratio under an informative Dirichlet prior (its share of all
documents). A word scores as the best of its features whose z-score is high; else, if the word itself is surely a clean one,
its own negative log-odds; a word of which the sample says nothing sure costs DRIFT. All maximal scoring segments of a text are
found in linear time. By Karlin and Altschul, among n clean words the best segment scores as an extreme value: lambda follows
from the words' rates in clean documents, K is the maximum-likelihood value given their best segments. A segment's excess over
what n words reach by chance, in nats, is summed over a text's significant segments, and a logistic curve turns the sum into
a score. Features come from one half of the training sample; K, the curve, and in how many toxic documents a feature must
stand at least are fitted on the other half, where features that fit the first by chance show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import ALNUM, LOWER, Hasher, chunks, materialise, remainder, utf8, words

PREFIXES = (4, 5, 6)
DRIFT = 0.7
#: Bits of the table that tells most words of a text apart from the lexicon's.
TABLE = 22


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature hashes for each word (0: none), and the first word of each text (and the end)."""
    h, starts, ends, firsts = words(data, offsets, ALNUM, hasher)
    sums = hasher.sums(LOWER[data])
    out = np.zeros((1 + len(PREFIXES), len(h)), np.uint64)
    out[0] = h
    for j, k in enumerate(PREFIXES, 1):
        long = ends - starts > k
        out[j, long] = hasher.of(sums, starts[long], starts[long] + k) ^ np.uint64(k)
    return out, firsts


@dataclass
class Model:
    """hashes (sorted) and weights of toxic features; clean, clean_weights: of clean words; scale: lambda; k: the constant K;
    curve: slope and intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    clean: np.ndarray
    clean_weights: np.ndarray
    scale: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (1.0, -3.0)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, 1 << TABLE), bool)
        for table, known in zip(out, (self.hashes, self.clean), strict=True):
            table[(known & np.uint64((1 << TABLE) - 1)).astype(np.int64)] = True
        return out[0], out[1]


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))


def found_in(h: np.ndarray, known: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of h that are known, and their places among the known ones."""
    at = np.flatnonzero(table[(h & np.uint64((1 << TABLE) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
    hit = known[place] == h[at] if len(known) else np.zeros(0, bool)
    return at[hit], place[hit]


def word_scores(own: np.ndarray, model: Model, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each word's weight, 0 where nothing sure is known of it."""
    out = np.zeros(own.shape[1])
    if len(model.clean) and own.shape[1]:
        at, place = found_in(own[0], model.clean, tables[1])
        out[at] = model.clean_weights[place]
    for h in own if len(model.hashes) else ():
        at, place = found_in(h, model.hashes, tables[0])
        # A toxic feature counts whatever the word itself says; weights of toxic features are positive.
        out[at] = np.maximum(out[at], model.weights[place])
    return out


def segments(places: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score), in linear time.

    places: of the words with a score of their own, in order; every other word scores -drift.
    """
    kept: list[list[float]] = []  # first place, end place, sum before, sum at its end
    total, before = 0.0, -1
    for at, s in zip(places.tolist(), scores.tolist(), strict=True):
        total -= drift * (at - before - 1)
        before = at
        total += s
        if s <= 0:
            continue
        new = [at, at + 1, total - s, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), d - c) for a, b, c, d in kept]


def excess(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """The sum over significant segments of lambda S - ln(K n)."""
    chance = np.log(max(model.k * n, 1e-300))
    return float(sum(max(0.0, model.scale * s - chance) for _, _, s in found))


def excesses(data: np.ndarray, offsets: np.ndarray, model: Model, tables: tuple[np.ndarray, np.ndarray], hasher: Hasher) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """For each text, its excess and its segments."""
    own, firsts = features(data, offsets, hasher)
    s = word_scores(own, model, tables)
    hit = np.flatnonzero(s)
    edges = np.searchsorted(hit, firsts)
    out, found = np.zeros(len(firsts) - 1), [[] for _ in range(len(firsts) - 1)]
    for k in np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(s > 0), firsts))):
        at = hit[edges[k] : edges[k + 1]]
        found[k] = segments(at - firsts[k], s[at])
        out[k] = excess(found[k], firsts[k + 1] - firsts[k], model)
    return out, found


# ---------------------------------------------------------------- training
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean, uses) of (text, toxic): documents that hold a feature, and its places in clean ones, added up
    over a piece. Feature 0 has all places of all words in clean documents."""
    hasher = Hasher()
    for batch in chunks(batches, "text", 1 << 20):
        data, offsets = utf8(batch.column(0))
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        own, firsts = features(data, offsets, hasher)
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(firsts))
        flat, rows = own.ravel(), np.tile(row, len(own))
        keep = flat != 0
        order = np.lexsort((rows[keep], flat[keep]))
        flat, rows = flat[keep][order], rows[keep][order]
        starts = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        add = lambda x, first: np.add.reduceat(x, first) if len(first) else first
        uses = add(1 - toxic[rows], starts(flat))
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
        flat, rows = flat[new], rows[new]
        first = starts(flat)
        n_toxic = add(toxic[rows], first)
        n_clean = np.diff(np.append(first, len(flat))) - n_toxic
        total = int(np.diff(firsts)[toxic == 0].sum())
        columns = [np.append(x, y) for x, y in ((flat[first].view(np.int64), 0), (n_toxic, 0), (n_clean, 0), (uses, total))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "toxic", "clean", "uses"])


def labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """(text, toxic, half) of `most` labelled training documents or somewhat fewer, chosen by a hash of the id; one text an id."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 3) != 1)).groupBy(id_col).agg(F.max("toxic").cast("long").alias("toxic"))
    n = rows.count()
    share = min(1.0, 0.95 * most / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0)).limit(most)
    texts = docs.select(F.col(id_col), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    return texts.groupBy(id_col).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64(id_col, F.lit(2)), F.lit(2)).cast("int").alias("half"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = 2.0, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds ratio, z-score) of each feature; the prior's mass is `least` and what follows the feature's share of all
    documents."""
    share = (toxic + clean) / max(n_toxic + n_clean, 1)
    a = least + prior * share
    total = a + prior
    t = np.log((toxic + a) / (n_toxic + total - toxic - a + 1e-9).clip(1e-9))
    c = np.log((clean + a) / (n_clean + total - clean - a + 1e-9).clip(1e-9))
    delta = t - c
    return delta, delta / np.sqrt(1 / (toxic + a) + 1 / (clean + a))


def solve_scale(scores: np.ndarray, rate: np.ndarray, drift: float = DRIFT) -> float:
    """lambda > 0 with E exp(lambda s) = 1, where words score `scores` at `rate` each and -drift else."""
    low, high = 1e-3, 20.0
    rest = max(0.0, 1 - rate.sum())
    f = lambda x: float((rate * np.exp(np.minimum(x * scores, 700))).sum() + rest * np.exp(-x * drift)) - 1
    if f(high) < 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def solve_k(best: np.ndarray, n: np.ndarray, scale: float) -> float:
    """K by maximum likelihood: the best of n clean words' segments stays below x with chance exp(-K n exp(-lambda x)); 0 in
    `best` says that a text has none."""
    return float(max((best > 0).sum(), 0.5) / max((n * np.exp(-np.minimum(scale * best, 700))).sum(), 1e-9))


def curve_loss(w: np.ndarray, z: np.ndarray, y: np.ndarray) -> float:
    v = z @ w
    return float((np.logaddexp(0, v) - y * v).sum() + 5e-4 * (w @ w))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log(1 + x), ridge 1e-3, by Newton steps that are halved until the loss falls."""
    z = np.stack([np.log1p(x), np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - y) + 1e-3 * w)
        now, size = curve_loss(w, z, y), 1.0
        while size > 1e-6 and curve_loss(w - size * step, z, y) > now:
            size /= 2
        if size <= 1e-6 or np.abs(step).max() < 1e-9:
            break
        w = w - size * step
    return float(w[0]), float(w[1])


def score_of(x: np.ndarray, model: Model) -> np.ndarray:
    slope, intercept = model.curve
    return 1 / (1 + np.exp(-np.clip(slope * np.log1p(x) + intercept, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = 40_000, least: int = 5, supports: tuple[float, ...] = (0.0, 0.005, 0.01, 0.02, 0.04), least_z: float = 2.5, least_odds: float = 2.0, lexicon: int = 50_000, id_col: str = "doc_id") -> Model:
    """The model of a bounded sample: `most` labelled documents; `lexicon` toxic features and as many clean words.

    least: documents in which a feature must stand; of `supports`, shares of the toxic documents, the one that tells the second
    half apart best is taken. least_z, least_odds: how sure and how large the log-odds of a toxic feature are (of a clean word:
    least_z, and DRIFT). Without a toxic or a clean document nothing is toxic; if a half lacks either, all rows are both halves.
    """
    rows = materialise(labelled(docs, labels, most, id_col), "labelled")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = len(sizes) == 4
    n_toxic, n_clean = (sizes.get((0, k), 0) + (0 if halves else sizes.get((1, k), 0)) for k in (1, 0))
    if not n_toxic or not n_clean:
        return NOTHING
    first, second = (rows.where(F.col("half") == k) if halves else rows for k in (0, 1))
    counts = first.select("text", "toxic").mapInArrow(counted, "feature long, toxic long, clean long, uses long")
    counts = materialise(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "uses")]), "features")
    words = counts.where("feature = 0").first()["uses"]
    # What is commoner among toxic documents, and what among clean ones: a bounded number of each comes to the driver.
    side = F.col("toxic") * n_clean - F.col("clean") * n_toxic
    pull = lambda rows, by: rows.orderBy(F.desc(by), "feature").limit(lexicon).toPandas()
    top = pull(counts.where((F.col("toxic") >= least) & (side > 0)), F.col("toxic") / (F.col("clean") + 1))
    low = pull(counts.where((F.col("clean") >= least) & (side < 0)), F.col("clean") / (F.col("toxic") + 1))
    (delta, z), (minus, w) = (log_odds(t.toxic.to_numpy(float), t.clean.to_numpy(float), n_toxic, n_clean) for t in (top, low))

    def part(t: pd.DataFrame, keep: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = t.feature.to_numpy()[keep].view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], odds[keep][order], t.uses.to_numpy(float)[keep][order]

    clean, clean_weights, _ = part(low, (w <= -least_z) & (minus < -DRIFT), minus)
    models = []
    for share in supports:
        toxic, weights, used = part(top, (z >= least_z) & (delta > least_odds) & (top.toxic.to_numpy(float) >= share * n_toxic), delta)
        # Clean words only make chance segments rarer; lambda is set without them, on the safe side.
        models.append(Model(toxic, weights, clean, clean_weights, solve_scale(weights, (used + 0.5) / max(words, 1)) if len(toxic) else 1.0))
    known = rows.sparkSession.sparkContext.broadcast(models)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, models = Hasher(), known.value
        tables = [m.tables() for m in models]
        for batch in chunks(batches, "text"):
            data, offsets = utf8(batch.column(0))
            found = [excesses(data, offsets, m, t, hasher)[1] for m, t in zip(models, tables, strict=True)]
            each = [[[s for _, _, s in own] for own in row] for row in zip(*found, strict=True)]
            n = np.diff(features(data, offsets, hasher)[1])
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.list_(pa.list_(pa.float64()))), pa.array(n, pa.int64()), batch.column(1)], ["segments", "n", "toxic"])

    fitted = second.select("text", "toxic").mapInArrow(best, "segments array<array<double>>, n long, toxic long").toPandas()  # `most` rows
    y, n = fitted.toxic.to_numpy(float), fitted.n.to_numpy(float)
    losses = []
    for k, model in enumerate(models):
        own = [row[k] for row in fitted.segments]
        model.k = solve_k(np.array([max(s, default=0.0) for s in own])[y == 0], n[y == 0], model.scale)
        x = np.array([excess([(0, 0, v) for v in s], m, model) for s, m in zip(own, n, strict=True)])
        model.curve = fit_curve(x, y)
        losses.append(curve_loss(np.array(model.curve), np.stack([np.log1p(x), np.ones(len(x))], 1), y))
    return models[int(np.argmin(losses))]


SCHEMA = "doc_id long, score double, segments array<struct<first:int,end:int,score:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, segments (in words, end exclusive) for each of docs, in one pass without a shuffle.

    Null and empty texts have no segments and the score of a text without toxic words. Whole texts are read. Repeated rows
    each give a row; other columns are ignored; no rows give no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon's bound holds
    rows = docs.selectExpr(f"try_cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(), known.value
        tables = model.tables()
        shape = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in chunks(batches, "text"):
            x, found = excesses(*utf8(batch.column(1)), model, tables, hasher)
            spans = pa.array([[{"first": a, "end": b, "score": s} for a, b, s in own] for own in found], shape)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_of(x, model)), spans], ["doc_id", "score", "segments"])

    return rows.mapInArrow(run, SCHEMA)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
