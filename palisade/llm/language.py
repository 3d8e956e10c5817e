"""Language identification by string kernels.

A text is the set of its n-grams of 2, 3 and 4 symbols (blended spectrum, presence only); a symbol is a letter, one of 32
classes of the bytes above 127, or the gap between words. Two texts' kernel is the cosine of their sets. Landmarks drawn from
the training sample span a Nyström approximation; in its space, one ridge regression a language (one versus rest) is fitted.
Texts are scored in batches: one matrix product with the landmarks' sets, one with the regression's weights.

Training brings to the driver the landmarks' sets and the sums of the regression, never the texts of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.llm.common import chunks, materialise, remainder, utf8

#: Symbols of bytes: 0 what is no letter, 1-26 a-z, 27-58 bytes above 127 by their lower five bits.
SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 + (b & 31) if b >= 128 else 0 for b in range(256)], np.uint32)
ORDERS = (2, 3, 4)
UNDETERMINED = "und"
#: Texts of one matrix product.
PIECE = 256


def spectrum(symbols: np.ndarray) -> list[np.ndarray]:
    """The n-gram codes of a text by order: six bits a symbol."""
    out, code = [], symbols
    for n in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint32(6)) | symbols[n - 1 :]
        if n in ORDERS:
            out.append(code)
    return out


def symbols_of(data: np.ndarray) -> np.ndarray:
    """The text's symbols between two gaps; a run of gaps is one."""
    s = np.concatenate([[0], SYMBOL[data], [0]]).astype(np.uint32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    return s[keep]


@dataclass
class Model:
    """languages; grams: sorted codes (order << 24 | code) that are told apart; landmarks: their sets, of those grams; sizes:
    of the landmarks' whole sets; weights: per landmark and language, then the bias."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each order, code -> place among grams + 1, or 0."""
        out = []
        for n in ORDERS:
            table = np.zeros(1 << 6 * n, np.int16 if len(self.grams) < 1 << 15 else np.int32)
            own = np.flatnonzero(self.grams >> np.uint32(24) == n)
            table[self.grams[own] & np.uint32(0xFFFFFF)] = own + 1
            out.append(table)
        return out


def distinct(codes: np.ndarray) -> int:
    s = np.sort(codes)
    return int(np.count_nonzero(s[1:] != s[:-1])) + (len(s) > 0)


def present(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x grams, as 0 or 1 in float32, and the size of each row's whole set."""
    out, sizes = np.zeros((len(offsets) - 1, width + 1), np.float32), np.zeros(len(offsets) - 1)
    for k in range(len(offsets) - 1):
        s = symbols_of(data[offsets[k] : offsets[k + 1]])
        for table, codes in zip(tables, spectrum(s), strict=True):
            out[k, table[codes]] = 1
            sizes[k] += distinct(codes)
    return out[:, 1:], sizes


def kernel(x: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    """Cosines of sets; an empty set is at right angles to all."""
    return (x @ landmarks.T) / (np.sqrt(np.maximum(sizes, 1))[:, None] * np.sqrt(np.maximum(landmark_sizes, 1))[None, :])


def whole_set(text: bytes) -> np.ndarray:
    """All n-grams of a text, sorted, with their order."""
    codes = spectrum(symbols_of(np.frombuffer(text, np.uint8)))
    return np.concatenate([np.unique(c) | np.uint32(n << 24) for n, c in zip(ORDERS, codes, strict=True)])


def span(sets: list[np.ndarray], langs: list[str], languages: list[str], n_grams: int) -> tuple[Model, np.ndarray]:
    """The model without weights, and the Nyström map: a text's features are its kernels with the landmarks times this map.

    Each language has an equal part of n_grams, and 500 at least: those that most of its landmarks hold (ties by code).
    """
    quota, chosen = max(500, n_grams // max(len(languages), 1)), [np.zeros(0, np.uint32)]
    for a in languages:
        grams, counts = np.unique(np.concatenate([s for s, b in zip(sets, langs, strict=True) if a == b]), return_counts=True)
        chosen.append(grams[np.argsort(-counts, kind="stable")[:quota]])
    grams = np.unique(np.concatenate(chosen))
    landmarks = np.stack([np.isin(grams, s, assume_unique=True) for s in sets]).astype(np.float32)
    sizes = np.array([len(s) for s in sets], float)
    values, vectors = np.linalg.eigh(kernel(landmarks, sizes, landmarks, sizes).astype(np.float64))
    good = values > 1e-6 * max(values.max(initial=0), 1e-12)
    return Model(languages, grams, landmarks, sizes, np.zeros((0, 0), np.float32)), vectors[:, good] / np.sqrt(values[good])


def sums(features: np.ndarray, langs: list[str], share: dict[str, float], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What the regression needs of some rows: weighted products of their features, and a weighted sum for each language."""
    f = np.hstack([features, np.ones((len(features), 1))])
    weighted = f * np.array([share[a] for a in langs])[:, None]
    by = np.zeros((len(languages), f.shape[1]))
    np.add.at(by, [languages.index(a) for a in langs], weighted)
    return weighted.T @ f, by


def solve(gram: np.ndarray, by: np.ndarray, root: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """One versus rest: a row's target is 1 for its own language and -1 for the others."""
    beta = np.linalg.solve(gram + ridge * n * np.eye(len(gram)), (2 * by - by.sum(0)).T)
    return np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)


def sample(docs: DataFrame, per_language: int, languages: int, id_col: str = "doc_id") -> DataFrame:
    """(lang, text, r): of each language, the labelled training rows with the smallest hashes of their id; most of per_language.

    Rows that the held-out rule sets aside are never taken. A first cut by the hash keeps what is sorted small; where a
    language has too few rows for it, all its rows are taken. r numbers a language's rows from 1.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col(id_col), 5) != 0)).select("lang", "text", F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)).alias("__h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.least(F.lit(1 << 40), ((1 << 40) * (3.0 * per_language + 30) / F.col("n")).cast("long"))
    few = rows.join(F.broadcast(counts.select("lang", share.alias("__cut"))), "lang").where(F.col("__h") < F.col("__cut"))
    w = Window.partitionBy("lang").orderBy("__h", "text")
    return few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("lang", "text", "r")


def train(docs: DataFrame, per_language: int = 250, languages: int = 1000, n_landmarks: int = 160, n_grams: int = 12_000, ridge: float = 1e-3, id_col: str = "doc_id") -> Model:
    """The model of a bounded sample: per_language texts of each of the commonest `languages` languages.

    n_landmarks and n_grams are shared by the languages, but each has two landmarks and 500 n-grams at least. Texts of the
    sample stay on the executors. No labelled row gives a model without languages.
    """
    rows = materialise(sample(docs, per_language, languages, id_col), "language_sample")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # `languages` rows
    names = sorted(counts)
    if not names:
        return Model([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((1, 0), np.float32))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [whole_set(t.encode()).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["lang", "r", "codes"])

    each = max(2, n_landmarks // len(names))
    marks = rows.where(F.col("r") <= each).mapInArrow(sets, "lang string, r int, codes array<int>").orderBy("lang", "r").collect()
    model, root = span([np.array(m["codes"], np.uint32) for m in marks], [m["lang"] for m in marks], names, n_grams)
    # Languages count alike, however many rows they have.
    n = sum(counts.values())
    share = {a: n / len(names) / c for a, c in counts.items()}
    known = rows.sparkSession.sparkContext.broadcast((model, root))  # landmarks x n-grams at most

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, root = known.value
        tables, gram, by = model.tables(), 0, 0
        for batch in chunks(batches, "text"):
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                x, sizes = present(*utf8(part.column(1)), tables, len(model.grams))
                g, b = sums(kernel(x, sizes, model.landmarks, model.sizes) @ root, part.column(0).to_pylist(), share, model.languages)
                gram, by = gram + g, by + b
        if not isinstance(gram, int):
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([by.tobytes()], pa.binary())], ["gram", "by"])

    size, gram, by = root.shape[1] + 1, 0, 0
    for r in rows.mapInArrow(partial, "gram binary, by binary").toLocalIterator():  # one row a partition of the sample
        gram, by = gram + np.frombuffer(r["gram"]).reshape(size, size), by + np.frombuffer(r["by"]).reshape(len(names), size)
    model.weights = solve(gram, by, root, n, ridge)
    return model


def predictions(texts: pa.Array, model: Model, tables: list[np.ndarray], most: int = PIECE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language and score, see identify(), and its kernel with the nearest landmark (0 without letters)."""
    letter = np.array(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist(), bool)
    best, share, near = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
    for at in range(0, len(texts) if model.languages else 0, most):
        k = kernel(*present(*utf8(texts.slice(at, most)), tables, len(model.grams)), model.landmarks, model.sizes)
        s = k @ model.weights[:-1] + model.weights[-1]
        own, e = s.argmax(1), np.exp(4 * (s - s.max(1, keepdims=True)))
        best[at : at + most], share[at : at + most], near[at : at + most] = own, (e / e.sum(1, keepdims=True))[np.arange(len(s)), own], k.max(1)
    share[~letter], near[~letter] = 0, 0
    return [model.languages[b] if ok and model.languages else UNDETERMINED for b, ok in zip(best, letter, strict=True)], share, near


SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each of docs, in one pass without a shuffle.

    `und` with score 0 if a text is null, empty or has no letter, or if the model has no language; else the language with the
    largest margin (on a tie, the first by name) and its share of a softmax over the margins. Whole texts are read. Repeated
    rows each give a row; other columns are ignored; no rows give no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # n_landmarks x n_grams numbers at most
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        tables = model.tables()
        for batch in chunks(batches, "text"):
            lang, share, _ = predictions(batch.column(1), model, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language can be told: they have a letter, and their kernel with the nearest
    landmark is more than `least` (0: they share an n-gram with one). A model without languages only asks for a letter."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        tables = model.tables()
        for batch in chunks(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col))
            if model.languages:
                keep = predictions(texts, model, tables)[2] > least
            else:
                keep = np.array(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist(), bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
