"""Benchmark decontamination by winnowing.

The fingerprints of a text are, for each window of W consecutive k-grams of words, the smallest k-gram hash. With
k + W - 1 = 13, every 13 words that two texts share hold a k-gram that is a fingerprint of both. Document fingerprints that
the benchmark has too are extended: the 13-word windows around them are held against all windows of the items. Items of
fewer than 13 words are one window each, looked up at every place.

A benchmark of at most `broadcast_windows` windows goes to the executors, and documents are read once without a shuffle.
A larger one is joined with the documents' fingerprints by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import ALNUM, Hasher, chunks, free_name, grams, utf8, words

WINDOW, GRAM = 13, 5
#: Windows of a benchmark that is broadcast: 16 bytes each, twice in memory.
BROADCAST_WINDOWS = 1_000_000


def fingerprints(hashes: np.ndarray, firsts: np.ndarray, k: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Places of the words at which a chosen k-gram starts; rows of fewer than `window` words have none.

    hashes: of the words of several rows; firsts: where each row starts, and the end. Equal smallest hashes are all chosen.
    """
    g = grams(hashes, k)
    w = window - k + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    inside = whole_windows(firsts, len(hashes), window)
    least[~inside] = 0
    most = np.zeros(len(g), np.uint64)
    for j in range(w):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero((most == g) & (most > 0))


def whole_windows(firsts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """For each place at which `window` words can start in the whole array: whether they lie in one row."""
    n = n_words - window + 1
    out = np.ones(max(n, 0), bool)
    for cut in firsts[1:-1]:
        out[max(0, cut - window + 1) : cut] = False
    return out


class Benchmark:
    """The windows of all items: sorted hashes per window length, each with its items, and the fingerprints."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        hasher, found, prints = Hasher(), {}, [np.zeros(0, np.uint64)]
        names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(names)}
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            h, *_ = words(data, np.array([0, len(data)]), ALNUM, hasher)
            if len(h):
                m = min(WINDOW, len(h))
                w = grams(h, m)
                found.setdefault(m, []).append((w, np.full(len(w), place[item])))
                if m == WINDOW:
                    prints.append(grams(h, GRAM)[fingerprints(h, np.array([0, len(h)]))])
        self.items = np.array(names, object)
        self.windows = {}
        for m, parts in sorted(found.items()):
            h, i = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((i, h))
            self.windows[m] = (h[order], i[order])
        self.prints = np.unique(np.concatenate(prints))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.prints & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, items): the windows of items that occur in the rows, once for each item."""
        for m, (known, item) in self.windows.items():
            n = len(hashes) - m + 1
            if n <= 0:
                continue
            if m == WINDOW:
                g = grams(hashes, GRAM)
                at = np.flatnonzero(self.seen[(g & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[member(self.prints, g[at])]
                if not len(at):
                    continue
                chosen = np.zeros(len(g), bool)
                chosen[fingerprints(hashes, firsts)] = True
                at = at[chosen[at]]
                # Extend: all windows that hold the fingerprint.
                starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                starts = starts[(starts >= 0) & (starts < n)]
            else:
                starts = np.arange(n)
            starts = starts[whole_windows(firsts, len(hashes), m)[starts]]
            w = grams(hashes, m)[starts]
            low, high = np.searchsorted(known, w, "left"), np.searchsorted(known, w, "right")
            hit = high > low
            low, high, starts = low[hit], high[hit], starts[hit]
            each = high - low
            if each.sum():
                index = np.repeat(low - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
                yield m, np.repeat(starts, each), item[index]


def member(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"
NONE = hashlib.sha256(b"").hexdigest()


def judged(n_words: np.ndarray, n_hit: np.ndarray, items: list[list[int]], ids: pa.Array) -> pa.RecordBatch:
    digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() if x else NONE for x in items]
    bad = (n_hit > 0) & (20 * n_hit >= n_words)
    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_()), pa.array(items, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def hits(ids: pa.Array, texts: pa.Array, benchmark: Benchmark, hasher: Hasher) -> pa.RecordBatch:
    """The decision for each text."""
    data, offsets = utf8(texts)
    h, _, _, firsts = words(data, offsets, ALNUM, hasher)
    edge = np.zeros(len(h) + 1, np.int32)
    pairs = []
    for m, starts, item in benchmark.places(h, firsts):
        at = np.unique(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + m, -1)
        rows = np.searchsorted(firsts, starts, "right") - 1
        pairs.append(np.unique(np.stack([rows, item], 1), axis=0))
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    items: list[list[int]] = [[] for _ in range(len(texts))]
    for row, item in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
        items[row].append(benchmark.items[item])
    return judged(np.diff(firsts), covered[firsts[1:]] - covered[firsts[:-1]], items, ids)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: a row for each of docs.

    Null and empty texts have no words and aren't contaminated; an item without words or id has no window. Items that share
    an id are one item. Repeated documents each give a row. A word that several windows cover counts once. Very long texts
    are read whole. Other columns are ignored; no rows give no rows.
    """
    rows = docs.selectExpr(f"try_cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text")
    items = items_of(benchmark, item_col, item_text_col)
    if too_large(items, broadcast_windows):
        from palisade.llm.decontaminate_join import joined

        return joined(rows, items).drop("tag")
    known = sent(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, benchmark = Hasher(), known.value
        for batch in chunks(batches, "text"):
            yield hits(batch.column(0), batch.column(1), benchmark, hasher)

    return rows.mapInArrow(scan, SCHEMA)


def items_of(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.selectExpr(f"try_cast(`{item_col}` as long) AS item_id", f"cast(`{item_text_col}` as string) AS text").where("item_id IS NOT NULL AND text IS NOT NULL")


def too_large(items: DataFrame, broadcast_windows: int) -> bool:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size // 2 > broadcast_windows  # a word and what follows it take two bytes at least


def sent(items: DataFrame) -> Broadcast:
    """The benchmark's windows on all executors; its size has been checked."""
    return items.sparkSession.sparkContext.broadcast(Benchmark([(i, t.encode()) for i, t in items.collect()]))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, that decontaminate() doesn't call contaminated."""
    items = items_of(benchmark, item_col, item_text_col)
    if too_large(items, broadcast_windows):
        # A benchmark of that size is met by a shuffle, by id and text.
        from palisade.llm.decontaminate_join import joined

        tag = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        found = joined(docs.selectExpr(f"try_cast(`{id_col}` as long) AS doc_id", f"cast(`{text_col}` as string) AS text"), items)
        own_id, own_tag = free_name(docs, "__id"), free_name(docs, "__tag")
        bad = found.where("contaminated").select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag))
        return docs.join(bad, F.col(id_col).try_cast("long").eqNullSafe(F.col(own_id)) & (tag == F.col(own_tag)), "left_anti")
    known = sent(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, benchmark = Hasher(), known.value
        for batch in chunks(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = hits(pa.nulls(batch.num_rows, pa.int64()), texts, benchmark, hasher)
            yield batch.filter(pc.invert(found.column("contaminated")))

    return docs.mapInArrow(scan, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, benchmark).drop("items")


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM dw, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
hit AS (SELECT p.r, p.s, p.m, i.item_id FROM (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM places) p JOIN windows i ON p.m = i.m AND p.win = i.win),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
