"""Decontamination against a benchmark too large to broadcast: fingerprints of both sides meet in a shuffle join.

A table of bits of a fixed size, set where the benchmark has a fingerprint or a short item's window, goes to the executors
whatever the benchmark's size: only what passes it is shuffled, with the words around it. The join decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ALNUM, Hasher, chunks, grams, materialise, utf8, words
from palisade.llm.decontaminate import GRAM, NONE, WINDOW, fingerprints, whole_windows

EXTRA = WINDOW - GRAM
#: Bits of the table, as a power of two: 8 MB.
BITS = 26


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the benchmark."""
    low = hashes & np.uint64((1 << BITS) - 1)
    return bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1) > 0


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The table of a column h: its words are put together on the executors, so the driver gets a bounded number of rows."""
    low = F.col("h").bitwiseAND((1 << BITS) - 1)
    bit = F.expr(f"shiftleft(1L, cast((h & {(1 << BITS) - 1}) % 64 as int))")
    own = hashes.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[own.word.to_numpy()] = own.bits.to_numpy()
    return out.view(np.uint64)


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, m, h, print) of (item_id, text): each window's hash; rows with print hold a fingerprint instead."""
    hasher = Hasher()
    for batch in chunks(batches, "text"):
        data, offsets = utf8(batch.column(1))
        h, _, _, firsts = words(data, offsets, ALNUM, hasher)
        ids, out = batch.column(0).to_numpy(zero_copy_only=False), []
        for k in range(batch.num_rows):
            own = h[firsts[k] : firsts[k + 1]]
            if len(own):
                m = min(WINDOW, len(own))
                out.append((ids[k], m, grams(own, m), False))
                out.append((ids[k], m, grams(own, GRAM)[fingerprints(own, np.array([0, len(own)]))] if m == WINDOW else own[:0], True))
        n = [len(x[2]) for x in out]
        columns = [np.repeat(np.array([x[0] for x in out], np.int64), n), np.repeat(np.array([x[1] for x in out], np.int32), n), np.concatenate([x[2] for x in out]).view(np.int64) if out else np.zeros(0, np.int64), np.repeat(np.array([x[3] for x in out], bool), n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "m", "h", "print"])


def doc_prints(short: list[int], known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tag, at, m, g, around): fingerprints that pass the table, with the words around them; for short items,
    the windows of m words that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Hasher(), known.value
        for batch in chunks(batches, "text"):
            data, offsets = utf8(batch.column(2))
            h, _, _, firsts = words(data, offsets, ALNUM, hasher)
            at = fingerprints(h, firsts)
            at = at[passing(bits, grams(h, GRAM)[at])]
            row = np.searchsorted(firsts, at, "right") - 1
            low, high = np.maximum(at - EXTRA, firsts[row]), np.minimum(at + WINDOW, firsts[row + 1])
            around = [h[a:b].view(np.int64) for a, b in zip(low, high, strict=True)]
            parts = [(row, low - firsts[row], np.full(len(at), WINDOW), grams(h, GRAM)[at], around)]
            for m in short:
                g, inside = grams(h, m), np.flatnonzero(whole_windows(firsts, len(h), m))
                inside = inside[passing(bits, g[inside])]
                row = np.searchsorted(firsts, inside, "right") - 1
                parts.append((row, inside - firsts[row], np.full(len(inside), m), g[inside], [None] * len(inside)))
            for row, first, m, g, around in parts:
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(first, pa.int64()), pa.array(m, pa.int32()), pa.array(g.view(np.int64)), pa.array(around, pa.list_(pa.int64()))], ["doc_id", "tag", "at", "m", "g", "around"])

    return run


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, at, m, h): the windows that hold a shared fingerprint."""
    for batch in batches:
        row, first, found = [], [], [np.zeros(0, np.uint64)]
        for k, (at, around) in enumerate(zip(batch.column(2).to_pylist(), batch.column(5), strict=True)):
            own = np.array(around.as_py(), np.int64).view(np.uint64)
            w = grams(own, WINDOW)
            found.append(w)
            row += [k] * len(w)
            first += range(at, at + len(w))
        index = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(first, pa.int64()), batch.column(3).take(index), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "tag", "at", "m", "h"])


def joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """As decontaminate.decontaminate, for any size of benchmark; rows: doc_id, text."""
    known = materialise(items.mapInArrow(item_windows, "item_id long, m int, h long, print boolean").distinct(), "windows")
    short = [r.m for r in known.where("m < %d" % WINDOW).select("m").distinct().collect()]
    tagged = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    bits = rows.sparkSession.sparkContext.broadcast(bit_table(known.where(F.col("print") | (F.col("m") < WINDOW))))  # 2 ** BITS bits
    prints = tagged.mapInArrow(doc_prints(short, bits), "doc_id long, tag long, at long, m int, g long, around array<long>")
    own = known.where("print").select(F.col("h").alias("g")).distinct()
    shape = "doc_id long, tag long, at long, m int, h long"
    long_ones = prints.where(F.col("m") == WINDOW).join(own, "g", "left_semi").select("doc_id", "tag", "at", "m", "g", "around").mapInArrow(extended, shape)
    # Documents are read once more for short items only where there are any.
    windows = long_ones.unionByName(prints.where(F.col("m") < WINDOW).select("doc_id", "tag", "at", "m", F.col("g").alias("h"))) if short else long_ones
    hit = windows.distinct().join(known.where("NOT print").select("item_id", "m", "h"), ["m", "h"])
    by = hit.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "m")).alias("places"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["m"] - 1)))))
    by = by.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), covered.cast("long").alias("n_hit"), "items")
    counts = tagged.select("doc_id", "tag", n_words().alias("n_words"))
    out = counts.join(by, counts.doc_id.eqNullSafe(by.d) & (counts.tag == by.t), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<long>"))
    digest = F.when(F.size(found) == 0, F.lit(NONE)).otherwise(F.sha2(F.array_join(F.array_sort(found.cast("array<string>")), ",").cast("binary"), 256))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), digest.alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), found.alias("items"), "tag")


def n_words() -> Column:
    gaps = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(gaps == "", F.lit(0).cast("long")).otherwise((F.length(gaps) - F.length(F.translate(gaps, " ", "")) + 1).cast("long"))
