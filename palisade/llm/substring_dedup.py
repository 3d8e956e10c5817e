"""Removal of long repeated byte strings by two-stage suffix sorting.

Every string of LENGTH bytes has an anchor: among its places whose suffix is smaller than its successor, the one with the
smallest hash of the GRAM bytes there. Equal strings have equal anchors at equal offsets, so a repeated string shows as an
anchor whose gram occurs again. Neighbouring strings with one anchor make up a context. Where all contexts of a gram are
equal, all their strings are repeated. Where they differ, the texts of the distinct contexts meet in one task and are suffix
sorted in two stages: the suffixes at the anchors, each smaller than its successor, are sorted directly; those left of
them are induced step by step by scans into buckets of the byte in front; and adjacent common prefixes tell which strings
occur again. Contexts of a gram that are too many for one task are counted string by string instead, by hashes.

Only hashes and places travel for the whole corpus: one row in 69 bytes or so. Bytes travel for differing contexts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import Hasher, chunks, drop_table, lookup, materialise, mix, utf8

LENGTH, GRAM = 200, 64
#: Places that the window of a string has for its anchor.
PLACES = LENGTH - GRAM + 1
#: Bits of a place in the keys that are compared; a longer piece of text is cut, with overlap.
PLACE_BITS = 22
#: Distinct contexts of one gram that a task sorts: some 60 MB.
MOST_CONTEXTS = 50_000


# ---------------------------------------------------------------- anchors
def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, in a logarithmic number of steps."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def contexts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(row, first string, strings, offset of the anchor, gram hash, context hash) for all contexts of the rows' texts."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none, none
    sums = hasher.sums(data)
    ends = np.arange(GRAM, len(data) + 1)
    grams = hasher.of(sums, ends - GRAM, ends)
    smaller = np.zeros(len(grams), bool)
    smaller[:] = data[: len(grams)] < np.append(data[1:], 0)[: len(grams)]
    key = (grams >> np.uint64(PLACE_BITS + 1)) << np.uint64(PLACE_BITS) | (~smaller).astype(np.uint64) << np.uint64(63)
    valid = np.ones(n, bool)
    for cut in offsets[1:-1].tolist():
        valid[max(0, cut - LENGTH + 1) : cut] = False
    anchor = np.zeros(n, np.int64)
    piece = (1 << PLACE_BITS) - PLACES
    for at in range(0, n, piece):
        end = min(n, at + piece)
        part = key[at : end + PLACES - 1] | np.arange(end - at + PLACES - 1, dtype=np.uint64)
        anchor[at:end] = at + (sliding_least(part, PLACES) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none, none, none, none, none
    new = np.ones(len(s), bool)
    new[1:] = (anchor[s[1:]] != anchor[s[:-1]]) | (s[1:] != s[:-1] + 1)
    first = s[new]
    last = s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
    a = anchor[first]
    row = np.searchsorted(offsets, first, "right") - 1
    whole = mix(hasher.of(sums, first, last + LENGTH) + (a - first).astype(np.uint64))
    return row, first - offsets[row], last - first + 1, a - first, grams[a].view(np.int64), whole.view(np.int64)


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, first, strings, at, gram, context) of (doc_id, tag, text)."""
    hasher = Hasher()
    for batch in chunks(batches, "text"):
        row, first, strings, at, gram, whole = contexts(*utf8(batch.column(2)), hasher)
        index = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(first.astype(np.int64)), pa.array(strings.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(gram), pa.array(whole)], ["doc_id", "tag", "first", "strings", "at", "gram", "context"])


# ---------------------------------------------------------------- sorting
def repeated(group: np.ndarray, right: np.ndarray, left: np.ndarray, at: np.ndarray, strings: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context and each offset o from 0 on, whether the string that starts o bytes before the anchor occurs again.

    group: contexts with one number share a gram. right: the bytes from the anchor on, `length` of them; left: the bytes
    before it, nearest first; both padded. A context holds the strings at offsets at - strings + 1 .. at.
    """
    m = len(group)
    out = np.zeros((m, left.shape[1] + 1), bool)
    # Stage one: the suffixes at the anchors, sorted directly, and their adjacent common prefixes.
    w = np.ascontiguousarray(right).view(">u8").astype(np.uint64)
    order = np.lexsort([*w.T[::-1], group])
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(1), length, np.argmin(same, 1))
    common[group[order[1:]] != group[order[:-1]]] = -1
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    low = at - strings + 1
    before = group.astype(np.int64)  # equal for suffixes that agree left of the anchor, o bytes far
    for o in range(int(at.max(initial=-1)) + 1):
        if o:
            # Stage two: a suffix's order follows from its first byte and the order of the suffix after it.
            order = order[at[order] >= o]
            byte = left[order, o - 1]
            order = order[np.argsort(byte, kind="stable")]
            byte = left[order, o - 1]
            k = before[order]
            # A class of equal left bytes isn't contiguous across groups; number the pairs (class, byte).
            pair = k * 256 + byte
            _, number = np.unique(pair, return_inverse=True)
            before = np.zeros(m, np.int64)
            before[order] = number
        held = order[low[order] <= o]
        if len(held) < 2:
            continue
        # Of the suffixes that agree on the left, neighbours in the anchors' order share the string if they share the rest.
        held = held[np.lexsort((rank[held], before[held]))]
        cut = np.cumsum(np.concatenate([[0], common < length - o]))
        a, b = held[:-1], held[1:]
        equal = (before[a] == before[b]) & (cut[rank[a]] == cut[rank[b]])
        out[a[equal], o] = True
        out[b[equal], o] = True
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def sort_block(t: pa.Table) -> pa.RecordBatch:
    """(doc_id, tag, begin, end): repeated stretches of the contexts that occur once; t: whole groups of contexts."""
    n, at, strings = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "at", "strings"))
    _, group = np.unique(t.column("gram").to_numpy(), return_inverse=True)
    m = t.num_rows
    body = t.column("bytes").combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + m + 1].astype(np.int64)
    data = np.append(np.frombuffer(body.buffers()[2], np.uint8), np.uint8(255))
    end, anchor = offsets[1:], offsets[:-1] + at
    far = anchor[:, None] + np.arange(LENGTH)
    right = data[np.where(far < end[:, None], far, len(data) - 1)]
    near = anchor[:, None] - 1 - np.arange(PLACES - 1)
    left = data[np.where(near >= offsets[:-1, None], near, len(data) - 1)]
    flags = repeated(group, right, left, at, strings)
    rows, begin, stop = [], [], []
    first = t.column("first").to_numpy()
    for k in np.flatnonzero((n == 1) & flags.any(1)).tolist():
        own = flags[k, at[k] - strings[k] + 1 : at[k] + 1][::-1]  # by start of string
        for a, b in runs(own):
            rows.append(k)
            begin.append(first[k] + a)
            stop.append(first[k] + b - 1 + LENGTH)
    index = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().take(index), t.column("tag").combine_chunks().take(index), pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], ["doc_id", "tag", "begin", "end"])


def sorted_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts blocks of whole groups; rows come sorted by gram. A group is bounded, and a block is cut at MOST_CONTEXTS / 4."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> int:
        """Rows before the last group, which may go on."""
        g = table.column("gram").to_numpy()
        return int(np.searchsorted(g, g[-1], "left"))

    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= MOST_CONTEXTS // 4:
            table = pa.Table.from_batches(held)
            k = cut(table)
            if k:
                yield sort_block(table.slice(0, k).combine_chunks())
                held = table.slice(k).combine_chunks().to_batches()
                n = table.num_rows - k
    if held:
        yield sort_block(pa.Table.from_batches(held).combine_chunks())


def string_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, start, n, a, b): two hashes of each string of the contexts."""
    hasher = Hasher()
    for batch in batches:
        for k in range(batch.num_rows):
            data = np.frombuffer(batch.column(7)[k].as_py(), np.uint8)
            s = np.arange(batch.column(4)[k].as_py())
            a = hasher.of(hasher.sums(data), s, s + LENGTH)
            b = hasher.of(hasher.sums(data ^ np.uint8(0x5A)), s, s + LENGTH)
            same = pa.array(np.full(len(s), k))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(same), batch.column(2).take(same), pa.array(s + batch.column(3)[k].as_py()), batch.column(6).take(same), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "tag", "start", "n", "a", "b"])


# ---------------------------------------------------------------- results
def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of (doc_id, text, stretches)."""
    for batch in chunks(batches, "text"):
        data, offsets = utf8(batch.column(1))
        marks = batch.column(2).to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in range(batch.num_rows):
            own = data[offsets[k] : offsets[k + 1]]
            edge = np.zeros(len(own) + 1, np.int32)
            for x in marks[k] or []:
                edge[x["begin"]] += 1
                edge[x["end"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            spans = runs(gone)
            for column, value in zip(out, (len(own), int(gone.sum()), len(spans), hashlib.sha256(own[~gone].tobytes()).hexdigest(), [{"begin": a, "end": b} for a, b in spans]), strict=True):
                column.append(value)
        shape = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], shape)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


MARK = "doc_id long, tag long, begin long, end long"


def repeated_stretches(rows: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, tag, begin, end): stretches of repeated strings, of rows doc_id, tag, text; they may overlap."""
    found = materialise(rows.mapInArrow(anchors, "doc_id long, tag long, first long, strings int, at int, gram long, context long"), "anchors")
    again = materialise(found.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"), F.min("context").alias("__a"), F.max("context").alias("__b")).where("__n > 1").select("gram", (F.col("__a") == F.col("__b")).alias("uniform")), "again")
    kept = materialise(found.join(again, "gram"), "repeated_anchors")
    drop_table(found)
    drop_table(again)
    whole = F.col("first"), F.col("first") + F.col("strings") - 1 + LENGTH
    mark = lambda df: df.select("doc_id", "tag", whole[0].alias("begin"), whole[1].alias("end"))
    mixed = kept.where("NOT uniform")
    at = F.min(F.struct("doc_id", "tag", "first", "strings", "at"))
    distinct = materialise(mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), at.alias("x")), "distinct_contexts")
    # Copies by the thousand share a context: such rows are looked up without a shuffle.
    several = lookup(mixed, distinct.where("n > 1").select("gram", "context", "n"), ["gram", "context"], "n", kept.count())
    many = materialise(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most_contexts).select("gram", F.lit(True).alias("hot")), "many")
    crowded = bool(many.limit(1).count())
    # Both sides are plain exchanges then, so that adaptive execution can split a gram's rows.
    distinct = distinct.join(many, "gram", "left") if crowded else distinct.withColumn("hot", F.lit(None).cast("boolean"))
    by_doc = distinct.groupBy(F.col("x.doc_id").alias("__id"), F.col("x.tag").alias("__tag")).agg(F.collect_list(F.struct("gram", "n", "hot", "x.first", "x.strings", "x.at")).alias("list"))
    texts = rows.join(by_doc, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.tag == F.col("__tag")))
    held = texts.select("doc_id", "tag", "text", F.explode("list").alias("c"))
    body = F.substring(F.col("text").cast("binary"), F.col("c.first").cast("int") + 1, F.col("c.strings") + LENGTH - 1)
    held = held.select(F.col("c.gram").alias("gram"), "doc_id", "tag", F.col("c.first").alias("first"), F.col("c.strings").alias("strings"), F.col("c.at").alias("at"), F.col("c.n").alias("n"), body.alias("bytes"), F.col("c.hot").alias("hot"))
    if not crowded:
        by = held.drop("hot").repartition("gram").sortWithinPartitions("gram")
        return mark(kept.where("uniform")).unionByName(mark(several)).unionByName(by.mapInArrow(sorted_stretches, MARK))
    held = materialise(held, "context_bytes")
    by = held.where("hot IS NULL").drop("hot").repartition("gram").sortWithinPartitions("gram")
    strings = materialise(held.where("hot").drop("hot").mapInArrow(string_hashes, "doc_id long, tag long, start long, n long, a long, b long"), "strings")
    twice = strings.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b")
    hot = strings.where("n = 1").join(twice, ["a", "b"], "left_semi").select("doc_id", "tag", F.col("start").alias("begin"), (F.col("start") + LENGTH).alias("end"))
    return mark(kept.where("uniform")).unionByName(mark(several)).unionByName(by.mapInArrow(sorted_stretches, MARK)).unionByName(hot)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (in bytes, end exclusive): a row for each of docs.

    Texts are UTF-8 bytes, null is empty; texts of fewer than LENGTH bytes lose nothing. Repeated rows are documents that
    repeat each other; rows that share an id keep their own bytes. Very long texts are read whole. Other columns are ignored;
    no rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    marks = repeated_stretches(rows, most_contexts)
    # A document's stretches are bounded by its length; equal ones of repeated rows fall together.
    marks = marks.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("begin", "end")).alias("stretches"))
    out = rows.join(marks, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.tag == F.col("__tag")), "left").select("doc_id", "text", "stretches")
    return out.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
