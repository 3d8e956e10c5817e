"""What the corpus operators share: scratch tables, UTF-8 views of Arrow columns, word hashing, skew-proof lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import delete, scratch, shared_dir  # noqa: F401

#: Rows of a side that may be broadcast: groups that hold over 1/HEAVY of the rows are fewer than this.
HEAVY = 1000


# ---------------------------------------------------------------- scratch tables
def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing will read again."""
    delete(df.sparkSession, df._palisade_path)


# ---------------------------------------------------------------- skew
def lookup(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows joined with groups, which has one row a key and the number of its rows in `size`; no key may make a large task.

    Keys with over total / HEAVY of the rows number fewer than HEAVY, so they are broadcast, and their rows stay where they
    are; any other key is too small to make a partition of the sort-merge join stand out. Both sides are read twice: pass
    materialised tables. Null keys join nothing.
    """
    keys = [key] if isinstance(key, str) else key
    most = max(1, total // HEAVY)
    heavy, light = groups.where(F.col(size) > most), groups.where(F.col(size) <= most)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge"), keys))


# ---------------------------------------------------------------- columns
def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- Arrow
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes (uint8) and row offsets (int64); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece has one row, or `most` bytes of text at most: bounds the memory of array code."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


# ---------------------------------------------------------------- words and hashes
def byte_class(inside: Callable[[int], bool]) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z, as UTF-8 bytes.
ALNUM = byte_class(lambda b: b >= 128 or chr(b).isalnum() and not chr(b).isupper())
#: [^\x20\x09-\x0D], as UTF-8 bytes.
NOT_SPACE = byte_class(lambda b: b not in b" \t\n\x0b\x0c\r")
#: A-Z lower-cased, byte by byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    at = 1
    while at < n:
        end = min(n, 2 * at)
        out[at:end] = out[: end - at] * np.uint64(pow(base, at, 1 << 64))
        at = end
    return out


class Hasher:
    """Hashes of substrings, from the differences of one running sum; the powers are kept between calls."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1), powers(BASE, 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            n = max(len(data) + 1, 1 << 18)
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a column of texts: their hashes, starts and ends in data, and the first word of each row (and the end)."""
    data = LOWER[data]
    mask = inside[data]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return hasher.of(hasher.sums(data), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; runs over the ends of rows must be left out by the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + hashes[j : j + n]
    return mix(out + np.uint64(k))
