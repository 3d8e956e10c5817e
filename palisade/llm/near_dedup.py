"""Near-duplicate documents: MinHash bands, odd sketches, and exact confirmation.

1. Documents with the same set of word shingles are one node. 2. Nodes that agree in a band of MinHash values meet. 3. In a
meeting, odd sketches (parity bitmaps of many MinHash samples) are compared by XOR and population count; pairs whose estimate
could belong to the threshold join a cluster. 4. In a cluster all pairs are intersected on their full sets. 5. Components of
the confirmed links. Meetings and clusters beyond a size are cut into chunks that meet pairwise, so no task holds an unbounded
group; what leaves a task is a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import NOT_SPACE, Hasher, chunks, drop_table, free_name, grams, lookup, materialise, mix, utf8, words
from palisade.llm.components import components

SHINGLE = 5
PERCENT = 75
#: A pair at the threshold agrees in a given band with chance .75 ** 3; it misses all of 40 once in 3e9.
BANDS, ROWS = 40, 3
#: MinHash samples and bits of an odd sketch.
SAMPLES, BITS = 1024, 2048
#: Members of a meeting, and shingles of a cluster, that a chunk holds; a chunk has a member at least.
MEETING, CLUSTER = 2048, 200_000


# ---------------------------------------------------------------- sketches
def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; with fewer words than a shingle has, all of them as one."""
    h, _, _, firsts = words(data, offsets, NOT_SPACE, hasher)
    g, out = grams(h, SHINGLE), []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(h[a:b], b - a) if b > a else h[:0])
    return out


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation; shingles must not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // len(a))
    for k in range(0, len(x), step):
        np.minimum(out, (x[k : k + step, None] * a + b).min(0), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """BITS parities as uint64 words: each (place, sample) flips one bit."""
    bit = (mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_bits(percent: int = PERCENT, sigmas: float = 5.0) -> int:
    """The XOR's population count that a pair at the threshold stays below, but for chance at so many deviations."""
    j = percent / 100
    flips = 2 * SAMPLES * (1 - j)
    mean = BITS / 2 * (1 - np.exp(-2 * flips / BITS))
    spread = np.sqrt((2 * np.exp(-2 * flips / BITS)) ** 2 * SAMPLES * j * (1 - j) + BITS / 4 * (1 - np.exp(-4 * flips / BITS)))
    return int(np.ceil(mean + sigmas * spread))


# ---------------------------------------------------------------- what runs on executors
def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, n, node, bands) of (doc_id, tag, text)."""
    hasher, (a, b) = Hasher(), permutations(BANDS * ROWS, 1)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in chunks(batches, "text"):
        sets = shingle_sets(*utf8(batch.column(2)), hasher)
        nodes, bands = [], []
        for s in sets:
            if not len(s):
                nodes.append(None)
                bands.append([])
                continue
            twice = np.array([s.sum(), mix(s).sum()], np.uint64)
            nodes.append(twice.tobytes() + len(s).to_bytes(4, "little"))
            m = minhash(s, a, b).reshape(BANDS, ROWS).astype(np.uint64)
            key = salt
            for k in range(ROWS):
                key = mix(key + m[:, k])
            bands.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "tag", "n", "node", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, shingles, sketch) of (node, text)."""
    hasher, (a, b) = Hasher(), permutations(SAMPLES, 2)
    for batch in chunks(batches, "text"):
        sets = shingle_sets(*utf8(batch.column(1)), hasher)
        sketches = [odd_sketch(minhash(s, a, b)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "n", "shingles", "sketch"])


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same first two columns, in a partition sorted by them; each is bounded by the chunks' size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = (a[start], b[start])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        return [(k, r) for k in range(len(self.up)) if (r := self.root(k)) != k]


def linked(nodes: list[bytes], forest: Forest) -> pa.RecordBatch:
    found = forest.edges()
    return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.binary()), pa.array([nodes[b] for _, b in found], pa.binary())], ["a", "b"])


def meetings(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): a forest of the pairs in each meeting whose sketches differ in `most` bits at most.

    Rows: key, block, side, node, n, sketch. In a block of two chunks (sides 0 and 1) pairs within a side are left out but in
    a block of one chunk (side -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            m = t.num_rows
            nodes, n, side = t.column(3).to_pylist(), t.column(4).to_numpy(), t.column(2).to_numpy()
            words_ = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(m, -1)
            forest = Forest(m)
            for i in range(m - 1):
                rest = words_[i + 1 :]
                near = (np.bitwise_count(rest ^ words_[i]).sum(1) <= most) & (100 * np.minimum(n[i + 1 :], n[i]) >= PERCENT * np.maximum(n[i + 1 :], n[i]))
                if side[i] >= 0:
                    near &= side[i + 1 :] != side[i]
                for j in np.flatnonzero(near).tolist():
                    forest.join(i, i + 1 + j)
            yield linked(nodes, forest)

    return run


def confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): a forest of the pairs in each block of a cluster whose full sets are similar enough.

    Rows: cluster, block, side, node, n, shingles. Every pair is intersected, but for pairs that are joined already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            m = t.num_rows
            nodes, n, side = t.column(3).to_pylist(), t.column(4).to_numpy(), t.column(2).to_numpy()
            flat = t.column(5).combine_chunks()
            shingles = flat.flatten().to_numpy()
            row = np.repeat(np.arange(m), n)
            # Each shingle's number, and for each number the rows that hold it.
            _, number = np.unique(shingles, return_inverse=True)
            order = np.argsort(number, kind="stable")
            holders, starts = row[order], np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
            first = np.concatenate([[0], np.cumsum(n)])
            forest = Forest(m)
            for i in range(m - 1):
                own = number[first[i] : first[i + 1]]
                low, size = starts[own], starts[own + 1] - starts[own]
                index = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                both = np.bincount(holders[index], minlength=m)
                near = 100 * both >= percent * (n + n[i] - both)
                near[: i + 1] = False
                if side[i] >= 0:
                    near &= side != side[i]
                for j in np.flatnonzero(near).tolist():
                    forest.join(i, j)
            yield linked(nodes, forest)

    return run


# ---------------------------------------------------------------- plans
def in_blocks(members: DataFrame, key: str, chunks_of: str, columns: list[str]) -> DataFrame:
    """The members of each key, as blocks of two chunks; a key of one chunk is a block with side -1.

    chunks_of: how many chunks the key is cut into. Each member goes to as many blocks as there are chunks.
    """
    n = F.col(chunks_of)
    own = F.pmod(F.xxhash64("node"), n)
    other = F.explode(F.when(n > 1, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    rows = members.withColumn("__own", own).withColumn("__other", other)
    block = F.least("__own", "__other") * n + F.greatest("__own", "__other")
    # In the block of a chunk with itself all pairs count; with another chunk, those across.
    side = F.when(F.col("__own") == F.col("__other"), F.lit(-1)).otherwise((F.col("__own") > F.col("__other")).cast("int"))
    return rows.select(F.col(key).alias("key"), block.cast("long").alias("block"), side.cast("int").alias("side"), *columns)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles, component_id, tag, root, kept: a row for each of docs; tag is xxhash64 of the text, root the
    component's own key (null without shingles), as components without an id, or with one id, are still different ones.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows with equal sets are
    linked, however many. Rows that share an id keep their own sets; the smallest id of a component stands for it. A row
    without an id belongs to its component too, and has a null component_id only where no row of it has an id. Very long
    texts are read whole. Other columns are ignored; no rows give no rows.
    """
    edges_shape = "a binary, b binary"
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(rows.mapInArrow(signatures, "doc_id long, tag long, n long, node binary, bands array<long>"), "signatures")
    real = signed.where("node IS NOT NULL")
    first = F.min(F.struct("doc_id", "tag"))
    nodes = materialise(real.groupBy("node").agg(F.min("doc_id").alias("least"), first.alias("at"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")), "nodes")

    met = nodes.select("node", F.explode("bands").alias("key"))
    full = materialise(met.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "keys")
    met = materialise(lookup(met, full, "key", "members", BANDS * nodes.count()).select("key", "node", "members"), "met")
    wanted = met.select("node").distinct().join(nodes.select("node", "at"), "node")
    wanted = wanted.select("node", F.col("at.doc_id").alias("__id"), F.col("at.tag").alias("__tag"))
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.tag == F.col("__tag"))).select("node", "text")
    sets = materialise(texts.mapInArrow(full_sets, "node binary, n long, shingles array<long>, sketch binary").dropDuplicates(["node"]), "sets")

    n_chunks = F.ceil(F.col("members") / meeting)
    held = in_blocks(met.join(sets.select("node", "n", "sketch"), "node").withColumn("__c", n_chunks), "key", "__c", ["node", "n", "sketch"])
    by = held.repartition("key", "block").sortWithinPartitions("key", "block")
    clusters = materialise(components(by.mapInArrow(meetings(most_bits(percent)), edges_shape)), "clusters")
    drop_table(met)

    sizes = clusters.join(sets.select("node", "n"), "node").groupBy("root").agg(F.least(F.ceil(F.sum("n") / cluster), F.count(F.lit(1))).alias("__c"), F.count(F.lit(1)).alias("members"))
    own = lookup(clusters, materialise(sizes, "sizes"), "root", "members", clusters.count())
    held = in_blocks(own.join(sets.select("node", "n", "shingles"), "node"), "root", "__c", ["node", "n", "shingles"])
    by = held.repartition("key", "block").sortWithinPartitions("key", "block")
    found = materialise(components(by.mapInArrow(confirmed(percent), edges_shape)), "components")
    drop_table(sets)

    ids = materialise(nodes.select("node", "size", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "ids")
    least = materialise(ids.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    named = materialise(lookup(ids, least, "root", "members", ids.count()).select("node", "size", "component_id", "root"), "named")
    total = signed.count()
    out = lookup(real.select("doc_id", "n", "node", "tag"), named, "node", "size", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "tag", "root")
    alone = signed.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "tag", F.lit(None).cast("binary").alias("root"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component, and all without shingles."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept")
    one = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select("x.doc_id", "x.tag")
    own_id, own_tag = free_name(docs, "__id"), free_name(docs, "__tag")
    stay = one.unionByName(found.where("n_shingles = 0").select("doc_id", "tag").distinct()).select(F.col("doc_id").alias(own_id), F.coalesce("tag", F.lit(0).cast("long")).alias(own_tag))
    # Nulls have a tag of their own.
    tag = F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0).cast("long"))
    return docs.join(stay, F.col(id_col).try_cast("long").eqNullSafe(F.col(own_id)) & (tag == F.col(own_tag)), "left_semi")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag", "root")
