"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. New rows are reduced to one row a digest, held against it by
a sort-merge anti-join, and what is new is appended. Only DataFrame functions run. Decisions are made on digests alone;
texts are shuffled once, and only where whole rows are returned (survivors).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import delete, free_name, lookup, materialise, scratch, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): the SHA-256 of each normalised text as 32 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """digest, keep_id, batch: one row for each distinct text seen, bucketed and sorted by digest.

    `path` is its folder in shared storage. A batch's name makes its append safe to repeat: rows of a batch that is already
    there aren't added twice, because the anti-join finds them.
    """

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = 64) -> None:
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets

    def create(self, id_type: str = "bigint") -> None:
        """An empty table where there is none, so that every batch, the first one too, is held against an index."""
        if not self.spark.catalog.tableExists(self.table):
            self._write(self.spark.createDataFrame([], f"digest binary, keep_id {id_type}, batch string"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def new(self, groups: DataFrame) -> DataFrame:
        """Of rows with distinct digests, those whose digest the index lacks."""
        self.create(dict(groups.dtypes).get("keep_id", "bigint"))
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds (digest, keep_id) rows that are new. A batch has one writer at a time."""
        out = self.new(groups).select("digest", "keep_id", F.lit(batch).alias("batch"))
        # One task writes one bucket: as many files a batch as there are buckets.
        self._write(out.repartition(self.buckets, "digest"))

    def _write(self, rows: DataFrame) -> None:
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def drop(self) -> None:
        """Takes the table out of the catalogue and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.path:
            delete(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends docs to the index; returns doc_id, keep_id, group_size, kept, text_sha256 for every row.

    keep_id is the row that stays: an older batch's where the index has the text, else the smallest id of this batch. A row is
    kept if it has that id and the index took the text from this batch: a batch that is fed again gets the same answer, and
    its rows under another batch's name keep nothing. group_size counts this batch's rows with the text. Null and empty texts
    are equal to each other, and to no text of white space (that is one space). Rows that share an id and a text share their
    decision. Null ids stay only where no row of their text has an id. No rows give no rows. Other columns are ignored.
    """
    found = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(found.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    index.append(groups, batch)
    known = index.rows().select("digest", "keep_id", (F.col("batch") == batch).alias("own"))
    kept = materialise(groups.drop("keep_id").join(known.hint("merge"), "digest"), "kept")
    out = lookup(found, kept, "digest", "group_size", found.count())
    stays = F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, index: DigestIndex, batch: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each text, and none of a text that another batch brought before.

    Rows meet their decision by one key of id and text, so texts are shuffled once, and copies of a text by the million are
    spread by their ids. Of repeated rows one stays.
    """
    name = free_name(docs, "__key")
    key = lambda i, sha: F.concat_ws(":", sha, i.cast("string"))  # noqa: E731  (a null id leaves the digest alone)
    kept = deduplicate(docs, index, batch, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, key(F.col(id_col), F.sha2(normalised(text_col).cast("binary"), 256)))
    return rows.dropDuplicates([name]).join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch(spark, "digest_index"), n)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)
    index.drop()  # the result reads the decisions, which are written
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
