"""Integrity: hash chains, changed files, contexts and paths."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions import rules
from palisade.functions.text import hmac_sha256

GENESIS, ROTATED = "GENESIS", "ROTATED"


def link(previous: Column, entry: Column, key: bytes) -> Column:
    return hmac_sha256(key, F.concat_ws(":", previous, entry))


def verify_chain(log: DataFrame, key: bytes, by: str, order: str = "seq") -> DataFrame:
    """log (entry, prev, chain) with `broken` and why: the link before isn't the one named, or the hash isn't the entry's."""
    before = F.lag("chain", 1, GENESIS).over(Window.partitionBy(by).orderBy(order))
    wrong = F.when((F.col("prev") != before) & (F.col("prev") != ROTATED), "link").when(F.col("chain") != link(F.col("prev"), F.col("entry"), key), "hash")
    return log.withColumn("reason", wrong).withColumn("broken", F.col("reason").isNotNull())


def write_chain(entries: DataFrame, key: bytes, by: str, order: str = "seq") -> DataFrame:
    """entries (with `entry`, the reply's hash and time) with `prev` and `chain`: each log's links in order, from GENESIS on; a
    null entry links to the hash before alone. A log is a chain, so one task follows it, but holds one hash of it, not its rows."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in entries.schema.fields)}, prev string, chain string"
    start = GENESIS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, before, begun = None, start, False
        for b in batches:
            prev, chain = [], []
            for own, entry in zip(b.column(by).to_pylist(), b.column("entry").to_pylist()):
                if not begun or own != log:
                    log, before, begun = own, start, True
                prev.append(before)
                text = before if entry is None else f"{before}:{entry}"
                before = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
                chain.append(before)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(chain, pa.string())], names=[*b.schema.names, "prev", "chain"])

    return entries.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def recent_fragments(fragments: DataFrame, key: bytes, now: Column, minutes: int = 60) -> DataFrame:
    """Fragments (ts, text, sig) younger than `minutes` that nobody changed: the signature is the text's, or there is none."""
    signed = F.nullif("sig", F.lit(""))
    own = signed.isNull() | (signed == hmac_sha256(key, F.coalesce("text", F.lit(""))))
    return fragments.where((F.unix_micros(F.col("ts").cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - minutes * 60_000_000) & own)


def modified(files: DataFrame, by: str = "path") -> DataFrame:
    """path, versions, changes: how often a file's content differs from the version before."""
    before = F.lag("sha").over(Window.partitionBy(by).orderBy("ts", "event_id"))
    return files.withColumn("__c", (F.col("sha") != before).cast("int")).groupBy(by).agg(F.count("*").alias("versions"), F.coalesce(F.sum("__c"), F.lit(0)).alias("changes"))


def sensitivity(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.rlike(rules.js(rules.HIGH_PATHS)), "high").when(p.rlike(rules.js(rules.MEDIUM_PATHS)), "medium").otherwise("low")


def context(tool: Column, path: Column) -> Column:
    """Where a tool's text comes from: the first rule that fits."""
    has = lambda p: tool.rlike("(?i)" + p)
    return (
        F.when(has("webfetch|fetch_url|browser"), "web_fetch").when(has("^read$") & path.rlike(r"(?i)\.pdf$"), "pdf_read").when(has("mail|slack|calendar"), "email")
        .when(has("knowledge|search_docs"), "knowledge_query").when(tool.startswith("mcp__"), "mcp_external").when(has("bash|execute|run_code"), "bash_output").otherwise("general")
    )


def last_message(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, turn, text: each conversation's last message of a role that has a text."""
    own = turns.where((F.col("role") == role) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return own.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
