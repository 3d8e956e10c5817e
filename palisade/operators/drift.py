"""Response drift of a session: entropy, hosts, commands and argument lengths against what the session did before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions import text as tx
from palisade.functions.numbers import entropy
from palisade.operators.detectors import counts
from palisade.operators.sessions import drift

RISKY = ("curl", "wget", "bash", "sh", "python", "node", "eval", "exec")
WARM = 5


def character_entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.length(text) > 0, entropy(F.transform(counts(letters), lambda c: c.cast("double")), F.length(text).cast("double"))).otherwise(0.0)


def fixed_life(rows: DataFrame, key: str, minutes: int = 30) -> DataFrame:
    """rows with `session`: one ends `minutes` after its first row, however busy it is; rows without a time are in session 0.
    Where a session begins hangs on where the one before did, so a key's rows are followed in order, holding one time of them."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, session long"
    life = minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, start, session = False, None, None, 0
        for b in batches:
            sessions = []
            for own, at in zip(b.column(key).to_pylist(), b.column("__at").to_pylist()):
                if not begun or own != last:
                    begun, last, start, session = True, own, None, 0
                if at is not None and (start is None or at - start > life):
                    start, session = at, session + 1
                sessions.append(session)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sessions, pa.int64())], names=[*b.schema.names[:-1], "session"])

    timed = rows.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.repartition(key).sortWithinPartitions(key, "__at").mapInArrow(run, schema)


#: Rows of a session whose share in the running variance is above rounding.
REACH = 32


def argument_lengths(rows: DataFrame, key: str, as_written: bool = True) -> DataFrame:
    """rows with `arg_anomaly`: how far a length lies from the session's mean, past three deviations.

    as_written: the running variance divides by n - 1 at every step; else it is the sample variance so far.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("arg_length").cast("double")
    if as_written:
        # Every step divides all that came before by n - 1 again, so what lies REACH rows back counts 1 / REACH! at most.
        by = Window.partitionBy(key).orderBy("ts", "event_id")
        rows = rows.withColumns({"__n": F.count("*").over(w), "__m": F.avg(x).over(w)})
        off = (x - F.coalesce(F.lag("__m").over(by), F.lit(0.0))) * (x - F.col("__m"))
        rows = rows.withColumn("__c", F.struct(off.alias("c"), F.greatest(F.col("__n") - 1, F.lit(1)).alias("by")))
        near = F.collect_list("__c").over(by.rowsBetween(1 - REACH, 0))
        var = F.aggregate(near, F.lit(0.0), lambda a, v: (a + F.coalesce(v["c"], F.lit(0.0))) / v["by"])
        rows = rows.withColumn("__s", F.struct("__m", F.greatest(var, F.lit(0.0)).alias("v"), F.col("__n").alias("n"))).drop("__n", "__m", "__c")
        mean, spread, n = F.col("__s.__m"), F.sqrt(F.col("__s.v")), F.col("__s.n")
    else:
        rows = rows.withColumn("__s", F.lit(None))
        mean, spread, n = F.avg(x).over(w), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)), F.count("*").over(w)
    z = F.abs(x - mean) / F.when(spread > 0, spread).otherwise(1.0)
    return rows.withColumn("arg_anomaly", F.when((n >= WARM) & (z > 3), F.least((z - 3) * 0.3, F.lit(1.0))).otherwise(0.0)).drop("__s")


def novelty(rows: DataFrame, key: str, value: str, name: str, maturity: int, as_written: bool = True) -> DataFrame:
    """rows with a score of values that the session hadn't before, growing with its age; as written it is always 0, because
    the profile is brought up to date before it is asked."""
    if as_written:
        return rows.withColumn(name, F.lit(0.0))
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    first = F.row_number().over(Window.partitionBy(key, value).orderBy("ts", "event_id")) == 1
    n = F.row_number().over(w)
    return rows.withColumn(name, F.when((n >= WARM) & first & F.col(value).isNotNull(), F.least(n / maturity, F.lit(1.0))).otherwise(0.0))


def response_drift(calls: DataFrame, key: str, as_written: bool = True) -> DataFrame:
    """calls (key, ts, event_id, arguments) with `score` and `drifting`."""
    rows = calls.withColumn("arg_length", F.length("arguments")).withColumn("__e", character_entropy(F.col("arguments")))
    rows = rows.withColumn("__host", F.get(tx.hosts(F.col("arguments")), F.lit(0))).withColumn("__command", tx.command_prefix(F.col("arguments")))
    rows = novelty(novelty(argument_lengths(drift(rows, key, "__e"), key, as_written), key, "__host", "__d", 20, as_written), key, "__command", "__c", 15, as_written)
    risky = F.when(F.col("__command").isin(*RISKY), 1.5).otherwise(1.0)
    score = 0.35 * F.col("cusum") / 3 + 0.30 * F.col("__d") + 0.20 * 0.5 * risky * F.col("__c") + 0.15 * F.col("arg_anomaly")
    n = F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))
    out = rows.withColumn("score", F.least(F.lit(1.0), score)).withColumn("drifting", (score > 0.6) & (n >= WARM))
    return out.drop("__e", "__host", "__command", "__d", "__c")
