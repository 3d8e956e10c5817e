"""Ordered and session operators: state encoding, transition models, slopes, drift, rolling rates.

Windows partition by a session or user key. One key's rows are sorted together, which is what the semantics ask for; nothing is
collected into arrays but the last few rows of a state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.functions import rules
from palisade.functions import text as tx


def sessionise(rows: DataFrame, key: str = "user_id", minutes: int = 30, order: str = "event_id") -> DataFrame:
    """rows with `session`, counted from 1 by key. A session goes on while gaps stay below `minutes`."""
    w = Window.partitionBy(key).orderBy("ts", order)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) >= minutes * 60_000_000).cast("int"), F.lit(1))
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def kept_sessions(rows: DataFrame, key: str = "user_id", minutes: int = 60, order: str = "event_id") -> DataFrame:
    """As sessionise for state that is kept `minutes` after a key's last row: only a longer gap ends it."""
    w = Window.partitionBy(key).orderBy("ts", order)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > minutes * 60_000_000).cast("int"), F.lit(1))
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def states(actions: DataFrame, n: int = 3) -> DataFrame:
    """actions (with session) with `state`, the last n actions before, and `next`, the action itself."""
    w = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    own = F.concat("category", F.lit(":"), "sensitivity")
    before = [F.lag(own, k).over(w) for k in range(n, 0, -1)]
    state = F.concat_ws("->", *before)
    return actions.withColumn("state", F.when(state == "", "__START__").otherwise(state)).withColumn("next", own)


def transitions(stated: DataFrame) -> DataFrame:
    return stated.groupBy("state", "next").agg(F.count("*").alias("n"))


def surprise(stated: DataFrame, model: DataFrame) -> DataFrame:
    """stated with `surprise`, 0 to 1; a state that the model has not met gives 0.6."""
    totals = model.groupBy("state").agg(F.sum("n").alias("total"))
    size = model.agg(F.count_distinct("state").alias("size"))  # one row
    out = stated.join(totals, "state", "left").join(model.select("state", "next", F.col("n").alias("seen")), ["state", "next"], "left").join(F.broadcast(size))
    every = F.col("total") + F.col("size")
    value = F.least(F.lit(1.0), -F.log2((F.coalesce("seen", F.lit(0)) + 1) / every) / F.log2(every.cast("double")))
    return out.withColumn("surprise", F.when(F.col("total").isNull(), 0.6).otherwise(value)).drop("total", "seen", "size")


def threshold(scored: DataFrame, budget: float = 0.001) -> DataFrame:
    """One row: the score at the budgeted rank, 0.5 at least; 0.8 where there is no score.

    The rank is found from counts of rounded scores: the table of distinct ones stays small, however many rows were scored.
    """
    counts = scored.select(F.round("surprise", 6).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    w = Window.orderBy("s")  # over at most a million distinct values
    ranked = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.sum("n").alias("all"))
    index = F.least(F.floor(F.col("all") * (1 - budget)), F.col("all") - 1)
    found = ranked.join(F.broadcast(total)).where(F.col("upto") > index).agg(F.min("s").alias("s"))
    return found.select(F.coalesce(F.greatest("s", F.lit(0.5)), F.lit(0.8)).alias("threshold"))


def session_risk(actions: DataFrame) -> DataFrame:
    """user_id, session, risk: sensitive actions, fetches followed by writes, executions followed by sensitive writes."""
    w = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    before = F.lag("category").over(w)
    write = F.col("category") == "WRITE"
    rows = actions.withColumn("fw", (before == "FETCH") & write).withColumn("ew", (before == "EXEC") & write & (F.col("sensitivity") == "high"))
    some = lambda c: F.when(F.coalesce(F.bool_or(c), F.lit(False)), 1.0).otherwise(0.0)
    out = rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("sensitivity") == "high").alias("high"), some("fw").alias("a"), some("ew").alias("b"))
    return out.select("user_id", "session", "n", F.round(F.least(F.lit(1.0), 0.15 * F.col("high") + 0.3 * F.col("a") + 0.4 * F.col("b")), 4).alias("risk"))


def turn_features(text: Column) -> dict[str, Column]:
    n = F.size(tx.words(text))
    density = F.when(n > 0, tx.count(text, rules.DENSITY) / n).otherwise(0.0)
    count = lambda ps: sum((text.rlike(rules.js(p)).cast("int") for p in ps), F.lit(0)).cast("long")
    return {"density": density} | {k: count(ps) for k, (_, _, ps) in rules.TURN_FEATURES.items()}


def escalation(turns: DataFrame, last: int = 5) -> DataFrame:
    """turns (conv_id, turn and the features) with `score` and `anomalous`: weighted slopes over the last turns."""
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1 - last, 0)
    weights = {"density": (0.15, 0.03)} | {k: (w, ref) for k, (w, ref, _) in rules.TURN_FEATURES.items()}
    parts = []
    for name, (weight, reference) in weights.items():
        # Turns count from 0 in a frame; slopes don't depend on where they start.
        slope = F.coalesce(F.regr_slope(F.col(name).cast("double"), F.col("__i").cast("double")).over(frame), F.lit(0.0))
        parts.append(F.when(slope > 0, F.least(slope / reference, F.lit(1.0)) * weight).otherwise(0.0))
    numbered = turns.withColumn("__i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    out = numbered.withColumn("score", F.least(F.lit(1.0), sum(parts[1:], parts[0]))).drop("__i")
    return out.withColumn("anomalous", F.round("score", 6) >= 0.5)


def drift(rows: DataFrame, key: str, value: str, warm: int = 5, slack: float = 0.5) -> DataFrame:
    """rows with `cusum`: the one-sided cumulative sum of z-scores, from the fifth row of a key on.

    S = max(0, S + z - slack) equals P less the least of 0 and all P so far, where P is the running sum of z - slack: two
    windows over one sort.
    """
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spread = F.coalesce(F.nullif(F.round(F.stddev_pop(value).over(upto), 12), F.lit(0.0)), F.lit(0.1))
    z = (F.col(value) - F.avg(value).over(upto)) / spread - slack
    out = rows.withColumn("__z", F.when(F.row_number().over(w) < warm, 0.0).otherwise(z))
    out = out.withColumn("__p", F.sum("__z").over(upto))
    return out.withColumn("cusum", F.col("__p") - F.least(F.lit(0.0), F.min("__p").over(upto))).drop("__z", "__p")


def too_fast(timings: DataFrame, last: int = 20, least: int = 5, share: float = 0.8, ms: float = 100.0) -> DataFrame:
    """timings (user_id, event_id, ts, value in ms) with `automatic`: most of the last approvals came within `ms`."""
    frame = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1 - last, 0)
    fast = F.avg((F.col("value") < ms).cast("double")).over(frame)
    return timings.withColumn("automatic", (F.count("*").over(frame) >= least) & (F.round(fast, 9) > share))


def recent_rate(rows: DataFrame, key: str, seconds: int = 3600, most: int = 10) -> DataFrame:
    """rows with `recent`, the rows of the key in the hour before, and whether one more is allowed."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds, -1)
    out = rows.withColumn("__at", at).withColumn("recent", F.count("*").over(frame)).drop("__at")
    return out.withColumn("allowed", F.col("recent") < most)


def composite_memory(rows: DataFrame, key: str, text: str, seconds: int = 3600) -> DataFrame:
    """rows with `combined`, the fragments that the key wrote in the hour before, in order, and this one; null below two.

    The frame holds an hour of one key's fragments.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds, -1)
    before = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col(text).alias("x"))).over(frame))
    out = rows.withColumn("__at", at).withColumn("__b", before).drop("__at")
    joined = F.array_join(F.concat(F.transform("__b", lambda s: s["x"]), F.array(text)), "\n")
    return out.withColumn("fragments", F.size("__b").cast("long")).withColumn("combined", F.when(F.size("__b") >= 2, joined)).drop("__b")
