"""Learning from feedback: threshold tuning, shadow-rule tests, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.numbers import beta_lower, beta_mean, clamp, ratio

#: Least feedback, step, floors and ceilings of tuning.
LEAST, STEP, NO_CHANGE = 20, 0.15, 0.001
DEFAULT, FLOOR, CEILING = 0.5, 0.2, 0.95


def tuning_stats(feedback: DataFrame, least: int = LEAST) -> DataFrame:
    of = lambda kind: F.count_if(F.col("feedback_type") == kind)
    out = feedback.groupBy("detector").agg(of("confirmed_true").alias("tp"), of("false_positive").alias("fp"), of("false_negative").alias("fn"), F.count("*").alias("total"))
    return out.where(F.col("total") >= least)


def direction() -> Column:
    """Which way a threshold should go, and how hard."""
    fp_rate, tp_rate = F.col("fp") / F.col("total"), F.col("tp") / F.col("total")
    return F.when((fp_rate > 0.5) & (F.col("total") >= 40), 1.0).when((fp_rate > 0.3) & (F.col("total") >= 20), 0.5).when(F.col("fn") > F.col("tp"), -1.0).when(tp_rate > 0.9, -0.3).otherwise(0.0)


def adjustments(stats: DataFrame, current: Column | float = DEFAULT) -> DataFrame:
    """The new threshold of each detector whose threshold should change."""
    delta = F.signum("direction") * F.least(F.abs(F.col("direction") * STEP * F.abs(0.5 - F.col("posterior"))), F.lit(STEP))
    out = stats.withColumn("direction", direction()).withColumn("posterior", beta_mean("tp", "fp"))
    out = out.withColumn("new_threshold", F.round(clamp(delta + current, FLOOR, CEILING), 6))
    return out.where(F.abs(F.col("new_threshold") - current) >= NO_CHANGE).withColumn("posterior", F.round("posterior", 6))


def posteriors(stats: DataFrame) -> DataFrame:
    return stats.select("detector", "tp", "fp", F.round(beta_mean("tp", "fp"), 6).alias("mean"), F.round(beta_lower("tp", "fp"), 6).alias("lower"))


def confusion(evaluations: DataFrame) -> DataFrame:
    """What each shadow rule would have done, against production."""
    w, p = F.col("would_fire"), F.col("production_fired")
    out = evaluations.groupBy("test_id").agg(F.count("*").alias("total"), F.count_if(w & p).alias("both"), F.count_if(w & ~p).alias("shadow_only"), F.count_if(~w & p).alias("production_only"), F.count_if(~w & ~p).alias("neither"), F.count_if(w).alias("fires"))
    return out.withColumn("fire_rate", ratio("fires", "total", 4)).withColumn("additional_rate", ratio("shadow_only", "total", 4))


def recommendation(matrix: DataFrame) -> DataFrame:
    extra, fire = F.col("additional_rate"), F.col("fire_rate")
    says = F.when(F.col("total") < 50, "insufficient_data").when(extra > 0.10, "retire").when((extra < 0.02) & (fire > 0.01), "promote").when(extra < 0.05, "promising").otherwise("monitor")
    return matrix.select("test_id", "total", "fire_rate", "additional_rate", says.alias("recommendation"))


def against_feedback(evaluations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Evaluations left-joined with feedback on the content's hash; contents judged several times count as often."""
    by = feedback.select("content_hash", "feedback_type")
    # Both sides are added up by hash first: a hash that is common on both makes one row, not their product.
    left = evaluations.groupBy("test_id", "content_hash").agg(F.count("*").alias("n"), F.count_if("would_fire").alias("fires"))
    right = by.groupBy("content_hash").agg(F.count("*").alias("m"), *[F.count_if(F.col("feedback_type") == k).alias(k) for k in ("false_positive", "confirmed_true", "false_negative")])
    out = left.join(right, "content_hash", "left").na.fill(0, ["false_positive", "confirmed_true", "false_negative"])
    times = lambda k: F.sum(F.col("fires") * F.col(k)).alias(f"fires_{k}")
    return out.groupBy("test_id").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(1))).alias("pairs"), times("false_positive"), times("confirmed_true"), times("false_negative"), F.sum(F.when(F.col("m").isNull(), F.col("n")).otherwise(0)).alias("unjudged"))


def shadow_evaluation(contents: DataFrame, rules: list[tuple[str, str, object]], text: str = "text") -> DataFrame:
    """Which shadow rules fire on each content: (rule, kind, config), kind regex, threshold or signature.

    Rules are few and known when the query is planned, so each is an expression over the row and no join takes place.
    """

    def fires(kind: str, config: object) -> Column:
        if kind == "regex":
            return F.col(text).rlike(str(config))
        if kind == "threshold":
            column, least = config  # type: ignore[misc]
            return F.col(column) >= least
        out = F.lit(False)
        for word in config:  # type: ignore[union-attr]
            out = out | F.contains(F.lower(text), F.lit(word))
        return out

    tests = F.array(*[F.struct(F.lit(name).alias("rule"), fires(kind, config).alias("fires")) for name, kind, config in rules])
    return contents.withColumn("t", F.explode(tests)).select("*", "t.rule", "t.fires").drop("t")
