"""The learning cycle: every stage over the log, one row a stage; a stage that fails is reported and doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from palisade.operators import reports, tuning


def learning_cycle(spark: SparkSession, detections: DataFrame, feedback: DataFrame, evaluations: DataFrame, scans: DataFrame) -> DataFrame:
    """(stage, status, rows). Each stage's result is small; its rows are counted on the executors."""
    stages: list[tuple[str, Callable[[], DataFrame]]] = [
        ("ingest", lambda: detections),
        ("analytics", lambda: reports.detector_hits(detections)),
        ("overrides", lambda: reports.overrides(feedback, 1)),
        ("tuning", lambda: tuning.adjustments(tuning.tuning_stats(feedback))),
        ("ab_tests", lambda: tuning.recommendation(tuning.confusion(evaluations))),
        ("health", lambda: reports.health_buckets(scans)),
        ("federated", lambda: detections.where("max_severity >= 7")),
        ("feedback", lambda: reports.feedback_pivot(feedback)),
    ]
    out = []
    for name, stage in stages:
        try:
            out.append((name, "ok", stage().count()))
        except PySparkException as e:
            out.append((name, type(e).__name__, None))
    return spark.createDataFrame(out, "stage string, status string, n long")


def session_summary(rows: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """The k commonest values of each key; counts first, so a busy key is no large group."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    by = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return by.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
