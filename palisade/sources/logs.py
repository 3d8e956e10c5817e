"""Sources and sinks of the detection log, feeds and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A log line: any field may be missing.
LINE = "ts string, hook string, tool string, source string, layer string, maxSev int, severity int, detections int, findings array<string>, confidence double, latencyMs int, command string, url string, reason string, error string"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Detection rows of JSON lines; what is no JSON object is left out. Defaults: layer by error and confidence, severity 0, a
    latency of 0 is unknown."""
    rows = lines.withColumn("j", F.from_json(column, LINE)).where(F.col(column).rlike(r"^\s*\{") & F.col("j").isNotNull())
    layer = F.when(F.col("j.error").isNotNull(), "fatal_error").when(F.col("j.confidence").isNotNull(), "semantic").otherwise("regex")
    return rows.select(
        F.to_timestamp("j.ts").alias("ts"), F.coalesce("j.hook", F.lit("unknown")).alias("hook"), F.col("j.tool").alias("tool"), F.col("j.source").alias("source"),
        F.coalesce("j.layer", layer).alias("layer"), F.coalesce(F.nullif("j.maxSev", F.lit(0)), "j.severity", F.lit(0)).alias("max_severity"),
        F.coalesce("j.detections", F.size("j.findings"), F.lit(0)).alias("detection_count"), F.to_json(F.coalesce("j.findings", F.array().cast("array<string>"))).alias("findings"),
        F.col("j.confidence").alias("confidence"), F.nullif("j.latencyMs", F.lit(0)).alias("latency_ms"), F.col("j.command").alias("command"), F.col("j.url").alias("url"), F.col("j.reason").alias("reason"), F.col("j.error").alias("error"),
    )


def backfill(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the logs that a path or pattern names."""
    return parsed(spark.read.text(path))


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream: rows of files that appear in a folder."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r", r"\\\\r"), "\n", r"\\\\n")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; line breaks within strings are escaped."""
    plain = {f.name: one_line(F.col(f.name)) for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    rows.withColumns(plain).write.mode("append").json(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str, order: str) -> None:
    """Writes a new version of a table, in which the latest row of each key stands: path must not be read meanwhile. The version
    before is moved aside until the new one is in its place; a call that finds a move unfinished brings it back first."""
    recover(spark, path)
    old = spark.read.parquet(path) if exists(spark, path) else rows.limit(0)
    newest = old.unionByName(rows).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    newest.write.mode("overwrite").parquet(path + ".next")
    swap(spark, path + ".next", path)


def files(spark: SparkSession, *paths: str):  # noqa: ANN201
    """The file system of the first path, and the paths in its form."""
    jvm = spark.sparkContext._jvm
    own = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return own[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *own


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = files(spark, path)
    return fs.exists(where)


def move(fs, a, b) -> None:  # noqa: ANN001
    if not fs.rename(a, b):
        raise OSError(f"{a} can't be renamed to {b}")


def recover(spark: SparkSession, path: str) -> None:
    """After a swap that was cut short: the version before where none is in its place, else that one is no longer needed."""
    fs, where, before = files(spark, path, path + ".before")
    if fs.exists(before) and not fs.exists(where):
        move(fs, before, where)
    fs.delete(before, True)


def swap(spark: SparkSession, new: str, path: str) -> None:
    fs, a, b, before = files(spark, new, path, path + ".before")
    if fs.exists(b):
        move(fs, b, before)
    move(fs, a, b)
    fs.delete(before, True)


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md,html}", longer_than: int = 50) -> DataFrame:
    """path, text: the files of a folder and those below it; names that start with a dot or underscore are left out by Spark."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    out = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out.where((F.length("text") > longer_than) & ~F.contains("path", F.lit("/node_modules/")))


def json_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines feed with the columns that operators.corpus.feed wants; missing ones are null."""
    wanted = "text string, prompt string, content string, input string, label string, is_injection string, class string"
    return spark.read.schema(wanted).json(path)


def csv_feed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("text", "prompt", "content", "input", "label", "is_injection", "class")])
