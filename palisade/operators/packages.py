"""Package integrity: names in install commands, and names one slip away from a known one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ecosystem -> what follows its install commands.
INSTALLERS = {"pypi": r"\bpip3?\s+install\s+([^|;&\n]+)", "npm": r"\b(?:npm\s+(?:install|i|add)|yarn\s+add|pnpm\s+add)\s+([^|;&\n]+)", "crates": r"\bcargo\s+(?:add|install)\s+([^|;&\n]+)", "gems": r"\bgem\s+install\s+([^|;&\n]+)"}
#: An @ that comes first is part of the name; gems have versions behind a colon.
VERSION = r"(?:\[[^\]]*\])?(?:[=<>~!].*|:\d.*|(?<=.)@.*)?$"

#: Options whose value is no package.
VALUES = {"gems": r"(?:^|\s)(?:-v|--version)[\s=]+\S+"}


def installed(commands: DataFrame) -> DataFrame:
    """(id, ecosystem, package): one row for each package that a command installs, without versions, extras and options."""
    parts = F.array(*[F.struct(F.lit(e).alias("ecosystem"), F.flatten(F.transform(F.regexp_extract_all("command", F.lit(p), F.lit(1)), lambda x: F.split(F.trim(F.regexp_replace(x, VALUES[e], " ") if e in VALUES else x), r"\s+"))).alias("names")) for e, p in INSTALLERS.items()])
    out = commands.withColumn("e", F.explode(parts)).select("id", "e.ecosystem", F.explode("e.names").alias("name"))
    return out.where("name <> '' AND NOT startswith(name, '-')").select("id", "ecosystem", F.lower(F.regexp_replace("name", VERSION, "")).alias("package"))


def verdicts(found: DataFrame, known: dict[str, list[str]], malicious: tuple[str, ...] = (), allowed: tuple[str, ...] = ()) -> DataFrame:
    """(id, ecosystem, package, near, distance, severity): 0 for known and unheard-of names, 9 and 8 for those one or two
    letters from a known one (the nearest; on a tie, the first in the list), 10 for malicious ones.

    The known names are a few hundred words: an array in the expression, not a join.
    """
    spark = found.sparkSession
    table = spark.createDataFrame([(e, names) for e, names in known.items()], "ecosystem string, names array<string>")
    out = found.where(~F.col("package").isin(*allowed)) if allowed else found
    out = out.join(F.broadcast(table), "ecosystem", "left")
    close = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda k, i: F.struct(F.levenshtein(F.col("package"), k, 2).alias("d"), i.alias("i"), k.alias("k"))), lambda x: x["d"] >= 0)
    out = out.withColumn("best", F.array_min(close))
    distance = F.col("best.d")
    severity = F.when(F.col("package").isin(*malicious), 10).when(distance == 1, 9).when(distance == 2, 8).otherwise(0) if malicious else F.when(distance == 1, 9).when(distance == 2, 8).otherwise(0)
    return out.select("id", "ecosystem", "package", F.when(distance > 0, F.col("best.k")).alias("near"), F.coalesce(distance, F.lit(-1)).cast("long").alias("distance"), severity.cast("long").alias("severity"))


def oracle(known: dict[str, list[str]]) -> str:
    """The verdicts on the test commands' packages, which the SQL lists."""
    found = [(0, "pypi", "requests"), (0, "pypi", "flask"), (1, "pypi", "reqeusts"), (1, "pypi", "numpyy"), (2, "npm", "expresss"), (2, "npm", "react"), (3, "npm", "lodahs"), (4, "pypi", "pandas"), (4, "pypi", "unknownpkg"), (5, "npm", "axois"), (5, "npm", "chalk"), (6, "pypi", "djnago"), (7, "crates", "serde")]
    rows = ", ".join(f"({i}, '{e}', '{p}')" for i, e, p in found)
    names = ", ".join(f"('{e}', '{n}', {i})" for e, ns in known.items() for i, n in enumerate(ns))
    return f"""WITH p AS (SELECT * FROM (VALUES {rows}) v(id, ecosystem, package)), k AS (SELECT * FROM (VALUES {names}) v(ecosystem, name, i)),
j AS (SELECT p.*, name, levenshtein(package, name) AS d, i FROM p LEFT JOIN k ON p.ecosystem = k.ecosystem AND levenshtein(package, name) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY id, ecosystem, package ORDER BY d, i) AS r FROM j)
SELECT CAST(id AS BIGINT) AS id, ecosystem, package, CASE WHEN d > 0 THEN name END AS near, coalesce(d, -1) AS distance, CAST(CASE d WHEN 1 THEN 9 WHEN 2 THEN 8 ELSE 0 END AS BIGINT) AS severity FROM b WHERE r = 1"""
