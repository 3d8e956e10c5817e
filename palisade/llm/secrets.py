"""Secret scans: fixed patterns, and a battery of randomness tests over token-like strings.

Base spans come from three patterns. Beside them, every string of 20 or more symbols of base64 or its URL form that holds a
digit and a letter is a candidate. Its encoding is inferred from its symbols (hex, base32, base62 or base64), and three tests
ask whether it could be random in that alphabet: chi-squared uniformity of its symbols, the number of runs about the middle of
the alphabet, and the correlation of neighbours. Candidates are many and short ones are hard to reject, so rejections follow
the Benjamini-Hochberg rule within each class of length, over all documents: what is rejected is text, what is left is random
and is reported. Only built-in functions run; texts are read once, and the rule's table has a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from palisade.llm.common import materialise, text_or_empty
from palisade.llm.native import let, matches

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,rank:int,end:int>>"
FOUND = "array<struct<start:int,rank:int,end:int,class:int,bin:int>>"
#: P-values are counted in bins of a quarter of a power of ten; the last holds all smaller ones.
BINS, PER_TEN = 64, 4
#: Length classes are powers of two; the last holds all longer candidates.
CLASSES = 12


def span(rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"))


def kept_spans(text: Column, gate: str, pattern: str, rank: int, test: Callable[[Column], Column] | None = None) -> Column:
    found = matches(text, F.lit(pattern), lambda m, s, e: F.when(test(m), span(rank, s, e)) if test else span(rank, s, e))
    return F.when(text.rlike(gate), F.array_compact(found)).otherwise(F.array().cast(SPAN))


# ---------------------------------------------------------------- tests
def normal_tail(z: Column) -> Column:
    """P(|Z| > z) for z >= 0, by a rational approximation good to 2e-7; below that, by the tail's leading term."""
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z < 4, poly * F.exp(-z * z / 2)).otherwise(0.79788456 * F.exp(-F.least(z * z, F.lit(1400.0)) / 2) / z)


def chi_squared_p(count_squares: Column, n: Column, k: Column) -> Column:
    """Upper tail of the uniformity statistic for n symbols of an alphabet of k, by the cube-root normal approximation."""
    df = k - 1
    x = k * count_squares / n - n
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(z <= 0, F.lit(1.0) - normal_tail(-z) / 2).otherwise(normal_tail(z) / 2)


def runs_p(symbols: Column, n: Column, k: Column) -> Column:
    """Two-sided test of the number of runs below and above the alphabet's middle."""
    high = F.transform(symbols, lambda x: (2 * x >= k).cast("int"))

    def of(h: Column) -> Column:
        n1 = F.aggregate(h, F.lit(0), lambda a, x: a + x).cast("double")
        n0 = n - n1
        changes = F.aggregate(F.zip_with(h, F.slice(h, 2, 1 << 30), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        expected = 2 * n1 * n0 / n + 1
        spread = F.sqrt(2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1)))
        return F.when((n1 == 0) | (n0 == 0), F.pow(F.lit(0.5), n - 1)).when(spread > 0, normal_tail(F.abs(changes + 1 - expected) / spread)).otherwise(F.lit(1.0))

    return let(high, of)


def serial_p(symbols: Column, n: Column, k: Column) -> Column:
    """Two-sided test of the correlation of neighbouring symbols about the alphabet's middle."""
    centred = F.transform(symbols, lambda x: x - (k - 1) / 2)

    def of(c: Column) -> Column:
        squares = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
        products = F.aggregate(F.zip_with(c, F.slice(c, 2, 1 << 30), lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        return F.when(squares > 0, normal_tail(F.abs(products / squares) * F.sqrt(n))).otherwise(F.lit(0.0))

    return let(centred, of)


#: Alphabets in the order in which they are tried.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("^[A-Z2-7]+$", LETTERS.upper() + "234567"),
    ("^[0-9a-z]+$", "0123456789" + LETTERS),
    ("^[0-9A-Z]+$", "0123456789" + LETTERS.upper()),
    ("^[0-9A-Za-z]+$", "0123456789" + LETTERS + LETTERS.upper()),
    ("", "0123456789" + LETTERS + LETTERS.upper() + "+/_-"),
)


def battery(token: Column) -> Column:
    """The battery's p-value: three times the least of three, 1 at most."""
    alphabet = F.lit(ALPHABETS[-1][1])
    for pattern, symbols in ALPHABETS[-2::-1]:
        alphabet = F.when(token.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    known = F.struct(alphabet.alias("a"), token.alias("t"))

    def of(s: Column) -> Column:
        t = F.when(s["a"].startswith("0123456789abcdef") & (F.length(s["a"]) == 16), F.lower(s["t"])).otherwise(s["t"])
        symbols = F.transform(F.split(t, ""), lambda ch: F.instr(s["a"], ch) - 1)
        squares = let(t, lambda u: F.aggregate(F.split(s["a"], ""), F.lit(0.0), lambda a, ch: a + F.pow(F.length(u) - F.length(F.replace(u, ch, F.lit(""))), F.lit(2.0))))
        all_of = F.struct(F.filter(symbols, lambda x: x >= 0).alias("x"), F.length(s["t"]).cast("double").alias("n"), F.length(s["a"]).cast("double").alias("k"), squares.alias("c"))
        return let(all_of, lambda v: F.least(F.lit(1.0), 3 * F.least(chi_squared_p(v["c"], v["n"], v["k"]), runs_p(v["x"], v["n"], v["k"]), serial_p(v["x"], v["n"], v["k"]))))

    return let(known, of)


def candidates(text: Column) -> Column:
    def fields(m: Column, s: Column, e: Column) -> Column:
        p = F.greatest(battery(m), F.lit(1e-300))
        at = F.least(F.lit(BINS - 1), F.floor(-F.log10(p) * PER_TEN)).cast("int")
        kind = F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.length(m)))).cast("int")
        return F.struct(s.cast("int").alias("start"), F.lit(3).alias("rank"), e.cast("int").alias("end"), kind.alias("class"), at.alias("bin"))

    return F.when(text.rlike(CANDIDATE), matches(text, F.lit(CANDIDATE), fields)).otherwise(F.array().cast(FOUND))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def rejected_from(found: DataFrame, q: float) -> DataFrame:
    """(class, cut): within a class, candidates whose bin is `cut` or more are rejected as random. CLASSES rows at most.

    Benjamini-Hochberg over binned p-values: the largest p whose expected share of true random strings among those rejected,
    n p / (number of p-values that small), stays below q. A bin counts by its largest p.
    """
    # Bins and classes bound this table: 768 rows.
    counts = found.select(F.explode("found").alias("f")).groupBy("f.class", "f.bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("class")
    cumulative = counts.withColumn("less", F.sum("n").over(w.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(w))
    largest = F.pow(F.lit(10.0), -F.col("bin") / PER_TEN)
    return cumulative.where(F.col("all") * largest <= q * F.col("less")).groupBy("class").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: a row for each of docs.

    Spans are kind:start:end in code points, end exclusive, by start, then kind (assign, access, hex, random). A random span
    within a base span isn't repeated. Null and empty texts have no span. Repeated rows each give a row; very long texts are
    read whole; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    found = rows.select(
        "doc_id",
        kept_spans(text, ASSIGN_GATE, ASSIGN, 0, test=long_enough).alias("assign"),
        kept_spans(text, "AKIA[A-Z0-9]{16}", ACCESS, 1, test=lambda m: F.length(m) >= 20).alias("access"),
        kept_spans(text, "[0-9a-f]{24}", HEX, 2).alias("hex"),
        candidates(text).alias("found"),
    )
    found = materialise(found, "secrets")
    by_class = {r["class"]: r["cut"] for r in rejected_from(found, q).collect()}  # CLASSES rows at most
    cuts = F.create_map(*[F.lit(x) for kv in by_class.items() for x in kv]) if by_class else F.create_map().cast("map<int,int>")
    base = F.concat("assign", "access", "hex")
    left = F.filter("found", lambda f: f["bin"] < F.coalesce(cuts[f["class"]], F.lit(BINS)))
    fresh = F.filter(left, lambda f: ~F.exists(base, lambda b: (b["start"] <= f["start"]) & (b["end"] >= f["end"])))
    out = found.withColumn("random", F.transform(fresh, lambda f: F.struct(f["start"].alias("start"), f["rank"].alias("rank"), f["end"].alias("end"))))
    size = lambda c: F.size(c).cast("long")
    return out.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.concat(base, F.col("random"))).alias("spans"), size("random").alias("n_random"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
