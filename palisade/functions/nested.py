"""Nested JSON and shell text: what a tool's input or output says, and what a command would run."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How deep and wide nested values are read.
DEPTH, WIDTH = 15, 50


def texts(value: object, depth: int = 0) -> list[str]:
    """All strings and numbers of a nested value, in order; what lies too deep or too far right is left out."""
    if depth > DEPTH or value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, bool):
        return [str(value).lower()]
    if isinstance(value, int | float):
        return [f"{value:g}" if isinstance(value, float) else str(value)]
    inside = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else []
    return [t for v in inside[:WIDTH] for t in texts(v, depth + 1)]


def deep_text(source: str) -> str:
    """The texts of a JSON value, joined by line feeds; what is no JSON stands for itself."""
    try:
        return "\n".join(t for t in texts(json.loads(source)) if t)
    except (ValueError, RecursionError):
        return source


def number(x: float) -> str:
    """A number as canonical JSON writes it: the shortest digits that give it back, an exponent from 1e21 and below 1e-6 only."""
    if math.isinf(x) or x == 0:
        return "null" if x else "0"
    sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
    own, point = "".join(map(str, digits)), len(digits) + int(power)
    if 0 < point <= 21:
        out = own.ljust(point, "0") if len(own) <= point else f"{own[:point]}.{own[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{own}"
    else:
        out = f"{own[0]}{'.' if own[1:] else ''}{own[1:]}e{point - 1:+d}"
    return "-" * sign + out


def quoted(s: str) -> str:
    """A JSON string; halves of surrogate pairs are escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def canonical_value(value: object) -> str:
    if isinstance(value, dict):
        own = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{quoted(k)}:{canonical_value(value[k])}" for k in own) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_value, value)) + "]"
    if isinstance(value, float):
        return number(value)
    return quoted(value) if isinstance(value, str) else json.dumps(value)


def no_constant(name: str) -> float:
    raise ValueError(name)


def canonical(source: str) -> str | None:
    """JSON with sorted keys (by UTF-16 units), no spaces, and numbers as doubles (RFC 8785); null for what is no JSON."""
    try:
        return canonical_value(json.loads(source, parse_int=float, parse_constant=no_constant))
    except (ValueError, RecursionError):
        return None


def canonical_body(source: str) -> str:
    """A reply's canonical form: that of its JSON value; what is no JSON is one string."""
    found = canonical(source)
    return quoted(source) if found is None else found


def plain_command(command: str) -> str:
    """A shell command with its usual disguises undone: variables set in it, base64 pipes, escapes, here-documents.

    What is undone is appended where it stands, so that rules see both; the result is text to search, not to run.
    """
    known: dict[str, str] = {}
    for m in re.finditer(r"(?:^|[;&|\s])([A-Za-z_]\w*)=(\"[^\"]*\"|'[^']*'|[^\s;&|]*)", command):
        known[m[1]] = m[2].strip("\"'")
    out = re.sub(r"\$\{?([A-Za-z_]\w*)\}?", lambda m: known.get(m[1], m[0]), command)

    def decoded(m: re.Match[str]) -> str:
        try:
            return base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            return m[0]

    out = re.sub(r"\$?\(?\s*echo\s+[\"']?([A-Za-z0-9+/=]{8,})[\"']?\s*\|\s*base64\s+(?:-d|--decode)\s*\)?", decoded, out)
    out = re.sub(r"\$'((?:\\x[0-9a-fA-F]{2}|[^'])*)'", lambda m: re.sub(r"\\x([0-9a-fA-F]{2})", lambda h: chr(int(h[1], 16)), m[1]), out)
    out = re.sub(r"printf\s+[\"']((?:\\x[0-9a-fA-F]{2})+)[\"']", lambda m: "".join(chr(int(h, 16)) for h in re.findall(r"\\x([0-9a-fA-F]{2})", m[1])), out)
    return re.sub(r"(\w)(?:''|\"\")(?=\w)", r"\1", out).replace("\\\n", "")


def arrow_strings(f: Callable[[str], str | None]):  # noqa: ANN201
    """f over batches of strings, as an Arrow function; null stays null."""

    def batch(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, StringType())


def strings(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    return lambda c: arrow_strings(f)(c)


deep_text_column, canonical_column, plain_command_column, canonical_body_column = strings(deep_text), strings(canonical), strings(plain_command), strings(canonical_body)


def canonical_hash(c: Column) -> Column:
    return F.sha2(canonical_column(c), 256)


# ---------------------------------------------------------------- shallow reads
def field(source: Column, path: str) -> Column:
    """A value of a JSON text; null where there is none or it is empty."""
    return F.nullif(F.get_json_object(source, path), F.lit(""))


def output_text(output: Column) -> Column:
    """What a tool's output (JSON) says at first sight: its string, its stdout, its content or the texts of its content's parts;
    else the JSON itself. Null counts as empty; what is no JSON is text."""
    kind = F.substring(F.ltrim(output), 1, 1)
    parts = F.from_json(F.get_json_object(output, "$.content"), "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    string = F.get_json_object(F.concat(F.lit('{"s":'), output, F.lit("}")), "$.s")
    content = field(output, "$.content")
    listed = F.substring(F.ltrim(content), 1, 1) == "["
    inside = F.coalesce(field(output, "$.stdout"), F.when(listed & parts.isNotNull(), joined).otherwise(content), output)
    return F.when(kind == "{", inside).when(kind == '"', F.coalesce(string, output)).otherwise(F.coalesce(output, F.lit("")))


def memory_metadata(call: Column) -> Column:
    """(confidence, encoding_agent, source_repo) of a memory call's arguments (JSON)."""
    of = lambda k: F.get_json_object(call, f"$.arguments.{k}")
    return F.struct(of("confidence").try_cast("double").alias("confidence"), of("encoding_agent").alias("encoding_agent"), of("source_repo").alias("source_repo"))
