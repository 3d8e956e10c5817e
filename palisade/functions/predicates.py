"""Small decisions on columns: who calls, where a call goes, what follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOOLS = {"Read": "READ", "Glob": "READ", "Grep": "READ", "Write": "WRITE", "Edit": "WRITE", "Bash": "EXEC", "WebFetch": "FETCH", "WebSearch": "FETCH"}
#: Names that a tool's holds, in the order in which they are tried, for shared reports.
SHARED = {
    "read": "READ", "read_file": "READ", "cat": "READ", "write": "WRITE", "write_file": "WRITE", "edit": "WRITE", "bash": "EXEC", "exec": "EXEC", "shell": "EXEC",
    "webfetch": "FETCH", "fetch": "FETCH", "curl": "FETCH", "wget": "FETCH", "mempalace": "MEMORY", "grug": "MEMORY", "memory": "MEMORY",
}
FIRST_PARTY = (
    "api.openai.com", "api.anthropic.com", "generativelanguage.googleapis.com", "aiplatform.googleapis.com", "bedrock-runtime.us-east-1.amazonaws.com",
    "bedrock-runtime.us-west-2.amazonaws.com", "bedrock-runtime.eu-west-1.amazonaws.com", "bedrock-runtime.ap-northeast-1.amazonaws.com", "models.inference.ai.azure.com",
)
AZURE = r"^[a-z0-9-]+\.openai\.azure\.com$"
LOCAL, ROUTERS = ("localhost", "127.0.0.1", "::1"), ("openrouter.ai", "litellm", "lite-llm")
#: Variables of the environment that name an endpoint.
ENDPOINT_VARIABLES = ("OPENAI_BASE_URL", "ANTHROPIC_BASE_URL", "OPENAI_API_BASE", "LITELLM_BASE_URL", "OPENROUTER_BASE_URL", "API_BASE_URL", "CLAUDE_BASE_URL")
IMAGES = r"(?i)\.(?:png|jpe?g|gif|webp|svg|bmp|ico)(?:\?|$)"
RESPONSES = {"confirm": "Ask the user before going on.", "quarantine": "Set the content aside for review.", "diversify": "Check against other sources.", "rollback": "Restore what was known before."}
PENDING_MINUTES = 5


def mapped(c: Column, names: dict[str, str], other: Column | str) -> Column:
    """A map literal with a default."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), other if isinstance(other, Column) else F.lit(other))


def tool_kind(tool: Column) -> Column:
    low = F.lower(tool)
    memory = low.startswith("mem") | low.startswith("knowledge") | F.contains(low, F.lit("memory"))
    return F.when(F.coalesce(tool, F.lit("")) == "", "OTHER").otherwise(mapped(tool, TOOLS, F.when(memory, "MEMORY").otherwise("OTHER")))


def shared_kind(tool: Column) -> Column:
    """As tool_kind for shared reports: the first name that the tool's holds, whatever its case."""
    low = F.lower(tool)
    return F.when(F.coalesce(tool, F.lit("")) == "", "UNKNOWN").otherwise(reduce(lambda out, kv: F.when(F.contains(low, F.lit(kv[0])), kv[1]).otherwise(out), reversed(SHARED.items()), F.lit("OTHER")))


def endpoint_host(url: Column) -> Column:
    """The host of a base URL or of a bare host, in lower case, without user, port and brackets."""
    return F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?\[?((?<=\[)[^\]]*|[^/:?#]*)", 1)


def endpoint(url: Column) -> Column:
    """What answers at a base URL: first_party, azure_openai, local, known_router, unknown_router; unknown for none."""
    host = endpoint_host(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown").when(host.isin(*FIRST_PARTY), "first_party").when(host.rlike(AZURE), "azure_openai").when(host.isin(*LOCAL), "local")
        .when(reduce(lambda a, b: a | b, [F.contains(host, F.lit(r)) for r in ROUTERS]), "known_router").otherwise("unknown_router")
    )


def trusted_endpoint(kind: Column) -> Column:
    return kind.isin("first_party", "azure_openai")


def memory_content(payload: Column) -> Column:
    """The text that a memory call writes, from its JSON input: direct fields first, then those of its arguments."""
    direct = [F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in ("content", "text", "memory", "body", "value", "note", "observation", "message", "data", "entry", "fact")]
    nested = [F.get_json_object(payload, f"$.{a}.{k}") for a in ("arguments", "tool_arguments") for k in ("content", "text", "memory", "body")]
    return F.coalesce(*direct, *[F.when(F.length(x) > 10, x) for x in nested])


def memory_source(tool: Column) -> Column:
    low = F.lower(tool)
    return reduce(lambda out, n: F.when(F.contains(low, F.lit(n)), n).otherwise(out), ("mem0", "forgetful", "engram", "grug"), F.lit("unknown"))


def write_threshold(path: Column) -> Column:
    """The severity from which a write is blocked: lower for files that agents and shells run by."""
    return F.when(path.rlike(r"(?i)(?:\.claude/|CLAUDE\.md|settings\.json|\.mcp\.json|\.env|\.ssh/)"), 6).when(path.rlike(r"(?i)(?:\.bashrc|\.zshrc|\.profile|\.bash_profile)$"), 6).otherwise(8)


def is_image(path: Column) -> Column:
    return path.rlike(IMAGES)


def automation(critical: Column, high: Column, medium: Column) -> Column:
    """The worst sign of unattended operation, and the modifier that it adds to severity thresholds."""
    level = F.when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("none")
    return F.struct(level.alias("level"), F.when(critical | high, -2).when(medium, -1).otherwise(0).alias("modifier"))


def outcome(verdict: Column) -> Column:
    """What a caller does with a verdict on an output."""
    return F.struct(F.when(verdict.isin("REDACT", "BLOCK"), 2).otherwise(0).alias("exit"), verdict.isin("REDACT", "BLOCK").alias("replace"))


def failure(hook: Column) -> Column:
    """Failing closed: hooks that run before an action block it, the others strip content."""
    return F.when(hook.startswith("pre-"), "block").otherwise("strip")


def semantic_decision(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "block").otherwise("sanitize")


def gate(surprise: Column, threshold: float = 0.75, block: float = 0.9) -> Column:
    return F.when(surprise > block, "block").when(surprise > threshold, "log").otherwise("pass")


def shared_report(severity: Column, findings: Column, layer: Column, surprise: Column) -> Column:
    """What is shared of a detection: a digest of its findings, no content."""
    return F.struct(F.left(F.sha2(findings, 256), F.lit(12)).alias("pattern"), severity.alias("severity"), layer.alias("layer"), F.round(surprise, 1).alias("surprise"))


def holds_marker(text: Column, current: list[str], previous: list[str] = (), least: int = 20) -> Column:
    """Whether a text holds a planted marker, of this rotation or the last; short texts are not looked at."""
    marks = [*current, *previous]
    hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]) if marks else F.lit(False)
    return (F.length(text) >= least) & hit


def model_verdict(reply: Column) -> Column:
    """(injection, confidence) from a classifier's reply; what can't be read counts as an injection of 0.5: it fails closed."""
    verdict = F.upper(F.regexp_extract(reply, r"(?i)VERDICT\s*:\s*(INJECTION|BENIGN)", 1))
    sure = F.regexp_extract(reply, r"(?i)CONFIDENCE\s*:\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.struct((F.coalesce(verdict, F.lit("")) != "BENIGN").alias("injection"), F.coalesce(F.when(F.coalesce(verdict, F.lit("")) != "", F.least(sure, F.lit(1.0))), F.lit(0.5)).alias("confidence"))


def last_json(reply: Column) -> Column:
    """The last JSON object without nested ones in a model's reply, after its thoughts."""
    shown = F.regexp_replace(reply, r"(?is)<think>.*?</think>", "")
    found = F.filter(F.regexp_extract_all(shown, F.lit(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0)), lambda x: F.get_json_object(x, "$").isNotNull())
    return F.try_element_at(found, F.lit(-1))
