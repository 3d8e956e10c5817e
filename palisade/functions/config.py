"""Configuration, with floors under which it can't be weakened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.predicates import mapped

#: The weakest settings that stand.
MOST_SANITISE, MOST_BLOCK, NEEDED = 9, 0.6, ("web_fetch", "email", "mcp_external")


@dataclass
class Config:
    sanitize_threshold: float = 7
    block_threshold: float = 0.4
    scan_contexts: list[str] = field(default_factory=lambda: ["web_fetch", "email", "mcp_external", "pdf_read", "general"])
    trusted_domains: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sanitize_threshold = min(self.sanitize_threshold, MOST_SANITISE)
        self.block_threshold = min(self.block_threshold, MOST_BLOCK)
        self.scan_contexts = [*self.scan_contexts, *[c for c in NEEDED if c not in self.scan_contexts]]


def threshold_key(detector: Column) -> Column:
    return mapped(detector, rules.THRESHOLD_KEYS, F.concat(F.lit("detector."), detector))


def threshold_default(detector: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.THRESHOLD_DEFAULTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, detector), F.lit(0.5))


def rules_digest() -> str:
    """A digest of the injection rules, to pin them by."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(rules.INJECTION, sort_keys=True).encode()).hexdigest()
