"""Signed replies: where a provider's signature is, whose it is, and whether the reply is the one that was signed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.nested import canonical_body_column, field

#: Headers that carry a signature, and the severity of a reply that was changed.
SIGNATURE, KEY_ID, CONTENT_HASH, PROVIDERS = "x-provider-signature", "x-provider-key-id", "x-provider-content-hash", ("x-provider-name", "x-provider")
TAMPERED, SEVERITY = ("hash_mismatch", "signature_invalid"), 10


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; of several, the last. Null where absent or empty."""
    own = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.nullif(F.try_element_at(own, F.lit(-1))["value"], F.lit(""))


def signature(headers: Column, body: Column) -> Column:
    """(signature, key_id, content_hash, provider) of the headers, else of the body's _signature, _integrity or
    metadata.signature, a string or an object; null for an unsigned reply."""
    outside = header(headers, SIGNATURE)
    inside = F.coalesce(field(body, "$._signature"), field(body, "$._integrity"), field(body, "$.metadata.signature"))
    held = lambda k: F.when(inside.startswith("{"), field(inside, f"$.{k}"))
    pick = lambda a, b: F.when(outside.isNotNull(), a).otherwise(b)
    provider = F.coalesce(*[header(headers, p) for p in PROVIDERS])
    own = F.struct(
        pick(outside, F.coalesce(held("signature"), inside)).alias("signature"), pick(header(headers, KEY_ID), held("keyId")).alias("key_id"),
        pick(header(headers, CONTENT_HASH), held("contentHash")).alias("content_hash"), pick(provider, held("provider")).alias("provider"),
    )
    return F.when(outside.isNotNull() | inside.isNotNull(), own)


def signed_payload(provider: Column, digest: Column, nonce: Column, key_id: Column) -> Column:
    """The canonical JSON that a provider signs."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"')), F.lit("null"))
    return F.concat(F.lit('{"content_hash":'), text(digest), F.lit(',"key_id":'), text(key_id), F.lit(',"provider":'), text(provider), F.lit(',"request_nonce":'), text(nonce), F.lit("}"))


def verify(replies: DataFrame, providers: tuple[str, ...] = (), check: Callable[[Column, Column, Column], Column] | None = None, expected: str | None = None) -> DataFrame:
    """replies (headers, body, nonce) with provider, status, verified, tampered, severity, detector.

    providers: those whose keys are known, none by default, as no provider signs yet. check(provider, payload, signature) says
    whether a signature is the payload's, null for one that can't be read; without it, none can. A null body has the form of "".
    """
    out = replies.withColumn("__s", signature(F.col("headers"), F.col("body")))
    provider = F.when(F.col("__s").isNotNull(), F.coalesce("__s.provider", F.lit(expected).cast("string")))
    # Only signed replies of known providers are read by the Python function that writes the canonical form.
    asks = F.coalesce(provider.isin(*providers), F.lit(False)) if providers else F.lit(False)
    digest = F.sha2(canonical_body_column(F.when(asks, F.coalesce("body", F.lit("")))), 256)
    out = out.withColumn("provider", provider).withColumn("__d", digest if providers else F.lit(None).cast("string"))
    payload = signed_payload(F.col("provider"), F.col("__d"), F.col("nonce"), F.col("__s.key_id"))
    good = check(F.col("provider"), payload, F.col("__s.signature")) if check else F.lit(None).cast("boolean")
    status = (
        F.when(F.col("__s").isNull(), "unsigned").when(~asks, "unknown_provider").when(F.col("__s.content_hash") != F.col("__d"), "hash_mismatch")
        .when(good.isNull(), "verification_error").when(good, "verified").otherwise("signature_invalid")
    )
    bad = F.col("status").isin(*TAMPERED)
    out = out.withColumn("status", status).withColumns({"verified": F.col("status") == "verified", "tampered": bad, "severity": F.when(bad, SEVERITY).otherwise(0)})
    return out.withColumn("detector", F.when(bad, F.concat(F.lit("provider_signature:"), "status"))).drop("__s", "__d")

