"""Deterministic identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.catalog import UUID_NAMESPACE


def uuid5(name: Column, namespace: str = UUID_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name, on the built-in SHA-1."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def comparison_id(policy_a: Column, policy_b: Column, prefix: str = "comparison:") -> Column:
    """Id of an ordered pair; (a, b) and (b, a) differ. ``prefix`` is the caller's own name space."""
    return uuid5(F.concat(F.lit(prefix), policy_a.cast("string"), F.lit("|"), policy_b.cast("string")))


def report_id(policy_ids: Column, prefix: str = "report:") -> Column:
    """O111: id of an ordered list of policies."""
    return uuid5(F.concat(F.lit(prefix), F.array_join(policy_ids, "|")))


def content_fingerprint(text: Column) -> Column:
    """SHA-256 of the text, in hex."""
    return F.sha2(text, 256)


def prompt_fingerprint(prompt: Column) -> Column:
    """First twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(prompt, 256), 1, 12)
