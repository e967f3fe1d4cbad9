"""Deterministic hashing and canonical text: the order and identity of everything sampled or compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strict_json


def stable_hash(value: Column, salt: str, n: int = 64, separator: str = "|") -> Column:
    """First ``n`` hex digits of SHA-256 over salt, separator and value."""
    digest = F.sha2(F.concat(F.lit(salt + separator), value.cast("string")), 256)
    return digest if n == 64 else F.substring(digest, 1, n)


def digest_int(digest: Column, start: int = 1, digits: int = 15) -> Column:
    """A non-negative integer from some hex digits of a digest; 15 digits fit a signed long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def hash_fraction(value: Column, salt: str, separator: str = "|") -> Column:
    """Uniform number in [0, 1) with 52 bits, exact in a double."""
    return digest_int(stable_hash(value, salt, separator=separator), 1, 13) / F.lit(float(2**52))


def family_seed(family: Column, seed: int | str, separator: str = "|") -> Column:
    """60-bit integer seed of a family under a run seed."""
    return digest_int(stable_hash(family, str(seed), separator=separator))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null when the text is not JSON."""
    return F.to_json(strict_json(text))


def row_digest(*columns: Column) -> Column:
    """SHA-256 of several columns; null and the empty string differ, and so do neighbouring values."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def observation_signature(content: Column, width: Column, height: Column, metadata: Column) -> Column:
    """Signature of an observation: pixel digest with a size header, then the digest of canonical metadata."""
    header = F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("|")).cast("binary")
    pixels = F.sha2(F.concat(header, content.cast("binary")), 256)
    return F.sha2(F.concat(pixels, F.lit("|"), F.sha2(canonical_json(metadata), 256)), 256)


def hidden_metadata(metadata: Column, allowed: list[str]) -> Column:
    """Sorted metadata keys which are not public; an observation that has any must be rejected."""
    keys = F.json_object_keys(metadata)
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))


def nonpixel_hash(messages: Column) -> Column:
    """Digest of an array of messages (structs with role, text, image_ref) with image references removed."""
    visible = F.transform(
        messages, lambda m: F.concat_ws("\x1f", m["role"], F.coalesce(F.concat(F.lit("="), m["text"]), F.lit("~")))
    )
    return F.sha2(F.array_join(visible, "\x1e"), 256)
