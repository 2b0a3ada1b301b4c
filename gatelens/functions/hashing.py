"""Hash columns: canonical JSON, digests, keyed pseudonyms and Merkle hashing."""

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()
_BLOCK = 64


def has_float(document: Column) -> Column:
    """True when a variant holds a number that is not an integer anywhere."""
    return F.regexp_like(
        F.schema_of_variant(document), F.lit(r"(?:DOUBLE|FLOAT|DECIMAL\(\d+,\s*[1-9]\d*\))")
    )


def canonical_json(document: Column) -> Column:
    """Compact JSON text with keys sorted by code point of a variant; NULL for floats.

    Money is integer, hence no floats. Variants keep object keys sorted by UTF-16 unit, which is
    the same order unless a key has signs beyond the Basic Multilingual Plane; only texts with such
    signs leave the JVM to be sorted anew.
    """

    @F.pandas_udf("string")
    def by_code_point(texts: pd.Series) -> pd.Series:
        import json

        def one(text):
            if text is None:
                return None
            return json.dumps(
                json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")
            )

        return texts.map(one)

    text = F.when(~has_float(document), F.to_json(document))
    astral = F.regexp_like(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.when(astral, by_code_point(F.when(astral, text))).otherwise(text)


def sha256_hex(text: str | Column) -> Column:
    """SHA-256 of text (as UTF-8) or binary, in hex."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Keyed hash from two plain hashes with the padded key literals (RFC 2104)."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in padded))
    outer = F.lit(bytes(b ^ 0x5C for b in padded))
    return F.sha2(
        F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256
    )


def pseudonym(text: Column, key: bytes) -> Column:
    """First 16 hex digits of the keyed hash: stable for one key, unlinkable across keys."""
    return F.substring(hmac_sha256(text, key), 1, 16)


def leaf_hash(payload: str | Column) -> Column:
    """Merkle leaf hash: SHA-256 of a zero byte and the payload."""
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.sha2(F.concat(F.lit(b"\x00"), p.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    """Merkle node hash of two hex hashes: SHA-256 of a one byte and both."""
    return F.sha2(F.unhex(F.concat(F.lit("01"), left, right)), 256)
