"""Stable keyed tokens: HMAC-SHA256 in column expressions, shown as base32."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK_SIZE = 64


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a string column under one key (RFC 2104)."""
    if len(key) > _BLOCK_SIZE:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK_SIZE, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in padded))
    outer = F.lit(bytes(b ^ 0x5C for b in padded))
    digest = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def _base32_of_40_bits(hex10: Column) -> Column:
    return F.translate(
        F.lpad(F.conv(hex10, 16, 32), 8, "0"),
        "0123456789ABCDEFGHIJKLMNOPQRSTUV",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    )


def stable_token(value: Column, key: str) -> Column:
    """``TOK_`` and 16 base32 characters; equal values get equal tokens."""
    if not key:
        raise ValueError("a token key is needed")
    # The mac is used twice; a one-element array keeps it evaluated once.
    mac = F.array(hmac_sha256(value, key.encode()))
    return F.element_at(
        F.transform(
            mac,
            lambda h: F.concat(
                F.lit("TOK_"),
                _base32_of_40_bits(h.substr(1, 10)),
                _base32_of_40_bits(h.substr(11, 10)),
            ),
        ),
        1,
    )
