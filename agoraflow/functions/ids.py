"""Binary identifiers, digests and sealed values."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_id(raw: Column) -> Column:
    """A binary id as lower-case hexadecimal text."""
    return F.lower(F.hex(raw))


def binary_id(text: Column) -> Column:
    """The binary id of hexadecimal text; null stays null."""
    return F.unhex(text)


def new_id() -> Column:
    """A random id of 16 bytes."""
    return F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def session_key(sid: Column) -> Column:
    return F.sha2(sid, 512)


def sealed(value: Column, key: Column) -> Column:
    """Encrypted and authenticated text; key has 16, 24 or 32 bytes."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def opened(value: Column, key: Column) -> Column:
    """The text of a sealed value, empty if it was changed or the key is another."""
    return F.coalesce(F.try_aes_decrypt(value, key, F.lit("GCM")).cast("string"), F.lit(""))


def keystream(key: bytes, size: int) -> bytes:
    """SHA-256 of key and a counter, block after block."""
    return b"".join(hashlib.sha256(key + i.to_bytes(4, "big")).digest() for i in range(-(-size // 32)))[:size]


def masked(key: bytes):
    """A function of a binary column that XORs it with the key's stream; applied twice it gives the value back."""

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else bytes(a ^ b for a, b in zip(v, keystream(key, len(v)), strict=True)))

    return run


def same_digest(a: str, b: str) -> bool:
    """Equality in a time that does not tell where texts differ."""
    return hmac.compare_digest(a.encode(), b.encode())
