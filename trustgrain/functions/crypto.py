"""Column encryption and token hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what an unreadable cipher text decrypts to.
UNREADABLE = "[Decryption Failed - Invalid Key or Corrupted Data]"


def _key(secret: str) -> Column:
    """AES-256 key: the secret's bytes, cut or zero-padded to 32."""
    return F.lit(secret.encode("utf-8")[:32].ljust(32, b"\0"))


def _pass_through(text: Column) -> Column:
    return text.isNull() | (text == "")


def encrypt(text: Column, secret: str) -> Column:
    """AES-256-GCM with a random 12-byte start value in front of cipher text and tag, as base64."""
    sealed = F.base64(F.aes_encrypt(text, _key(secret), F.lit("GCM")))
    return F.when(_pass_through(text), text).otherwise(sealed)


def decrypt(sealed: Column, secret: str) -> Column:
    opened = F.try_aes_decrypt(F.try_to_binary(sealed, F.lit("base64")), _key(secret), F.lit("GCM")).cast("string")
    return F.when(_pass_through(sealed), sealed).otherwise(F.coalesce(opened, F.lit(UNREADABLE)))


def token_hash(token: Column) -> Column:
    return F.base64(F.unhex(F.sha2(token, 256)))
