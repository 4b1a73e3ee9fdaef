"""Authenticated encryption of a content column."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.fixed_values import KEY_DERIVATION_ROUNDS
from spanveil.functions.texts import content_hash
from spanveil.functions.tokens import hmac_sha256


def derive_key(passphrase: str, secret: str) -> bytes:
    """A 256-bit key, derived once per job on the driver."""
    salt = secret[:16].encode()
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, KEY_DERIVATION_ROUNDS, 32)


def encrypt(content: Column, key: bytes) -> Column:
    return F.aes_encrypt(content.cast("binary"), F.lit(key), F.lit("GCM"))


def decrypt(encrypted: Column, key: bytes) -> Column:
    """The content; null if it was changed or the key is another one."""
    return F.try_aes_decrypt(encrypted, F.lit(key), F.lit("GCM"))


def data_key(secret: bytes, file_id: Column) -> Column:
    """The 256-bit key of one file, derived from a secret and the file's id."""
    return F.unhex(hmac_sha256(file_id.cast("string"), secret))


def encrypt_with(content: Column, key: Column) -> Column:
    """The content under a key of its own row."""
    return F.aes_encrypt(content.cast("binary"), key, F.lit("GCM"))


def decrypt_with(encrypted: Column, key: Column) -> Column:
    """The content; null if it was changed, or the key is another one or null."""
    return F.try_aes_decrypt(encrypted, key, F.lit("GCM"))


def wrapped_keys(files: DataFrame, secret: bytes, master: bytes, file_id: str = "file_id") -> DataFrame:
    """The key table: each file's key, encrypted under the master key, and that one's name."""
    own = data_key(secret, F.col(file_id))
    return files.select(
        file_id, encrypt(own, master).alias("wrapped_key"), key_id(master).alias("master_key_id")
    )


def unwrap(wrapped: Column, master: bytes) -> Column:
    """A file's key; null under another master key."""
    return decrypt(wrapped, master)


def rotate_keys(keys: DataFrame, old: bytes, new: bytes) -> DataFrame:
    """The key table under a new master key; no content is read or written.

    Keys that the old master key doesn't open fail the job: written back, they would be lost.
    """
    own = unwrap(F.col("wrapped_key"), old)
    opened = F.when(own.isNull(), F.raise_error(F.lit("a key is not under this master key"))).otherwise(own)
    return keys.withColumns({"wrapped_key": encrypt(opened, new), "master_key_id": key_id(new)})


def key_id(key: bytes) -> Column:
    """The name of a key, the same for every row; the key cannot be told from it."""
    return F.lit(hashlib.sha256(b"key id" + key).hexdigest()[:32])


def new_key_id() -> Column:
    """A random id per row."""
    return F.uuid()


def verify_hashes(df: DataFrame, content: str, expected: str) -> DataFrame:
    """Rows whose content does not have the expected hash."""
    actual = content_hash(F.col(content))
    return df.withColumn("actual_hash", actual).filter(
        ~F.col("actual_hash").eqNullSafe(F.col(expected))
    )
