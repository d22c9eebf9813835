"""Message encryption as columns.

Stored layout: base64(IV 12 bytes | tag 16 bytes | ciphertext), AES-256-GCM, key =
SHA-256 of the secret. Spark's GCM layout is IV | ciphertext | tag, so the parts are
rearranged on the way in and out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IV_BYTES, TAG_BYTES = 12, 16


def _key(secret: Column) -> Column:
    return F.unhex(F.sha2(secret, 256))


def decrypted(text: Column, secret: Column) -> Column:
    """The plain text, or NULL when the value is empty, malformed or not ours."""
    raw = F.try_to_binary(text, F.lit("base64"))
    head = IV_BYTES + TAG_BYTES
    spark_layout = F.concat(
        F.substring(raw, 1, IV_BYTES),
        F.substr(raw, F.lit(head + 1)),
        F.substring(raw, IV_BYTES + 1, TAG_BYTES),
    )
    plain = F.try_aes_decrypt(spark_layout, _key(secret), F.lit("GCM")).cast("string")
    return F.when(F.octet_length(raw) > head, plain)


def encrypted(text: Column, secret: Column, row_key: Column) -> Column:
    """The stored form of a plain text; NULL and the empty text give NULL.

    The IV is derived from the secret, the row and the text, so it is unique per
    message and a retried task writes the same bytes.
    """
    seed = F.concat_ws("|", secret, row_key.cast("string"), text)
    iv = F.substring(F.unhex(F.sha2(seed, 256)), 1, IV_BYTES)
    sealed = F.aes_encrypt(
        F.encode(text, "UTF-8"), _key(secret), F.lit("GCM"), F.lit("DEFAULT"), iv
    )
    body = F.octet_length(sealed) - IV_BYTES - TAG_BYTES
    stored = F.concat(
        F.substring(sealed, 1, IV_BYTES),
        F.substr(sealed, F.lit(IV_BYTES + 1) + body),
        F.substr(sealed, F.lit(IV_BYTES + 1), body),
    )
    return F.when(text != "", F.regexp_replace(F.base64(stored), "[\r\n]", ""))
