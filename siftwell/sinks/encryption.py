"""Payload encryption with AES-GCM.

A missing key is an error; nothing is ever written in the clear in its place. The key is data,
a table of one row that is broadcast, so it is no literal of the plan: neither ``explain`` nor
the event log shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ordinals import beside


def _with_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_key``, 32 bytes derived from ``key`` by the tasks."""
    if not key:
        raise ValueError("an encryption key is required")
    given = df.sparkSession.createDataFrame([(key,)], "_given string")
    derived = given.select(F.unhex(F.sha2(F.col("_given").cast("binary"), 256)).alias("_key"))
    return beside(df, derived, F.octet_length("_key"))


def encrypt_payload(df: DataFrame, payload: str, key: str) -> DataFrame:
    """``payload`` as AES-GCM bytes: a random start of 12 bytes, as many bytes as the text has, and a tag of 16."""
    closed = F.aes_encrypt(F.col(payload).cast("binary"), F.col("_key"), F.lit("GCM"))
    return _with_key(df, key).withColumn(payload, closed).drop("_key")


def decrypt_payload(df: DataFrame, payload: str, key: str, as_text: bool = True) -> DataFrame:
    """The inverse; a wrong key fails the query rather than returning garbage."""
    clear = F.aes_decrypt(F.col(payload), F.col("_key"), F.lit("GCM"))
    return _with_key(df, key).withColumn(payload, clear.cast("string") if as_text else clear).drop("_key")
