"""Audit rows: digests in place of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    """SHA-256 of the text in hexadecimal; null reads as empty."""
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def audit_rows(decisions: DataFrame, *, request_id: str, prompt: str, timestamp: Column | None = None) -> DataFrame:
    """timestamp, request_id, action, reason and the digests of the text and of its rewriting."""
    return decisions.select(
        (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"), F.col(request_id).cast("string").alias("request_id"), "action", "reason",
        digest(F.col(prompt)).alias("prompt_sha256"), digest(F.col("rewritten_prompt")).alias("rewritten_sha256"),
    )


def append(rows: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines."""
    rows.write.mode("append").json(path)
