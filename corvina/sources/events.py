"""Lifecycle events as bounded, signed JSON payloads."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.text import bounded

#: Characters of a payload at most.
MOST_PAYLOAD = 8_192


def payloads(jobs: DataFrame, event: str, occurred_at: str) -> DataFrame:
    """(id, payload): one JSON object per job, its error text bounded; payloads that are too long are left out."""
    body = F.to_json(
        F.struct(F.lit(event).alias("event"), F.lit(occurred_at).alias("occurredAt"), F.col("id").alias("jobId"), "status", "indexed", "skipped", "failed", F.when(F.col("error").isNotNull() & (F.col("error") != ""), bounded(F.col("error"), 500, "unknown")).alias("error"))
    )
    return jobs.select("id", body.alias("payload")).where(F.length("payload") <= MOST_PAYLOAD)


def signed(rows: DataFrame, secret: str) -> DataFrame:
    """``rows`` with ``signature``: HMAC-SHA256 of the payload, hex."""

    @F.pandas_udf(T.StringType())
    def sign(payload: pd.Series) -> pd.Series:
        key = secret.encode()
        return payload.map(lambda p: None if p is None else hmac.new(key, p.encode(), hashlib.sha256).hexdigest())

    return rows.withColumn("signature", sign("payload"))
