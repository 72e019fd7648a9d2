"""Keyed updates: a snapshot and its changes give the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_changes(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Apply ``changes``, one row per key.

    A change column that is NULL leaves the value as it is, so a change may
    provide any part of the columns. Rows without a change stay.
    """
    changed = [c for c in changes.columns if c != key]
    patch = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changed))
    return snapshot.join(patch, key, "left").select(
        *(
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
            for c in snapshot.columns
        )
    )
