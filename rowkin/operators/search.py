"""Predicates of the listings, composed from what a reader asks for; each is one filter that the scan may push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowkin.functions import text as T


def providers(asked: str) -> Column:
    """Ten digits are an identifier; other text is an exact key or part of the folded name."""
    text = (asked or "").strip()
    if not text:
        return F.lit(True)
    if len(text) == 10 and text.isdigit():
        return F.col("npi") == text
    name = T.fold(F.coalesce("organization_name", F.concat_ws(" ", "first_name", "last_name")))
    return (F.col("provider_id") == text) | name.contains(" ".join(text.upper().split()))


def sanctions(asked: str) -> Column:
    """Part of the key or identifier, or of the name in any case."""
    text = (asked or "").strip()
    name = F.lower(F.coalesce("organization_name", F.concat_ws(" ", "first_name", "last_name")))
    return F.col("record_id").contains(text) | F.coalesce(F.col("npi").contains(text), F.lit(False)) | F.coalesce(name.contains(text.lower()), F.lit(False))


def audit(action: str) -> Column:
    """One action, or with a last dot its whole family."""
    return F.col("action").startswith(action) if action.endswith(".") else F.col("action") == action


def stale(now: Column, minutes: int = 30) -> Column:
    """Status of a job: a live one that has been silent for too long is STALE."""
    silent = F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")
    return F.when(F.col("status").isin("QUEUED", "RUNNING") & silent, "STALE").otherwise(F.col("status"))
