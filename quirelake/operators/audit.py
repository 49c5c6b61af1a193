"""Audit and event logs: histories, counts, redaction, latest stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact


def audit_history(logs: DataFrame, **keys) -> DataFrame:
    """Rows of a patient, actor, action or resource, newest first."""
    for column, value in keys.items():
        logs = logs.where(F.col(column) == value)
    return logs.orderBy(F.desc("created_at"), F.desc("uuid"))


def audit_counts(logs: DataFrame, *columns: str) -> DataFrame:
    return logs.groupBy(*columns).agg(F.count("*").alias("n"))


def redacted(logs: DataFrame, *columns: str) -> DataFrame:
    """logs with sensitive values in the given JSON columns replaced."""
    return logs.withColumns({c: redact(F.col(c)) for c in columns})


def latest_event(events: DataFrame, key: str = "document_uuid") -> DataFrame:
    """Each document's latest event, by time and id; works on streams too."""
    last = F.max_by(F.struct("event_type", "created_at"), F.struct("created_at", "uuid"))
    return events.groupBy(key).agg(last.alias("e")).select(key, "e.event_type", "e.created_at")
