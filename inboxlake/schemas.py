"""Enumerations, weights and fixed lookup values of the triage data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for equal results) ----------
# Urgency levels and their numeric weights (low=1, medium=2, high=3, critical=4);
# inverse bucketing thresholds 3.5 / 2.5 / 1.5.
URGENCY_WEIGHTS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
URGENCY_BUCKETS = [(3.5, "critical"), (2.5, "high"), (1.5, "medium")]
SUGGESTED_ACTIONS = ["none", "archive", "flag", "reply", "delete"]
TRIAGE_STATUSES = ["needs_review", "auto_filed", "corrected"]
PIPELINE_STATUSES = ["pending", "processing", "completed", "failed"]
CATEGORY_STATUSES = ["active", "pending_review", "rejected", "merged"]
CATEGORY_SOURCES = ["llm", "user"]
ACTION_TYPES = ["archive", "delete", "label_applied", "reply_draft_created"]
UNDOABLE_ACTIONS = ["archive", "delete", "label_applied"]
ELIGIBLE_EXAMPLE_STATUSES = ["auto_filed", "corrected"]
PIPELINE_STAGES = ["anonymize", "triage", "embed"]
LOG_STATUSES = ["started", "succeeded", "failed", "skipped"]
DEFAULT_CONFIDENCE_THRESHOLD = 75
CONFIDENCE_BANDS = [(75, "high"), (50, "medium")]
UNCATEGORIZED = "Uncategorized"
RECENT_ACTIONS_LIMIT = 10
RAG_LIMIT = 5
RAG_OVERFETCH = 3
PAGE_SIZE = 25
DASHBOARD_RECENT = 10
INITIAL_FETCH_DAYS = 3
MAX_ATTEMPTS = 3
# seconds before a failed stage is tried again
BACKOFF_SECONDS = {"poll": 30, "anonymize": 15, "triage": 20, "embed": 15}
DEFAULT_SENDER = "unknown@unknown"
DEFAULT_SUBJECT = "(no subject)"
# PHP trim() character set
PHP_TRIM_CHARS = " \t\n\r\u000b\u0000"
# ---------------------------------------------------------------------------


def urgency_weight(col: Column, default: int | None = None) -> Column:
    """Urgency label -> weight 1..4 (``default`` for null / unknown)."""
    expr = None
    for name, w in URGENCY_WEIGHTS.items():
        expr = F.when(col == name, F.lit(w)) if expr is None else expr.when(col == name, F.lit(w))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def urgency_from_weight(col: Column) -> Column:
    """Inverse bucketing of an average weight to a label."""
    expr = None
    for thr, name in URGENCY_BUCKETS:
        expr = F.when(col >= thr, F.lit(name)) if expr is None else expr.when(col >= thr, F.lit(name))
    return expr.otherwise(F.lit("low"))


def ucfirst(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def confidence_band(col: Column) -> Column:
    expr = None
    for thr, name in CONFIDENCE_BANDS:
        expr = F.when(col >= thr, F.lit(name)) if expr is None else expr.when(col >= thr, F.lit(name))
    return expr.otherwise(F.lit("low"))


def php_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(PHP_TRIM_CHARS))
