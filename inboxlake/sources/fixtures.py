"""Triage-domain views derived from the driver tables.

The driver ships generic tables (documents, events, embeddings, ...).  These
functions derive the message-triage tables from them with plain DataFrame
operations, so every view grows with the input.  The same derivations exist
as SQL in ``inboxlake.plans.oracle`` for the DuckDB comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables

# ---- fixed values: the category taxonomy of the fixture -------------------
# (id, name, status, confidence_threshold, merged_into_id).  Ids 1-15 are the
# seeded default names; 16-18 exercise pending / merged / rejected handling.
CATEGORY_ROWS = [
    (1, "Banking", "active", 90, None),
    (2, "Receipt/Invoice", "active", None, None),
    (3, "Job Opportunity", "active", 60, None),
    (4, "Marketing", "active", None, None),
    (5, "Newsletter", "active", 50, None),
    (6, "Social Media", "active", None, None),
    (7, "Personal", "active", None, None),
    (8, "Action Required", "active", 80, None),
    (9, "Calendar/Scheduling", "active", None, None),
    (10, "Shipping/Delivery", "active", None, None),
    (11, "Travel", "active", None, None),
    (12, "Account/Security", "active", 95, None),
    (13, "Forums/Mailing Lists", "active", None, None),
    (14, "Spam/Suspicious", "active", None, None),
    (15, "Onboarding", "active", None, None),
    (16, "Crypto Alerts", "pending_review", None, None),
    (17, "Invoices", "merged", None, 2),
    (18, "Old Stuff", "rejected", None, None),
]
# ---------------------------------------------------------------------------

CATEGORY_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("confidence_threshold", T.IntegerType()),
    T.StructField("merged_into_id", T.IntegerType()),
])


def case(col: Column, mapping: dict, default=None) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END``."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def categories_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_ROWS, CATEGORY_SCHEMA)


def message_count_cut(documents: DataFrame) -> Column:
    """Scalar subquery: four fifths of the document count (messages with results)."""
    return documents.select((F.count(F.lit(1)) * 4 / 5).cast("bigint")).scalar()


def emails_from(documents: DataFrame, events: DataFrame) -> DataFrame:
    n = message_count_cut(documents)
    d, e = documents.alias("d"), events.alias("e")
    doc_id = F.col("d.doc_id")
    return d.join(e, F.col("e.event_id") == doc_id).select(
        doc_id.alias("id"),
        F.concat(F.lit("msg-"), doc_id.cast("string")).alias("gmail_id"),
        F.concat(F.col("d.source"), F.lit("@"), F.col("d.lang"), F.lit(".example.com")).alias("sender_email"),
        F.concat(F.col("d.lang"), F.lit(".example.com")).alias("sender_domain"),
        F.substring(F.col("d.text"), 1, 60).alias("subject"),
        F.col("d.text").alias("body"),
        F.col("e.ts").alias("received_at"),
        F.col("e.ts").alias("created_at"),
        F.when(doc_id % 29 == 0, F.col("e.ts")).alias("deleted_at"),
        F.when(doc_id % 13 == 0, F.lit("failed"))
         .when(doc_id < n, F.lit("completed"))
         .when(doc_id % 2 == 0, F.lit("processing"))
         .otherwise(F.lit("pending")).alias("pipeline_status"),
    )


def triage_from(events: DataFrame, documents: DataFrame, categories: DataFrame) -> DataFrame:
    n = message_count_cut(documents)
    eid = F.col("event_id")
    t = events.select(
        eid.alias("id"),
        (eid % n).alias("email_id"),
        (1 + (eid * 7) % 20).cast("int").alias("cat"),
        case((eid * 3) % 4, {0: "low", 1: "medium", 2: "high"}, "critical").alias("llm_urgency"),
        F.when(F.col("value") < 10, "low").when(F.col("value") < 25, "medium")
         .when(F.col("value") < 60, "high").otherwise("critical").alias("urgency"),
        ((eid * 37) % 101).cast("int").alias("confidence"),
        case(F.col("event_type"), {"click": "reply", "view": "archive", "purchase": "flag",
                                   "error": "delete"}, "none").alias("suggested_action"),
        case(F.col("user_id") % 5, {0: "reply", 1: "archive", 2: "flag", 3: "delete"},
             "none").alias("llm_suggested_action"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    ).alias("t")
    c = F.broadcast(categories).alias("c")  # fixed-size dimension
    cs = F.col("c.status")
    return t.join(c, F.col("c.id") == F.col("t.cat"), "left").select(
        F.col("t.id"), F.col("t.email_id"),
        F.when(cs == "active", F.col("t.cat")).alias("category_id"),
        F.col("t.cat").alias("llm_category_id"),
        F.when(cs == "pending_review", F.col("c.name")).alias("proposed_category_name"),
        "t.urgency", "t.llm_urgency", "t.confidence",
        F.when(F.col("t.id") % 11 == 0, "corrected")
         .when(F.col("c.id").isNull() | (cs == "pending_review"), "needs_review")
         .when(F.col("t.confidence") >= F.coalesce(F.col("c.confidence_threshold"), F.lit(75)), "auto_filed")
         .otherwise("needs_review").alias("status"),
        "t.suggested_action", "t.llm_suggested_action", "t.created_at", "t.updated_at",
    )


def pipeline_logs_from(events: DataFrame, documents: DataFrame) -> DataFrame:
    n = message_count_cut(documents)
    eid = F.col("event_id")
    return events.select(
        eid.alias("id"), (eid % n).alias("email_id"),
        case(F.col("event_type"), {"click": "anonymize", "view": "anonymize", "purchase": "embed"},
             "triage").alias("stage"),
        case(eid % 5, {0: "started", 1: "succeeded", 2: "succeeded", 3: "failed"}, "skipped").alias("status"),
        (1 + eid % 3).cast("int").alias("attempt"),
        F.when(eid % 5 == 3, F.concat(F.lit("boom "), F.col("user_id").cast("string"))).alias("message"),
        F.col("props").alias("payload"),
        F.floor(F.col("value") * 1000).cast("int").alias("duration_ms"),
        F.col("ts").alias("recorded_at"),
    )


def actions_log_from(events: DataFrame, documents: DataFrame) -> DataFrame:
    n = message_count_cut(documents)
    eid = F.col("event_id")
    return events.where((eid % 3 == 0) & ((eid % n) % 4 != 3)).select(
        eid.alias("id"), (eid % n).alias("email_id"),
        case(F.col("event_type"), {"view": "archive", "error": "delete", "purchase": "label_applied"},
             "reply_draft_created").alias("action_type"),
        F.when(eid % 4 == 0, "auto").otherwise("user").alias("initiated_by"),
        F.col("ts").alias("executed_at"),
        F.when(eid % 9 == 0, F.col("ts")).alias("undone_at"),
    )


SEED_NAMES = [r[1] for r in CATEGORY_ROWS[:15]]


def categories_full(categories: DataFrame) -> DataFrame:
    """Categories with description, source and the system-default flag (seeded names)."""
    seeded = F.col("name").isin(*SEED_NAMES)
    return categories.select(
        "*", F.lit(None).cast("string").alias("description"),
        F.when(seeded, "user").otherwise("llm").alias("source"),
        seeded.alias("is_system_default"))


def model_responses(triage: DataFrame) -> DataFrame:
    """Parsed model responses derived from results: a matched id for most rows,
    otherwise a proposal (existing active name, new name, or existing pending
    name; blank reasoning for some, which voids the proposal)."""
    tid = F.col("id")
    no_match = tid % 4 == 0
    name = (F.when(tid % 3 == 0, F.lit("Banking"))
             .when(tid % 3 == 1, F.concat(F.lit("Topic "), (tid % 7).cast("string")))
             .otherwise(F.lit("Crypto Alerts")))
    reasoning = F.when(tid % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("because "), tid.cast("string")))
    return triage.select(
        "id", "email_id",
        F.when(~no_match, F.col("llm_category_id")).alias("matched_category_id"),
        F.when(no_match, name).alias("proposal_name"),
        F.when(no_match, reasoning).alias("proposal_reasoning"),
        "confidence")


def category_commands(events: DataFrame) -> DataFrame:
    """Category commands derived from events (C4)."""
    eid = F.col("event_id")
    return events.select(
        eid.alias("cmd_id"), "ts",
        case(F.col("event_type"), {"click": "accept", "view": "reject", "purchase": "update",
                                   "error": "delete"}, "create").alias("command"),
        (1 + eid % 18).cast("int").alias("category_id"),
        F.when(F.col("event_type") == "signup",
               F.concat(F.lit("Topic "), (F.col("user_id") % 50).cast("string"))).alias("name"),
        (F.floor(F.col("value")).cast("int") % 101).alias("threshold"))


def embeddings_from(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("email_id"), "embedding")


class Fixture:
    """All triage views of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    @cached_property
    def categories(self) -> DataFrame:
        return categories_df(self.spark)

    @cached_property
    def emails(self) -> DataFrame:
        return emails_from(self.t.documents, self.t.events)

    @cached_property
    def triage(self) -> DataFrame:
        return triage_from(self.t.events, self.t.documents, self.categories)

    @cached_property
    def pipeline_logs(self) -> DataFrame:
        return pipeline_logs_from(self.t.events, self.t.documents)

    @cached_property
    def actions_log(self) -> DataFrame:
        return actions_log_from(self.t.events, self.t.documents)

    @cached_property
    def categories_full(self) -> DataFrame:
        return categories_full(self.categories)

    @cached_property
    def responses(self) -> DataFrame:
        return model_responses(self.triage)

    @cached_property
    def category_commands(self) -> DataFrame:
        return category_commands(self.t.events)

    @cached_property
    def embeddings(self) -> DataFrame:
        return embeddings_from(self.t.embeddings)
