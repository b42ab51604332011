"""Read-path queries: triage queue (Q1), filters (P1-P5, P10), sorts and pages
(O1-O4), dashboard counts (A2) and category counts (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DASHBOARD_RECENT, PAGE_SIZE, urgency_weight
from .latest import alive, latest_per_key, with_latest

QUEUE_COLS = ["status", "urgency", "category_id", "confidence", "suggested_action"]


def queue_base(emails: DataFrame, triage: DataFrame) -> DataFrame:
    """Alive messages left-joined to their latest result, with the sort weight."""
    q = with_latest(alive(emails), triage, QUEUE_COLS, prefix="latest_")
    return q.withColumn("urgency_weight", urgency_weight(F.col("latest_urgency"), default=0))


def filter_queue(q: DataFrame, status: str | None = None, category_id: int | None = None,
                 urgency: str | None = None, matching_ids: DataFrame | None = None) -> DataFrame:
    """Optional predicates; an absent parameter adds nothing (P10).

    ``status='failed'`` tests the message's pipeline status (P2); other
    statuses test the latest triage status (P1).  ``matching_ids`` (a DataFrame
    with ``email_id``) is the full-text predicate of T7 applied as a semi join.
    """
    if status == "failed":
        q = q.where(F.col("pipeline_status") == "failed")
    elif status:
        q = q.where(F.col("latest_status") == status)
    if category_id:
        q = q.where(F.col("latest_category_id") == category_id)
    if urgency:
        q = q.where(F.col("latest_urgency") == urgency)
    if matching_ids is not None:
        q = q.join(matching_ids.select(F.col("email_id").alias("id")), "id", "left_semi")
    return q


def sort_queue(q: DataFrame, sort: str = "urgency") -> DataFrame:
    """O1 (urgency first) or O2 (recent first); ``id desc`` makes the order total."""
    if sort == "recent":
        keys = [F.col("received_at").desc(), F.col("urgency_weight").desc()]
    else:
        keys = [F.col("urgency_weight").desc(), F.col("received_at").desc()]
    return q.orderBy(*keys, F.col("id").desc())


def page(q: DataFrame, page_no: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a sorted frame: planned as a top-k (TakeOrderedAndProject), no global sort."""
    return q.offset(size * (page_no - 1)).limit(size) if page_no > 1 else q.limit(size)


def page_with_total(q: DataFrame, sort: str = "urgency", page_no: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One sorted page plus ``total``, the number of rows of all pages (a scalar subquery)."""
    total = q.select(F.count(F.lit(1))).scalar()
    return page(sort_queue(q, sort), page_no, size).withColumn("total", total)


def page_after(q: DataFrame, last: tuple | None, sort: str = "urgency", size: int = PAGE_SIZE) -> DataFrame:
    """O3 keyset variant for deep pages: the ``size`` rows after ``last`` =
    (urgency_weight, received_at, id) of the previous page's final row (urgency
    order) -- a filter plus top-k, no OFFSET scan of the skipped pages."""
    if last is not None:
        w, ts, i = last
        wc, tc, ic = F.col("urgency_weight"), F.col("received_at"), F.col("id")
        if sort == "recent":
            after = (tc < F.lit(ts)) | ((tc == F.lit(ts)) & (wc < w)) | ((tc == F.lit(ts)) & (wc == w) & (ic < i))
        else:
            after = (wc < w) | ((wc == w) & (tc < F.lit(ts))) | ((wc == w) & (tc == F.lit(ts)) & (ic < i))
        q = q.where(after)
    return sort_queue(q, sort).limit(size)


def dashboard_stats(spark: SparkSession, emails: DataFrame, triage: DataFrame,
                    categories: DataFrame, actions: DataFrame) -> DataFrame:
    """The six dashboard counters as one row of scalar subqueries (no join between them).

    Counts use every triage row, not the latest (kept from the reference).
    """
    live = alive(emails)
    critical = (triage.where((F.col("urgency") == "critical") & (F.col("status") != "corrected"))
                .join(live.select(F.col("id").alias("email_id")), "email_id", "left_semi")
                .join(actions.select("email_id"), "email_id", "left_anti"))
    tri = triage.agg(F.count_if(F.col("status") == "needs_review").alias("n"),
                     F.count_if(F.col("status") == "auto_filed").alias("a"))
    mail = live.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pipeline_status") == "failed").alias("f"))
    return spark.range(1).select(
        tri.select("n").scalar().alias("needs_review_count"),
        tri.select("a").scalar().alias("auto_filed_count"),
        mail.select("n").scalar().alias("total_emails"),
        categories.select(F.count_if(F.col("status") == "pending_review")).scalar().alias("pending_categories"),
        critical.select(F.count(F.lit(1))).scalar().alias("critical_urgency_count"),
        mail.select("f").scalar().alias("failed_pipeline_count"),
    )


def recent_needs_review(emails: DataFrame, triage: DataFrame, n: int = DASHBOARD_RECENT) -> DataFrame:
    """Top-n newest alive messages whose latest result needs review."""
    latest = latest_per_key(triage, "email_id", "id", ["status", "urgency", "category_id"])
    return (alive(emails).join(latest.where(F.col("status") == "needs_review")
                               .select(F.col("email_id").alias("id"), "urgency", "category_id"), "id")
            .orderBy(F.col("received_at").desc(), F.col("id").desc()).limit(n))


def category_counts(categories: DataFrame, triage: DataFrame) -> DataFrame:
    """Results per category including zero (A3).

    ``triage_count`` counts current ``category_id`` like the reference;
    ``proposed_count`` counts ``llm_category_id`` (what the model chose).
    Both are pre-aggregated before the join so the fact side never shuffles
    row by row; the category dimension is tiny.
    """
    cur = triage.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("triage_count"))
    llm = triage.groupBy(F.col("llm_category_id").alias("id")).agg(F.count(F.lit(1)).alias("proposed_count"))
    return (categories.select("id", "name", "status")
            .join(cur, "id", "left").join(llm, "id", "left")
            .select("id", "name", "status",
                    F.coalesce("triage_count", F.lit(0)).alias("triage_count"),
                    F.coalesce("proposed_count", F.lit(0)).alias("proposed_count")))
