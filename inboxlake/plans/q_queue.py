"""Queue, dashboard, log and category-count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest, logs, queue
from ..operators import privacy as pv
from .catalog import query
from .oracle import URGENCY_WEIGHT_SQL
from .q_search import ALL_TERMS_SQL, matching_messages

_QUEUE_SELECT = ("id", "gmail_id", "sender_email", "subject", "received_at", "pipeline_status",
                 "latest_status", "latest_urgency", "latest_category_id", "latest_confidence",
                 "latest_suggested_action", "urgency_weight")

_QUEUE_SQL = f"""SELECT e.id, e.gmail_id, e.sender_email, e.subject, e.received_at, e.pipeline_status,
  l.status AS latest_status, l.urgency AS latest_urgency, l.category_id AS latest_category_id,
  l.confidence AS latest_confidence, l.suggested_action AS latest_suggested_action,
  {URGENCY_WEIGHT_SQL.format(c='l.urgency')} AS urgency_weight
FROM emails_v e LEFT JOIN latest_v l ON l.email_id = e.id
WHERE e.deleted_at IS NULL"""


@query("triage_queue_urgent", oracle=_QUEUE_SQL + "\nORDER BY urgency_weight DESC, received_at DESC, id DESC LIMIT 25")
def triage_queue_urgent(fx):
    """Q1/O1/O3: first page of the urgency-first queue."""
    q = queue.queue_base(fx.emails, fx.triage).select(*_QUEUE_SELECT)
    return queue.page(queue.sort_queue(q, "urgency"), 1)


@query("triage_queue_recent", oracle=_QUEUE_SQL + "\nORDER BY received_at DESC, urgency_weight DESC, id DESC LIMIT 25 OFFSET 25")
def triage_queue_recent(fx):
    """Q1/O2/O3: second page of the recent-first queue."""
    q = queue.queue_base(fx.emails, fx.triage).select(*_QUEUE_SELECT)
    return queue.page(queue.sort_queue(q, "recent"), 2)


@query("queue_keyset", oracle=_QUEUE_SQL + "\nORDER BY urgency_weight DESC, received_at DESC, id DESC LIMIT 25 OFFSET 25")
def queue_keyset(fx):
    """O3: the second page reached from the last row of the first, without skipping over rows."""
    q = queue.queue_base(fx.emails, fx.triage).select(*_QUEUE_SELECT)
    first = queue.page(queue.sort_queue(q, "urgency"), 1).select("urgency_weight", "received_at", "id").collect()
    return queue.page_after(q, tuple(first[-1]) if first else None)


@query("queue_page_full", oracle=f"""WITH hit AS (SELECT DISTINCT id FROM ({ALL_TERMS_SQL})),
q AS ({_QUEUE_SQL} AND l.status = 'needs_review' AND e.id IN (SELECT id FROM hit))
SELECT id, sender_email, latest_status, latest_urgency, 'About: ' || subject AS summary,
  (SELECT count(*) FROM q) AS total
FROM q ORDER BY urgency_weight DESC, received_at DESC, id DESC LIMIT 25""")
def queue_page_full(fx):
    """Q1 as it is served: status filter, full-text filter (any benchmark passage), sort, page and total, with the
    summary's placeholders replaced by the page's mappings (T3)."""
    q = queue.filter_queue(queue.queue_base(fx.emails, fx.triage), status="needs_review",
                           matching_ids=matching_messages(fx).select(F.col("id").alias("email_id")).distinct())
    page = pv.anonymize_columns(queue.page_with_total(q))
    stored_summary = F.concat(F.lit("About: "), "anonymized_subject")
    return page.select("id", "sender_email", "latest_status", "latest_urgency",
                       pv.deanonymize(stored_summary, F.col("pii_mappings")).alias("summary"), "total")


@query("queue_filtered", oracle=_QUEUE_SQL + "\nAND l.status = 'needs_review' AND l.urgency = 'critical'")
def queue_filtered(fx):
    """Every alive message whose latest result needs review and is critical."""
    q = queue.queue_base(fx.emails, fx.triage)
    return queue.filter_queue(q, status="needs_review", urgency="critical").select(*_QUEUE_SELECT)


@query("queue_failed_by_category", oracle=_QUEUE_SQL + "\nAND e.pipeline_status = 'failed' AND l.category_id = 8")
def queue_failed_by_category(fx):
    """Failed pipeline filter combined with a latest-category filter."""
    q = queue.queue_base(fx.emails, fx.triage)
    return queue.filter_queue(q, status="failed", category_id=8).select(*_QUEUE_SELECT)


@query("dashboard_stats", oracle="""SELECT
 (SELECT count(*) FROM triage_v WHERE status = 'needs_review') AS needs_review_count,
 (SELECT count(*) FROM triage_v WHERE status = 'auto_filed') AS auto_filed_count,
 (SELECT count(*) FROM emails_v WHERE deleted_at IS NULL) AS total_emails,
 (SELECT count(*) FROM categories_v WHERE status = 'pending_review') AS pending_categories,
 (SELECT count(*) FROM triage_v t WHERE t.urgency = 'critical' AND t.status <> 'corrected'
    AND EXISTS (SELECT 1 FROM emails_v e WHERE e.id = t.email_id AND e.deleted_at IS NULL
                AND NOT EXISTS (SELECT 1 FROM actions_log_v a WHERE a.email_id = e.id))) AS critical_urgency_count,
 (SELECT count(*) FROM emails_v WHERE deleted_at IS NULL AND pipeline_status = 'failed') AS failed_pipeline_count""")
def dashboard_stats(fx):
    """Dashboard counters."""
    return queue.dashboard_stats(fx.spark, fx.emails, fx.triage, fx.categories, fx.actions_log)


@query("recent_needs_review", oracle="""SELECT e.id, e.gmail_id, e.sender_email, e.subject, e.received_at,
  l.urgency, l.category_id
FROM emails_v e JOIN latest_v l ON l.email_id = e.id
WHERE e.deleted_at IS NULL AND l.status = 'needs_review'
ORDER BY e.received_at DESC, e.id DESC LIMIT 10""")
def recent_needs_review(fx):
    """Ten newest messages needing review."""
    return queue.recent_needs_review(fx.emails, fx.triage).select(
        "id", "gmail_id", "sender_email", "subject", "received_at", "urgency", "category_id")


@query("pipeline_status_backfill", oracle="""SELECT e.id,
  CASE WHEN EXISTS (SELECT 1 FROM triage_v t WHERE t.email_id = e.id) THEN 'completed'
       WHEN EXISTS (SELECT 1 FROM pipeline_logs_v g WHERE g.email_id = e.id AND g.status = 'failed') THEN 'failed'
       ELSE 'processing' END AS pipeline_status
FROM emails_v e""")
def pipeline_status_backfill(fx):
    """Status backfill with priority cascade (trashed messages included)."""
    return latest.pipeline_status_backfill(fx.emails, fx.triage, fx.pipeline_logs)


@query("stage_metrics", oracle="""SELECT stage, status, count(*) AS n, count(DISTINCT email_id) AS n_emails,
  max(attempt) AS max_attempt, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
  min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(duration_ms), 6) AS avg_ms
FROM pipeline_logs_v GROUP BY stage, status""")
def stage_metrics(fx):
    """Per stage and outcome counts, attempts and durations."""
    return logs.stage_metrics(fx.pipeline_logs)


@query("latest_failure", oracle="""SELECT email_id, arg_max(message, (recorded_at, id)) AS message,
  max(recorded_at) AS failed_at, count(*) AS n_failures
FROM pipeline_logs_v WHERE status = 'failed' GROUP BY email_id""")
def latest_failure(fx):
    """Latest failure message per message."""
    return logs.latest_failure(fx.pipeline_logs)


@query("category_counts", oracle="""SELECT c.id, c.name, c.status,
  (SELECT count(*) FROM triage_v t WHERE t.category_id = c.id) AS triage_count,
  (SELECT count(*) FROM triage_v t WHERE t.llm_category_id = c.id) AS proposed_count
FROM categories_v c""")
def category_counts(fx):
    """A3: results per category including zero."""
    return queue.category_counts(fx.categories, fx.triage)


@query("stage_duration_quantiles", oracle="""SELECT stage, quantile_disc(duration_ms, 0.5) AS p50_ms,
  quantile_disc(duration_ms, 0.9) AS p90_ms, quantile_disc(duration_ms, 0.99) AS p99_ms
FROM pipeline_logs_v GROUP BY stage""")
def stage_duration_quantiles(fx):
    """Approximate duration percentiles (p50, p90, p99) per stage."""
    q = logs.stage_duration_quantiles(fx.pipeline_logs)
    return q.select("stage", *[F.col("p50_p90_p99")[i].alias(n) for i, n in enumerate(["p50_ms", "p90_ms", "p99_ms"])])
