"""DuckDB reference SQL for each registered query.

Each statement inlines the fixture views it needs as a WITH chain (same
bodies as ``inboxlake.sources.fixtures`` derives with DataFrames).  Used by
the correctness gate and by ``tests/test_oracle.py``.
"""

from __future__ import annotations

import re

_N = "(SELECT CAST(count(*) * 4 / 5 AS BIGINT) AS n FROM documents)"

VIEWS: dict[str, str] = {
    "categories_v": """SELECT * FROM (VALUES
 (1,'Banking','active',CAST(90 AS INT),CAST(NULL AS INT)),
 (2,'Receipt/Invoice','active',NULL,NULL),(3,'Job Opportunity','active',60,NULL),
 (4,'Marketing','active',NULL,NULL),(5,'Newsletter','active',50,NULL),
 (6,'Social Media','active',NULL,NULL),(7,'Personal','active',NULL,NULL),
 (8,'Action Required','active',80,NULL),(9,'Calendar/Scheduling','active',NULL,NULL),
 (10,'Shipping/Delivery','active',NULL,NULL),(11,'Travel','active',NULL,NULL),
 (12,'Account/Security','active',95,NULL),(13,'Forums/Mailing Lists','active',NULL,NULL),
 (14,'Spam/Suspicious','active',NULL,NULL),(15,'Onboarding','active',NULL,NULL),
 (16,'Crypto Alerts','pending_review',NULL,NULL),(17,'Invoices','merged',NULL,2),
 (18,'Old Stuff','rejected',NULL,NULL)
) AS t(id,name,status,confidence_threshold,merged_into_id)""",
    "emails_v": f"""SELECT d.doc_id AS id, 'msg-' || CAST(d.doc_id AS STRING) AS gmail_id,
       d.source || '@' || d.lang || '.example.com' AS sender_email,
       d.lang || '.example.com' AS sender_domain,
       substring(d.text, 1, 60) AS subject, d.text AS body,
       e.ts AS received_at, e.ts AS created_at,
       CASE WHEN d.doc_id % 29 = 0 THEN e.ts END AS deleted_at,
       CASE WHEN d.doc_id % 13 = 0 THEN 'failed' WHEN d.doc_id < p.n THEN 'completed'
            WHEN d.doc_id % 2 = 0 THEN 'processing' ELSE 'pending' END AS pipeline_status
FROM documents d JOIN events e ON e.event_id = d.doc_id
CROSS JOIN {_N} p""",
    "triage_v": f"""SELECT t.id, t.email_id,
       CASE WHEN c.status = 'active' THEN t.cat END AS category_id,
       t.cat AS llm_category_id,
       CASE WHEN c.status = 'pending_review' THEN c.name END AS proposed_category_name,
       t.urgency, t.llm_urgency, t.confidence,
       CASE WHEN t.id % 11 = 0 THEN 'corrected'
            WHEN c.id IS NULL OR c.status = 'pending_review' THEN 'needs_review'
            WHEN t.confidence >= coalesce(c.confidence_threshold, 75) THEN 'auto_filed'
            ELSE 'needs_review' END AS status,
       t.suggested_action, t.llm_suggested_action, t.created_at, t.updated_at
FROM (SELECT event_id AS id, event_id % p.n AS email_id,
             CAST(1 + (event_id * 7) % 20 AS INT) AS cat,
             CASE (event_id * 3) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS llm_urgency,
             CASE WHEN value < 10 THEN 'low' WHEN value < 25 THEN 'medium' WHEN value < 60 THEN 'high' ELSE 'critical' END AS urgency,
             CAST((event_id * 37) % 101 AS INT) AS confidence,
             CASE event_type WHEN 'click' THEN 'reply' WHEN 'view' THEN 'archive' WHEN 'purchase' THEN 'flag' WHEN 'error' THEN 'delete' ELSE 'none' END AS suggested_action,
             CASE user_id % 5 WHEN 0 THEN 'reply' WHEN 1 THEN 'archive' WHEN 2 THEN 'flag' WHEN 3 THEN 'delete' ELSE 'none' END AS llm_suggested_action,
             ts AS created_at, ts AS updated_at
      FROM events CROSS JOIN {_N} p) t LEFT JOIN categories_v c ON c.id = t.cat""",
    "embeddings_v": "SELECT vec_id AS email_id, embedding FROM embeddings",
    "pipeline_logs_v": f"""SELECT event_id AS id, event_id % p.n AS email_id,
       CASE event_type WHEN 'click' THEN 'anonymize' WHEN 'view' THEN 'anonymize' WHEN 'purchase' THEN 'embed' ELSE 'triage' END AS stage,
       CASE event_id % 5 WHEN 0 THEN 'started' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'skipped' END AS status,
       CAST(1 + event_id % 3 AS INT) AS attempt,
       CASE WHEN event_id % 5 = 3 THEN 'boom ' || CAST(user_id AS STRING) END AS message,
       props AS payload, CAST(floor(value * 1000) AS INT) AS duration_ms, ts AS recorded_at
FROM events CROSS JOIN {_N} p""",
    "actions_log_v": f"""SELECT event_id AS id, event_id % p.n AS email_id,
       CASE event_type WHEN 'view' THEN 'archive' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'label_applied' ELSE 'reply_draft_created' END AS action_type,
       CASE WHEN event_id % 4 = 0 THEN 'auto' ELSE 'user' END AS initiated_by,
       ts AS executed_at, CASE WHEN event_id % 9 = 0 THEN ts END AS undone_at
FROM events CROSS JOIN {_N} p
WHERE event_id % 3 = 0 AND (event_id % p.n) % 4 <> 3""",
    # latest triage result per message (max id), all columns
    "latest_v": """SELECT t.* FROM triage_v t
JOIN (SELECT email_id, max(id) AS mid FROM triage_v GROUP BY email_id) m ON t.id = m.mid""",
    # values each message's latest result folds into sender statistics:
    # current values (cur) and the model's original values (llm)
    "folded_v": """SELECT e.id, l.id AS triage_id, e.sender_email, e.sender_domain, e.created_at, l.status,
  coalesce(c.name, l.proposed_category_name, 'Uncategorized') AS category,
  coalesce(lc.name, l.proposed_category_name, 'Uncategorized') AS llm_category,
  l.suggested_action AS action, l.llm_suggested_action AS llm_action,
  CASE l.urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS urgency_weight,
  CASE l.llm_urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS llm_urgency_weight,
  l.confidence, l.updated_at AS at_ts
FROM emails_v e JOIN latest_v l ON l.email_id = e.id
LEFT JOIN categories_v c ON c.id = l.category_id
LEFT JOIN categories_v lc ON lc.id = l.llm_category_id""",
    "hist_v": """SELECT sender_email, 'category' AS kind, category AS label, count(*) AS n,
  min((created_at, id)) AS first_seen FROM folded_v GROUP BY sender_email, category
UNION ALL
SELECT sender_email, 'action' AS kind, action AS label, count(*) AS n,
  min((created_at, id)) AS first_seen FROM folded_v GROUP BY sender_email, action""",
    "categories_full_v": """SELECT *, CAST(NULL AS VARCHAR) AS description,
  CASE WHEN id <= 15 THEN 'user' ELSE 'llm' END AS source, id <= 15 AS is_system_default FROM categories_v""",
    "responses_v": """SELECT id, email_id,
  CASE WHEN id % 4 = 0 THEN NULL ELSE llm_category_id END AS matched_category_id,
  CASE WHEN id % 4 = 0 THEN CASE id % 3 WHEN 0 THEN 'Banking' WHEN 1 THEN 'Topic ' || CAST(id % 7 AS VARCHAR)
       ELSE 'Crypto Alerts' END END AS proposal_name,
  CASE WHEN id % 4 = 0 THEN CASE WHEN id % 5 = 0 THEN '  ' ELSE 'because ' || CAST(id AS VARCHAR) END END AS proposal_reasoning,
  confidence FROM triage_v""",
    "commands_v": """SELECT event_id AS cmd_id, ts,
  CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'update'
       WHEN 'error' THEN 'delete' ELSE 'create' END AS command,
  CAST(1 + event_id % 18 AS INT) AS category_id,
  CASE WHEN event_type = 'signup' THEN 'Topic ' || CAST(user_id % 50 AS VARCHAR) END AS name,
  CAST(floor(value) AS INT) % 101 AS threshold FROM events""",
    "commands_ok_v": """SELECT * FROM commands_v WHERE NOT (command = 'delete'
    AND category_id IN (SELECT id FROM categories_full_v WHERE is_system_default))""",
    # the taxonomy after applying every category command (latest wins)
    "commanded_v": """SELECT c.id, c.name,
  CASE l.life WHEN 'accept' THEN 'active' WHEN 'reject' THEN 'rejected' ELSE c.status END AS status,
  CASE WHEN u.thr IS NOT NULL THEN u.thr ELSE c.confidence_threshold END AS confidence_threshold,
  c.source, c.description, c.is_system_default
FROM categories_full_v c
LEFT JOIN (SELECT category_id, arg_max(command, (ts, cmd_id)) AS life FROM commands_ok_v
           WHERE command IN ('accept', 'reject', 'delete') GROUP BY category_id) l ON l.category_id = c.id
LEFT JOIN (SELECT category_id, arg_max(threshold, (ts, cmd_id)) AS thr FROM commands_ok_v
           WHERE command = 'update' GROUP BY category_id) u ON u.category_id = c.id
WHERE coalesce(l.life, '') <> 'delete'
UNION ALL
SELECT CAST(NULL AS INT) AS id, name, 'active' AS status, arg_min(threshold, (ts, cmd_id)) AS confidence_threshold,
  'user' AS source, CAST(NULL AS VARCHAR) AS description, false AS is_system_default
FROM commands_ok_v WHERE command = 'create' AND name NOT IN (SELECT name FROM categories_v) GROUP BY name""",
}

_ORDER = list(VIEWS)


def with_views(body: str) -> str:
    """Prefix ``body`` with the view CTEs it (transitively) references."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in _ORDER if n in needed)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


URGENCY_WEIGHT_SQL = ("CASE {c} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 "
                      "WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END")
