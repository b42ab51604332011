"""Actions, table maintenance, nesting and scale queries
(X1, X2, P18, S4, S6, S7, S14, S16, S17, P13, J9, O7, Q2, F9, F10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as act
from ..operators import categories as cats
from ..operators import reputation as rep
from ..operators.latest import latest_per_key
from ..operators.validation import triage_violations
from ..schemas import MAX_ATTEMPTS, confidence_band, ucfirst, urgency_from_weight, urgency_weight
from ..sources import store
from .catalog import query


def _now(fx):
    """Processing time is a parameter, never the wall clock: the newest event."""
    return fx.t.events.select(F.max("ts")).scalar()


@query("action_undo", oracle="""SELECT a.id AS action_id, a.email_id, a.action_type,
  CASE WHEN a.action_type IN ('archive', 'delete', 'label_applied') AND a.undone_at IS NULL THEN 'applied' ELSE 'rejected' END AS outcome,
  CASE WHEN a.action_type IN ('archive', 'delete', 'label_applied') AND a.undone_at IS NULL THEN NULL
       WHEN a.undone_at IS NOT NULL THEN 'already undone' ELSE 'not undoable' END AS reason,
  CASE WHEN a.action_type IN ('archive', 'delete', 'label_applied') AND a.undone_at IS NULL
       THEN (SELECT max(ts) FROM events) ELSE a.undone_at END AS undone_at,
  (a.action_type = 'delete' AND a.undone_at IS NULL) AS restores_email
FROM actions_log_v a""")
def action_undo(fx):
    """An undo request for every logged action; applied or rejected with reason."""
    req = fx.actions_log.select(F.col("id").alias("action_id"))
    return act.undo_actions(req, fx.actions_log, _now(fx))


@query("undo_restores", oracle="""SELECT count(*) FILTER (WHERE deleted_at IS NOT NULL) AS still_deleted,
  count(*) AS total FROM (
  SELECT e.id, CASE WHEN r.email_id IS NULL THEN e.deleted_at END AS deleted_at FROM emails_v e
  LEFT JOIN (SELECT DISTINCT email_id FROM actions_log_v WHERE action_type = 'delete' AND undone_at IS NULL) r
    ON r.email_id = e.id)""")
def undo_restores(fx):
    """Messages restored by undone deletes (soft delete cleared)."""
    req = fx.actions_log.select(F.col("id").alias("action_id"))
    res = act.undo_actions(req, fx.actions_log, _now(fx))
    e = act.apply_restores(fx.emails.select("id", "deleted_at"), res)
    return e.agg(F.count_if(F.col("deleted_at").isNotNull()).alias("still_deleted"),
                 F.count(F.lit(1)).alias("total"))


@query("action_record", oracle="""SELECT e.id AS email_id, l.id AS triage_id,
  CASE l.suggested_action WHEN 'archive' THEN 'archive' WHEN 'delete' THEN 'delete'
       WHEN 'flag' THEN 'label_applied' WHEN 'reply' THEN 'reply_draft_created' END AS action_type,
  'auto' AS initiated_by, CASE WHEN l.suggested_action = 'flag' THEN 'Flagged' END AS label
FROM emails_v e JOIN latest_v l ON l.email_id = e.id
WHERE e.deleted_at IS NULL AND l.status = 'auto_filed' AND l.suggested_action <> 'none'""")
def action_record(fx):
    """Automatic actions for auto-filed messages, as action-log rows."""
    latest = latest_per_key(fx.triage, "email_id", "id", ["id", "status", "suggested_action"])
    cmds = (fx.emails.where(F.col("deleted_at").isNull()).select(F.col("id").alias("email_id"))
            .join(latest.where(F.col("status") == "auto_filed"), "email_id")
            .select("email_id", F.col("id").alias("triage_id"), F.col("suggested_action").alias("action"),
                    F.lit("auto").alias("initiated_by")))
    logs, _ = act.record_actions(cmds, _now(fx))
    return logs.select("email_id", "triage_id", "action_type", "initiated_by",
                       F.col("payload")["label"].alias("label"))


@query("quality_checks", oracle="""SELECT 'emails' AS table_name, gmail_id AS key, 'duplicate_key' AS rule FROM emails_v GROUP BY gmail_id HAVING count(*) > 1
UNION ALL SELECT 'categories', name, 'duplicate_key' FROM categories_v GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'triage_results', CAST(t.id AS VARCHAR), r.rule FROM triage_v t, (
   SELECT 'urgency_invalid' AS rule UNION ALL SELECT 'llm_urgency_invalid' UNION ALL SELECT 'action_invalid'
   UNION ALL SELECT 'confidence_out_of_range' UNION ALL SELECT 'status_invalid'
   UNION ALL SELECT 'category_unknown' UNION ALL SELECT 'llm_category_unknown') r
 WHERE (r.rule = 'urgency_invalid' AND t.urgency NOT IN ('low', 'medium', 'high', 'critical'))
    OR (r.rule = 'llm_urgency_invalid' AND t.llm_urgency NOT IN ('low', 'medium', 'high', 'critical'))
    OR (r.rule = 'action_invalid' AND t.suggested_action NOT IN ('reply', 'archive', 'delete', 'flag', 'none'))
    OR (r.rule = 'confidence_out_of_range' AND (t.confidence < 0 OR t.confidence > 100))
    OR (r.rule = 'status_invalid' AND t.status NOT IN ('needs_review', 'auto_filed', 'corrected'))
    OR (r.rule = 'category_unknown' AND t.category_id IS NOT NULL AND t.category_id NOT IN (SELECT id FROM categories_v))
    OR (r.rule = 'llm_category_unknown' AND t.llm_category_id IS NOT NULL AND t.llm_category_id NOT IN (SELECT id FROM categories_v))""")
def quality_checks(fx):
    """S17 + P13: duplicate natural keys and row-rule violations, one row per violation."""
    dup_e = store.uniqueness_violations(fx.emails, "emails", ["gmail_id"]).select("table_name", "key")
    dup_c = store.uniqueness_violations(fx.categories, "categories", ["name"]).select("table_name", "key")
    dups = dup_e.unionByName(dup_c).withColumn("rule", F.lit("duplicate_key"))
    v = triage_violations(fx.triage, fx.categories).select(
        F.lit("triage_results").alias("table_name"), F.col("id").cast("string").alias("key"),
        F.explode("violations").alias("rule"))
    return dups.unionByName(v)


@query("cascade_delete", oracle="""WITH gone AS (SELECT id FROM emails_v WHERE deleted_at IS NOT NULL)
SELECT 'triage_results' AS table_name, count(*) AS remaining FROM triage_v WHERE email_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'email_embeddings', count(*) FROM embeddings_v WHERE email_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'pipeline_logs', count(*) FROM pipeline_logs_v WHERE email_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'actions_log', count(*) FROM actions_log_v WHERE email_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'emails', count(*) FROM emails_v WHERE id NOT IN (SELECT id FROM gone)""")
def cascade_delete(fx):
    """Hard-delete trashed messages and cascade to every child table."""
    gone = fx.emails.where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("email_id"))
    parts = [
        ("triage_results", store.delete_keys(fx.triage, gone, "email_id")),
        ("email_embeddings", store.delete_keys(fx.embeddings, gone, "email_id")),
        ("pipeline_logs", store.delete_keys(fx.pipeline_logs, gone, "email_id")),
        ("actions_log", store.delete_keys(fx.actions_log, gone, "email_id")),
        ("emails", store.delete_keys(fx.emails, gone, "id", "email_id")),
    ]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table_name"), "remaining")
        out = c if out is None else out.unionByName(c)
    return out


@query("insert_absent", oracle="""SELECT id, gmail_id, sender_email, received_at FROM emails_v
WHERE gmail_id NOT IN (SELECT gmail_id FROM emails_v WHERE pipeline_status = 'completed')""")
def insert_absent(fx):
    """A poll delivers every message twice (a re-delivery arrives later);
    messages already stored (completed ones, trashed included) are skipped and the
    first arrival of each new one is inserted."""
    e = fx.emails.select("id", "gmail_id", "sender_email", "received_at")
    incoming = (e.withColumn("arrival", F.lit(0))
                .unionByName(e.withColumn("arrival", F.lit(1))))
    stored = fx.emails.where(F.col("pipeline_status") == "completed").select("gmail_id")
    return store.insert_absent(stored, incoming, "gmail_id", "arrival").drop("arrival")


@query("vector_upsert", oracle="""SELECT email_id, len(emb) AS dims, round(list_sum(emb), 4) AS checksum, version
FROM (SELECT u.email_id, CASE WHEN u.label % 2 = 0 THEN list_transform(u.embedding, lambda x: CAST(x AS DOUBLE) * 2)
             ELSE list_transform(u.embedding, lambda x: CAST(x AS DOUBLE)) END AS emb,
             CASE WHEN u.label % 2 = 0 THEN 2 ELSE 1 END AS version
      FROM (SELECT vec_id AS email_id, embedding, label FROM embeddings) u)""")
def vector_upsert(fx):
    """Re-embedded vectors (version 2, for even labels) upserted over the store; last write wins."""
    base = fx.t.embeddings.select(F.col("vec_id").alias("email_id"),
                                  F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
                                  F.lit(1).alias("version"))
    upd = (fx.t.embeddings.where(F.col("label") % 2 == 0)
           .select(F.col("vec_id").alias("email_id"),
                   F.transform("embedding", lambda x: x.cast("double") * 2).alias("embedding"),
                   F.lit(2).alias("version")))
    up = store.upsert_latest(base, upd, "email_id", "version")
    return up.select("email_id", F.size("embedding").alias("dims"),
                     F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"),
                     "version")


@query("message_nest", oracle="""SELECT e.id,
  (SELECT count(*) FROM actions_log_v a WHERE a.email_id = e.id) AS n_actions,
  (SELECT arg_min(action_type, (executed_at, id)) FROM actions_log_v a WHERE a.email_id = e.id) AS first_action,
  (SELECT arg_max(action_type, (executed_at, id)) FROM actions_log_v a WHERE a.email_id = e.id) AS last_action,
  (SELECT count(*) FROM pipeline_logs_v g WHERE g.email_id = e.id) AS n_logs,
  (SELECT arg_min(stage || ':' || status, (recorded_at, id)) FROM pipeline_logs_v g WHERE g.email_id = e.id) AS first_log,
  (SELECT arg_max(stage || ':' || status, (recorded_at, id)) FROM pipeline_logs_v g WHERE g.email_id = e.id) AS last_log,
  (SELECT status FROM latest_v l WHERE l.email_id = e.id) AS latest_status
FROM emails_v e""")
def message_nest(fx):
    """Per message, its actions and stage log in time order (sizes,
    first and last element) and the latest result.  Aggregated per message
    with min_by / max_by, so no message's children are collected in one place."""
    a = fx.actions_log.groupBy("email_id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.min_by("action_type", F.struct("executed_at", "id")).alias("first_action"),
        F.max_by("action_type", F.struct("executed_at", "id")).alias("last_action"))
    label = F.concat_ws(":", "stage", "status")
    g = fx.pipeline_logs.groupBy("email_id").agg(
        F.count(F.lit(1)).alias("n_logs"),
        F.min_by(label, F.struct("recorded_at", "id")).alias("first_log"),
        F.max_by(label, F.struct("recorded_at", "id")).alias("last_log"))
    lt = latest_per_key(fx.triage, "email_id", "id", ["status"]).withColumnRenamed("status", "latest_status")
    e = fx.emails.select(F.col("id").alias("email_id"))
    return (e.join(a, "email_id", "left").join(g, "email_id", "left").join(lt, "email_id", "left")
            .select(F.col("email_id").alias("id"),
                    F.coalesce("n_actions", F.lit(0)).alias("n_actions"), "first_action", "last_action",
                    F.coalesce("n_logs", F.lit(0)).alias("n_logs"), "first_log", "last_log", "latest_status"))


@query("message_detail", oracle=f"""WITH page AS (
  SELECT e.id FROM emails_v e LEFT JOIN latest_v l ON l.email_id = e.id WHERE e.deleted_at IS NULL
  ORDER BY CASE l.urgency WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
           e.received_at DESC, e.id DESC LIMIT 25)
SELECT email_id, 'action' AS kind, executed_at AS at, id AS child_id, action_type AS detail
FROM actions_log_v WHERE email_id IN (SELECT id FROM page)
UNION ALL
SELECT email_id, 'log' AS kind, recorded_at AS at, id AS child_id, stage || ':' || status || ':' || coalesce(message, '') AS detail
FROM pipeline_logs_v WHERE email_id IN (SELECT id FROM page)
UNION ALL
SELECT email_id, 'result' AS kind, created_at AS at, id AS child_id, status || ':' || urgency || ':' || suggested_action AS detail
FROM latest_v WHERE email_id IN (SELECT id FROM page)""")
def message_detail(fx):
    """The detail view of one queue page -- each message's actions,
    stage log and latest result as time-ordered child rows.  The order is a global sort on
    (email_id, at, child id): range partitioning splits even a message with a
    huge history over many tasks, where nesting it into one array would not."""
    from ..operators.queue import page, queue_base, sort_queue
    ids = page(sort_queue(queue_base(fx.emails, fx.triage)), 1).select(F.col("id").alias("email_id"))
    acts = fx.actions_log.join(ids, "email_id", "left_semi").select(
        "email_id", F.lit("action").alias("kind"), F.col("executed_at").alias("at"), F.col("id").alias("child_id"),
        F.col("action_type").alias("detail"))
    logs = fx.pipeline_logs.join(ids, "email_id", "left_semi").select(
        "email_id", F.lit("log").alias("kind"), F.col("recorded_at").alias("at"), F.col("id").alias("child_id"),
        F.concat_ws(":", "stage", "status", F.coalesce("message", F.lit(""))).alias("detail"))
    last = latest_per_key(fx.triage.join(ids, "email_id", "left_semi"), "email_id", "id",
                          ["id", "status", "urgency", "suggested_action", "created_at"]).select(
        "email_id", F.lit("result").alias("kind"), F.col("created_at").alias("at"), F.col("id").alias("child_id"),
        F.concat_ws(":", "status", "urgency", "suggested_action").alias("detail"))
    return acts.unionByName(logs).unionByName(last).orderBy("email_id", "at", "kind", "child_id")


@query("urgency_scale", oracle="""SELECT urgency, upper(substr(urgency, 1, 1)) || substr(urgency, 2) AS label,
  CASE urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS weight,
  count(*) AS n,
  CASE WHEN avg(CASE urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) >= 3.5 THEN 'critical'
       WHEN avg(CASE urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) >= 2.5 THEN 'high'
       WHEN avg(CASE urgency WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) >= 1.5 THEN 'medium'
       ELSE 'low' END AS bucket_of_weight
FROM triage_v GROUP BY urgency""")
def urgency_scale(fx):
    """weight, label (ucfirst) and inverse bucket per urgency, with counts."""
    w = urgency_weight(F.col("urgency"))
    return fx.triage.groupBy("urgency").agg(F.count(F.lit(1)).alias("n"), F.avg(w).alias("_w")).select(
        "urgency", ucfirst(F.col("urgency")).alias("label"), urgency_weight(F.col("urgency")).alias("weight"),
        "n", urgency_from_weight(F.col("_w")).alias("bucket_of_weight"))


@query("confidence_bands", oracle="""SELECT CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS band,
  status, count(*) AS n FROM triage_v GROUP BY ALL""")
def confidence_bands(fx):
    """confidence bands (>=75 / >=50 / else) per triage status."""
    return fx.triage.groupBy(confidence_band(F.col("confidence")).alias("band"), "status").agg(
        F.count(F.lit(1)).alias("n"))


@query("sender_snapshot", oracle="""SELECT triage_id, action, category AS category_name, urgency_weight, confidence
FROM folded_v""")
def sender_snapshot(fx):
    """The contribution each latest result folds into its sender's statistics."""
    s = rep.snapshot(rep.folded_results(fx.emails, fx.triage, fx.categories))
    return s.select("triage_id", "reputation_snapshot.*")


@query("bulk_requeue", oracle="""SELECT id, CASE WHEN id IN (SELECT email_id FROM pipeline_logs_v
    WHERE status = 'failed' AND attempt < 3) THEN 'processing' ELSE pipeline_status END AS pipeline_status FROM emails_v""")
def bulk_requeue(fx):
    """Messages with a failed attempt and attempts left go back to processing, in one update by key set."""
    keys = fx.pipeline_logs.where((F.col("status") == "failed") & (F.col("attempt") < MAX_ATTEMPTS))
    return store.bulk_set(fx.emails.select("id", "pipeline_status"), keys.select(F.col("email_id").alias("id")),
                          "id", "pipeline_status", F.lit("processing"))


@query("published_sender_counts", oracle="""SELECT sender_email, count(*) AS email_count, max(created_at) AS last_seen_at
FROM folded_v GROUP BY sender_email""")
def published_sender_counts(fx):
    """The rebuilt sender table published over an earlier version; a reader gets the later one."""
    f = rep.folded_results(fx.emails, fx.triage, fx.categories)
    built = rep.rebuild_scalars(f).select("sender_email", "email_count", "last_seen_at")
    store.publish(fx.spark, built.where(F.col("email_count") > 1), "sender_counts")
    store.publish(fx.spark, built, "sender_counts")
    return store.read_current(fx.spark, "sender_counts")


@query("category_hierarchy_counts", oracle="""SELECT c.id, c.name, p.name AS parent_name, m.name AS merged_into_name,
  (SELECT count(*) FROM triage_v t WHERE t.llm_category_id = c.id) AS proposed_count
FROM categories_v c LEFT JOIN categories_v p ON c.id % 5 = 0 AND p.id = c.id // 5
LEFT JOIN categories_v m ON m.id = c.merged_into_id""")
def category_hierarchy_counts(fx):
    """J10 + A3: results per category with the names of its parent and of the category it was merged into."""
    parents = fx.categories.withColumn(
        "parent_category_id", F.when(F.col("id") % 5 == 0, (F.col("id") / 5).cast("int")))
    n = fx.triage.groupBy(F.col("llm_category_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return cats.hierarchy(parents).join(n, "id", "left").select(
        "id", "name", "parent_name", "merged_into_name", F.coalesce("n", F.lit(0)).alias("proposed_count"))
