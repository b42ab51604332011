"""Sender-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reputation as rep
from ..schemas import urgency_from_weight
from .catalog import query


def _folded(fx, original=False):
    return rep.folded_results(fx.emails, fx.triage, fx.categories, original=original)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@query("sender_rebuild_scalar", oracle="""SELECT sender_email, arg_min(sender_domain, id) AS sender_domain,
  count(*) AS email_count, round(sum(urgency_weight) / count(*), 6) AS avg_urgency_score,
  round(sum(confidence) / count(*), 6) AS avg_confidence, max(created_at) AS last_seen_at
FROM folded_v GROUP BY sender_email""")
def sender_rebuild_scalar(fx):
    """Per-sender count, averages, last seen, first domain."""
    s = rep.rebuild_scalars(_folded(fx))
    return s.select("sender_email", "sender_domain", "email_count", _r6("avg_urgency_score"),
                    _r6("avg_confidence"), "last_seen_at")


@query("sender_histogram_category", oracle="""SELECT sender_email, label, n FROM hist_v WHERE kind = 'category'""")
def sender_histogram_category(fx):
    """A4: category histogram per sender (exploded)."""
    return rep.histogram(_folded(fx), "category").select("sender_email", "label", "n")


@query("sender_histogram_action", oracle="""SELECT sender_email, label, n FROM hist_v WHERE kind = 'action'""")
def sender_histogram_action(fx):
    """A4: action histogram per sender (exploded)."""
    return rep.histogram(_folded(fx), "action").select("sender_email", "label", "n")


_MODE_SQL = """SELECT c.sender_email, c.label AS most_common_category, a.label AS most_common_action
FROM (SELECT sender_email, arg_min(label, (-n, first_seen)) AS label FROM hist_v WHERE kind = 'category' GROUP BY sender_email) c
JOIN (SELECT sender_email, arg_min(label, (-n, first_seen)) AS label FROM hist_v WHERE kind = 'action' GROUP BY sender_email) a
  ON a.sender_email = c.sender_email"""


@query("sender_mode", oracle=_MODE_SQL)
def sender_mode(fx):
    """Most common category and action; ties to the label seen first."""
    f = _folded(fx)
    return (rep.mode(rep.histogram(f, "category"), "most_common_category")
            .join(rep.mode(rep.histogram(f, "action"), "most_common_action"), "sender_email"))


RECENT_SQL = """SELECT sender_email, pos, action, category,
  strftime(at_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "at"
FROM (SELECT *, row_number() OVER (PARTITION BY sender_email ORDER BY created_at DESC, id DESC) AS pos FROM folded_v)
WHERE pos <= 10"""


@query("sender_recent_actions", oracle=RECENT_SQL)
def sender_recent_actions(fx):
    """Ten newest (action, category, at) per sender, exploded with position."""
    return rep.recent_actions(_folded(fx)).withColumn("pos", F.col("pos").cast("bigint"))


@query("sender_histogram_sorted", oracle="""SELECT sender_email, kind, label, n,
  row_number() OVER (PARTITION BY sender_email, kind ORDER BY n DESC, first_seen) AS pos
FROM hist_v""")
def sender_histogram_sorted(fx):
    """Histogram entries by count desc (ties: first seen) with positions, both kinds."""
    f = _folded(fx)
    out = None
    for kind in ("category", "action"):
        h = rep.sorted_histogram(rep.histogram(f, kind)).select(
            "sender_email", F.lit(kind).alias("kind"), "label", "n", F.col("pos").cast("bigint").alias("pos"))
        out = h if out is None else out.unionByName(h)
    return out


@query("sender_list", oracle=f"""SELECT s.sender_email, s.sender_domain, s.email_count, s.avg_urgency_score,
  s.avg_confidence, m.most_common_category, m.most_common_action,
  CASE WHEN s.avg_urgency_score >= 3.5 THEN 'critical' WHEN s.avg_urgency_score >= 2.5 THEN 'high'
       WHEN s.avg_urgency_score >= 1.5 THEN 'medium' ELSE 'low' END AS urgency_label
FROM (SELECT sender_email, arg_min(sender_domain, id) AS sender_domain, count(*) AS email_count,
        round(sum(urgency_weight) / count(*), 6) AS avg_urgency_score,
        round(sum(confidence) / count(*), 6) AS avg_confidence FROM folded_v GROUP BY sender_email) s
JOIN ({_MODE_SQL}) m ON m.sender_email = s.sender_email
ORDER BY s.email_count DESC, s.sender_email LIMIT 25""")
def sender_list(fx):
    """First page of senders by volume with modes and urgency label."""
    f = _folded(fx)
    s = (rep.rebuild_scalars(f)
         .join(rep.mode(rep.histogram(f, "category"), "most_common_category"), "sender_email")
         .join(rep.mode(rep.histogram(f, "action"), "most_common_action"), "sender_email"))
    return (s.select("sender_email", "sender_domain", "email_count", _r6("avg_urgency_score"),
                     _r6("avg_confidence"), "most_common_category", "most_common_action",
                     urgency_from_weight(F.round("avg_urgency_score", 6)).alias("urgency_label"))
            .orderBy(F.col("email_count").desc(), "sender_email").limit(25))


def _revised(fx):
    base = _folded(fx, original=True)
    cur = _folded(fx)
    corrected = F.col("status") == "corrected"
    return base, base.where(corrected), cur.where(corrected)


@query("sender_revise", oracle="""SELECT sender_email, 'category' AS kind,
  CASE WHEN status = 'corrected' THEN category ELSE llm_category END AS label, count(*) AS n
FROM folded_v GROUP BY ALL
UNION ALL
SELECT sender_email, 'action' AS kind,
  CASE WHEN status = 'corrected' THEN action ELSE llm_action END AS label, count(*) AS n
FROM folded_v GROUP BY ALL""")
def sender_revise(fx):
    """Stats folded from the model's values, then corrections revised
    in as signed deltas; must equal a rebuild from the corrected values."""
    base, before, after = _revised(fx)
    out = None
    for kind in ("category", "action"):
        h = rep.apply_histogram_deltas(rep.histogram(base, kind).select("sender_email", "label", "n"),
                                       rep.revision_deltas(before, after, kind))
        h = h.select("sender_email", F.lit(kind).alias("kind"), "label", "n")
        out = h if out is None else out.unionByName(h)
    return out


@query("sender_revise_avg", oracle="""SELECT sender_email, count(*) AS email_count,
  round(sum(CASE WHEN status = 'corrected' THEN urgency_weight ELSE llm_urgency_weight END) / count(*), 6) AS avg_urgency_score,
  round(sum(confidence) / count(*), 6) AS avg_confidence
FROM folded_v GROUP BY sender_email""")
def sender_revise_avg(fx):
    """Averages after revising corrected results (count unchanged)."""
    base, before, after = _revised(fx)
    r = rep.apply_scalar_deltas(rep.rebuild_scalars(base), before, after)
    return r.select("sender_email", "email_count", _r6("avg_urgency_score"), _r6("avg_confidence"))


@query("rebuild_dry_run", oracle="""SELECT count(DISTINCT sender_email) AS senders, count(*) AS emails FROM folded_v""")
def rebuild_dry_run(fx):
    """Dry-run counts of a rebuild."""
    return rep.dry_run_counts(_folded(fx))


@query("sender_summary", oracle=f"""SELECT e.id, e.sender_email, coalesce(s.email_count, 0) AS email_count,
  m.most_common_category, m.most_common_action, s.avg_urgency_score, s.avg_confidence,
  coalesce(s.email_count, 0) = 0 AS is_new_sender
FROM emails_v e
LEFT JOIN (SELECT sender_email, count(*) AS email_count, round(sum(urgency_weight) / count(*), 6) AS avg_urgency_score,
             round(sum(confidence) / count(*), 6) AS avg_confidence FROM folded_v GROUP BY sender_email) s
  ON s.sender_email = e.sender_email
LEFT JOIN ({_MODE_SQL}) m ON m.sender_email = e.sender_email
WHERE e.deleted_at IS NULL""")
def sender_summary(fx):
    """Reputation context for every alive message."""
    f = _folded(fx)
    stats = rep.rebuild_scalars(f).join(rep.context_stats(f).drop("email_count"), "sender_email").select(
        "sender_email", "email_count", "most_common_category", "most_common_action",
        _r6("avg_urgency_score"), _r6("avg_confidence"))
    msgs = fx.emails.where(F.col("deleted_at").isNull()).select("id", "sender_email")
    return rep.sender_summary(msgs, stats)


@query("sender_stats_full")
def sender_stats_full(fx):
    """Q5: the complete sender_stats rows (maps, modes, recent list) as a rebuild writes them."""
    return rep.sender_stats(_folded(fx))


@query("sender_stats_rows", oracle=f"""WITH m AS ({_MODE_SQL}), r AS ({RECENT_SQL})
SELECT sender_email, 'emails' AS item, CAST(count(*) AS VARCHAR) AS value FROM folded_v GROUP BY sender_email
UNION ALL SELECT sender_email, 'domain', arg_min(sender_domain, id) FROM folded_v GROUP BY sender_email
UNION ALL SELECT sender_email, 'urgency', CAST(sum(urgency_weight) AS VARCHAR) FROM folded_v GROUP BY sender_email
UNION ALL SELECT sender_email, 'confidence', CAST(sum(confidence) AS VARCHAR) FROM folded_v GROUP BY sender_email
UNION ALL SELECT sender_email, kind || ' ' || label, CAST(n AS VARCHAR) FROM hist_v
UNION ALL SELECT sender_email, 'most common category', most_common_category FROM m
UNION ALL SELECT sender_email, 'most common action', most_common_action FROM m
UNION ALL SELECT sender_email, 'recent ' || CAST(pos AS VARCHAR), concat_ws(' | ', action, category, "at") FROM r""")
def sender_stats_rows(fx):
    """Q5: every value of the complete sender_stats rows (maps, modes, recent list), a row each."""
    full = rep.sender_stats(_folded(fx))
    text = lambda c: F.col(c).cast("string").alias("value")
    one = lambda item, c: full.select("sender_email", F.lit(item).alias("item"), text(c))
    out = one("emails", "email_count")
    for item, c in (("domain", "sender_domain"), ("urgency", "urgency_sum"), ("confidence", "confidence_sum"),
                    ("most common category", "most_common_category"), ("most common action", "most_common_action")):
        out = out.unionByName(one(item, c))
    for kind in ("category", "action"):
        bins = full.select("sender_email", F.explode(f"{kind}_histogram").alias("label", "n"))
        out = out.unionByName(bins.select("sender_email", F.concat(F.lit(f"{kind} "), "label").alias("item"), text("n")))
    recent = full.select("sender_email", F.posexplode("recent_actions").alias("i", "r"))
    return out.unionByName(recent.select(
        "sender_email", F.concat(F.lit("recent "), (F.col("i") + 1).cast("string")).alias("item"),
        F.concat_ws(" | ", "r.action", "r.category", "r.at").alias("value")))
