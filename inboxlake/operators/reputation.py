"""Per-sender rolling statistics: full rebuild (Q5), histograms (A4), averages
(A5-A7), mode (A11), recent list (A12), snapshots (A13), dry-run counts (A14),
revision by signed deltas (A9/A10, C6) and the context summary (C7/J11).

Layout at scale: every statistic is first reduced per (sender, label) or per
sender with map-side partial aggregation, so a sender holding a third of all
messages costs one partial row per map task, never one task holding all its
rows.  Recent-10 uses ``row_number() <= 10`` which Spark plans as a
WindowGroupLimit before and after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RECENT_ACTIONS_LIMIT, UNCATEGORIZED, urgency_weight
from .latest import latest_per_key

_TRIAGE_COLS = ["category_id", "llm_category_id", "proposed_category_name", "urgency", "llm_urgency",
                "confidence", "status", "suggested_action", "llm_suggested_action", "updated_at"]


def category_label(name: Column, proposed: Column) -> Column:
    """Category name, else the proposed name, else 'Uncategorized'."""
    return F.coalesce(name, proposed, F.lit(UNCATEGORIZED))


def iso8601(ts: Column) -> Column:
    """Timestamp (UTC wall clock) as ISO-8601 with offset, e.g. 2024-01-01T00:00:07+00:00."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def folded_results(emails: DataFrame, triage: DataFrame, categories: DataFrame,
                   original: bool = False) -> DataFrame:
    """One row per message with a result (trashed included): the values folded into stats.

    ``original=True`` uses the model's immutable ``llm_*`` values (what was
    folded before any correction); otherwise the current values (A13 snapshot).
    """
    lt = latest_per_key(triage, "email_id", "id", ["id"] + _TRIAGE_COLS).withColumnRenamed("id", "triage_id")
    cat = categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    cat_key = "llm_category_id" if original else "category_id"
    e = emails.select("id", "sender_email", "sender_domain", "created_at")
    j = (e.join(lt, e["id"] == lt["email_id"])
          .join(cat, F.col(cat_key) == F.col("_cid"), "left"))
    urg = "llm_urgency" if original else "urgency"
    act = "llm_suggested_action" if original else "suggested_action"
    return j.select(
        "id", "triage_id", "sender_email", "sender_domain", "created_at", "status",
        category_label(F.col("_cname"), F.col("proposed_category_name")).alias("category"),
        F.col(act).alias("action"),
        urgency_weight(F.col(urg)).alias("urgency_weight"),
        F.col("confidence"),
        F.col("updated_at").alias("at"),
    )


def rebuild_scalars(folded: DataFrame) -> DataFrame:
    """Count, averages, last seen, and the domain of the sender's first message."""
    return folded.groupBy("sender_email").agg(
        F.min_by("sender_domain", "id").alias("sender_domain"),
        F.count(F.lit(1)).alias("email_count"),
        F.sum("urgency_weight").cast("bigint").alias("urgency_sum"),
        F.sum("confidence").cast("bigint").alias("confidence_sum"),
        F.max("created_at").alias("last_seen_at"),
    ).select("sender_email", "sender_domain", "email_count",
             (F.col("urgency_sum") / F.col("email_count")).alias("avg_urgency_score"),
             (F.col("confidence_sum") / F.col("email_count")).alias("avg_confidence"),
             "urgency_sum", "confidence_sum", "last_seen_at")


def histogram(folded: DataFrame, label: str) -> DataFrame:
    """Exploded histogram (A4): (sender_email, label, n, first_seen) with first_seen =
    min(created_at, id) -- the insertion order the reference's map would have."""
    return folded.groupBy("sender_email", F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("created_at", "id")).alias("first_seen"))


def histogram_map(hist: DataFrame) -> DataFrame:
    """Nest an exploded histogram into ``map<label, n>`` per sender, label-sorted."""
    return hist.groupBy("sender_email").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("histogram"))


def mode(hist: DataFrame, alias: str) -> DataFrame:
    """Most common label per sender (A11); ties go to the label seen first."""
    return hist.groupBy("sender_email").agg(
        F.min_by("label", F.struct((-F.col("n")).alias("neg_n"), F.col("first_seen"))).alias(alias))


def sorted_histogram(hist: DataFrame) -> DataFrame:
    """Histogram entries by count desc, then first seen (O8) with their position."""
    w = Window.partitionBy("sender_email").orderBy(F.col("n").desc(), F.col("first_seen"))
    return hist.withColumn("pos", F.row_number().over(w))


def recent_actions(folded: DataFrame, n: int = RECENT_ACTIONS_LIMIT) -> DataFrame:
    """Newest-first last ``n`` (action, category, at) per sender (A12 / W2), exploded."""
    w = Window.partitionBy("sender_email").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (folded.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .select("sender_email", "pos", "action", "category", iso8601(F.col("at")).alias("at")))


def recent_actions_nested(recent: DataFrame) -> DataFrame:
    return recent.groupBy("sender_email").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "action", "category", "at"))),
                    lambda s: s.dropFields("pos")).alias("recent_actions"))


def sender_stats(folded: DataFrame) -> DataFrame:
    """The full sender_stats row (Q5): scalars, both histograms as maps, modes, recent list."""
    cat_h, act_h = histogram(folded, "category"), histogram(folded, "action")
    return (rebuild_scalars(folded)
            .join(histogram_map(cat_h).withColumnRenamed("histogram", "category_histogram"), "sender_email")
            .join(histogram_map(act_h).withColumnRenamed("histogram", "action_histogram"), "sender_email")
            .join(mode(cat_h, "most_common_category"), "sender_email")
            .join(mode(act_h, "most_common_action"), "sender_email")
            .join(recent_actions_nested(recent_actions(folded)), "sender_email"))


def context_stats(folded: DataFrame) -> DataFrame:
    """What a prompt needs per sender (C7): count and the two modes -- no maps, no recent list."""
    n = folded.groupBy("sender_email").agg(F.count(F.lit(1)).alias("email_count"))
    return (n.join(mode(histogram(folded, "category"), "most_common_category"), "sender_email")
            .join(mode(histogram(folded, "action"), "most_common_action"), "sender_email"))


def snapshot(folded: DataFrame) -> DataFrame:
    """The contribution a result folded in, keyed by result id."""
    return folded.select("triage_id", F.struct(
        "action", F.col("category").alias("category_name"), "urgency_weight", "confidence"
    ).alias("reputation_snapshot"))


def dry_run_counts(folded: DataFrame) -> DataFrame:
    """Senders and messages a rebuild would touch."""
    return folded.agg(F.countDistinct("sender_email").alias("senders"),
                      F.count(F.lit(1)).alias("emails"))


def revision_deltas(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Signed deltas (A9): -1 for the label folded before, +1 for the label after.

    ``before`` / ``after`` carry (triage_id, sender_email, <label>); rows whose
    label does not change cancel out in the later sum.
    """
    b = before.select("triage_id", "sender_email", F.col(label).alias("label"), F.lit(-1).alias("d"))
    a = after.select("triage_id", "sender_email", F.col(label).alias("label"), F.lit(1).alias("d"))
    return b.unionByName(a)


def apply_histogram_deltas(hist: DataFrame, deltas: DataFrame) -> DataFrame:
    """A10: fold deltas into an exploded histogram; bins reaching zero disappear.

    One aggregation over the union (partial per map task), no per-sender state.
    """
    base = hist.select("sender_email", "label", F.col("n").alias("d"))
    return (base.unionByName(deltas.select("sender_email", "label", "d"))
            .groupBy("sender_email", "label").agg(F.sum("d").cast("bigint").alias("n"))
            .where(F.col("n") > 0))


def apply_scalar_deltas(scalars: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Average revision: sums move by (new - old); the count stays (same message)."""
    d = (after.select("sender_email", "urgency_weight", "confidence")
         .unionByName(before.select("sender_email", (-F.col("urgency_weight")).alias("urgency_weight"),
                                    (-F.col("confidence")).alias("confidence")))
         .groupBy("sender_email").agg(F.sum("urgency_weight").alias("du"), F.sum("confidence").alias("dc")))
    j = scalars.join(d, "sender_email", "left")
    us = F.col("urgency_sum") + F.coalesce(F.col("du"), F.lit(0))
    cs = F.col("confidence_sum") + F.coalesce(F.col("dc"), F.lit(0))
    n = F.greatest(F.col("email_count"), F.lit(1))
    return j.select("sender_email", "email_count",
                    (us / n).alias("avg_urgency_score"), (cs / n).alias("avg_confidence"))


def sender_summary(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """Reputation context per incoming message; unknown sender -> count 0, nulls."""
    s = stats.select("sender_email", "email_count", "most_common_category", "most_common_action",
                     "avg_urgency_score", "avg_confidence")
    return (messages.join(s, "sender_email", "left")
            .withColumn("email_count", F.coalesce(F.col("email_count"), F.lit(0)))
            .withColumn("is_new_sender", F.col("email_count") == 0))
