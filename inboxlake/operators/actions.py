"""Mailbox actions as data: record (X1) and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import UNDOABLE_ACTIONS


def undoable(action_type: Column, undone_at: Column) -> Column:
    """Archive / delete / label_applied, and not undone yet."""
    return action_type.isin(*UNDOABLE_ACTIONS) & undone_at.isNull()


def record_actions(commands: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Commands (email_id, triage_id, action, initiated_by) -> (log rows, soft deletes).

    ``action`` is a suggested action: archive, delete, flag (label 'Flagged'),
    reply (draft) ; ``none`` produces nothing.  Provider side effects are not
    part of the data path.
    """
    kind = (F.when(F.col("action") == "archive", "archive").when(F.col("action") == "delete", "delete")
             .when(F.col("action") == "flag", "label_applied")
             .when(F.col("action") == "reply", "reply_draft_created"))
    logs = (commands.where(kind.isNotNull())
            .select("email_id", "triage_id", kind.alias("action_type"), "initiated_by",
                    F.when(F.col("action") == "flag", F.create_map(F.lit("label"), F.lit("Flagged")))
                     .otherwise(F.create_map().cast("map<string,string>")).alias("payload"),
                    now.alias("executed_at"), F.lit(None).cast("timestamp").alias("undone_at")))
    deletes = commands.where(F.col("action") == "delete").select("email_id", now.alias("deleted_at"))
    return logs, deletes


def undo_actions(requests: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Join undo requests (action ids) to the log; applied or rejected with a reason.

    Applied rows carry ``undone_at = now``; an applied delete restores the
    message (``restores_email``).  Unknown ids are rejected too.
    """
    a = actions.select(F.col("id").alias("action_id"), "email_id", "action_type", "undone_at")
    j = requests.select("action_id").join(a, "action_id", "left")
    ok = undoable(F.col("action_type"), F.col("undone_at"))
    reason = (F.when(F.col("action_type").isNull(), "unknown action")
               .when(F.col("undone_at").isNotNull(), "already undone")
               .when(~F.col("action_type").isin(*UNDOABLE_ACTIONS), "not undoable"))
    return j.select(
        "action_id", "email_id", "action_type",
        F.when(ok, "applied").otherwise("rejected").alias("outcome"),
        F.when(ok, None).otherwise(reason).alias("reason"),
        F.when(ok, now).otherwise(F.col("undone_at")).alias("undone_at"),
        (ok & (F.col("action_type") == "delete")).alias("restores_email"),
    )


def apply_restores(emails: DataFrame, undo_result: DataFrame) -> DataFrame:
    """Clear ``deleted_at`` of messages whose delete was undone."""
    r = undo_result.where("restores_email").select(F.col("email_id").alias("_rid")).distinct()
    return (emails.join(r, emails["id"] == r["_rid"], "left")
            .withColumn("deleted_at", F.when(F.col("_rid").isNull(), F.col("deleted_at"))).drop("_rid"))
