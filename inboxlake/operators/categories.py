"""Category resolution and lifecycle: routing (P12), active-only projection (P15),
resolve (C1), get-or-create (S9), seed upsert (S10), merges and their chains (C3), commands and edits (C4),
delete with null-out (S16) and prompt options (C5).

Categories are a taxonomy (tens to thousands of rows).  No broadcast hint is
forced on them: AQE measures the joined side at runtime and broadcasts it
only under ``spark.sql.autoBroadcastJoinThreshold``, otherwise it stays a
shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_CONFIDENCE_THRESHOLD, php_trim
from ..sources.store import checkpoint_table


def effective_threshold(threshold: Column) -> Column:
    return F.coalesce(threshold, F.lit(DEFAULT_CONFIDENCE_THRESHOLD))


def route_status(cat_id: Column, cat_status: Column, threshold: Column, confidence: Column) -> Column:
    """No category or a pending one -> needs_review; else by effective threshold.

    Rejected / merged categories still take the threshold test (kept as in the reference).
    """
    return (F.when(cat_id.isNull() | (cat_status == "pending_review"), F.lit("needs_review"))
             .when(confidence >= effective_threshold(threshold), F.lit("auto_filed"))
             .otherwise(F.lit("needs_review")))


def proposal(name: Column, reasoning: Column) -> Column:
    """A proposal exists only when both name and reasoning are non-blank."""
    ok = (F.coalesce(php_trim(name), F.lit("")) != "") & (F.coalesce(php_trim(reasoning), F.lit("")) != "")
    return F.when(ok, F.struct(name.alias("name"), reasoning.alias("reasoning")))


def route_responses(responses: DataFrame, categories: DataFrame) -> DataFrame:
    """P12 + P15 for responses carrying ``matched_category_id`` and ``confidence``."""
    c = categories.select(F.col("id").alias("_cid"), F.col("status").alias("_cstatus"),
                          F.col("confidence_threshold").alias("_thr"), F.col("name").alias("_cname"))
    j = responses.join(c, F.col("matched_category_id") == F.col("_cid"), "left")
    return j.select(
        *responses.columns,
        route_status(F.col("_cid"), F.col("_cstatus"), F.col("_thr"), F.col("confidence")).alias("routed_status"),
        F.when(F.col("_cstatus") == "active", F.col("_cid")).alias("category_id"),
        F.when(F.col("_cstatus") == "pending_review", F.col("_cname")).alias("proposed_category_name"),
        F.when(F.col("_cid").isNotNull(), effective_threshold(F.col("_thr"))).alias("effective_threshold"),
    )


def new_proposed_categories(responses: DataFrame, categories: DataFrame) -> DataFrame:
    """One pending category per proposed name not yet present (any status),
    described by the earliest proposal's reasoning."""
    props = responses.where(F.col("matched_category_id").isNull() & F.col("proposal").isNotNull())
    names = (props.groupBy(F.col("proposal.name").alias("name"))
             .agg(F.min_by("proposal.reasoning", "id").alias("description"),
                  F.min("id").alias("first_response_id")))
    return (names.join(categories.select("name"), "name", "left_anti")
            .select("name", "description", F.lit("llm").alias("source"),
                    F.lit("pending_review").alias("status"), "first_response_id"))


def with_ids(created: DataFrame, categories: DataFrame) -> DataFrame:
    """New categories numbered after the highest known id, by first proposal (a taxonomy fits into one prompt,
    so its new names are few)."""
    top = categories.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    order = Window.orderBy("first_response_id", "name")
    return created.withColumn("id", (top + F.row_number().over(order)).cast("int"))


def resolve_category(responses: DataFrame, categories: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """C1 + P12 + P15: matched id wins (unknown id -> none); else the proposal by
    name, reusing an existing row of any status or a newly created pending row.
    ``resolved_id`` is that category's id whatever its status; a proposal's name
    is recorded only where the category is pending, and only from the proposal.
    ``created``: the new categories with ids; without it they have none yet."""
    if created is None:
        created = new_proposed_categories(responses, categories).withColumn("id", F.lit(None).cast("int"))
    created = created.select(
        "name", "id", "status", F.lit(None).cast("int").alias("confidence_threshold"))
    by_name = categories.select("name", "id", "status", "confidence_threshold").unionByName(created)
    by_id = categories.select(F.col("id").alias("m_id"), F.col("name").alias("m_name"),
                              F.col("status").alias("m_status"), F.col("confidence_threshold").alias("m_thr"))
    by_name = by_name.select(F.col("name").alias("p_name"), F.col("id").alias("p_id"),
                             F.col("status").alias("p_status"), F.col("confidence_threshold").alias("p_thr"))
    matched = F.col("matched_category_id").isNotNull()
    j = (responses.join(by_id, F.col("matched_category_id") == F.col("m_id"), "left")
         .join(by_name, (~matched) & (F.col("proposal.name") == F.col("p_name")), "left"))
    name = F.when(matched, F.col("m_name")).otherwise(F.col("p_name"))
    status = F.when(matched, F.col("m_status")).otherwise(F.col("p_status"))
    thr = F.when(matched, F.col("m_thr")).otherwise(F.col("p_thr"))
    cid = F.when(matched, F.col("m_id")).otherwise(F.col("p_id"))
    return j.select(
        "id", name.alias("resolved_name"), status.alias("resolved_status"),
        cid.alias("resolved_id"), F.when(status == "active", cid).alias("category_id"),
        F.when(status == "pending_review", F.col("proposal.name")).alias("proposed_category_name"),
        route_status(name, status, thr, F.col("confidence")).alias("routed_status"),
    )


def seed_upsert(categories: DataFrame, seeds: DataFrame) -> DataFrame:
    """Upsert seed (name, description) by name; existing rows keep id and
    threshold, get the seed description, source 'user', status 'active', system flag."""
    s = seeds.select(F.col("name").alias("s_name"), F.col("description").alias("s_desc"))
    j = categories.join(s, categories["name"] == s["s_name"], "full_outer")
    seeded = F.col("s_name").isNotNull()
    return j.select(
        F.col("id"),
        F.coalesce(F.col("name"), F.col("s_name")).alias("name"),
        F.when(seeded, F.col("s_desc")).otherwise(F.col("description")).alias("description"),
        F.when(seeded, F.lit("user")).otherwise(F.col("source")).alias("source"),
        F.when(seeded, F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.col("confidence_threshold"),
        (seeded | F.coalesce(F.col("is_system_default"), F.lit(False))).alias("is_system_default"),
        *[F.col(c) for c in categories.columns
          if c not in ("id", "name", "description", "source", "status", "confidence_threshold", "is_system_default")],
    )


def merge_categories(triage: DataFrame, categories: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-point ``category_id`` of merged sources to their target and mark the
    sources merged.  ``llm_category_id`` (history) is untouched.  Self merges
    and unknown targets are rejected.  Returns (triage', categories')."""
    valid = (merges.join(categories.select(F.col("id").alias("target_id")), "target_id", "left_semi")
             .where(F.col("source_id") != F.col("target_id")))
    m = valid.select(F.col("source_id").alias("_src"), F.col("target_id").alias("_tgt"))
    t = (triage.join(m, triage["category_id"] == m["_src"], "left")
         .withColumn("category_id", F.coalesce(F.col("_tgt"), F.col("category_id"))).drop("_src", "_tgt"))
    c = (categories.join(m, categories["id"] == m["_src"], "left")
         .withColumn("status", F.when(F.col("_tgt").isNotNull(), F.lit("merged")).otherwise(F.col("status")))
         .withColumn("merged_into_id", F.coalesce(F.col("_tgt"), F.col("merged_into_id")))
         .drop("_src", "_tgt"))
    return t, c


def merge_roots(categories: DataFrame) -> DataFrame:
    """Where each category's chain of merges ends: (id, root_id, hops, in_cycle).

    Pointers jump (each round a category takes its target's target), so a chain of n merges is resolved in log2(n)
    rounds of one equi-join, however long.  A target that isn't there ends the chain before it.  A category whose
    chain runs into a cycle has no root: root_id and hops null, in_cycle true.  All joins are merges: a taxonomy's files
    are small enough for the planner to broadcast it in each round, however many rows go through the driver.
    """
    spark = categories.sparkSession
    ids = categories.select(F.col("id").alias("_t")).hint("merge")
    step = (categories.join(ids, F.col("merged_into_id") == F.col("_t"), "left")
            .select("id", F.coalesce("_t", "id").alias("at"), F.col("_t").isNotNull().cast("long").alias("hops")))
    step = checkpoint_table(spark, step, "merge-roots")
    ends = step.where("hops = 0").select(F.col("id").alias("_end")).hint("merge")
    for _ in range(max(1, step.count() - 1).bit_length()):
        there = step.select(F.col("id").alias("_a"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
        step = checkpoint_table(spark, step.join(there.hint("merge"), F.col("at") == F.col("_a")).select(
            "id", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops")), "merge-roots")
        if step.join(ends, F.col("at") == F.col("_end"), "left_anti").isEmpty():
            break
    cycle = F.col("_end").isNull()
    return step.join(ends, F.col("at") == F.col("_end"), "left").select(
        "id", F.col("_end").alias("root_id"), F.when(~cycle, F.col("hops")).alias("hops"), cycle.alias("in_cycle"))


def compress_merges(triage: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C3 over chains: results and merged categories point to the end of their chain; members of a cycle stay as
    they are.  ``llm_category_id`` (history) is untouched.  Returns (triage', categories')."""
    roots = merge_roots(categories).where(F.col("hops") > 0).select(F.col("id").alias("_m"), F.col("root_id").alias("_root"))
    # results name few of the categories: only those are joined to them
    used = triage.select(F.col("category_id").alias("_u")).distinct().hint("merge")
    t = (triage.join(roots.join(used, F.col("_m") == F.col("_u"), "left_semi"), F.col("category_id") == F.col("_m"), "left")
         .withColumn("category_id", F.coalesce("_root", "category_id")).drop("_m", "_root"))
    c = (categories.join(roots.hint("merge"), F.col("id") == F.col("_m"), "left")
         .withColumn("merged_into_id", F.coalesce("_root", "merged_into_id")).drop("_m", "_root"))
    return t, c


def edit_categories(categories: DataFrame, edits: DataFrame) -> DataFrame:
    """C4: renames and new descriptions, the latest given value of each field on its own.

    ``edits``: (cmd_id, ts, category_id, new_name, new_description), a null leaves the field as it is.  A blank name
    is no name.  A name that another category has is refused; of several categories that take the same new name the
    one whose command came first has it.
    """
    order = F.struct("ts", "cmd_id")
    name = F.btrim("new_name")
    given = edits.withColumn("new_name", F.when(name != "", name))
    taken = categories.select(F.col("name").alias("new_name"), F.col("id").alias("_owner"))
    names = (given.where(F.col("new_name").isNotNull()).groupBy("category_id")
             .agg(F.max_by(F.struct("new_name", "ts", "cmd_id"), order).alias("n")).select("category_id", "n.*")
             .join(taken, "new_name", "left").where(F.col("_owner").isNull()))
    names = names.groupBy("new_name").agg(F.min_by("category_id", order).alias("_n"))
    texts = (given.where(F.col("new_description").isNotNull()).groupBy(F.col("category_id").alias("_d"))
             .agg(F.max_by("new_description", order).alias("new_description")))
    return (categories.join(names, F.col("id") == F.col("_n"), "left").join(texts, F.col("id") == F.col("_d"), "left")
            .withColumn("name", F.coalesce("new_name", "name"))
            .withColumn("description", F.coalesce("new_description", "description"))
            .drop("_n", "_d", "new_name", "new_description"))


def delete_categories(triage: DataFrame, categories: DataFrame, deletes: DataFrame,
                      system_flag: Column) -> tuple[DataFrame, DataFrame]:
    """Delete categories (system defaults refused) and null out every reference
    (category_id, llm_category_id, merged_into_id).  Returns (triage', categories')."""
    protected = categories.where(system_flag).select("id")
    gone = deletes.select(F.col("id")).join(protected, "id", "left_anti").distinct()
    c = categories.join(gone, "id", "left_anti")
    g1 = gone.select(F.col("id").alias("_g1"))
    g2 = gone.select(F.col("id").alias("_g2"))
    g3 = gone.select(F.col("id").alias("_g3"))
    t = (triage.join(g1, triage["category_id"] == g1["_g1"], "left")
         .join(g2, triage["llm_category_id"] == g2["_g2"], "left")
         .withColumn("category_id", F.when(F.col("_g1").isNull(), F.col("category_id")))
         .withColumn("llm_category_id", F.when(F.col("_g2").isNull(), F.col("llm_category_id")))
         .drop("_g1", "_g2"))
    c = (c.join(g3, c["merged_into_id"] == g3["_g3"], "left")
         .withColumn("merged_into_id", F.when(F.col("_g3").isNull(), F.col("merged_into_id"))).drop("_g3"))
    return t, c


def apply_commands(categories: DataFrame, commands: DataFrame, system_flag: Column) -> DataFrame:
    """C4: apply accept / reject / update / delete / create commands.

    Per category the latest lifecycle command (accept, reject, delete) decides
    the status or removal, and the latest update decides the threshold; delete
    of a system default is refused.  ``create`` adds an active user category
    unless the name exists; the earliest create per name wins.
    """
    order = F.struct("ts", "cmd_id")
    sys_ids = categories.where(system_flag).select(F.col("id").alias("category_id"))
    refused = (commands.where(F.col("command") == "delete")
               .join(sys_ids, "category_id", "left_semi").select("cmd_id"))
    cmds = commands.join(refused, "cmd_id", "left_anti")
    life = (cmds.where(F.col("command").isin("accept", "reject", "delete"))
            .groupBy("category_id").agg(F.max_by("command", order).alias("life")))
    upd = (cmds.where(F.col("command") == "update")
           .groupBy("category_id").agg(F.max_by("threshold", order).alias("new_thr")))
    cur = (categories.join(life, categories["id"] == life["category_id"], "left").drop("category_id")
           .join(upd, categories["id"] == upd["category_id"], "left").drop("category_id")
           .where(F.coalesce(F.col("life"), F.lit("")) != "delete")
           .select("id", "name",
                   F.when(F.col("life") == "accept", "active").when(F.col("life") == "reject", "rejected")
                    .otherwise(F.col("status")).alias("status"),
                   F.when(F.col("new_thr").isNotNull(), F.col("new_thr"))
                    .otherwise(F.col("confidence_threshold")).alias("confidence_threshold"),
                   F.col("source"), F.col("description"), F.col("is_system_default")))
    creates = (cmds.where(F.col("command") == "create")
               .groupBy("name").agg(F.min_by("threshold", order).alias("confidence_threshold"))
               .join(categories.select("name"), "name", "left_anti")
               .select(F.lit(None).cast(categories.schema["id"].dataType).alias("id"), "name",
                       F.lit("active").alias("status"), "confidence_threshold", F.lit("user").alias("source"),
                       F.lit(None).cast("string").alias("description"), F.lit(False).alias("is_system_default")))
    return cur.unionByName(creates)


def ranked_options(categories: DataFrame) -> DataFrame:
    """Active (id, name, description) options with their position by name."""
    pos = F.row_number().over(Window.orderBy("name", "id")).cast("bigint")
    return categories.where(F.col("status") == "active").select("id", "name", "description", pos.alias("pos"))


def hierarchy(categories: DataFrame) -> DataFrame:
    """One level of parent / merged-into names (self joins)."""
    p = categories.select(F.col("id").alias("_pid"), F.col("name").alias("parent_name"))
    m = categories.select(F.col("id").alias("_mid"), F.col("name").alias("merged_into_name"))
    return (categories.join(p, categories["parent_category_id"] == p["_pid"], "left")
            .join(m, categories["merged_into_id"] == m["_mid"], "left").drop("_pid", "_mid"))
