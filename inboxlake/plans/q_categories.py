"""Category routing, resolution and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categories as cats
from ..operators.latest import latest_per_key
from ..sources.seeds import seeds_df, seeds_values_sql
from .catalog import query

_ROUTE_SQL = """CASE WHEN {cid} IS NULL OR {st} = 'pending_review' THEN 'needs_review'
       WHEN {conf} >= coalesce({thr}, 75) THEN 'auto_filed' ELSE 'needs_review' END"""


@query("confidence_routing", oracle=f"""SELECT t.id, t.llm_category_id AS matched_category_id, t.confidence,
  {_ROUTE_SQL.format(cid='c.id', st='c.status', conf='t.confidence', thr='c.confidence_threshold')} AS routed_status,
  CASE WHEN c.status = 'active' THEN c.id END AS category_id,
  CASE WHEN c.status = 'pending_review' THEN c.name END AS proposed_category_name,
  CASE WHEN c.id IS NOT NULL THEN coalesce(c.confidence_threshold, 75) END AS effective_threshold
FROM triage_v t LEFT JOIN categories_v c ON c.id = t.llm_category_id""")
def confidence_routing(fx):
    """Route every model response by its category's effective threshold."""
    r = fx.triage.select("id", F.col("llm_category_id").alias("matched_category_id"), "confidence")
    return cats.route_responses(r, fx.categories)


def _responses(fx):
    r = fx.responses
    return r.withColumn("proposal", cats.proposal(F.col("proposal_name"), F.col("proposal_reasoning")))


_PROPOSED = "trim(coalesce(r.proposal_name, '')) <> '' AND trim(coalesce(r.proposal_reasoning, '')) <> ''"
_HAS_PROP = ("matched_category_id IS NULL AND trim(coalesce(proposal_name, '')) <> '' "
             "AND trim(coalesce(proposal_reasoning, '')) <> ''")


@query("resolve_category", oracle=f"""SELECT id, name AS resolved_name, status AS resolved_status,
  cid AS resolved_id, CASE WHEN status = 'active' THEN cid END AS category_id,
  CASE WHEN status = 'pending_review' THEN proposed END AS proposed_category_name,
  {_ROUTE_SQL.format(cid='name', st='status', conf='confidence', thr='thr')} AS routed_status
FROM (SELECT r.id, r.confidence,
        CASE WHEN {_PROPOSED} THEN r.proposal_name END AS proposed,
        CASE WHEN r.matched_category_id IS NOT NULL THEN m.name WHEN {_HAS_PROP.replace('matched', 'r.matched')} THEN r.proposal_name END AS name,
        CASE WHEN r.matched_category_id IS NOT NULL THEN m.status WHEN {_HAS_PROP.replace('matched', 'r.matched')} THEN coalesce(p.status, 'pending_review') END AS status,
        CASE WHEN r.matched_category_id IS NOT NULL THEN m.confidence_threshold ELSE p.confidence_threshold END AS thr,
        CASE WHEN r.matched_category_id IS NOT NULL THEN m.id ELSE p.id END AS cid
      FROM responses_v r
      LEFT JOIN categories_v m ON m.id = r.matched_category_id
      LEFT JOIN categories_v p ON p.name = r.proposal_name AND {_HAS_PROP.replace('matched', 'r.matched')})""")
def resolve_category(fx):
    """C1 + P12 + P15: resolve each response's category and route it."""
    return cats.resolve_category(_responses(fx), fx.categories)


@query("category_get_or_create", oracle=f"""SELECT proposal_name AS name, arg_min(proposal_reasoning, id) AS description,
  'llm' AS source, 'pending_review' AS status, min(id) AS first_response_id
FROM responses_v WHERE {_HAS_PROP} AND proposal_name NOT IN (SELECT name FROM categories_v)
GROUP BY proposal_name""")
def category_get_or_create(fx):
    """One new pending category per new proposed name."""
    return cats.new_proposed_categories(_responses(fx), fx.categories)


@query("seed_upsert", oracle=f"""SELECT c.id, coalesce(c.name, s.name) AS name,
  CASE WHEN s.name IS NOT NULL THEN s.description ELSE c.description END AS description,
  CASE WHEN s.name IS NOT NULL THEN 'user' ELSE c.source END AS source,
  CASE WHEN s.name IS NOT NULL THEN 'active' ELSE c.status END AS status,
  c.confidence_threshold,
  (s.name IS NOT NULL OR coalesce(c.is_system_default, false)) AS is_system_default
FROM commanded_v c FULL OUTER JOIN ({seeds_values_sql()}) s ON s.name = c.name""")
def seed_upsert(fx):
    """Re-run the default-taxonomy seed over the taxonomy the command stream
    produced (rejected defaults are re-activated, user thresholds and created
    categories kept, deleted non-defaults stay deleted)."""
    return cats.seed_upsert(_commanded(fx), seeds_df(fx.spark)).select(
        "id", "name", "description", "source", "status", "confidence_threshold", "is_system_default")


def _commanded(fx):
    return cats.apply_commands(fx.categories_full, fx.category_commands, F.col("is_system_default"))


# merge commands: (source, target); a self merge and an unknown target are refused
_MERGES = [(4, 5), (13, 5), (7, 7), (9, 99)]
_MERGE_SQL = "SELECT * FROM (VALUES (4, 5), (13, 5), (7, 7), (9, 99)) AS m(source_id, target_id)"
_VALID_MERGE = (f"(SELECT * FROM ({_MERGE_SQL}) WHERE source_id <> target_id "
                "AND target_id IN (SELECT id FROM categories_v))")


@query("category_merge", oracle=f"""SELECT t.id, coalesce(m.target_id, t.category_id) AS category_id, t.llm_category_id
FROM triage_v t LEFT JOIN {_VALID_MERGE} m ON m.source_id = t.category_id""")
def category_merge(fx):
    """Re-point results of merged categories (history in llm_category_id kept)."""
    merges = fx.spark.createDataFrame(_MERGES, "source_id int, target_id int")
    t, _ = cats.merge_categories(fx.triage, fx.categories, merges)
    return t.select("id", "category_id", "llm_category_id")


@query("category_merge_status", oracle=f"""SELECT c.id, c.name,
  CASE WHEN m.target_id IS NOT NULL THEN 'merged' ELSE c.status END AS status,
  coalesce(m.target_id, c.merged_into_id) AS merged_into_id,
  (SELECT count(*) FROM triage_v t LEFT JOIN {_VALID_MERGE} m2 ON m2.source_id = t.category_id
    WHERE coalesce(m2.target_id, t.category_id) = c.id) AS result_count
FROM categories_v c LEFT JOIN {_VALID_MERGE} m ON m.source_id = c.id""")
def category_merge_status(fx):
    """Merged sources marked with their target, with each category's result
    count after re-pointing (sources drop to zero, targets absorb them)."""
    merges = fx.spark.createDataFrame(_MERGES, "source_id int, target_id int")
    t, c = cats.merge_categories(fx.triage, fx.categories, merges)
    n = t.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("result_count"))
    return (c.join(n, "id", "left")
            .select("id", "name", "status", "merged_into_id",
                    F.coalesce("result_count", F.lit(0)).alias("result_count")))


# delete requests: a pending, a rejected and a (protected) system default category
_DELETES = [(16,), (18,), (3,)]
_GONE = "(SELECT id FROM categories_full_v WHERE id IN (16, 18, 3) AND NOT is_system_default)"


@query("category_delete_nullout", oracle=f"""SELECT t.id,
  CASE WHEN t.category_id IN {_GONE} THEN NULL ELSE t.category_id END AS category_id,
  CASE WHEN t.llm_category_id IN {_GONE} THEN NULL ELSE t.llm_category_id END AS llm_category_id
FROM triage_v t""")
def category_delete_nullout(fx):
    """Delete categories (system defaults refused), null out references."""
    deletes = fx.spark.createDataFrame(_DELETES, "id int")
    t, _ = cats.delete_categories(fx.triage, fx.categories_full, deletes, F.col("is_system_default"))
    return t.select("id", "category_id", "llm_category_id")


@query("apply_category_commands", oracle="""SELECT id, name, status, confidence_threshold, source FROM commanded_v""")
def apply_category_commands(fx):
    """C4: accept / reject / update / delete / create commands, latest wins."""
    return _commanded(fx).select("id", "name", "status", "confidence_threshold", "source")


@query("approve_and_correct", oracle="""SELECT t.id, t.email_id,
  CASE WHEN lb.toxic = 1 THEN 'corrected' ELSE 'auto_filed' END AS status,
  CASE WHEN lb.toxic = 1 THEN 14 ELSE t.category_id END AS category_id,
  t.urgency,
  CASE WHEN lb.toxic = 1 THEN 'delete' ELSE t.suggested_action END AS suggested_action,
  t.llm_category_id
FROM labels lb JOIN latest_v t ON t.email_id = lb.doc_id
WHERE lb.toxic = 1 OR lb.quality = 1""")
def approve_and_correct(fx):
    """Human feedback from ``labels`` applied to latest results --
    toxic -> correction (Spam/Suspicious, delete; urgency unchanged because a
    null field never overwrites), else quality -> approval."""
    latest = latest_per_key(fx.triage, "email_id", "id",
                            ["id", "category_id", "urgency", "suggested_action", "status", "llm_category_id"])
    lb = fx.t.labels
    cmd = lb.select(
        F.col("doc_id").alias("email_id"),
        F.when(F.col("toxic") == 1, "correct").when(F.col("quality") == 1, "approve").alias("command"),
        F.when(F.col("toxic") == 1, F.lit(14)).alias("new_category_id"),
        F.lit(None).cast("string").alias("new_urgency"),
        F.when(F.col("toxic") == 1, F.lit("delete")).alias("new_action"),
    ).where(F.col("command").isNotNull())
    j = latest.join(cmd, "email_id")
    corr = F.col("command") == "correct"
    return j.select(
        "id", "email_id",
        F.when(corr, "corrected").otherwise("auto_filed").alias("status"),
        F.when(corr, F.coalesce("new_category_id", "category_id")).otherwise(F.col("category_id")).alias("category_id"),
        F.when(corr, F.coalesce("new_urgency", "urgency")).otherwise(F.col("urgency")).alias("urgency"),
        F.when(corr, F.coalesce("new_action", "suggested_action")).otherwise(F.col("suggested_action")).alias("suggested_action"),
        "llm_category_id")


@query("category_options", oracle="""SELECT id, name, row_number() OVER (ORDER BY name) AS pos
FROM commanded_v WHERE status = 'active'""")
def category_options(fx):
    """Active options for the prompt, by name, from the taxonomy the
    command stream produced, with their position."""
    return cats.ranked_options(_commanded(fx)).select("id", "name", "pos")


# a taxonomy as long as the documents: chains of five merges, every tenth of them ending in a cycle
_CHAINS = """SELECT doc_id AS id, CASE WHEN doc_id % 6 < 5 THEN doc_id + 1 WHEN doc_id % 60 = 59 THEN doc_id - 3 END AS merged_into_id
FROM documents"""


def _chains(fx):
    i = F.col("doc_id")
    return fx.t.documents.select(i.alias("id"), F.when(i % 6 < 5, i + 1).when(i % 60 == 59, i - 3).alias("merged_into_id"))


_ROOTS = f"""WITH RECURSIVE c AS ({_CHAINS}),
walk(id, here, hops) AS (SELECT id, id, 0 FROM c
  UNION ALL SELECT w.id, n.id, w.hops + 1 FROM walk w JOIN c ON c.id = w.here JOIN c n ON n.id = c.merged_into_id WHERE w.hops < 12),
ends AS (SELECT w.id, w.here AS root_id, w.hops FROM walk w JOIN c ON c.id = w.here
  WHERE c.merged_into_id IS NULL OR c.merged_into_id NOT IN (SELECT id FROM c))
"""


@query("merge_chains", oracle=f"""{_ROOTS}SELECT c.id, e.root_id, CAST(e.hops AS BIGINT) AS hops, e.id IS NULL AS in_cycle
FROM c LEFT JOIN ends e ON e.id = c.id""")
def merge_chains(fx):
    """The end of every chain of merges; chains that run into a cycle have none."""
    return cats.merge_roots(_chains(fx))


@query("merge_compressed", oracle=f"""{_ROOTS}SELECT t.id, coalesce(e.root_id, t.category_id) AS category_id, t.llm_category_id
FROM triage_v t LEFT JOIN ends e ON e.id = t.category_id AND e.hops > 0""")
def merge_compressed(fx):
    """C3 over chains: every result points to the end of its category's chain, its history stays."""
    t, _ = cats.compress_merges(fx.triage.select("id", "category_id", "llm_category_id"), _chains(fx))
    return t.select("id", F.col("category_id").cast("bigint").alias("category_id"), "llm_category_id")


_EDITS = """SELECT event_id AS cmd_id, ts, 1 + event_id % 20 AS category_id,
  CASE WHEN event_id % 9 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN ' Topic ' || CAST(event_id % 13 AS VARCHAR)
       WHEN event_id % 7 = 0 THEN (SELECT min(name) FROM categories_full_v) END AS new_name,
  CASE WHEN event_id % 2 = 0 THEN 'about ' || CAST(event_id AS VARCHAR) END AS new_description FROM events"""


@query("category_edits", oracle=f"""WITH e AS ({_EDITS}),
n AS (SELECT category_id, trim(new_name) AS new_name, ts, cmd_id FROM e WHERE trim(new_name) <> ''
  QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY ts DESC, cmd_id DESC) = 1),
f AS (SELECT * FROM n WHERE new_name NOT IN (SELECT name FROM categories_full_v)
  QUALIFY row_number() OVER (PARTITION BY new_name ORDER BY ts, cmd_id) = 1),
d AS (SELECT category_id, new_description FROM e WHERE new_description IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY ts DESC, cmd_id DESC) = 1)
SELECT c.id, coalesce(f.new_name, c.name) AS name, coalesce(d.new_description, c.description) AS description
FROM categories_full_v c LEFT JOIN f ON f.category_id = c.id LEFT JOIN d ON d.category_id = c.id""")
def category_edits(fx):
    """C4: renames and descriptions from a command per event, the latest of each field; taken names are refused."""
    e, s = F.col("event_id"), lambda c: c.cast("string")
    first = fx.categories_full.agg(F.min("name")).scalar()
    edits = fx.t.events.select(
        e.alias("cmd_id"), "ts", (1 + e % 20).alias("category_id"),
        F.when(e % 9 == 0, "  ").when(e % 3 == 0, F.concat(F.lit(" Topic "), s(e % 13))).when(e % 7 == 0, first).alias("new_name"),
        F.when(e % 2 == 0, F.concat(F.lit("about "), s(e))).alias("new_description"))
    return cats.edit_categories(fx.categories_full, edits).select("id", "name", "description")
