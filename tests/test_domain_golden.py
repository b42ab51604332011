"""Golden rows for routing (P12), resolution (C1), model JSON (F17), undo (X2),
revision (A9/A10) and retrieval edge cases (K1)."""

import numpy as np
from pyspark.sql import functions as F

from inboxlake.functions import model_io as mio
from inboxlake.operators import actions as act
from inboxlake.operators import categories as cats
from inboxlake.operators import knn
from inboxlake.operators import reputation as rep
from inboxlake.sources.fixtures import CATEGORY_SCHEMA

CATS = [(1, "Banking", "active", 90, None), (2, "Receipt/Invoice", "active", None, None),
        (3, "Zero", "active", 0, None), (16, "Crypto Alerts", "pending_review", None, None),
        (17, "Invoices", "merged", None, 2), (18, "Old Stuff", "rejected", None, None)]


def test_routing(spark):
    c = spark.createDataFrame(CATS, CATEGORY_SCHEMA)
    r = spark.createDataFrame([(1, None, 99), (2, 99, 99), (3, 16, 99), (4, 18, 80), (5, 17, 74),
                               (6, 1, 90), (7, 1, 89), (8, 3, 0), (9, 2, 75)],
                              "id long, matched_category_id int, confidence int")
    got = {x.id: (x.routed_status, x.category_id, x.proposed_category_name)
           for x in cats.route_responses(r, c).collect()}
    assert got[1] == ("needs_review", None, None)            # null category
    assert got[2] == ("needs_review", None, None)            # unknown id
    assert got[3] == ("needs_review", None, "Crypto Alerts")  # pending
    assert got[4] == ("auto_filed", None, None)              # rejected still takes the test
    assert got[5] == ("needs_review", None, None)            # merged, below default 75
    assert got[6] == ("auto_filed", 1, None)                 # equal to threshold
    assert got[7] == ("needs_review", 1, None)               # below threshold
    assert got[8] == ("auto_filed", 3, None)                 # threshold 0
    assert got[9] == ("auto_filed", 2, None)                 # null threshold -> 75


def test_resolve(spark):
    c = spark.createDataFrame(CATS, CATEGORY_SCHEMA)
    r = spark.createDataFrame([
        (1, 1, "Banking", "x", 95),          # matched + proposal: matched wins
        (2, None, "Banking", "why", 95),     # proposal equal to an active name: reused
        (3, None, "New One", "why", 95),     # new name: created pending
        (4, None, "New One", "again", 95),   # second proposal of the same name
        (5, None, "Half", " ", 95),          # half-filled proposal: none
        (6, None, "Old Stuff", "why", 95),   # existing rejected row reused
    ], "id long, matched_category_id int, proposal_name string, proposal_reasoning string, confidence int")
    r = r.withColumn("proposal", cats.proposal(F.col("proposal_name"), F.col("proposal_reasoning")))
    got = {x.id: (x.resolved_name, x.resolved_status, x.routed_status) for x in cats.resolve_category(r, c).collect()}
    assert got[1] == ("Banking", "active", "auto_filed")
    assert got[2] == ("Banking", "active", "auto_filed")
    assert got[3] == ("New One", "pending_review", "needs_review")
    assert got[5] == (None, None, "needs_review")
    assert got[6] == ("Old Stuff", "rejected", "auto_filed")
    new = cats.new_proposed_categories(r, c).collect()
    assert [(x.name, x.description) for x in new] == [("New One", "why")]


def test_parse_model_json(spark):
    raws = ['{"urgency": "high", "confidence": 90, "suggested_action": "reply"}',
            '```json\n{"urgency": "high", "confidence": 90.7}\n```',
            '```\n{"confidence": "80"}\n```',
            '{"urgency": "hi',
            '{}', '5', 'null',
            '{"confidence": 150}', '{"urgency": "urgent"}',
            '{"category_proposal": {"category": "A", "reasoning": ""}}',
            '{"category_proposal": {"category": "A", "reasoning": "b"}, "matched_category_id": null}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id long, raw string")
    p = df.select("id", mio.parse_response(F.col("raw")).alias("p"))
    out = {x.id: x for x in p.select("id", "p.*", mio.response_violations(F.col("p")).alias("v"),
                                     mio.has_proposal(F.col("p")).alias("hp")).collect()}
    assert (out[0].urgency, out[0].confidence, out[0].suggested_action, out[0].v) == ("high", 90, "reply", [])
    assert (out[1].urgency, out[1].confidence) == ("high", 90)
    assert out[2].confidence == 80 and out[2].urgency == "low" and out[2].suggested_action == "none"
    assert out[3].v == ["malformed_json"]
    assert (out[4].urgency, out[4].confidence, out[4].summary, out[4].v) == ("low", 0, "", [])
    assert out[5].v == ["not_an_object"] and out[6].v == ["not_an_object"]
    assert out[7].v == ["confidence_out_of_range"]
    assert out[8].v == ["urgency_invalid"]
    assert out[9].hp is False and out[10].hp is True


def test_undo(spark):
    log = spark.createDataFrame([(1, 10, "archive", None), (2, 11, "delete", None), (3, 12, "label_applied", None),
                                 (4, 13, "reply_draft_created", None), (5, 14, "archive", "2024-01-01")],
                                "id long, email_id long, action_type string, undone_at string") \
        .withColumn("undone_at", F.col("undone_at").cast("timestamp"))
    req = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (99,)], "action_id long")
    got = {x.action_id: (x.outcome, x.reason, x.restores_email)
           for x in act.undo_actions(req, log, F.current_timestamp()).collect()}
    assert got[1] == ("applied", None, False)
    assert got[2] == ("applied", None, True)
    assert got[3] == ("applied", None, False)
    assert got[4] == ("rejected", "not undoable", False)
    assert got[5] == ("rejected", "already undone", False)
    assert got[99][0] == "rejected" and got[99][1] == "unknown action"


def test_revise_histogram(spark):
    hist = spark.createDataFrame([("s", "A", 2), ("s", "B", 1)], "sender_email string, label string, n long")
    before = spark.createDataFrame([(1, "s", "B"), (2, "s", "A"), (3, "s", "A")], "triage_id long, sender_email string, lbl string")
    after = spark.createDataFrame([(1, "s", "C"), (2, "s", "A"), (3, "s", "C")], "triage_id long, sender_email string, lbl string")
    out = rep.apply_histogram_deltas(hist, rep.revision_deltas(before, after, "lbl"))
    got = {(x.label, x.n) for x in out.collect()}
    assert got == {("A", 1), ("C", 2)}  # B reached zero and disappeared; same-label revision is a no-op


def test_knn_edges(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(1, 9)]
    vecs.append((9, [0.0] * 8))                        # zero vector
    vecs.append((10, vecs[0][1]))                      # exact duplicate of 1
    df = spark.createDataFrame(vecs, "id long, vec array<double>")
    nb = knn.blocked_topk(df, df, 3, exclude_self=True, block_rows=3).collect()
    by_q = {}
    for r in nb:
        by_q.setdefault(r.query_id, []).append((r.rank, r.email_id, r.similarity))
    for q, rows in by_q.items():
        assert len(rows) == 3 and all(e != q for _, e, _ in rows)       # self excluded, k kept
        sims = [s for _, _, s in sorted(rows)]
        finite = [s for s in sims if s == s]
        assert finite == sorted(finite, reverse=True)
    assert sorted(by_q[1])[0][1] == 10 and abs(sorted(by_q[1])[0][2] - 1.0) < 1e-12
    assert all(s != s for _, _, s in by_q[9])          # zero vector: NaN similarity
    for q, rows in by_q.items():                        # NaN ranks after every number
        if q != 9 and any(e == 9 for _, e, _ in rows):
            assert sorted(rows)[-1][1] == 9
