"""ST5 fold semantics per message: newest result wins, retractions balance, older arrivals are ignored."""

import uuid

import pytest

from inboxlake.session import shared_path
from inboxlake.streaming import sender_state as ss


@pytest.fixture
def state(spark):
    """(run a batch of results, its deltas)."""
    path = shared_path(spark, "t", uuid.uuid4().hex)
    table = ss.snapshots(spark, f"{path}/snapshots")
    schema = f"email_id long, {ss.SNAP_SCHEMA}"

    def run(batch_id, *rows, compact_every=0):
        ss.fold_into(table, f"{path}/deltas", compact_every)(spark.createDataFrame(list(rows), schema), batch_id)
        got = spark.read.schema(ss.DELTA_SCHEMA).parquet(f"{path}/deltas/batch={batch_id}").collect()
        return sorted(got, key=lambda r: (r.email_id, r.sign))
    run.table, run.log = table, f"{path}/deltas"
    return run


def test_fold_retracts_and_ignores_older(spark, state):
    d = state(0, (1, 10, "s", "A", "archive", 1, 50, 7, 70), (1, 11, "s", "B", "flag", 3, 70, 7, 71),
              (2, 5, "s", "A", "none", 2, 10, 8, 80))
    assert [(r.email_id, r.triage_id, r.sign, r.new_email) for r in d] == [(1, 11, 1, 1), (2, 5, 1, 1)]
    assert state(1, (1, 9, "s", "Z", "reply", 4, 99, 7, 72)) == []      # older than the stored result: nothing
    assert state(2, (1, 11, "s", "B", "flag", 3, 70, 7, 71)) == []      # the same result again: nothing
    d = state(3, (1, 12, "s", "C", "delete", 4, 90, 7, 73), compact_every=4)  # newer: retract B, add C, count unchanged
    assert [(r.triage_id, r.sign, r.new_email) for r in d] == [(11, -1, 0), (12, 1, 0)]
    assert sum(r.urgency_weight for r in d) == 1 and sum(r.confidence for r in d) == 20
    again = state(3, (1, 12, "s", "C", "delete", 4, 90, 7, 73))         # the batch is run again: the same deltas
    assert again == d
    assert {r.email_id: r.triage_id for r in state.table.read().collect()} == {1: 12, 2: 5}  # merged: a row a message
    d = state(4, (1, 13, "t", "D", "none", 1, 10, 7, 74))               # from the merged part on
    assert [(r.triage_id, r.sender_email, r.sign) for r in d] == [(12, "s", -1), (13, "t", 1)]
    stats = {r.sender_email: r for r in ss.stats_from_deltas(
        spark.read.schema(ss.DELTA_SCHEMA).parquet(state.log)).collect()}
    assert stats["s"].email_count == 1 and stats["s"].avg_urgency_score == 2   # message 1 has moved to t
    assert stats["t"].email_count == 1 and stats["t"].avg_confidence == 10


def test_fold_of_nothing_and_of_null_labels(state):
    assert state(0) == [] and state.table.read().collect() == []
    d = state(1, (1, 3, None, None, None, 0, 0, 7, 70))
    assert [r.category for r in d] == [None] and [r.triage_id for r in state.table.read().collect()] == [3]
