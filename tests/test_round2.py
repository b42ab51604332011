"""Faults that an earlier version had: late deliveries, resumed streams, recognisers, overflow, keys, vectors."""

import json

import pytest
from pyspark.sql import functions as F

from inboxlake.functions import model_io as mio
from inboxlake.operators import knn
from inboxlake.operators import privacy as pv
from inboxlake.session import shared_path
from inboxlake.streaming import dedup, runner


def test_dedup_keeps_late_first_deliveries_and_resumes(spark):
    import uuid
    source, sink, ckpt = (shared_path(spark, "t", uuid.uuid4().hex) for _ in range(3))
    polls = [[(1, "2024-01-10"), (2, "2024-01-11")], [(2, "2024-01-11"), (3, "2024-03-01")],
             [(4, "2023-06-01"), (1, "2024-01-10")], [(5, "2022-01-01"), (4, "2023-06-01")]]
    schema = spark.createDataFrame([], "id long, ts string").schema
    for half in (polls[:2], polls[2:]):
        for rows in half:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = dedup.dedup_stream(spark, source, schema, "id", sink=sink, checkpoint=ckpt)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "2024-01-10"), (2, "2024-01-11"), (3, "2024-03-01"), (4, "2023-06-01"), (5, "2022-01-01")]


def test_a_failed_stream_raises(spark):
    import uuid
    source = shared_path(spark, "t", uuid.uuid4().hex)
    spark.range(3).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        runner.run_available_now(stream.writeStream.format("noop").option(
            "checkpointLocation", shared_path(spark, "t", uuid.uuid4().hex)))


def test_custom_recognisers_entities_and_threshold(spark):
    df = spark.createDataFrame([("ticket T-123 to a.b@c.org",)], "t string")
    ticket = pv.Recognizer("TICKET", r"T-\d+", 0.9, hint="T-")
    kinds = lambda **k: [s["entity_type"] for s in df.select(pv.detect(F.col("t"), **k).alias("s")).first().s]
    assert kinds(recognizers=[ticket]) == ["TICKET"]
    assert kinds() == ["EMAIL_ADDRESS"]
    both = [ticket, *pv.DEFAULT_RECOGNIZERS]
    assert kinds(recognizers=both, entities=["TICKET"]) == ["TICKET"]
    assert kinds(recognizers=both, threshold=0.95) == ["EMAIL_ADDRESS"]


@pytest.mark.parametrize("given, valid", [(99999999999, False), (1e30, False), (-1e30, False), (85, True), (101, False)])
def test_confidence_beyond_int_is_out_of_range(spark, given, valid):
    df = spark.createDataFrame([(json.dumps({"confidence": given}),)], "raw string")
    ok, bad = mio.split_responses(df)
    assert (ok.count(), bad.count()) == ((1, 0) if valid else (0, 1))


def test_no_key_no_encryption(spark):
    old = spark.conf.get("inboxlake.crypto.key", None)
    spark.conf.unset("inboxlake.crypto.key")
    try:
        with pytest.raises(ValueError):
            pv.session_key(spark)
    finally:
        if old:
            spark.conf.set("inboxlake.crypto.key", old)


def test_rejected_vectors_do_not_reach_the_kernel(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, vec array<double>")
    store = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [1.0, 2.0, 3.0])], "email_id long, embedding array<double>")
    emails = spark.createDataFrame([(7, "s")], "id long, anonymized_subject string")
    triage = spark.createDataFrame(
        [(1, 7, "corrected", 1, 1, None, "low", "low", "none", "none")],
        "id long, email_id long, status string, category_id int, llm_category_id int, proposed_category_name string, "
        "urgency string, llm_urgency string, suggested_action string, llm_suggested_action string")
    categories = spark.createDataFrame([(1, "A")], "id int, name string")
    got = knn.find_similar(q, store, emails, triage, categories, dims=2).collect()
    assert [(r.query_id, r.email_id) for r in got] == [(1, 7)]


def test_spread_runs_no_job_while_planning(spark):
    from inboxlake.operators.partitioning import spread
    tracker = spark.sparkContext.statusTracker()
    a = spark.range(1000).join(spark.range(1000).withColumnRenamed("id", "k"), F.col("id") == F.col("k"))
    group = "spread-planning"
    spark.sparkContext.setJobGroup(group, "plan only")
    spread(a)
    assert list(tracker.getJobIdsForGroup(group)) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pipeline_resumes_with_its_sink_and_checkpoint(spark):
    from inboxlake.streaming import pipeline as pl
    from inboxlake.streaming.runner import fresh_paths, land_polls
    mail = "From: Ann <ann{0}@a.example>\r\nMessage-ID: <m{0}@a.example>\r\nSubject: hello bob{0}@b.example\r\n\r\nBody {0}"
    raw = spark.createDataFrame([(i, bytearray(mail.format(i).encode()), i // 3) for i in range(6)],
                                "uid long, content binary, poll int")
    seed = pl.empty_seed(spark, categories=spark.createDataFrame(
        [(1, "Banking", "active", None, None, None)], pl.SCHEMAS["categories"]))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sink, checkpoint = fresh_paths(spark, "resume_test")

    def fails_first(prompt):
        answer = F.lit('{"category_proposal": {"category": "Topic", "reasoning": "new"}, "confidence": 90}')
        return F.when(~((F.col("id") % 3 == 1) & (F.col("attempt") == 1)), answer)

    path = None
    for k in (0, 1):  # the retry round after the first run must not take the number of the second run's batch
        part = raw.where(F.col("poll") == k).withColumn("poll", F.lit(0))
        path = land_polls(spark, part, "resume_test", "poll", 1, path=path)
        store = pl.run_pipeline(spark, path, raw.drop("poll").schema, seed, now, backend=fails_first,
                                sink=sink, checkpoint=checkpoint)
        status = {r.id: r.pipeline_status for r in pl.pipeline_status(store).collect()}
        assert status == {i: "completed" for i in range(3 * (k + 1))}
    results = store.read("results").collect()
    assert sorted(r.email_id for r in results) == list(range(6))
    assert len({r.id for r in results}) == 6
    # one category for the proposed name, referenced by every result
    assert [(r.id, r.name) for r in store.read("categories").where("status = 'pending_review'").collect()] == [(2, "Topic")]
    assert {r.llm_category_id for r in results} == {2}
    assert {r.llm_backend for r in results} == {"rules"}
    logs = {(r.stage, r.status): r["count"] for r in store.read("logs").groupBy("stage", "status").count().collect()}
    assert logs[("anonymize", "succeeded")] == 6 and logs[("anonymize", "skipped")] == 2
    assert logs[("embed", "succeeded")] == 6 and logs[("triage", "failed")] == 2
    texts = [r.anonymized_subject for r in store.read("messages").collect()]
    assert all("@" not in t and "[EMAIL_ADDRESS_1]" in t for t in texts)


def test_refused_vectors_become_failed_rows(spark):
    from inboxlake.streaming.pipeline import embed_logs
    df = spark.createDataFrame([(1, [1.0], 1), (2, None, 2)], "email_id long, embedding array<double>, attempt int")
    got = {(r.email_id, r.status, r.attempt, r.message) for r in embed_logs(df, F.current_timestamp()).collect()}
    assert got == {(1, "started", 1, None), (1, "succeeded", 1, None), (2, "started", 2, None),
                   (2, "failed", 2, "no vector of the expected dimension")}
