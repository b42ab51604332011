"""Properties: blocked top-k is independent of block size, LSH recall bound,
idempotent upserts and insert-if-absent."""

from pyspark.sql import functions as F

from conftest import SF_ORACLE
from inboxlake.operators import knn
from inboxlake.sources import store


def _vectors(spark):
    e = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), knn.as_double(F.col("embedding")).alias("vec"))


def test_blocked_topk_block_size_invariant(spark):
    v = _vectors(spark)
    a = knn.blocked_topk(v, v, 15).select("query_id", "email_id", "rank")
    b = knn.blocked_topk(v, v, 15, block_rows=53).select("query_id", "email_id", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_lsh_recall(spark):
    v = _vectors(spark)
    exact = knn.blocked_topk(v, v, 15).select("query_id", "email_id")
    approx = knn.approx_topk(v, v, 15, 64).select("query_id", "email_id")
    recall = approx.join(exact, ["query_id", "email_id"]).count() / exact.count()
    assert recall >= 0.9, recall


def test_upsert_and_insert_idempotent(spark):
    s = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, ver int")
    u = spark.createDataFrame([(2, "B", 2), (3, "c", 2)], "k long, v string, ver int")
    once = store.upsert_latest(s, u, "k", "ver")
    twice = store.upsert_latest(once, u, "k", "ver")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, "B"), (3, "c")}
    inc = spark.createDataFrame([(3, "x", 0), (3, "y", 1), (4, "z", 0)], "k long, v string, arrival int")
    new1 = store.insert_absent(once.select("k"), inc, "k", "arrival")
    assert {(r.k, r.v) for r in new1.collect()} == {(4, "z")}
    stored = once.select("k").unionByName(new1.select("k"))
    assert store.insert_absent(stored, inc, "k", "arrival").count() == 0
