"""Library operators without a registered query of their own: keyset paging (O3),
versioned publish (S11), bulk update (S14), hierarchy (J10)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from inboxlake.operators import categories as cats
from inboxlake.operators import queue
from inboxlake.sources import store
from inboxlake.sources.fixtures import Fixture


def test_keyset_paging_equals_offset_paging(spark):
    fx = Fixture(spark, SF_SMALL)
    base = queue.queue_base(fx.emails, fx.triage).select("id", "urgency_weight", "received_at").cache()
    for sort in ("urgency", "recent"):
        p1 = queue.page(queue.sort_queue(base, sort), 1).collect()
        last = p1[-1]
        p2 = queue.page_after(base, (last.urgency_weight, last.received_at, last.id), sort).collect()
        want = queue.page(queue.sort_queue(base, sort), 2).collect()
        assert [r.id for r in p2] == [r.id for r in want]


def test_publish_and_read_current(spark):
    df1 = spark.createDataFrame([(1, "a")], "k long, v string")
    df2 = spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    store.publish(spark, df1, "pub_test")
    assert store.read_current(spark, "pub_test").count() == 1
    store.publish(spark, df2, "pub_test")
    assert sorted(r.v for r in store.read_current(spark, "pub_test").collect()) == ["b", "c"]


def test_bulk_set(spark):
    df = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "completed")], "id long, pipeline_status string")
    keys = spark.createDataFrame([(1,), (1,), (3,)], "id long")
    out = {r.id: r.pipeline_status for r in store.bulk_set(df, keys, "id", "pipeline_status", F.lit("processing")).collect()}
    assert out == {1: "processing", 2: "pending", 3: "processing"}


def test_hierarchy_one_level(spark):
    c = spark.createDataFrame([(1, "Root", None, None), (2, "Child", 1, None), (3, "Old", None, 2)],
                              "id int, name string, parent_category_id int, merged_into_id int")
    got = {r.id: (r.parent_name, r.merged_into_name) for r in cats.hierarchy(c).collect()}
    assert got == {1: (None, None), 2: ("Root", None), 3: (None, "Child")}
