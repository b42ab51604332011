"""Chains of merges, edits of categories, moved senders."""

import datetime as dt

from pyspark.sql import functions as F

from inboxlake.operators import categories as cats


def roots(spark, rows):
    df = spark.createDataFrame(rows, "id long, merged_into_id long")
    return {r.id: (r.root_id, r.hops, r.in_cycle) for r in cats.merge_roots(df).collect()}


def test_roots_of_chains_cycles_and_unknown_targets(spark):
    got = roots(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, None), (7, 99), (8, 9), (9, 10), (10, 8), (11, 8),
                        (12, 12), (13, 6)])
    assert [got[i] for i in range(1, 7)] == [(6, 6 - i, False) for i in range(1, 7)]
    assert got[7] == (7, 0, False) and got[13] == (6, 1, False)
    assert all(got[i] == (None, None, True) for i in (8, 9, 10, 11, 12))
    assert roots(spark, []) == {} and roots(spark, [(1, None)]) == {1: (1, 0, False)}


def test_a_chain_of_a_thousand(spark):
    got = roots(spark, [(i, i + 1 if i < 999 else None) for i in range(1000)])
    assert all(got[i] == (999, 999 - i, False) for i in range(1000))


def test_compressed(spark):
    c = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id long, merged_into_id long")
    t = spark.createDataFrame([(i, i, i) for i in (1, 2, 3, 4, None)], "id long, category_id long, llm_category_id long")
    t2, c2 = cats.compress_merges(t, c)
    assert {r.id: r.category_id for r in t2.collect()} == {1: 3, 2: 3, 3: 3, 4: 4, None: None}
    assert {r.id: r.llm_category_id for r in t2.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, None: None}
    assert {r.id: r.merged_into_id for r in c2.collect()} == {1: 3, 2: 3, 3: None, 4: 5, 5: 4}


def test_edits_field_by_field(spark):
    c = spark.createDataFrame([(1, "A", "a"), (2, "B", None), (3, "C", "c")], "id int, name string, description string")
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    edits = spark.createDataFrame(
        [(1, at(1), 1, "X", "first"), (2, at(2), 1, None, "second"), (3, at(3), 2, "  ", None), (4, at(4), 2, "C", None),
         (5, at(2), 3, " Y ", None), (6, at(3), 3, "X", None), (7, at(9), 99, "Z", "z")],
        "cmd_id long, ts timestamp, category_id int, new_name string, new_description string")
    got = {r.id: (r.name, r.description) for r in cats.edit_categories(c, edits).collect()}
    # 1 took X before 3 did; C is another's; a blank name is none; each field has its own latest value
    assert got == {1: ("X", "second"), 2: ("B", None), 3: ("C", "c")}
    assert cats.edit_categories(c, edits.limit(0)).select(F.count("*")).first()[0] == 3
