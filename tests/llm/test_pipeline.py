"""The corpus pipeline: each stage judged on its own input."""

import re
from collections import Counter

import corpus_pipeline
from inboxlake.llm import common, decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = kept["quality"]
    scores, _ = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scores.where("predicted = 1")) and 0 < after.count() < before.count()

    before, after = kept["near_dedup"]
    groups = simhash.near_duplicates(before).select("doc_id", "component_id").collect()
    assert ids(after) == {r.component_id for r in groups} and after.count() == len(ids(after))

    before, after = kept["decontaminate"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = {tuple(w[s:s + 10]) for r in items.collect() for w in [decontaminate.words((r.text or "").encode())] if w
               for s in range(max(1, len(w) - 9))}
    dirty = set()
    for r in before.collect():
        w = decontaminate.words((r.text or "").encode())
        if any(tuple(w[s:s + k]) in windows for k in {len(x) for x in windows} for s in range(len(w) - k + 1)):
            dirty.add(r.doc_id)
    assert ids(after) == ids(before) - dirty and dirty

    before, after = kept["secrets"]
    old, new = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    secret = re.compile(r'(token = "|password=)([0-9a-f]{18,40})|(AKIA[0-9A-Z]{16})')
    assert not any(secret.search(t or "") for t in new.values())
    assert all(new[i] == t for i, t in old.items() if not re.search(r"[A-Za-z0-9+/_\-]{16}", t or ""))

    before, after = kept["packing"]
    rows = after.toPandas()
    assert ids(after) == ids(before) and rows.groupby("sequence_id").length.sum().max() <= 1024


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(docs)
