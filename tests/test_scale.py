"""Work that grew faster than the input: equal vectors, entities of one text, tasks by bytes, broadcasts, batches."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inboxlake.operators import categories as cats
from inboxlake.operators import knn, partitioning, search
from inboxlake.operators import privacy as pv
from inboxlake.sources import mime


def ranked(df):
    return sorted((r.query_id, r["rank"], r.email_id, round(r.similarity, 9)) for r in df.collect())


def test_many_entities_of_one_text(spark):
    """Numbering computed every list anew for each entity: 120 of them never ended."""
    names = [f"user{i % 100}@host.example.org" for i in range(120)]
    df = spark.createDataFrame([(1, names[7] + " and " + names[99], " or ".join(names))], "id long, subject string, body string")
    row = pv.anonymize_columns(df).first()
    order = [names[99], names[7], *[n for n in reversed(names) if n not in (names[99], names[7])]]
    number = {n: i for i, n in enumerate(dict.fromkeys(order), 1)}
    hide = lambda text: re.sub(r"user\d+@host.example.org", lambda m: f"[EMAIL_ADDRESS_{number[m.group(0)]}]", text)
    assert row.anonymized_subject == hide(df.first().subject)
    assert row.anonymized_body == hide(df.first().body)
    assert [m.placeholder for m in row.pii_mappings] == [f"EMAIL_ADDRESS_{i}" for i in range(1, 101)]
    _, maps = pv.anonymize_stage(df, parity=True)
    found = {m.placeholder: m.original_value for m in maps.collect()}
    assert len(found) == maps.count() == 100 and found["EMAIL_ADDRESS_1"] == names[119]  # the body's, not the subject's


def test_overlaps_of_spans_are_resolved_as_before():
    rules = [pv.Recognizer("A", "b+", 0.5), pv.Recognizer("B", "a+b", 0.7), pv.Recognizer("C", "c", 0.9), pv.Recognizer("D", "bb", 0.6)]
    found = [(s["entity_type"], s["start"], s["end"]) for s in pv.detect_spans("aabbbbc bb aab", rules)]
    assert found == [("B", 0, 3), ("D", 4, 6), ("C", 6, 7), ("D", 8, 10), ("B", 11, 14)]


def test_mappings_are_detected_once(spark):
    df = spark.createDataFrame([(1, "s", "a@b.org")], "id long, subject string, body string")
    _, maps = pv.anonymize_stage(df)
    assert maps._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_tasks_follow_the_bytes(spark, tmp_path):
    path = str(tmp_path / "texts with blanks")
    spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "texts with blanks").glob("*.parquet"))
    assert partitioning.tasks_for(df, 10_000) == -(-size // 10_000)
    assert partitioning.tasks_for(df, 1 << 30) == 2 * spark.sparkContext.defaultParallelism


def test_chains_are_merged_without_broadcast(spark):
    c = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id int, merged_into_id int")
    roots = cats.merge_roots(c)
    assert "Broadcast" not in roots._jdf.queryExecution().executedPlan().toString()
    t = spark.createDataFrame([(1, 1), (2, 1), (3, 4), (4, None), (5, 9)], "id int, category_id int")
    out, _ = cats.compress_merges(t, c)
    assert sorted((r.id, r.category_id) for r in out.collect()) == [(1, 3), (2, 3), (3, 4), (4, None), (5, 9)]


def test_stems_are_dealt_by_document_before_repeats_go(spark, tmp_path):
    path = str(tmp_path / "postings")
    spark.createDataFrame([(1, "run"), (1, "running"), (1, "runs"), (2, "run")], "doc_id long, term string").write.parquet(path)
    out = search.stemmed(spark.read.parquet(path), "doc_id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "run"), (2, "run")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(doc_id#" in plan and "REPARTITION_BY_NUM" in plan


def test_messages_are_handed_on_in_slices():
    raw = b"Message-ID: <a@b>\nSubject: s\n\nbody"
    n = 2 * mime.PARSED_ROWS + 1
    outs = list(mime._parse_batches([pd.DataFrame({"uid": range(n), "content": [raw] * n})]))
    assert [len(o) for o in outs] == [mime.PARSED_ROWS, mime.PARSED_ROWS, 1]
    assert pd.concat(outs)["uid"].tolist() == list(range(n))


def test_equal_vectors_are_searched_once_with_the_same_answer(spark, monkeypatch):
    rng = np.random.default_rng(4)
    some = rng.standard_normal((5, 8))
    stored = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)] + [(60 + i, some[i % 5].tolist()) for i in range(10)]
    asked = stored[:20] + [(60 + i, some[i % 5].tolist()) for i in range(40)]
    q, c = (spark.createDataFrame(r, "id long, vec array<double>") for r in (asked, stored))
    want = ranked(knn.blocked_topk(q, c, 4))
    searched = []
    whole = knn.blocked_topk
    monkeypatch.setattr(knn, "blocked_topk", lambda a, *x, **y: searched.append(a.count()) or whole(a, *x, **y))
    assert ranked(knn.distinct_topk(q, c, 4)) == want
    assert searched == [25]


def test_blocks_of_a_bucket_follow_the_dimension(spark, monkeypatch):
    seen = []
    whole = knn.blocked_topk
    monkeypatch.setattr(knn, "blocked_topk", lambda *x, **y: seen.append(y) or whole(*x, **y))
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vec array<double>")
    knn.approx_topk(v, v, 2, 64)
    assert seen[0]["block_rows"] * 64 * 8 == knn.BLOCK_BYTES


def test_tiles_hold_a_bounded_score_matrix_and_give_the_whole_answer(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(9)
    v = rng.standard_normal((700, 6))
    v[5] = 0
    v[300:420] = v[7]  # equal vectors: ties go to the smaller id
    ids = rng.permutation(700)
    table = pa.table({"id": ids, "vec": pa.array(list(v), pa.list_(pa.float64()))})
    monkeypatch.setattr(knn, "TILE_QUERIES", 64)
    monkeypatch.setattr(knn, "TILE_ROWS", 600)
    got = {}
    for r in knn._block_topk(9, True)(table, table).to_pylist():
        got.setdefault(r["query_id"], []).append(r)
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, np.nan, np.linalg.norm(v, axis=1, keepdims=True))
    for i, own in zip(ids, u):
        sim = np.einsum("ij,ij->i", u, np.broadcast_to(own, u.shape))
        order = sorted((j for j in range(700) if ids[j] != i), key=lambda j: (np.isnan(sim[j]), -np.nan_to_num(sim[j]), ids[j]))[:9]
        mine = sorted(got[i], key=lambda r: (np.isnan(r["similarity"]), -np.nan_to_num(r["similarity"]), r["email_id"]))[:9]
        assert [r["email_id"] for r in mine] == [ids[j] for j in order]


def test_spans_of_a_tile_that_hold_nothing_are_not_looked_into():
    rng = np.random.default_rng(3)
    sim = rng.standard_normal((40, 4 * knn.TILE_SPAN)).astype(np.float32)
    least = np.r_[np.full(20, 2.5), np.full(19, -np.inf), np.inf].astype(np.float32)
    for width in (4 * knn.TILE_SPAN, 3 * knn.TILE_SPAN + 5):  # whole spans, and a tile of what is over
        part = np.ascontiguousarray(sim[:, :width])
        for found, wanted in zip(knn._reaching(part, least), np.nonzero(part >= least[:, None])):
            assert found.tolist() == wanted.tolist()
    v = rng.standard_normal((5 * knn.TILE_SPAN + 9, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r, c, _ = knn._top(v[:50], np.arange(50), v, np.arange(len(v)), 7, True)
    exact = v[:50] @ v.T
    exact[np.arange(50), np.arange(50)] = -2
    assert c.reshape(50, 7).tolist() == np.argsort(-exact, axis=1, kind="stable")[:, :7].tolist()


def test_an_equal_header_is_parsed_once(monkeypatch):
    """A message looked at its content type nine times, each time parsing it anew."""
    from email import headerregistry
    parse, seen = headerregistry.ContentTypeHeader.value_parser, []
    monkeypatch.setattr(headerregistry.ContentTypeHeader, "value_parser", staticmethod(lambda v: seen.append(v) or parse(v)))
    raw = "Message-ID: <m{}@x>\nSubject: s\nContent-Type: text/plain; charset=utf-8; name=\"once\"\n\nHello {}"
    for i in range(4):
        row = mime._parse_one(i, raw.format(i, i).encode(), None)
        assert row["ok"] and row["message_id"] == f"m{i}@x" and row["plain"] == f"Hello {i}"
    assert len(seen) == 1
    long = "Message-ID: <m@x>\nSubject: " + "a" * 2000 + "\n\nx"
    before = mime._header.cache_info().currsize
    assert len(mime._parse_one(1, long.encode(), None)["subject"]) == 2000
    assert mime._header.cache_info().currsize <= before + 3 and mime._header.cache_info().maxsize == mime.KEPT_HEADERS


def test_recognisers_try_only_places_where_a_match_begins():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("0123456789+-(). aZ")) for _ in range(90)) for _ in range(300)]
    texts += ["1.2.3.4.5 10.0.0.1, +1 (555) 123-4567", "4111 1111 1111 1111 123-45-6789", "x٣٤٥-12-3456", "((12)345 6789", ""]
    tried = [r for r in pv.DEFAULT_RECOGNIZERS if r.first]
    assert {r.entity_type for r in tried} == {"IP_ADDRESS", "CREDIT_CARD", "US_SSN", "PHONE_NUMBER"}
    for r in pv.DEFAULT_RECOGNIZERS:
        for text in texts:
            assert [m.span() for m in pv._matches(r, text)] == [m.span() for m in re.finditer(r.pattern, text)]


def test_stage_embeds_a_message_once(spark, tmp_path):
    """The search counts, filters and deals its queries: each of these embedded every message anew."""
    from inboxlake.operators import triage
    from inboxlake.streaming import pipeline as pl
    calls = spark.sparkContext.accumulator(0)

    def embedder(text):
        def fn(s: pd.Series) -> pd.Series:
            calls.add(int(s.notna().sum()))
            return s.map(lambda t: None if t is None else [float(len(t)), 1.0])
        return F.pandas_udf(fn, "array<double>")(text)
    msgs = spark.createDataFrame([(i, "a@b.org", "b.org", f"s{i}", "text " * i, True) for i in range(1, 7)],
                                 "id long, sender_email string, sender_domain string, anonymized_subject string, "
                                 "anonymized_body string, is_anonymized boolean")
    seed = pl.empty_seed(spark)
    emails = msgs.select("id", "sender_email", "sender_domain", "anonymized_subject", F.current_timestamp().alias("created_at"))
    stored = spark.createDataFrame([(9, [1.0, 2.0]), (2, [0.5, 1.0])], "email_id long, embedding array<double>")
    taken = []

    def materialize(df, name):
        taken.append(name)
        df.write.parquet(f"{tmp_path}/{name}")
        if name == "answered":  # parsed here, not by each of the outputs
            assert {"parsed", "violations"} <= set(df.columns)
        return spark.read.parquet(f"{tmp_path}/{name}")
    hashing, triage.hashing_embedder = triage.hashing_embedder, lambda dims: embedder
    try:
        outputs = triage.triage_stage(msgs, stored, emails, seed["results"], seed["categories"], dims=2, materialize=materialize)
    finally:
        triage.hashing_embedder = hashing
    for out in outputs:
        assert not re.search("parse_?json", out._jdf.queryExecution().optimizedPlan().toString().lower())
    assert outputs[2].where("status = 'started'").count() == 6
    assert taken == ["query_vectors", "answered"] and calls.value == 6


def test_hashed_vectors_of_tokens_hashed_together():
    import zlib

    from inboxlake.operators import triage
    texts = ["Ärger mit  dem\tZug ", "", " \n", "a a a b", "x y " * 50]
    out = triage._hash_embed(pd.Series([*texts, None]), 8)
    assert out[5] is None
    for text, got in zip(texts, out):
        v = np.zeros(8)
        for token in text.lower().split():
            h = zlib.crc32(token.encode("utf-8"))
            v[h % 8] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(v)
        assert got == (v / n if n > 0 else v).tolist() and all(type(x) is float for x in got)
