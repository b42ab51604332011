"""Archives of other writers, pushed filters with nulls, hot payloads, the reader's partitions."""

import gzip
import io
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inboxlake.llm import common, warc


def crawl_record(kind, uri, block, extra=()):
    fields = [("WARC-Type", kind), ("WARC-Target-URI", uri), ("Content-Length", len(block)), *extra]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


HTTP = ("Content-Type", "application/http; msgtype=response")
BIG = "".join(random.Random(4).choices("0123456789abcdef", k=400_000)).encode()
RECORDS = [
    crawl_record("warcinfo", None, b"software: some crawler\r\n"),
    crawl_record("request", "http://a/", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", [("content-type", "application/http; msgtype=request")]),
    crawl_record("response", "http://a/", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>a\r\n\r\nb</p>",
                 [HTTP, ("WARC-Payload-Digest", "sha1:ABC")]),
    crawl_record("response", "<http://b/>", b"HTTP/1.1 200 OK\r\n\r\n" + BIG, [HTTP]),
    crawl_record("response", "http://c/", b"HTTP/1.1 204 No Content\r\n\r\n", [HTTP]),
    crawl_record("revisit", "http://a/", b"HTTP/1.1 200 OK\r\n\r\n", [HTTP]),
    crawl_record("resource", "ftp://d/", b"plain\r\n\r\nfile"),
    crawl_record("metadata", "http://a/", b"k: v")]
WANT = [("warcinfo", None, None), ("request", "http://a/", None), ("response", "http://a/", b"<p>a\r\n\r\nb</p>"),
        ("response", "http://b/", BIG), ("response", "http://c/", b""), ("revisit", "http://a/", None),
        ("resource", "ftp://d/", b"plain\r\n\r\nfile"), ("metadata", "http://a/", None)]


@pytest.fixture(scope="module")
def crawl(spark):
    """A folder with a gzip member a record, a plain file, and one gzip stream over all records."""
    path = common.scratch(spark, "crawl")
    os.makedirs(f"{path}/part")
    for name, data in (("a.warc.gz", b"".join(map(gzip.compress, RECORDS))), ("part/b.warc", b"".join(RECORDS)),
                       ("part/c.warc.gz", gzip.compress(b"".join(RECORDS))), ("d.txt", b"not an archive"),
                       ("e.warc.gz", b"")):
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    return path


def test_reads_other_writers_archives(spark, crawl):
    seen = lambda df: Counter((r.record_type, r.target_uri, r.payload and bytes(r.payload)) for r in df.collect())
    plain = [(k, u, p or None) if not p else (k, u, p) for k, u, p in WANT]
    got = Counter((r.record_type, r.target_uri, None if r.payload is None else bytes(r.payload))
                  for r in warc.read_archives(spark, crawl).collect())
    assert got == Counter(WANT * 3)
    assert seen(warc.read_archives(spark, crawl, payload=False)) == Counter([(k, u, None) for k, u, _ in plain] * 3)
    one = warc.read_archives(spark, f"{crawl}/a.warc.gz").where("record_type = 'response' AND target_uri = 'http://a/'")
    row = one.first()
    assert one.count() == 1 and row.payload_digest == "ABC" and row.payload_bytes == len(row.payload)
    assert warc.read_archives(spark, crawl).where("page_id = 3").count() == 0


def test_members_keep_no_unwanted_bytes():
    data = io.BytesIO(b"".join(map(gzip.compress, RECORDS)))
    members, heads = warc.Members(data, True), 0
    while (head := members.head()) is not None:
        heads += 1
        assert members.block(warc.parse_head(head)["block_bytes"], False) == b""
        assert len(members.out) <= members.STEP
    assert heads == len(RECORDS)
    cut = warc.Members(io.BytesIO(b"".join(map(gzip.compress, RECORDS))[:-20]), True)  # a file that breaks off
    while (head := cut.head()) is not None:
        cut.block(warc.parse_head(head)["block_bytes"], True)


def test_pushed_membership_with_null(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "b", "y"), (3, "c", "z")], "page_id long, url string, html string")
    path = common.scratch(spark, "warc")
    warc.write_pages(pages, path)
    back = warc.read_archives(spark, path)
    assert back.where("target_uri IN ('b', NULL)").count() == 1
    assert back.where("target_uri IN ('b', 'c')").count() == 2
    assert back.where("target_uri = NULL").count() == 0
    assert back.where("target_uri IS NULL").count() == 1
    assert back.where("NOT target_uri IN ('b', 'x')").count() == 1
    assert back.where("payload_bytes = 1 AND record_type = 'response'").count() == 3


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_hot_payload(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(warc, "HOT_ROWS", hot_rows)
    rows = [(i, f" u{i} ", "copy" if i % 3 else "other" if i % 2 else f"own {i}") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x"))
    path = common.scratch(spark, "warc")
    warc.write_pages(pages.repartition(7), path)
    back = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(back) == 90 and {r.target_uri for r in back.values()} == {u for _, u, _ in rows}
    last = {}
    for i, _, h in rows:
        last[h] = i
    for i, _, h in rows:
        assert back[i].refers_to == (None if last[h] == i else last[h])
        assert (back[i].payload is None) == (last[h] != i)
        assert back[i].payload_digest == warc.digest(h.encode())


def test_partitions_take_whole_files(monkeypatch):
    reader = warc.WarcReader("x", True, 4)
    reader.files = lambda: ([(f"f{i}", 10) for i in range(10)] + [("big", 500)], True)
    monkeypatch.setattr(warc, "LEAST_BYTES", 30)
    groups = [p.paths for p in reader.partitions()]
    assert [p for g in groups for p in g] == [f"f{i}" for i in range(10)] + ["big"] and len(groups) <= 4
    reader.files = lambda: ([], True)
    assert [p.paths for p in reader.partitions()] == [[]]


def test_digest_column(spark):
    texts = ["", "a", "é" * 100, "x" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        warc.digest_column(F.sha1(F.col("t").cast("binary")))).collect()
    assert [r[0] for r in got] == [warc.digest(t.encode()) for t in texts]
