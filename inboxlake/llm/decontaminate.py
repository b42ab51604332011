"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of benchmark words.

Words are the alphabet: a block is two consecutive words.  For the windows of one length a shift table says how far
the search may advance when a block ends at the current word (positions where no window can end are skipped), the
bucket of the last block selects the windows to try, their first block is compared next, and a direct comparison of
all words confirms an occurrence.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 10
#: (window, item) pairs of a block: what the driver holds and broadcasts at once.
BLOCK_PAIRS = 50_000

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if b in _WORD_BYTES else 32 for b in bytes(range(256)).translate(bytes.maketrans(_UPPER, _LOWER)))
_TABLES: dict[int, list[WindowSearch]] = {}


def words(text: bytes | None) -> tuple[bytes, ...]:
    """Lower-cased (A-Z) words of a text in UTF-8: runs of digits, letters a-z and all beyond ASCII."""
    return tuple(text.translate(_FOLD).split()) if text else ()


class WindowSearch:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, pairs: list[tuple[tuple[bytes, ...], int | None]]):
        self.length = len(pairs[0][0])
        self.block = min(2, self.length)
        self.farthest = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, list]]] = {}
        for window, item in pairs:
            for end in range(self.block, self.length + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.farthest), self.length - end)
            bucket = self.buckets.setdefault(window[-self.block:], {})
            bucket.setdefault(window[:self.block], {}).setdefault(window, []).append(item)

    def find(self, text: tuple[bytes, ...]) -> Iterator[tuple[int, list]]:
        """(first word, items) of each occurrence."""
        end, size, block, far, shift = self.length, len(text), self.block, self.farthest, self.shift
        while end <= size:
            last = text[end - block:end]
            skip = shift.get(last, far)
            if skip:
                end += skip
                continue
            start = end - self.length
            same_start = self.buckets[last].get(text[start:start + block])
            if same_start:
                items = same_start.get(text[start:end])
                if items is not None:
                    yield start, items
            end += 1


def _tables(block) -> list[WindowSearch]:
    """The tables of a broadcast block, built once in a worker; the last block built is kept."""
    if block.id not in _TABLES:
        _TABLES.clear()
        by_length: dict[int, list] = {}
        for window, item in block.value:
            split = tuple(window.split(b" "))
            by_length.setdefault(len(split), []).append((split, item))
        _TABLES[block.id] = [WindowSearch(p) for p in by_length.values()]
    return _TABLES[block.id]


class _Block:
    """A broadcast with a stable id."""

    def __init__(self, id: str, sent):
        self.id, self.sent = id, sent

    @property
    def value(self):
        return self.sent.value


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window binary: words joined by a space, item_id long) of ``items`` (item_id, text)."""
    def cut(batches):
        for batch in batches:
            out, ids = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    out.append(b" ".join(w[i:i + window]))
                    ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())],
                                             ["window", "item_id"])
    return (items.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
            .mapInArrow(cut, "window binary, item_id long").distinct())


def search_blocks(items: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> list[_Block]:
    """The windows of ``items`` (item_id, text) as broadcast blocks of about ``block_pairs`` (window, item) pairs.

    The windows are cut and made distinct in Spark; the driver reads one hash block at a time, so what it holds and
    the size of a broadcast don't grow with the benchmark.
    """
    spark = items.sparkSession
    pairs = common.stored(windows(items, window), "windows")
    n_blocks = max(1, -(-pairs.count() // block_pairs))
    block_of = F.pmod(F.xxhash64("window", "item_id"), F.lit(n_blocks))
    blocks = []
    for i in range(n_blocks):
        rows = [(bytes(r[0]), r[1]) for r in pairs.where(block_of == i).toLocalIterator()]
        if rows:
            blocks.append(_Block(uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
    return blocks


def _search(texts: list[tuple[bytes, ...]], blocks: list[_Block]) -> tuple[list[bytearray], list[set]]:
    """Per text the marks of its hit words and the items found; one block's tables are held at a time."""
    hits = [bytearray(len(t)) for t in texts]
    found: list[set] = [set() for _ in texts]
    for block in blocks:
        for table in _tables(block):
            mark = b"\1" * table.length
            for text, hit, seen in zip(texts, hits, found):
                for start, ids in table.find(text):
                    hit[start:start + table.length] = mark
                    seen.update(ids)
    return hits, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, spans of hit words (start, end after the last; maximal
    runs), items (ids that occur, as strings in order).

    ``items``: item_id, text.  Texts aren't shuffled; a task holds one Arrow batch.

    Null or wordless texts: no words, no hits, no items.  An item without words has no window.  Windows of an item
    whose id is null mark words but aren't listed as an item.  Items repeated with one id count once.  Repeated
    documents give a row each.  Empty tables: no rows, or no hits.  Other columns are ignored.
    """
    blocks = search_blocks(items, window, block_pairs)

    def search(batches):
        for batch in batches:
            texts = [words(t) for t in batch.column(1).to_pylist()]
            hits, found = _search(texts, blocks)
            spans = [[{"start": m.start(), "end": m.end()} for m in re.finditer(b"\1+", h)] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array([sorted(str(i) for i in seen if i is not None) for seen in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        search, "doc_id long, n_words long, spans array<struct<start int, end int>>, items array<string>")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in whose text no window of ``items`` occurs, with all their columns and no shuffle."""
    blocks = search_blocks(items, window)
    at = docs.columns.index("text")

    def clean(batches):
        for batch in batches:
            texts = [words(t.encode() if t is not None else None) for t in batch.column(at).to_pylist()]
            hits, _ = _search(texts, blocks)
            yield batch.filter(pa.array([1 not in h for h in hits], pa.bool_()))
    return docs.mapInArrow(clean, docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


_SQL_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
hits AS (SELECT pos.doc_id, s, pos.k, item_id FROM pos JOIN win
  ON win.k = pos.k AND win.t = array_to_string(w[s:s + pos.k - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(n, ',' ORDER BY n) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS n FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
