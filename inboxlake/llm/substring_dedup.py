"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeats merge to removal intervals.

Map tasks hash all windows of their documents and ship, for each bucket, one packed row of hashes and positions.
A window's bucket comes from the smallest hash of the shorter word runs in it, so neighbouring windows mostly share a
bucket and what comes back are intervals, not windows.  Of windows that repeat inside an Arrow batch only the first is
shipped: however often a passage occurs, its bucket gets it once per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
#: Words of the runs whose smallest hash names a window's bucket.
RUN = 8
#: Text bytes per bucket, about, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 24 << 20, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HASH_BYTES = 7
#: Text bytes that a task hashes at a time.
CHUNK_BYTES = 4 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash (base _BASE, modulo 2**64) of every ``width`` consecutive word hashes."""
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k:k + n]
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step, n = 1, len(x) - width + 1
    while step * 2 <= width:
        x = np.minimum(x[:len(x) - step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def _pack(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Byte planes of the hashes, then positions as differences (which the shuffle's compression takes well)."""
    planes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES].T
    moves = [np.diff(x, prepend=x.dtype.type(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T for x in (docs, starts)]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in (planes, *moves))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(_HASH_BYTES + 16, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :_HASH_BYTES] = planes[:_HASH_BYTES].T
    number = lambda p: np.ascontiguousarray(p.T).view("<i8").ravel().cumsum()
    return whole.view("<u8").ravel(), number(planes[_HASH_BYTES:_HASH_BYTES + 8]), number(planes[_HASH_BYTES + 8:])


def _intervals(docs: np.ndarray, starts: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows in order of (doc, start) as maximal intervals: doc_id, first word, word after the last."""
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(docs)]]) - 1 if len(at) else at
    return pa.RecordBatch.from_arrays([pa.array(docs[at], pa.int64()), pa.array(starts[at], pa.int64()),
                                       pa.array(starts[last] + window, pa.int64())], ["doc_id", "start", "end"])


def repeated(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, start, end): word intervals of ``docs`` (doc_id, text) covered by windows whose words also start
    earlier (smaller doc_id, or same document, earlier start).

    Hashes have 64 bits, of which 56 are shipped and others are in the bucket; no two different windows are expected
    to share one below some billions of windows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())

    def hashed(batches):
        number = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for chunk in chunks(np.argsort(ids, kind="stable"), [len(t or b"") for t in texts], CHUNK_BYTES):
                number += 1
                yield from hashed_chunk(number, ids[chunk], [texts[i] for i in chunk])

    def hashed_chunk(number, ids, texts):
        words = []
        for text in texts:
            w = (text or b"").split()
            words.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
        w = np.concatenate(words)
        lengths = np.array([len(x) for x in words], np.int64)
        if len(w) < window:
            return
        first = np.concatenate([[0], lengths.cumsum()[:-1]])
        starts = np.arange(len(w)) - np.repeat(first, lengths)
        left = np.repeat(lengths, lengths) - starts
        inside = np.flatnonzero(left[:len(w) - window + 1] >= window)
        h = _mix(_rolling(w, window)[inside])
        least = _sliding_min(_mix(_rolling(w, run)), window - run + 1)[inside]
        doc, start = np.repeat(ids, lengths)[inside], starts[inside]
        # first of each hash in the batch: positions are in order, the sort is stable
        by = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        same = h[by][1:] == h[by][:-1]
        again[by[1:][same]] = True
        if same.any():
            # the same place twice (a repeated row) is no earlier start
            group = np.cumsum(np.concatenate([[True], ~same])) - 1
            lead = by[np.flatnonzero(np.concatenate([[True], ~same]))][group]
            twin = (doc[by] == doc[lead]) & (start[by] == start[lead])
            again[by[twin]] = False
            dropped = again | np.isin(np.arange(len(h)), by[twin & (by != lead)])
        else:
            dropped = again
        if again.any():
            found = _intervals(doc[again], start[again], window)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number % buckets], pa.int32()), pa.array([None], pa.binary()),
                 *(pa.array([x.to_pylist()], pa.list_(pa.int64())) for x in found.columns)], _NAMES)
        keep = np.flatnonzero(~dropped)
        bucket = (_mix(least[keep]) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by])) + 1
        for part in np.split(keep[by], cuts):
            if len(part):
                name = int(_mix(least[part[:1]])[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.int32()), pa.array([_pack(h[part], doc[part], start[part])], pa.binary()),
                     *(pa.array([None], pa.list_(pa.int64())) for _ in range(3))], _NAMES)

    def counted(batches):
        held: list[bytes] = []
        name = None
        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if batch.column(1)[i].is_valid:
                    if b != name and held:
                        yield later(held)
                        held = []
                    name = b
                    held.append(batch.column(1)[i].as_py())
                else:
                    cols = [pa.array(batch.column(k)[i].as_py(), pa.int64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end"])
        if held:
            yield later(held)

    def later(held):
        h, doc, start = (np.concatenate(x) for x in zip(*map(_unpack, held)))
        by = np.argsort(h, kind="stable")
        same = h[by][1:] == h[by][:-1]
        among = np.zeros(len(h), bool)
        among[1:] |= same
        among[:-1] |= same
        by = by[among]
        h, doc, start = h[by], doc[by], start[by]
        by = np.lexsort((start, doc, h))
        h, doc, start = h[by], doc[by], start[by]
        new = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else by
        gone = (doc != doc[lead]) | (start != start[lead])
        doc, start = doc[gone], start[gone]
        by = np.lexsort((start, doc))
        return _intervals(doc[by], start[by], window)

    packed = (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
              .mapInArrow(hashed, _PACKED))
    return (packed.repartition(min(buckets, _partitions(docs, buckets)), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(counted, "doc_id long, start long, end long"))


_NAMES = ["bucket", "packed", "doc_id", "start", "end"]
_PACKED = "bucket int, packed binary, doc_id array<long>, start array<long>, end array<long>"


def _partitions(docs: DataFrame, buckets: int) -> int:
    """Tasks for the buckets: all of them on a large input, fewer where the session asks for few."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)


def chunks(order: np.ndarray, sizes: list[int], limit: int) -> list[np.ndarray]:
    """``order`` cut into parts of at most ``limit`` in ``sizes`` (or of one row)."""
    total = np.cumsum(np.array(sizes, np.int64)[order]) // limit
    return [x for x in np.split(order, np.flatnonzero(np.diff(total)) + 1) if len(x)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in any order as maximal ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the other words, joined by a space).

    Null, empty and short texts keep all their words.  Rows without doc_id keep theirs and aren't compared.  Rows
    repeated with one doc_id are one place each: neither is earlier than the other.  An empty table gives no rows;
    other columns are ignored.  Intervals and texts meet by doc_id, one document at a time.
    """
    gone = common.stored(repeated(docs, window), "intervals")
    spans = (gone.groupBy(F.col("doc_id").alias("__id"))
             .agg(F.collect_list("start").alias("__start"), F.collect_list("end").alias("__end")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or b"").split()
                n = len(words)
                if a:
                    left, at = [], 0
                    for s, e in merged(list(zip(a, b))):
                        left += words[at:s]
                        at = e
                    words = left + words[at:]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()),
                                              pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])
    return (rows.join(spans, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__start", "__end")
            .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    found = dedup_substrings(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM win)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p)
  GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
