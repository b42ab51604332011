"""Suffix-array dedup: distributed merge sort of front-coded suffix runs by loser trees that know common prefixes.

Every string of LENGTH bytes has an anchor, the leftmost of its GRAM-byte strings with the smallest hash, so equal
strings have equal anchors at equal places.  Consecutive strings of a document with one anchor form a stretch; a
sparse suffix array over the anchors answers for all byte positions:

1. Stretches are counted by (hash of the anchor's gram, hash of the stretch).  Grams that occur once in the corpus
   can't lie in a repeat; stretches that occur twice repeat as a whole.  Both are settled without any text.
2. What is left are stretches whose gram also occurs in other stretches: the edges of repeats.  Each distinct one
   sends its suffix from the anchor in sorted, front-coded runs to the gram's bucket, with the bytes left of it.
3. A bucket's runs are merged by a loser tree that carries common prefix lengths and so never compares known prefixes
   again.  In the merged order the common prefixes to the right and the bytes to the left tell which strings repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring_dedup import _mix, _sliding_min, chunks, merged

LENGTH = 200
GRAM = 32
#: Text bytes that a task hashes at a time; documents are hashed in segments of SEGMENT starts.
CHUNK_BYTES, SEGMENT = 2 << 20, 1 << 20
#: Text bytes per bucket, about, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 24 << 20, 64
#: Suffixes of one gram that are compared pairwise; larger groups are refined byte by byte.
PAIRWISE = 12

_PLACE = np.uint64((1 << 24) - 1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM consecutive bytes."""
    h, width, power = _LETTERS[data], 1, _POWER
    while width < GRAM:
        h = h[:len(h) - width] * power + h[width:]
        width, power = width * 2, power * power
    return _mix(h)


def stretches(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(segment, anchor, start, last start, gram hash) of segments that begin at ``first`` in ``data``, with ``n``
    string starts each; positions in ``data`` (shorter than 2**24)."""
    grams = _grams(data)
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(key, LENGTH - GRAM + 1)
    segment = np.repeat(np.arange(len(first)), n)
    start = np.repeat(first - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(len(segment))
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(new)
    last = start[np.concatenate([at[1:], [len(start)]]) - 1] if len(at) else at
    return segment[at], anchor[at], start[at], last, grams[anchor[at]]


_FOUND = "doc_id long, start long, end long, gram long, anchor long, open boolean"
_FOUND_NAMES = ["doc_id", "start", "end", "gram", "anchor", "open"]
_FOUND_TYPES = [pa.int64()] * 5 + [pa.bool_()]
_PACKED = "bucket int, packed binary"


def _found(doc, start, end, gram=None, anchor=None, open_=None) -> pa.RecordBatch:
    n = len(doc)
    cols = [doc, start, end, *(x if x is not None else [None] * n for x in (gram, anchor, open_))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND_TYPES)], _FOUND_NAMES)


def _pack(rows: np.ndarray) -> bytes:
    """Byte planes of 64-bit columns; documents and places, which are in order, as differences."""
    rows = rows.copy()
    rows[1:, 2:4] -= rows[:-1, 2:4].copy()
    return np.ascontiguousarray(rows.T).astype("<i8").view(np.uint8).reshape(rows.shape[1], -1, 8).transpose(0, 2, 1).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(7, 8, -1).transpose(0, 2, 1)
    rows = np.ascontiguousarray(planes).view("<i8").reshape(7, -1).T.copy()
    rows[:, 2:4] = rows[:, 2:4].cumsum(axis=0)
    return rows


def count_stretches(docs: DataFrame, buckets: int) -> DataFrame:
    """Settled intervals (gram null) and open or partner stretches of ``docs`` (doc_id, text): columns of _FOUND.

    A stretch that a chunk holds twice is shipped once, marked as repeated, so what a bucket gets of equal stretches
    grows with the chunks and not with the copies.
    """
    def hashed(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            order = np.argsort(ids, kind="stable")
            parts = [(ids[i], texts[i], at, min(SEGMENT, len(texts[i]) - LENGTH + 1 - at))
                     for i in order for at in range(0, len(texts[i]) - LENGTH + 1, SEGMENT)]
            for chunk in chunks(np.arange(len(parts)), [p[3] + LENGTH for p in parts], CHUNK_BYTES):
                yield from hashed_chunk([parts[i] for i in chunk])

    def hashed_chunk(parts):
        data = b"".join(text[at:at + n + LENGTH - 1] for _, text, at, n in parts)
        n = np.array([p[3] for p in parts], np.int64)
        first = np.concatenate([[0], (n + LENGTH - 1).cumsum()[:-1]])
        segment, anchor, start, last, gram = stretches(np.frombuffer(data, np.uint8), first, n)
        context = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in
                               zip(start.tolist(), (last + LENGTH).tolist())), np.uint64, len(start))
        move = np.array([p[2] for p in parts], np.int64)[segment] - first[segment]
        doc = np.array([p[0] for p in parts], np.int64)[segment]
        rows = np.stack([gram.view(np.int64), context.view(np.int64), doc, start + move, anchor - start,
                         last - anchor, np.zeros(len(doc), np.int64)], axis=1)
        rows, settled = _settle(rows)
        if len(settled):
            # packed like the rest and let through by the bucket
            yield _packed(int(settled[0, 3]) % buckets, _settled_mark(settled))
        bucket = (_mix(rows[:, 0].view(np.uint64) if rows[:, 0].flags.c_contiguous
                       else np.ascontiguousarray(rows[:, 0]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((rows[:, 3], rows[:, 2], bucket))
        rows, bucket = rows[by], bucket[by]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(part):
                yield _packed(int(bucket[part[0]]), rows[part])

    def _packed(bucket, rows):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_pack(rows)], pa.binary())],
                                          ["bucket", "packed"])

    def counted(batches):
        held: list[np.ndarray] = []
        name = None
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != name and held:
                    yield from settled(np.concatenate(held))
                    held = []
                name = b
                rows = _unpack(data)
                done = rows[:, 6] == 2
                if done.any():
                    yield _interval_rows(rows[done])
                held.append(rows[~done])
        if held:
            yield from settled(np.concatenate(held))

    def settled(rows):
        rows, done = _settle(rows)
        if len(done):
            yield _interval_rows(done)
        # rows: one per distinct stretch, in order of gram
        gram = rows[:, 0]
        new = np.concatenate([[True], gram[1:] != gram[:-1]])[:len(gram)]
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(group) else group
        unsettled = np.bincount(group, weights=rows[:, 6] == 0) if len(group) else group
        rows = rows[(size[group] > 1) & (unsettled[group] > 0)] if len(group) else rows
        if len(rows):
            anchor = rows[:, 3] + rows[:, 4]
            yield _found(rows[:, 2], rows[:, 3], anchor + rows[:, 5] + LENGTH, rows[:, 0], anchor, rows[:, 6] == 0)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return (rows.mapInArrow(hashed, _PACKED).repartition(_partitions(docs, buckets), "bucket")
            .sortWithinPartitions("bucket").mapInArrow(counted, _FOUND))


def _partitions(docs: DataFrame, buckets: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)


def _settled_mark(rows: np.ndarray) -> np.ndarray:
    rows = rows.copy()
    rows[:, 6] = 2
    return rows[np.lexsort((rows[:, 3], rows[:, 2]))]


def _interval_rows(rows: np.ndarray) -> pa.RecordBatch:
    return _found(rows[:, 2], rows[:, 3], rows[:, 3] + rows[:, 4] + rows[:, 5] + LENGTH)


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (gram, context, doc, start, ., ., repeated): one row per (gram, context) with the mark whether it is
    at two places, and the rows of those that became known to be only now.  The same place twice is one place."""
    rows = rows[np.lexsort((rows[:, 6], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows, rows
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    elsewhere = (rows[:, 2:4] != rows[at[group], 2:4]).any(axis=1)
    repeats = np.bincount(group, weights=elsewhere | (rows[:, 6] == 1)) > 0
    done = rows[repeats[group] & (rows[:, 6] == 0)]
    first = rows[at].copy()
    first[:, 6] = repeats
    return first, done


def _mismatch(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h is known."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h:h + 16] == b[h:h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


class Run:
    """A sorted, front-coded run: strings as (length shared with the string before, rest)."""

    def __init__(self, shared: list[int], rest: list[bytes]):
        self.shared, self.rest, self.i, self.now, self.known = shared, rest, -1, b"", 0
        self.step()

    def step(self) -> None:
        """Goes to the next string; ``known`` is what it shares with the string before, ``now`` None at the end."""
        self.i += 1
        if self.i == len(self.rest):
            self.now, self.known = None, -1
        else:
            self.known = self.shared[self.i]
            self.now = self.now[:self.known] + self.rest[self.i]


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as (shared lengths, rests)."""
    shared, rest, last = [], [], b""
    for s in strings:
        h = _mismatch(last, s, 0)
        shared.append(h)
        rest.append(s[h:])
        last = s
    return shared, rest


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, length shared with the string before) in sorted order of all runs.

    Each inner node of the tree holds the loser of its match.  ``known`` of a run's front string is what it shares
    with the last string given out: of two fronts the one that shares more is smaller; only if they share equally
    much are their bytes compared, from there on, and the loser then knows what it shares with the winner.
    """
    n = len(runs)
    losers = [-1] * n

    def play(x: int, node: int) -> None:
        while node:
            y = losers[node]
            if y < 0:
                losers[node] = x
                return
            a, b = runs[x], runs[y]
            if a.now is None:
                wins = False
            elif b.now is None:
                wins = True
            elif a.known != b.known:
                wins = a.known > b.known
            else:
                h = _mismatch(a.now, b.now, a.known)
                wins = a.now[h:h + 1] <= b.now[h:h + 1]
                (b if wins else a).known = h
            if not wins:
                losers[node], x = x, y
            node //= 2
        losers[0] = x

    for x in range(n):
        play(x, (x + n) // 2)
    while runs[losers[0]].now is not None:
        x = losers[0]
        yield x, runs[x].i, runs[x].known
        runs[x].step()
        play(x, (x + n) // 2)


def _shared_end(a: bytes, b: bytes) -> int:
    """Length of the common end of a and b."""
    n = min(len(a), len(b))
    if a[len(a) - n:] == b[len(b) - n:]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[len(a) - mid:] == b[len(b) - mid:] else (low, mid)
    return low


def _offsets(group: list[dict], shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix of one gram, in sorted order: the smallest and largest offset of the anchor in a string that also
    occurs at another suffix of the group (smallest > largest: none).

    ``shared[i]``: bytes that suffixes i - 1 and i have in common.  The string at offset o of two suffixes is equal
    if they share o bytes to the left and LENGTH - o to the right.
    """
    m = len(group)
    low, high = np.full(m, LENGTH), np.full(m, -1)
    if m <= PAIRWISE:
        for i in range(m):
            right = LENGTH
            for j in range(i + 1, m):
                right = min(right, shared[j])
                a, b = group[i], group[j]
                o1 = max(LENGTH - right, a["low"], b["low"])
                o2 = min(a["high"], b["high"])
                if o1 <= o2:
                    o2 = min(o2, _shared_end(a["left"], b["left"]))
                    if o1 <= o2:
                        for k in (i, j):
                            low[k], high[k] = min(low[k], o1), max(high[k], o2)
        return low, high
    first, last = (np.array([g[k] for g in group]) for k in ("low", "high"))
    left = np.zeros((m, LENGTH), np.int64)
    for i, g in enumerate(group):
        left[i, :len(g["left"])] = np.frombuffer(g["left"], np.uint8)[::-1]
    lcp = np.array(shared)
    alike = np.zeros(m, np.int64)  # class of the bytes to the left so far
    for o in range(last.max() + 1):
        if o:
            alike = np.unique(alike * 256 + left[:, o - 1], return_inverse=True)[1]
        have = np.flatnonzero((first <= o) & (o <= last))
        if len(have) > 1:
            block = np.cumsum(lcp < LENGTH - o)
            _, inverse, counts = np.unique(block[have] * m + alike[have], return_inverse=True, return_counts=True)
            hit = have[counts[inverse] > 1]
            low[hit] = np.minimum(low[hit], o)
            high[hit] = o
    return low, high


_RUNS = ("bucket int, shared array<int>, rest array<binary>, left array<binary>, doc array<long>, "
         "anchor array<long>, low array<int>, open array<boolean>")
_RUN_NAMES = ["bucket", "shared", "rest", "left", "doc", "anchor", "low", "open"]
_RUN_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]


def resolve(docs: DataFrame, waiting: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, start, end) of repeats in the open stretches of ``waiting`` (rows of count_stretches with a gram)."""
    ask = F.struct("gram", "anchor", "start", "end", "open")
    asked = (waiting.select(F.col("doc_id").alias("__id"), ask.alias("ask"))
             .groupBy("__id").agg(F.collect_list("ask").alias("asks")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asks = rows.join(asked, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "asks")

    def sorted_runs(batches):
        for batch in batches:
            records: dict[int, list] = {}
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for a in wanted:
                    at, start, end = a["anchor"], a["start"], a["end"]
                    bucket = int(_mix(np.array([a["gram"]], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                    records.setdefault(bucket, []).append(
                        (text[at:end], text[start:at], doc, at, at - (end - LENGTH), a["open"]))
            for bucket, found in records.items():
                found.sort(key=lambda r: r[0])
                shared, rest = front_coded([r[0] for r in found])
                columns = [shared, rest, *(list(c) for c in list(zip(*found))[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()),
                     *(pa.array([c], pa.list_(t)) for c, t in zip(columns, _RUN_TYPES[1:]))], _RUN_NAMES)

    def merged_runs(batches):
        held: list[dict] = []
        name = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != name and held:
                    yield _intervals(held)
                    held = []
                name = row["bucket"]
                held.append(row)
        if held:
            yield _intervals(held)

    def _intervals(rows):
        out: list[tuple] = []
        group: list[dict] = []
        shared: list[int] = []
        seen = set()

        def close():
            if len(group) > 1:
                low, high = _offsets(group, shared)
                for g, a, b in zip(group, low.tolist(), high.tolist()):
                    if a <= b and g["open"]:
                        out.append((g["doc"], g["anchor"] - b, g["anchor"] - a + LENGTH))
        for r, i, h in merge([Run(row["shared"], row["rest"]) for row in rows]):
            row = rows[r]
            place = (row["doc"][i], row["anchor"][i], row["low"][i])
            if h < GRAM:
                close()
                group, shared, least, seen = [], [], LENGTH, set()
            else:
                least = min(least, h)
            if place in seen:  # a repeated row of the table
                continue
            seen.add(place)
            left = row["left"][i]
            group.append({"doc": place[0], "anchor": place[1], "left": left, "low": place[2], "high": len(left),
                          "open": row["open"][i]})
            shared.append(min(least, LENGTH))
            least = LENGTH
        close()
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "end"])

    return (asks.mapInArrow(sorted_runs, _RUNS).repartition(_partitions(docs, buckets), "bucket")
            .sortWithinPartitions("bucket").mapInArrow(merged_runs, "doc_id long, start long, end long"))


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary, the other bytes).

    Removed is every byte in a string of LENGTH bytes that starts at another place too, in whatever document.  Null
    texts are empty; shorter texts keep all bytes.  Rows without doc_id keep theirs and aren't compared; rows
    repeated with one doc_id are one place.  An empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    found = common.stored(count_stretches(docs, buckets), "stretches")
    edges = common.stored(resolve(docs, found.where("gram IS NOT NULL"), buckets), "edges")
    gone = found.where("gram IS NULL").select("doc_id", "start", "end").unionByName(edges)
    spans = (gone.groupBy(F.col("doc_id").alias("__id"))
             .agg(F.collect_list("start").alias("__start"), F.collect_list("end").alias("__end")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def cut(batches):
        for batch in batches:
            n_removed, n_spans, kept = [], [], []
            for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                gone = merged(list(zip(a, b))) if a else []
                left, at = [], 0
                for s, e in gone:
                    left.append(text[at:s])
                    at = e
                rest = b"".join([*left, text[at:]])
                n_removed.append(len(text) - len(rest))
                n_spans.append(len(gone))
                kept.append(rest)
            n_bytes = [len(k) + r for k, r in zip(kept, n_removed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return (rows.join(spans, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__start", "__end")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    found = dedup_suffixes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
