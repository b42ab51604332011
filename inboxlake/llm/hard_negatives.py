"""Hard negatives by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys (anchor, descending score, role, id): 25 bytes whose byte order is
the order wanted, positives before negatives of the same score.  Keys are dealt by anchor and sorted within the
partitions (``repartition`` + ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions), so
one pass over the sorted stream opens a window at each of an anchor's first positives and hands negatives to the open
windows; it never holds more than the windows of one anchor.

Scores come from blocks: anchors and rows are hashed into blocks of bounded bytes, every pair of blocks meets once in
a cogrouped task.  A first round ships, per anchor and row block, the best positives of that block; the sorted stream
turns them into the anchor's positives.  A second round knows the windows and ships, per window and row block, the
first negatives of that block.  Both are exact partial results (what isn't among a block's first can't be among all
rows' first), so the shuffle carries a few keys per anchor and block instead of every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import inner_products, is_finite, matrix, scaled

#: Bytes of one block's vectors, and anchors scored at once against a block of rows.
BLOCK_BYTES, ANCHOR_CHUNK = 4 << 20, 128
SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("role", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
_POSITIVE, _NEGATIVE = 0, 1
_FLUSH_ROWS = 1 << 14


def pack(anchor: np.ndarray, score: np.ndarray, role: int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is (anchor, descending score, role, id)."""
    out = np.empty(len(ids), _KEY)
    out["anchor"] = np.asarray(anchor, np.int64).view(np.uint64) ^ _SIGN
    out["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ _SIGN)
    out["role"] = role
    out["id"] = np.asarray(ids, np.int64).view(np.uint64) ^ _SIGN
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(out), [None, pa.py_buffer(out.tobytes())])
    return fixed.cast(pa.binary())


def unpack(keys: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, score, role, id) of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    signed = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    return zip(signed(raw["anchor"]), signed(~raw["score"].astype(np.uint64)), raw["role"].tolist(), signed(raw["id"]))


def _sorted_keys(keys: DataFrame) -> DataFrame:
    """Keys of an anchor in one partition, in order."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` largest scores, ties by smaller id."""
    if len(score) > 4 * k:  # all scores that reach the k-th largest
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], ~score[at]))][:k]


def _blocks(df: DataFrame, block_bytes: int) -> int:
    """Blocks that the vectors of ``df`` need."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return max(1, -(-n * 8 * max(1, width or 1) // block_bytes))


def _blocked(anchors: DataFrame, na: int, rows: DataFrame, nr: int, anchor_cols: list[str]) -> tuple:
    """Both sides grouped by (anchor block, row block), every pair of blocks once."""
    # a row's block isn't that of its vec_id alone: different rows of one id don't gather in one
    a = anchors.select(*anchor_cols, F.pmod(F.xxhash64("vec_id"), F.lit(na)).cast("int").alias("ab"),
                       F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r = rows.select("vec_id", "label", "x", F.pmod(F.xxhash64("vec_id", "x"), F.lit(nr)).cast("int").alias("rb"),
                    F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("ab"))
    return a.groupBy("ab", "rb"), r.groupBy("ab", "rb")


def _scores(left: pa.Table, right: pa.Table):
    """Per anchor: (its row number, scores of all rows of the block), a chunk of anchors at a time."""
    width = max([int(t.column("x").combine_chunks().value_lengths().to_numpy().max()) for t in (left, right)])
    a, r = matrix(left.column("x"), width), matrix(right.column("x"), width)
    for at in range(0, len(a), ANCHOR_CHUNK):
        for i, scores in enumerate(inner_products(a[at:at + ANCHOR_CHUNK], r), at):
            yield i, scores


def _keys_table(parts: list[pa.Array]) -> pa.Table:
    return pa.table({"key": pa.concat_arrays([pa.array([], pa.binary()), *parts])})


def _block_positives(k: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _keys_table([])
        ids, labels = (right.column(c).to_numpy() for c in ("vec_id", "label"))
        anchors, own = (left.column(c).to_numpy() for c in ("vec_id", "label"))
        parts = []
        for i, scores in _scores(left, right):
            at = np.flatnonzero((labels == own[i]) & (ids != anchors[i]))
            at = at[_first(scores[at], ids[at], k)]
            parts.append(pack(np.full(len(at), anchors[i]), scores[at], _POSITIVE, ids[at]))
        return _keys_table(parts)
    return fn


def _lowest(score: int, low: int, high: int) -> int:
    """The smallest s with low * score <= high * s."""
    return -(-low * score // high)


def _block_negatives(k: int, low: int, high: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _keys_table([])
        ids, labels = (right.column(c).to_numpy() for c in ("vec_id", "label"))
        anchors, own = (left.column(c).to_numpy() for c in ("vec_id", "label"))
        windows = left.column("positive_scores").to_pylist()
        parts = []
        for i, scores in _scores(left, right):
            tops = [(p, _lowest(p, low, high)) for p in windows[i] if _lowest(p, low, high) <= p]
            if not tops:
                continue
            at = np.flatnonzero((scores <= max(t for t, _ in tops)) & (scores >= min(b for _, b in tops))
                                & (labels != own[i]) & (ids != anchors[i]))
            found = [at[inside[_first(scores[at[inside]], ids[at[inside]], k)]] for top, bottom in tops
                     for inside in [np.flatnonzero((scores[at] <= top) & (scores[at] >= bottom))]]
            chosen = np.unique(np.concatenate(found))
            parts.append(pack(np.full(len(chosen), anchors[i]), scores[chosen], _NEGATIVE, ids[chosen]))
        return _keys_table(parts)
    return fn


def _first_positives(k: int):
    """Sorted positive keys -> (vec_id, positive_ids, positive_scores) of each anchor's first ``k``."""
    def fn(batches):
        anchor, ids, scores, rows = None, [], [], []
        for batch in batches:
            for a, score, _, i in unpack(batch.column(0)):
                if a != anchor:
                    if anchor is not None:
                        rows.append((anchor, ids, scores))
                    anchor, ids, scores = a, [], []
                if len(ids) < k:
                    ids.append(i)
                    scores.append(score)
            if len(rows) >= _FLUSH_ROWS:
                yield _columns(rows)
                rows = []
        if anchor is not None:
            rows.append((anchor, ids, scores))
        yield _columns(rows)

    def _columns(rows):
        a, i, s = zip(*rows) if rows else ((), (), ())
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(i, longs), pa.array(s, longs)],
                                          ["vec_id", "positive_ids", "positive_scores"])
    return fn


def _emit(k: int, low: int, high: int):
    """Sorted keys -> mined rows: a positive opens a window, a negative goes to every open window with room."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in SCHEMA.split(", ")]

    def fn(batches):
        anchor, windows, rows = None, [], []
        for batch in batches:
            for a, score, role, i in unpack(batch.column(0)):
                if a != anchor:
                    anchor, windows = a, []
                if role == _POSITIVE:
                    if _lowest(score, low, high) <= score:
                        windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < k and low * w[1] <= high * score]
                for w in windows:
                    w[2] += 1
                    rows.append((a, w[0], w[2], i, w[1], score))
                if len(rows) >= _FLUSH_ROWS:
                    yield _columns(rows)
                    rows = []
        yield _columns(rows)

    def _columns(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)],
                                          names)
    return fn


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives of the anchors among ``vectors`` (vec_id long, label, x array<long>): the columns of SCHEMA.

    A row's score is its inner product with the anchor; higher first, ties by smaller vec_id.  An anchor's positives
    are its first other rows of the same label; for each, the first rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score are ranked from 1.  An anchor without
    positives, or a positive without such rows, gives no row.

    Rows with a null vec_id, label or vector take no part.  Rows of an anchor's own vec_id are the anchor; an id that
    occurs several times is one anchor (its smallest label and vector), while repeated other rows count one by one.
    Vectors of different lengths are filled up with zeros.  Scores beyond 64 bits are the nearest long.  An empty
    table gives no rows; other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x",
        F.coalesce(is_anchor, F.lit(False)).alias("__anchor"))
    anchors = (rows.where("__anchor").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
               .select("vec_id", "r.label", "r.x"))
    anchors = common.stored(anchors, "anchors")
    rows = rows.drop("__anchor")
    na, nr = _blocks(anchors, block_bytes), _blocks(rows, block_bytes)
    a, r = _blocked(anchors, na, rows, nr, ["vec_id", "label", "x"])
    keys = a.cogroup(r).applyInArrow(_block_positives(positives), "key binary")
    windows = common.stored(_sorted_keys(keys).mapInArrow(
        _first_positives(positives), "vec_id long, positive_ids array<long>, positive_scores array<long>"), "positives")
    a, r = _blocked(anchors.join(windows, "vec_id"), na, rows, nr, ["vec_id", "label", "x", "positive_scores"])
    keys = a.cogroup(r).applyInArrow(_block_negatives(negatives, low, high), "key binary")

    def positive_keys(batches):
        for batch in batches:
            anchor, ids, scores = batch.columns
            each = np.repeat(anchor.to_numpy(), ids.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pack(each, scores.flatten().to_numpy(), _POSITIVE, ids.flatten().to_numpy())], ["key"])
    opened = windows.mapInArrow(positive_keys, "key binary")
    return _sorted_keys(keys.unionByName(opened)).mapInArrow(_emit(negatives, low, high), SCHEMA)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are the rows whose vec_id is divisible by 100, every seventh label is moved on by one."""
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = (rows.where(F.col("label").isNotNull() & is_finite(F.col("embedding")))
               .select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("x")))
    return mine(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
