"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A hash is the nearest of the 2d signed unit vectors to a pseudo-random rotation (three rounds of random signs and the
fast Hadamard transform); a table's bucket joins CODES hashes.  A vector is filed in its own bucket of each table and
probes that bucket and those with one hash replaced by its second nearest vector.  Narrow rows find the buckets where
vectors meet; only for those are vectors shipped, in blocks of bounded size, and compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least tables, and hashes of each.  With 6 tables pairs at cosine 0.95 in 64 dimensions meet with probability 0.98,
#: closer ones more often; a hash separates more in more dimensions, so there is a table more for each doubling.
TABLES, CODES = 6, 3
COSINE = 0.95
#: Vectors of one block of a bucket, about.
BLOCK = 512
SEED = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row (a power of two long)."""
    n, size, half = len(x), x.shape[1], 1
    while half < size:
        x = x.reshape(n, size // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, size)
        half *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = CODES) -> np.ndarray:
    """(n, tables, hashes, 2): nearest and second nearest signed unit vector under each rotation."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    out = np.empty((n, tables, hashes, 2), np.int32)
    rng = np.random.default_rng([SEED, size])
    for t in range(tables):
        for h in range(hashes):
            y = padded
            for signs in rng.integers(0, 2, (3, size)) * 2.0 - 1.0:
                y = _hadamard(y * signs)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            swap = np.abs(np.take_along_axis(y, top, 1))
            top = np.where((swap[:, :1] < swap[:, 1:]), top[:, ::-1], top)
            out[:, t, h] = top + size * (np.take_along_axis(y, top, 1) < 0)
    return out


def _buckets(code: np.ndarray, dims: int) -> np.ndarray:
    """(n, tables, 1 + hashes) bucket numbers: the own bucket, then the probes with one second choice."""
    n, tables, hashes, _ = code.shape
    choice = np.repeat(code[:, :, None, :, 0], hashes + 1, axis=2).astype(np.uint64)
    for h in range(hashes):
        choice[:, :, h + 1, h] = code[:, :, h, 1]
    out = np.full((n, tables, hashes + 1), dims, np.uint64)
    for h in range(hashes):
        out = out * np.uint64(0x9E3779B97F4A7C15) + choice[..., h] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def tables_for(dims: int) -> int:
    """Tables for vectors of this many dimensions."""
    return max(TABLES, math.ceil(math.log2(max(1, dims))))


def _unit(lists) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so no square over- or underflows."""
    x = np.asarray(lists, np.float64)
    # a power of two: exact, and finite for the smallest numbers as well
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _rows_by_size(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, unit vectors) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    found = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        found.append((int(d), at, _unit(flat[starts[at][:, None] + np.arange(d)])))
    return found


def _meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the own bucket of x is one that y probes, for pairs of one table's codes (n, hashes, 2)."""
    other = x[:, :, 0] != y[:, :, 0]
    return (other.sum(axis=1) <= 1) & (~other | (x[:, :, 0] == y[:, :, 1])).all(axis=1)


def _compare(table: int, filed: dict, probes: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, numbers of links, smallest id of the component here) of one block of filed and one of probing vectors.

    A pair that meets several times counts in its first table, and there in the direction of the smaller id if it
    meets in both.
    """
    a, b = np.nonzero(filed["v"] @ probes["v"].T >= cosine)
    a, b = a[(differ := filed["id"][a] != probes["id"][b])], b[differ]
    if not len(a):
        return None
    x, y = filed["code"][a], probes["code"][b]
    counts = _meets(x[:, table], y[:, table])
    counts &= ~_meets(y[:, table], x[:, table]) | (filed["id"][a] < probes["id"][b])
    for t in range(table):
        counts &= ~(_meets(x[:, t], y[:, t]) | _meets(y[:, t], x[:, t]))
    a, b = a[counts], b[counts]
    if not len(a):
        return None
    ids, at = np.unique(np.concatenate([filed["id"][a], probes["id"][b]]), return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, left, probes["n"][b])
    np.add.at(n, right, filed["n"][a])
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return ids, n, ids[root]
        root = new


def _met(spark_rows: DataFrame, cosine: float) -> DataFrame:
    """id, n, root over all blocks; ``spark_rows`` are partitioned and sorted by block."""
    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ends = _ends(held)
            if len(ends) > 1:
                yield from out(held, ends[:-1])
                held = held.slice(ends[-2])
        if held is not None and held.num_rows:
            yield from out(held, _ends(held))

    def _ends(batch):
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        return [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]

    def out(batch, ends):
        tables, probing = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
        ids, n = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        sizes = np.diff(batch.column(8).offsets.to_numpy())
        found = []
        for start, end in zip([0, *ends], ends):
            probe = probing[start:end]
            if end - start < 2 or probe.all() or not probe.any() or len(set(sizes[start:end])) > 1:
                continue
            part = batch.slice(start, end - start)
            v = _unit(np.asarray(part.column(8).flatten().to_numpy(zero_copy_only=False)).reshape(end - start, -1))
            code = part.column(7).flatten().to_numpy().reshape(end - start, -1, CODES, 2)
            side = lambda m: {"v": v[m], "code": code[m], "id": ids[start:end][m], "n": n[start:end][m]}
            got = _compare(int(tables[start]), side(~probe), side(probe), cosine)
            if got:
                found.append(got)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["id", "n", "root"])

    return spark_rows.mapInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None,
                    block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are one class before anything is compared (told apart by 128 bits of hash).  Buckets of any size
    are cut into blocks of about ``block`` filed and probing vectors, every pair of blocks is a unit of work of its
    own, and a unit returns a row per vector, not per pair.  Links found are exact; pairs that meet in no table are
    missed (see TABLES; ``tables`` follows the longest vector if not given).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id, link with
    nothing: n_links 0, themselves their component.  Vectors of different lengths don't link.  Rows equal in vec_id
    and embedding count as different vectors.  An empty table gives no rows; other columns are ignored.
    """
    e = F.col("embedding").cast("array<double>")
    usable = (F.col("vec_id").isNotNull() & (F.size(e) > 0)
              & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists(e, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"),
                          F.coalesce(usable, F.lit(False)).alias("usable"),
                          F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    if tables is None:
        tables = tables_for(rows.where("usable").agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0])
    members = common.stored(rows.select("vec_id", "usable", "h1", "h2"), "vectors")
    classes = rows.where("usable").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))

    def file(batches):
        for batch in batches:
            column = batch.column("v")
            code = np.empty((batch.num_rows, tables, CODES, 2), np.int32)
            bucket = np.empty((batch.num_rows, tables, CODES + 1), np.int64)
            for dims, at, x in _rows_by_size(column):
                code[at] = codes(x, tables)
                bucket[at] = _buckets(code[at], dims)
            lists = lambda x, t: pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * x[0].size if len(x) else [0], pa.int32()), pa.array(x.ravel(), t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), batch.column("id"), batch.column("n"), column,
                 lists(code, pa.int32()), lists(bucket, pa.int64())], ["h1", "h2", "id", "n", "v", "code", "bucket"])

    hashed = common.stored(classes.mapInArrow(
        file, "h1 long, h2 long, id long, n long, v array<double>, code array<int>, bucket array<long>"), "hashed")
    probes = CODES + 1
    narrow = (hashed.select("id", F.posexplode("bucket").alias("i", "bucket"))
              .select("id", "bucket", F.expr(f"CAST(i div {probes} AS INT)").alias("table"),
                      (F.col("i") % probes == 0).alias("own")))
    # an own bucket is filed in and probed, the others are probed only
    met = (narrow.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("probing"), F.count_if("own").alias("filed"))
           .where("filed > 0 AND probing > 1"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    meeting = (narrow.join(met, ["table", "bucket"])
               .withColumns({"fb": blocks("filed"), "pb": blocks("probing")}))
    spot = F.xxhash64("id")
    filed = meeting.where("own").select(
        "id", "table", "bucket", F.pmod(spot, F.col("fb")).cast("int").alias("f"),
        F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("p"), F.lit(False).alias("probe"))
    probing = meeting.select(
        "id", "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("fb") - 1)).alias("f"),
        F.pmod(spot, F.col("pb")).cast("int").alias("p"), F.lit(True).alias("probe"))
    key = ["table", "bucket", "f", "p"]
    work = (filed.unionByName(probing).join(hashed.select("id", "n", "code", "v"), "id")
            .repartition(*key).sortWithinPartitions(*key)
            .select(*key, "probe", "id", "n", "code", "v"))
    found = common.stored(_met(work, cosine), "links")
    linked = found.groupBy("id").agg(F.sum("n").alias("links"))
    roots = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = (hashed.select("h1", "h2", "id", "n").join(linked, "id", "left")
             .join(roots, F.col("id") == F.col("node"), "left")
             .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("class_links"),
                     F.coalesce("component", "id").alias("class_component")))
    of_class = (members["h1"] == named["h1"]) & (members["h2"] == named["h2"]) & members["usable"]
    component = F.coalesce("class_component", "vec_id")
    return members.join(named, of_class, "left").select(
        "vec_id", F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
