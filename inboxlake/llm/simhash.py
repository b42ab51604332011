"""SimHash near-duplicates: candidates by pigeonring filtering, exact Hamming check, components of the links.

A fingerprint is cut into max_bits + 2 segments laid out on a ring.  Two fingerprints within max_bits agree in two
segments at least, so pairs are sought by equal segment pairs; of these only pairs with a chain of consecutive
segments whose cumulative differences stay within their proportional budget (length * max_bits / segments) reach the
full Hamming check.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints with equal segment pairs that are compared pairwise; larger buckets are linked through the
#: fingerprints between their members instead (see ``links``).
PAIRWISE = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text in UTF-8 as a signed number (0 for a text without words)."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        cut = [joined[s:e] for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, itertools.repeat(SEED)), np.uint64, len(cut))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key (hash of the text, null for null), fp (signed long) per row of ``docs`` (doc_id, text)."""
    def run(batches):
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())],
                                             ["doc_id", "text_key", "fp"])
    key = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    return (docs.select(F.col("doc_id").cast("long"), key.alias("text_key"), F.col("text").cast("binary"))
            .mapInArrow(run, "doc_id long, text_key long, fp long"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _masks(segments: int) -> list[int]:
    edges = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def viable_chain(a: Column, b: Column, max_bits: int) -> Column:
    """Whether some chain of segments stays within its budget at every length, ring-wise."""
    masks = _masks(max_bits + 2)
    m = len(masks)
    diff = [F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(x)))) for x in masks]
    chains = []
    for start in range(m):
        total, within = F.lit(0), []
        for length in range(1, m):
            total = total + diff[(start + length - 1) % m]
            within.append(total * m <= length * max_bits)
        chains.append(reduce(lambda x, y: x & y, within))
    return reduce(lambda x, y: x | y, chains)


def links(prints: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b) of distinct fingerprints that connect all pairs within ``max_bits`` (an even number).

    ``prints``: distinct fp.  Buckets (equal segment pairs) of up to ``pairwise`` members are joined with
    themselves.  In a larger one every member is dealt to all fingerprints within max_bits / 2 of it outside the equal
    segments: two members within max_bits meet at one between them, and all that meet there are within max_bits,
    so linking them to their smallest is exact, and the rows grow with the members, not with their square.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    masks = _masks(max_bits + 2)
    pairs = [x | y for x, y in itertools.combinations(masks, 2)]
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("part"))
        for i, x in enumerate(pairs)])).alias("k")).select("fp", "k.pair", "k.part")
    sizes = keyed.groupBy("pair", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.stored(keyed.join(sizes, ["pair", "part"]), "buckets")
    few = shared.where(F.col("n") <= pairwise)
    a, b = F.col("x.fp"), F.col("y.fp")
    near = (few.alias("x").join(few.alias("y"), (F.col("x.pair") == F.col("y.pair")) & (F.col("x.part") == F.col("y.part"))
                                & (a < b))
            .where(viable_chain(a, b, max_bits)).where(F.bit_count(a.bitwiseXOR(b)) <= max_bits)
            .select(a.alias("a"), b.alias("b")))
    flips = [(i, _signed(sum(1 << x for x in bits))) for i, mask in enumerate(pairs)
             for k in range(max_bits // 2 + 1)
             for bits in itertools.combinations([x for x in range(64) if not mask >> x & 1], k)]
    # a table fixed by max_bits alone: 6 * 33 rows for 2 bits
    flip = F.broadcast(prints.sparkSession.createDataFrame(flips, "pair int, flip long"))
    met = (shared.where(F.col("n") > pairwise).join(flip, "pair")
           .groupBy("pair", F.col("fp").bitwiseXOR(F.col("flip")).alias("between"))
           .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))  # at most 65 differ by one bit
           .select("a", F.explode("fps").alias("b")).where("a <> b"))
    return near.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable through links), kept (the first of its component by doc_id and text_key).

    Equal fingerprints are one class before any pair is formed, so groups of copies cost a row each.  Null, empty
    and wordless texts have fingerprint zero and link like any other.  A null doc_id takes part but is never a
    component's id unless all of it are null.  Equal rows are kept or not together.  Empty table: no rows.  Other
    columns are ignored.
    """
    prints = common.stored(fingerprints(docs, shingle), "fingerprints")
    # nulls last, then by id and text
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    classes = common.stored(prints.groupBy("fp").agg(F.min(rank).alias("first")), "classes")
    roots = common.components(links(classes.select("fp"), max_bits))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("component", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return prints.join(named, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
         & F.col("text_key").eqNullSafe(F.col("first.text_key"))).alias("kept"))


def keep_firsts(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, with all its columns: the first by doc_id and text; of rows
    equal in both any one."""
    found = near_duplicates(docs, shingle, max_bits).where("kept")
    kept = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__kept_key")).distinct()
    keyed = docs.withColumn("__key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__kept_key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__key"]).drop("__key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
