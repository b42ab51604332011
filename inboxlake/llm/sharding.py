"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

DataFrame functions only.  The texts are read once for size and checksum; the tree works on a narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Bits that a round of the median search resolves; a node has at most 2**RADIX bins in a round.
RADIX = 15
#: A dimension's key: KEY_BITS of the value above TIE_BITS of a hash that orders equal values.
KEY_BITS, TIE_BITS = 32, 28
#: A metadata value with more than one in so many of the rows is frequent.
FREQUENT = 1000


def _order_numbers(values: DataFrame) -> DataFrame:
    """``values`` (value, n; values distinct) with ``code``: the value's place in the order of all, from 0.

    Ranks are taken within ranges of the order and raised by the sizes of earlier ranges, one number a range.
    """
    ranged = common.stored(values.repartitionByRange("value").withColumn("__p", F.spark_partition_id()), "values")
    before, parts = [], 0
    for r in sorted(ranged.groupBy("__p").count().collect()):
        before.append((r[0], parts))
        parts += r[1]
    offsets = values.sparkSession.createDataFrame(before, "__p int, __before long")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("value")) - 1
    return (ranged.withColumn("__rank", rank).join(F.broadcast(offsets), "__p")
            .select("value", "n", (F.col("__rank") + F.col("__before")).cast("long").alias("code")))


def _coded(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the string column ``name`` replaced by its value's order number (null before all others).

    The at most FREQUENT values that hold more than 1/FREQUENT of the rows each are looked up without a shuffle, so no
    task gets all rows of one of them.
    """
    keyed = rows.withColumn(name, F.coalesce(F.concat(F.lit("+"), name), F.lit("")))
    values = keyed.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    codes = common.stored(_order_numbers(values), "codes").withColumnRenamed("value", name)
    bound = (codes.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent, others = (codes.where(c).select(name, "code") for c in (F.col("n") > bound, F.col("n") <= bound))
    found = keyed.join(F.broadcast(frequent), name).unionByName(
        keyed.join(F.broadcast(frequent.select(name)), name, "left_anti").join(others, name))
    return found.drop(name).withColumnRenamed("code", name)


def _key(value: Column, salt: int) -> Column:
    """Ordered key: the value, equal values by a hash of the row; the whole range of a long isn't needed."""
    top = F.least(F.greatest(F.coalesce(value, F.lit(0)).cast("long"), F.lit(0)), F.lit((1 << KEY_BITS) - 1))
    tie = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(salt)), F.lit(1 << TIE_BITS))
    return F.shiftleft(top, TIE_BITS) + tie


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32 and the tree's dimensions d0 (length), d1 (language) and
    d2 (source), both as order numbers of the distinct values, of ``docs`` (doc_id, text, lang, source)."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__b"),
                      F.col("lang").cast("string").alias("__lang"), F.col("source").cast("string").alias("__source"))
    flat = raw.select("doc_id", (F.coalesce(F.octet_length("__b"), F.lit(0)) + 1).cast("long").alias("size"),
                      F.crc32(F.coalesce("__b", F.lit(b""))).alias("text_crc32"), "__lang", "__source")
    coded = _coded(_coded(common.stored(flat, "described"), "__lang"), "__source")
    return coded.select("doc_id", "size", "text_crc32", _key(F.col("size"), 0).alias("d0"),
                        _key(F.col("__lang"), 1).alias("d1"), _key(F.col("__source"), 2).alias("d2"))


def _widest(rows: DataFrame, dims: list[str]) -> DataFrame:
    """node, dim: per node the dimension whose range of values is the largest share of the whole table's range.

    The hash that orders equal values is no width: a dimension of one value has none.
    """
    width = {d: F.shiftright(F.max(d), TIE_BITS) - F.shiftright(F.min(d), TIE_BITS) for d in dims}
    spans = rows.groupBy("node").agg(*[w.cast("double").alias(d) for d, w in width.items()])
    whole = rows.agg(*[F.greatest(w, F.lit(1)).cast("double").alias(d) for d, w in width.items()]).first()
    shares = spans.select("node", *[(F.col(d) / whole[d]).alias(d) for d in dims] if whole[0] else [*dims])
    best = F.greatest(*dims)
    pick = F.lit(len(dims) - 1)
    for i in reversed(range(len(dims) - 1)):
        pick = F.when(F.col(dims[i]) == best, i).otherwise(pick)
    return shares.select("node", pick.alias("dim"))


def _split(rows: DataFrame, dims: list[str], leaves: dict[int, int]) -> DataFrame:
    """One level of the tree: ``rows`` with ``node`` replaced by its child.

    A node of k leaves gives floor(k/2)/k of its bytes to the left.  The cut is found by radix descent: each round
    sums bytes by node and the next RADIX bits of the key (partial sums before the shuffle) and keeps the bin that
    holds the cut, so no task sees a node's rows together.
    """
    share = F.lit(0.0)
    for node, k in leaves.items():
        share = F.when(F.col("node") == node, (k // 2) / k).otherwise(share)
    picked = rows.join(F.broadcast(_widest(rows, dims)), "node").withColumn(
        "key", F.element_at(F.array(*dims), F.col("dim") + 1)).select("doc_id", "size", "text_crc32", *dims, "node", "key")
    total = KEY_BITS + TIE_BITS
    cuts = None
    for low in range(total - RADIX, -1, -RADIX):
        bins = picked.withColumn("bin", F.shiftright("key", low))
        if cuts is None:
            sums = bins.groupBy("node", "bin").agg(F.sum("size").alias("b")).withColumn("left", F.lit(0).cast("long"))
            goal = F.sum("b").over(Window.partitionBy("node")) * share
        else:
            sums = (bins.join(F.broadcast(cuts), "node").where(F.shiftright("bin", RADIX) == F.col("cut"))
                    .groupBy("node", "bin", "left", "goal").agg(F.sum("size").alias("b")))
            goal = F.col("goal")
        upto = F.sum("b").over(Window.partitionBy("node").orderBy("bin"))
        at = sums.select("node", "bin", (F.col("left") + upto - F.col("b")).alias("left"), "b", goal.alias("goal"))
        # the last bin that begins at or before the goal
        best = at.where("left <= goal").groupBy("node").agg(F.max(F.struct("bin", "left", "goal", "b")).alias("s"))
        found = best.select("node", F.col("s.bin").alias("cut"), F.col("s.left").alias("left"),
                            F.col("s.goal").alias("goal"), F.col("s.b").alias("b")).collect()
        cuts = rows.sparkSession.createDataFrame([(r.node, r.cut, r.left, r.goal) for r in found],
                                                 "node int, cut long, left long, goal double")
        last = found
    # rows of the last bin go to the side where the cut is nearer to the goal
    line = F.lit(None).cast("long")
    for r in last:
        edge = r.cut + (1 if r.goal - r.left > r.left + r.b - r.goal else 0)
        line = F.when(F.col("node") == r.node, F.lit(edge)).otherwise(line)
    split = F.lit(False)
    for node, k in leaves.items():
        split = F.when(F.col("node") == node, k > 1).otherwise(split)
    child = F.when(split & (F.col("key") >= line), F.col("node") * 2 + 1).otherwise(F.col("node") * 2)
    return picked.withColumn("node", child.cast("int")).drop("key")


def kd_shards(rows: DataFrame, dims: list[str], shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` (0 to shards-1, sizes near equal) to ``rows`` (doc_id, size, text_crc32, keys ``dims``).

    Every node is cut where its left part comes nearest to its leaves' share of the bytes; leaves are ready when
    they stand for one shard, the target size being all bytes over ``shards``.  Only one row per node (at most
    ``shards``) reaches the driver.  A document larger than the target makes its shard larger.
    """
    tree = common.stored(rows.withColumn("node", F.lit(0)), "kd")
    leaves = {0: shards}
    while any(k > 1 for k in leaves.values()):
        tree = common.stored(_split(tree, dims, leaves), "kd")
        leaves = {n * 2 + side: part for n, k in leaves.items()
                  for side, part in ((0, max(k // 2, 1) if k > 1 else 1), (1, k - k // 2 if k > 1 else 0)) if part}
    name = F.lit(0)
    for i, node in enumerate(sorted(leaves)):
        name = F.when(F.col("node") == node, i).otherwise(name)
    return tree.select("doc_id", "size", "text_crc32", name.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, size, text_crc32, law ('bytes'), shard, slot,
    grown_shard (null: a new tree is needed for another number of shards).

    Null texts have size 1; null metadata sorts first; equal values are told apart by a hash of the row, so one
    source, language or group of copies may hold any share of the rows.  Rows equal in doc_id and text stay in one
    place of the order and take neighbouring slots.  An empty table gives no rows; other columns are ignored.
    """
    placed = common.stored(kd_shards(describe(docs), ["d0", "d1", "d2"], shards), "shards")
    ranked = common.gapless_rank(placed, ["shard"], ["doc_id", "text_crc32"], placed.count(), "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards of near equal bytes."""
    return shard_documents(common.table(spark, sf_dir, "documents"))
