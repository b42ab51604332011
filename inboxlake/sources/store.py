"""Table maintenance on Parquet: insert-if-absent (S4), vector upsert / delete
(S6, S7), mapping upsert (S8), versioned publish (S11), bulk update by key
(S14), cascade delete (S16) and uniqueness checks (S17).

Parquet has no MERGE: every write produces a new version folder and a
pointer is switched last, so readers never see a half-written table.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Parquet codec of tables with texts: about two thirds of the bytes that Spark's default takes.
TEXT_CODEC = "zstd"


def insert_absent(store: DataFrame, incoming: DataFrame, key: str, arrival: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet; among duplicates in
    the batch the first arrival wins.  Stored rows (trashed too) count as present.

    Dedup is ``min_by(struct, arrival)`` per key (one partial aggregation), the
    difference a left-anti join on the key.
    """
    cols = [c for c in incoming.columns if c != key]
    first = (incoming.groupBy(key)
             .agg(F.min_by(F.struct(*cols), F.col(arrival)).alias("_r"))
             .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
    return first.join(store.select(key), key, "left_anti")


def upsert_latest(store: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Union and keep the row with the highest ``version`` per key (last write wins)."""
    both = store.unionByName(updates, allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    return (both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def delete_keys(df: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """Drop rows whose key is in ``keys`` (left anti join)."""
    k = keys.select(F.col(keys_col or key).alias(key))
    return df.join(k, key, "left_anti")


def bulk_set(df: DataFrame, keys: DataFrame, key: str, col: str, value: Column) -> DataFrame:
    """Set ``col = value`` for rows whose key is in ``keys``."""
    k = keys.select(F.col(key).alias("_k")).distinct()
    return (df.join(k, df[key] == k["_k"], "left")
            .withColumn(col, F.when(F.col("_k").isNotNull(), value).otherwise(F.col(col))).drop("_k"))


def uniqueness_violations(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Key groups occurring more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(F.lit(table).alias("table_name"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n"))


def publish(spark: SparkSession, df: DataFrame, table: str, partition_by: list[str] | None = None) -> str:
    """Write a new immutable version under the shared folder, then switch the
    ``_CURRENT`` pointer.  Never overwrites a path that may be being read."""
    base = shared_path(spark, "tables", table)
    version = f"v-{uuid.uuid4().hex}"
    path = f"{base}/{version}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # pointers are only ever added, so a reader sees the last one or the one before, never none
    (spark.createDataFrame([(version, time.time_ns())], "version string, published_at long").coalesce(1)
     .write.mode("append").json(f"{base}/_CURRENT"))
    return path


def read_current(spark: SparkSession, table: str) -> DataFrame:
    base = shared_path(spark, "tables", table)
    pointers = spark.read.schema("version string, published_at long").json(f"{base}/_CURRENT")
    version = pointers.agg(F.max_by("version", "published_at")).first()[0]
    return spark.read.parquet(f"{base}/{version}")


def checkpoint_table(spark: SparkSession, df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing
    upstream UDF stages) and lets later scans prune columns and row groups;
    ``sort_by`` clusters rows inside each file for min/max pruning.
    """
    path = shared_path(spark, "stage", f"{name}-{uuid.uuid4().hex}")
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.parquet(path)
    return spark.read.parquet(path)


# ---- small filesystem helpers (Hadoop FileSystem: local, HDFS, object stores) ----

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def fs_list(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def fs_touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.close()


def fs_size(spark: SparkSession, path: str) -> int:
    """Bytes below ``path`` (0 if it isn't there)."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def fs_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files below ``path``."""
    fs, p = _fs(spark, path)
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return found


def fs_delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
