"""Helpers shared by the operators: tables in the shared folder, gapless ranks, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path, ship_package

#: Rows that one task of a gapless rank sorts, on average.
RANK_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any store that Spark knows)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gapless_rank(df: DataFrame, by: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    """Adds ``out``: positions from 0 without gaps within each value of ``by``.

    A group is dealt over salts (hash of ``order``) of about ``RANK_ROWS`` rows each, so one group may hold any
    share of the ``rows`` rows; a position is the rank within (group, salt) plus the sizes of the group's
    earlier salts.  Rows that are equal in ``by`` and ``order`` take their positions in any order.
    """
    salts = max(1, -(-rows // RANK_ROWS))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = (salted.groupBy(*by, "__salt").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__salt")) - F.col("__n"))
              .drop("__n"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order)) - 1)
    return (ranked.join(before, [*by, "__salt"])
            .withColumn(out, (F.col("__rank") + F.col("__before")).cast("long"))
            .drop("__salt", "__rank", "__before"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): node, component (its smallest node).

    Alternating large-star and small-star rounds until the links no longer change.  Each round only aggregates
    and joins by node (never collects a neighbourhood), and its links are written to the shared folder.  Nodes
    without links are absent from the result; self links and repeated links don't matter.
    """
    name = "components"
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = stored(small, name)
        last, state = state, _state(now)
        if state == last:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()


def _state(links: DataFrame) -> tuple:
    """Number and order-free digest of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
