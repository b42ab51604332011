"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files that one task of a CPU-heavy stage takes, about.
TASK_BYTES = 16 << 20


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES, factor: int = 2) -> int:
    """Tasks for a stage over ``df``: ``task_bytes`` of its input files each, and some for every core.

    Only the plan's file list and the files' sizes are looked at: no job runs for it.
    """
    sc = df.sparkSession.sparkContext
    conf, size = sc._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(sc.defaultParallelism * factor, -(-size // task_bytes))


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin repartition only when ``df`` reads fewer files than the
    cluster runs tasks at once (few row groups before a CPU-heavy stage), or
    fewer than its bytes make tasks of ``TASK_BYTES``: however much there is,
    no task gets more.  Inputs of many small files pass through unchanged.
    """
    parallel = df.sparkSession.sparkContext.defaultParallelism
    files, tasks = len(df.inputFiles()), tasks_for(df, factor=factor)
    return df.repartition(tasks) if files < parallel or files < tasks and tasks > parallel * factor else df
