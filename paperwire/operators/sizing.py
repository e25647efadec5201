"""Choices that depend on the optimizer's size estimate of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the tables read for each task that sorts what becomes of them.
TASK_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _settings(df: DataFrame):
    return df.sparkSession._jsparkSession.sessionState().conf()


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the estimate is within ``autoBroadcastJoinThreshold``."""
    return estimated_bytes(df) <= _settings(df).autoBroadcastJoinThreshold()


def tasks_for(df: DataFrame) -> int:
    """Into how many tasks to deal work on ``df`` that keeps its rows in memory.

    They grow in number with the tables that ``df`` reads, not in size.  The estimate of ``df`` itself would
    not do: that of a join is the product of its sides.  If a size is not known, the session decides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if read >= _settings(df).defaultSizeInBytes():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-read // TASK_BYTES))


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that has fewer file splits than there are cores over all of them.

    For work that costs much more per row than moving the row.  A larger input already
    keeps every core busy and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < cores * _settings(df).filesMaxPartitionBytes():
        return df.repartition(cores, key)
    return df
