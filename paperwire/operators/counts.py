"""Row counts per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_counts(papers: DataFrame, rank: str = "source_rank") -> DataFrame:
    """Per source, in source order: its rows, the rows so far and the rows in all.

    The windows run over the counts, one row per source.
    """
    counts = papers.groupBy(rank).agg(F.count("*").alias("papers"))
    so_far = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        rank,
        "papers",
        F.sum("papers").over(so_far).alias("papers_so_far"),
        F.sum("papers").over(everything).alias("papers_total"),
    )
