"""Concatenation of the sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_sources(*papers: DataFrame) -> DataFrame:
    """All rows of all sources by column name; the same paper from two sources stays twice."""
    return reduce(DataFrame.unionByName, papers)


def in_digest_order(papers: DataFrame) -> DataFrame:
    """Source by source, list order inside; a range-partitioned sort."""
    return papers.orderBy("source_rank", "source_seq", "paper_key")
