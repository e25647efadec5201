"""Shared by the sources: the record key and the Paper column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire import constants as K
from paperwire.schema import PAPER


def source_rank(kind: str) -> Column:
    return F.lit(K.SOURCE_ORDER.index(kind))


def as_papers(rows: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Add the source columns and a row key, and bring ``rows`` to the Paper schema.

    A DOI may come twice (versions of one paper), so the key also holds the position.
    """
    identity = F.coalesce("DOI", F.nullif("PMID", F.lit("")), "paperLink", F.lit(""))
    keyed = rows.select(
        "*",
        F.lit(kind).alias("source_kind"),
        source_rank(kind).alias("source_rank"),
        F.concat_ws(
            ":", F.lit(kind), identity, F.coalesce(F.col("source_seq").cast("string"), F.lit(""))
        ).alias("paper_key"),
    )
    columns = [F.col(name).cast(kind).alias(name) for name, kind in PAPER.items()]
    return keyed.select(*keep, *columns)
