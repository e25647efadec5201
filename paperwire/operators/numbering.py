"""Positions 1..n over the whole digest without one task that sees every row."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

MAX_BLOCKS = 1000
MAX_SHARES = 64
# Values of a sample for each part that it is to give.
SAMPLE = 40
# Up to here a BIGINT and its DOUBLE are the same number.
EXACT = 2**53
NO_PLACE = -(2**63)


def number_rows(
    rows: DataFrame,
    rank: str = "source_rank",
    seq: str = "source_seq",
    tie: str = "paper_key",
    blocks: int | None = None,
) -> DataFrame:
    """Add ``position`` and ``total`` in order of ``rank, seq, tie``.

    Rows are cut into blocks that follow the order, so that position = rows in earlier
    blocks + place in the block.  The cuts are quantiles of ``seq``, taken from the data
    first as a range-partitioned sort would, so a source with most of the rows is cut into
    many blocks.  A ``seq`` that fills several quantiles by itself is a crowd of copies, and is
    cut once more by ``tie``, whatever its type.  Any cuts give the same
    positions; good ones only balance the tasks.  ``rank`` is one of a fixed list of
    sources, so the block counts to sum up and broadcast are bounded by
    ``sources * MAX_BLOCKS * MAX_SHARES / 2``, whatever the number of rows.

    The three must name a row, or the rows must be a written table: they are read thrice.
    """
    if blocks is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = min(2 * tasks, MAX_BLOCKS)
    # A row without a place in its list comes first, as NULLs do in an ascending sort.
    placed = rows.withColumn("_seq", F.coalesce(seq, F.lit(NO_PLACE)))
    found = placed.approxQuantile("_seq", _steps(blocks), 0.5 / blocks)
    blocked = _bucket(placed, "_seq", found, "_block")
    repeated = {c for c in found if found.count(c) > 1}
    crowds = [int(c) for c in repeated if abs(c) <= EXACT or c == NO_PLACE]
    share, later = F.lit(0.0), F.lit(False)
    if crowds:
        shares = min(blocks, MAX_SHARES)
        in_crowd = F.col("_seq").isin(crowds)
        members = placed.where(in_crowd)
        if isinstance(rows.schema[tie].dataType, NumericType):
            found = members.approxQuantile(tie, _steps(shares), 0.5 / shares)
            blocked = _bucket(blocked, tie, found, "_tie_block")
        else:
            splitters = F.array(*[F.lit(c) for c in _sampled_cuts(members, tie, shares)])
            reached = F.size(F.filter(splitters.cast(f"array<{rows.schema[tie].dataType.simpleString()}>"), lambda c: c <= F.col(tie)))
            blocked = blocked.withColumn("_tie_block", F.coalesce(reached, F.lit(0)).cast("double"))
        # A crowd is the lower bound of its block, so the block's other rows come after it.
        share, later = F.when(in_crowd, F.col("_tie_block")).otherwise(0.0), ~in_crowd
    block = F.struct("_block", later.alias("later"), share.alias("share"))
    blocked = blocked.select(*rows.columns, "_seq", block.alias("_block"))

    counts = blocked.groupBy(rank, "_block").agg(F.count("*").alias("_rows"))
    up_to_here = Window.orderBy(rank, "_block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    everything = Window.orderBy(rank, "_block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = counts.select(
        rank,
        "_block",
        (F.sum("_rows").over(up_to_here) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(everything).alias("total"),
    )
    in_block = F.row_number().over(Window.partitionBy(rank, "_block").orderBy("_seq", tie))
    return (
        blocked.withColumn("_in_block", in_block)
        .join(F.broadcast(offsets), [rank, "_block"])
        .withColumn("position", F.col("_before") + F.col("_in_block"))
        .select(*rows.columns, "position", "total")
    )


def _steps(parts: int) -> list[float]:
    return [i / parts for i in range(1, parts)]


def _sampled_cuts(rows: DataFrame, column: str, parts: int) -> list:
    """Values that cut ``column`` into about ``parts`` even parts, from one sample of bounded size."""
    wanted = SAMPLE * parts
    share = min(1.0, wanted / max(1, rows.count()))
    part = F.pmod(F.xxhash64(F.lit("cuts"), column), F.lit(1 << 30)) < int(share * (1 << 30))
    # Distinct, so that copies of one value, which no cut can part, do not swell the sample.
    values = rows.where(F.col(column).isNotNull() & part).select(column).distinct()
    found = [r[0] for r in values.orderBy(column).limit(4 * wanted).collect()]
    return [found[len(found) * i // parts] for i in range(1, parts)] if len(found) >= parts else found[1:]


def _bucket(rows: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """Add the number of the interval between ``cuts`` that ``column`` lies in."""
    inner = sorted(set(cuts))
    if not inner:
        return rows.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name).transform(rows)


def position_label(position: Column, total: Column) -> Column:
    """``i/n`` (W2)."""
    return F.concat(position.cast("string"), F.lit("/"), total.cast("string"))
