"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; a row's fractional rank says
how far through its source it stands. In the order of fractional ranks all sources are spread
evenly, so any run of rows, and with it every shard, matches the mixture. Shards are runs of equal
length: their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperwire.llm.common import bounded, checkpointed, key_digits, ranked, shuffle_key

SHARDS, SEED = 40, 29


def interleave(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", source: str = "source", ties: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    All columns of ``df`` pass two shuffles, so select narrow ones and join texts later, or write
    with ``write_shards``. The order depends on ``key``, then on the columns ``ties``; rows that agree in
    all of these may change places. NULL keys are alike and NULL is a source of its own. An empty
    table stays empty. Columns ``shard`` and ``slot`` are replaced. Each source starts at a random fraction, so that many
    sources of one row are spread too.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    digits = key_digits(df.sparkSession)
    names = [f"_tie{i}" for i in range(len(ties))]
    rows = df.select(
        F.struct(*columns).alias("_row"), F.col(source).alias("_source"), F.col(key).alias("_id"), shuffle_key(F.col(key), seed).alias("_key"),
        *[F.col(c).alias(n) for c, n in zip(ties, names)],
    )
    order = ["_key", F.col("_id").asc_nulls_last(), *[F.col(n).asc_nulls_last() for n in names]]
    rows = checkpointed(rows.withColumn("_bucket", F.substring("_key", 1, digits)))
    rows = ranked(rows, "_source", "_bucket", order, "_rank")
    rows = checkpointed(rows)
    sizes = checkpointed(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of")))
    total = sizes.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("null")))
    shift = F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    sizes = checkpointed(sizes.select(F.col("_source").alias("_name"), "_of", shift.alias("_shift")))
    rows = rows.join(bounded(sizes), F.col("_source").eqNullSafe(F.col("_name")))
    rows = rows.withColumn("_fraction", (F.col("_rank") - 1 + F.col("_shift")) / F.col("_of"))
    parts = 16**digits
    rows = rows.withColumn("_bucket", F.least(F.floor(F.col("_fraction") * parts), F.lit(parts - 1))).withColumn("_all", F.lit(0))
    rows = ranked(checkpointed(rows), "_all", "_bucket", ["_fraction", F.col("_source").asc_nulls_last(), *order], "_at")
    rows = rows.withColumn("_shard", F.expr(f"cast(((_at - 1) * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(_shard * bigint({total}) + {shards - 1}) div {shards}")
    return rows.select("_row.*", F.col("_shard").alias("shard"), (F.col("_at") - 1 - first).alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """One folder per shard, rows in slot order within a file."""
    made = interleave(df, **options)
    made.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def mixture(sharded: DataFrame, source: str = "source") -> DataFrame:
    """Rows and share of each source in each shard, to be held against the whole."""
    counts = sharded.groupBy("shard", source).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("shard")))
