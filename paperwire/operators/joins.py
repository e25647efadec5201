"""Joins on a key that may be heavily skewed.

The right side is reduced to one row per key first.  If Spark's own size estimate lets it
be broadcast, a plain join is enough: the left side is not shuffled.  Otherwise the few
keys that hold a large share of the left rows are answered from a broadcast table, whose
size is bounded by construction, and their rows are spread evenly over the shuffle that
serves all other keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperwire.operators.sizing import fits_broadcast
from paperwire.session import write_once

# A key is hot if it holds more than 1/MAX_HOT_KEYS of the rows; there are fewer than
# MAX_HOT_KEYS such keys, whatever the data.
MAX_HOT_KEYS = 2000


def hot_keys(counts: DataFrame, key: str, rows: str) -> DataFrame:
    """The keys of ``counts`` holding more than 1/MAX_HOT_KEYS of all ``rows``."""
    total = counts.agg(F.sum(rows).alias("total")).scalar()
    return counts.where(F.col(rows) > total / MAX_HOT_KEYS).select(key)


def attach_hot_safe(
    left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: str | None = None
) -> DataFrame:
    """Left join on a null-safe key; ``right`` has one row per key, ``hot`` is bounded.

    A hot row takes its values from the broadcast table and goes through the shuffle in a
    slot of its own choice instead of its key's, so no task gets a hot key whole.
    """
    values = [c for c in right.columns if c != key]
    # Read twice below, and costly to find: written once.
    hot = write_once(hot.select(F.col(key).alias("_hot_key")), "hot-keys")
    # One row per hot key at most on either side.
    small = right.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left_semi")
    small = small.select(F.col(key).alias("_small_key"), F.struct(*values).alias("_small"))
    answers = hot.join(
        F.broadcast(small), F.col("_hot_key").eqNullSafe(F.col("_small_key")), "left"
    ).select("_hot_key", "_small", F.lit(True).alias("_is_hot"))

    salt = F.xxhash64(*left.columns) if spread is None else F.xxhash64(spread)
    salted = left.join(
        F.broadcast(answers), F.col(key).eqNullSafe(F.col("_hot_key")), "left"
    ).withColumn("_slot", F.when(F.col("_is_hot"), salt).otherwise(F.xxhash64(key)))
    cold = right.select(
        F.col(key).alias("_cold_key"),
        F.struct(*values).alias("_cold"),
        # Not a constant, which the optimizer would take out of the join keys.
        F.xxhash64(key).alias("_cold_slot"),
    )
    joined = salted.join(
        cold,
        F.col(key).eqNullSafe(F.col("_cold_key"))
        & (F.col("_slot") == F.col("_cold_slot")),
        "left",
    )
    found = F.when(F.col("_is_hot"), F.col("_small")).otherwise(F.col("_cold"))
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])


def attach(
    left: DataFrame, right: DataFrame, key: str, spread: str | None = None
) -> DataFrame:
    """Left join ``right`` (one row per key) to ``left`` on a null-safe key.

    ``spread`` names a column of ``left`` with many distinct values.  Without one the whole row
    is taken, so name one if many rows are alike.  Either way a repeated task sends every row
    where the first attempt did.
    """
    if fits_broadcast(right):
        other = right.withColumnRenamed(key, "_right_key")
        on = F.col(key).eqNullSafe(F.col("_right_key"))
        return left.join(other, on, "left").drop("_right_key")
    counts = left.groupBy(key).agg(F.count("*").alias("_rows"))
    return attach_hot_safe(left, right, key, hot_keys(counts, key, "_rows"), spread)


def _match(left: DataFrame, keys: DataFrame, key: str, spread: str | None, how: str) -> DataFrame:
    if fits_broadcast(keys):
        other = keys.select(F.col(key).alias("_right_key"))
        return left.join(other, F.col(key).eqNullSafe(F.col("_right_key")), how)
    known = keys.select(key).distinct().withColumn("_known", F.lit(True))
    marked = attach(left, known, key, spread)
    kept = F.col("_known").isNotNull() if how == "left_semi" else F.col("_known").isNull()
    return marked.where(kept).drop("_known")


def keep_matching(
    left: DataFrame, keys: DataFrame, key: str, spread: str | None = None
) -> DataFrame:
    """Rows of ``left`` whose key is among ``keys`` (J2); duplicates on the left stay."""
    return _match(left, keys, key, spread, "left_semi")


def drop_matching(
    left: DataFrame, keys: DataFrame, key: str, spread: str | None = None
) -> DataFrame:
    """Rows of ``left`` whose key is not among ``keys``.

    NULL equals NULL here, as ``None`` does in a set; duplicates on the left stay.
    """
    return _match(left, keys, key, spread, "left_anti")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """The set of values of a column (A1); partial aggregation absorbs hot values."""
    return rows.select(column).distinct()

