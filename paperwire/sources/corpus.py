"""MEDLINE records as a current, dated table: one record per id, kept up to date by small batches.

The table is Parquet, partitioned by the Entrez day and bucketed by id.  A search of the last days reads
the partitions of these days; a fetch by id joins bucket by bucket, so the corpus is never shuffled.
A batch of new and revised records rewrites the partitions it touches and no others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.session import write_once
from paperwire.sources.medline import one_per_id

COLUMNS = {
    "PMID": "STRING", "TI": "STRING", "AB": "STRING", "AU": "ARRAY<STRING>", "AD": "ARRAY<STRING>",
    "SO": "STRING", "mdat": "DATE", "pdat": "DATE", "edat": "DATE",
}
DAY, KEY = "edat", "PMID"
#: Buckets of a new corpus; a bucket of one day is a file.
BUCKETS = 16


def open_corpus(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Make the corpus at ``path`` known to this session as ``table``, empty if there is none yet."""
    columns = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({DAY}) "
        f"CLUSTERED BY ({KEY}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    try:
        spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return
    spark.catalog.recoverPartitions(table)


def _stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).where(F.col(KEY).isNotNull())


def read_corpus(spark: SparkSession, table: str) -> DataFrame:
    """The current records: pass ``current=True`` to a search or fetch over them."""
    return _stored(spark, table)


def upsert(spark: SparkSession, table: str, records: DataFrame, buckets: int = BUCKETS) -> None:
    """Put a batch of records in place of the stored ones of the same ids.

    A record that was revised earlier than the stored one is left out; at a tie the new one stays.
    Records without an id cannot be fetched and are left out.  A record whose day changes leaves its old
    partition.  A partition is never left without files, as an overwrite by partition would not empty
    it: each one touched gets a row without an id, which readers skip.  Only the ids and dates
    of the corpus are read whole; the batch is what is joined to them.
    """
    rows = records.select(*[F.col(c).cast(kind).alias(c) if c in records.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])
    incoming = one_per_id(rows)
    old = _stored(spark, table).select(F.col(KEY).alias("_old"), F.col("mdat").alias("_mdat"), F.col(DAY).alias("_day"))
    met = incoming.join(old, F.col(KEY) == F.col("_old"), "left")
    earliest = F.lit("0001-01-01").cast("date")
    newer = F.col("_old").isNull() | (F.coalesce("mdat", earliest) >= F.coalesce("_mdat", earliest))
    fresh = write_once(met.where(newer), "fresh")
    days = fresh.select(F.col(DAY).alias("_touched")).union(fresh.where(F.col("_old").isNotNull()).select("_day"))
    # A row per day of the calendar at most.
    days = write_once(days.distinct(), "days")
    touched = _stored(spark, table).join(F.broadcast(days), F.col(DAY).eqNullSafe(F.col("_touched")), "left_semi")
    # No sort, and no shuffle of the stored texts: the ids come to their buckets.
    kept = touched.join(fresh.select(KEY).hint("shuffle_hash"), KEY, "left_anti").select(*COLUMNS)
    blank = days.select(*[F.lit(None).cast(kind).alias(c) if c != DAY else F.col("_touched").alias(c) for c, kind in COLUMNS.items()])
    # The batch alone is dealt by bucket, as what is kept lies so already.
    added = fresh.select(*COLUMNS).unionByName(blank).repartition(buckets, KEY)
    mode = "spark.sql.sources.partitionOverwriteMode"
    usual = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:  # written apart by Spark, which replaces the partitions when all of it is there
        kept.unionByName(added).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, usual)
