"""Incremental intake of landed replies (R1) and removal of papers already seen (R2)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from paperwire.functions import text as X
from paperwire.operators.joins import keep_matching
from paperwire.schema import LANDED
from paperwire.session import write_once
from paperwire.sources.atom import atom_columns, scan_arxiv
from paperwire.sources.common import as_papers
from paperwire.sources.landing import (
    biorxiv_columns,
    chemrxiv_columns,
    scan_biorxiv,
    scan_chemrxiv,
)

SHUFFLE_TASKS = "spark.sql.shuffle.partitions"
#: Where and when a reply landed: files in the order of their age, rows in the order of a file.
ARRIVAL = "arrival"
ARRIVAL_KIND = "struct<landed: timestamp, file: string, row: bigint>"


# --- R1 ---------------------------------------------------------------------------------


def landing_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of the landing folder; each micro-batch takes a bounded number of them.

    ``arrival`` differs between replies even if all else is equal, is the same whenever a task is
    repeated, and rises in the order in which the files are taken.
    """
    stream = (
        spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
    meta = F.col("_metadata")
    arrival = F.struct(
        meta["file_modification_time"].alias("landed"),
        meta["file_path"].alias("file"),
        meta["row_index"].alias("row"),
    )
    return stream.select("*", arrival.cast(ARRIVAL_KIND).alias(ARRIVAL))


def _biorxiv(landing: DataFrame, term: str) -> DataFrame:
    items = scan_biorxiv(landing, ARRIVAL)
    hits = items.where(X.any_keyword(term, F.col("title"), F.col("abstract")))
    return biorxiv_columns(hits, ARRIVAL)


def _chemrxiv(landing: DataFrame, words: str) -> DataFrame:
    items = scan_chemrxiv(landing, ARRIVAL)
    hits = items.where(X.phrase(words, F.col("title"), F.col("abstract")))
    return chemrxiv_columns(hits, ARRIVAL)


def _arxiv(landing: DataFrame, term: str) -> DataFrame:
    rows = atom_columns(scan_arxiv(landing, ARRIVAL), None, ARRIVAL)
    hits = rows.where(X.all_words(term, F.col("Title"), F.col("Abstract")))
    return hits.withColumn("source_seq", F.lit(None).cast("bigint"))


STREAMS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "biorxiv": _biorxiv, "chemrxiv": _chemrxiv, "arxiv": _arxiv,
}


def paper_stream(landing: DataFrame, term: str, source: str = "biorxiv") -> DataFrame:
    """Landed replies of a source to matching papers; the Paper columns and ``arrival``, no state.

    Each source matches as in a daily run.  arXiv's relevance ranks a whole day, so its papers
    have no place in a list here.
    """
    return as_papers(STREAMS[source](landing, term), source, ARRIVAL)


def run_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Process what has landed since the last run, append it to ``table``, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
    query.awaitTermination()


# --- R2 ---------------------------------------------------------------------------------

# Rows without a day are compared among themselves.
_NO_DAY = -(10**7)
_FIRST_DAY = dt.date(1970, 1, 1)


def _day_number(day: str) -> Column:
    return F.coalesce(F.date_diff(F.col(day).cast("date"), F.lit(_FIRST_DAY)), F.lit(_NO_DAY))


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The table at ``path``, None while nothing has been written there."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return None
    return spark.read.schema(schema).parquet(path)


def unseen(
    batch: DataFrame,
    ledger: DataFrame | None,
    key: str,
    day: str,
    keep: int,
    batch_id: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Which rows of a batch come for the first time, and what the ledger has to learn from it.

    A row is a repeat if a row of the same ``key`` that arrived before it, in this batch or an
    earlier one, has a day at most ``keep`` days from its own.  That says nothing of batches, so
    it gives the same rows however the files are dealt to batches, and a file of an old day that lands
    late is judged like any other.  NULL keys are one key, and rows without a day are compared
    with each other.

    A key that has very many rows is thinned first: each task keeps the first arrival of a key and day,
    and only these meet, so a key has as many rows in one task as it has days at most.  Of
    the ledger only the days within reach of the batch are read.
    """
    arrived = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col(ARRIVAL).alias("at"))
    first = batch.groupBy(F.col(key).alias("key"), _day_number(day).alias("day")).agg(
        F.min(F.struct(arrived.alias("arrived"), F.col("row_id").alias("row_id"))).alias("first")
    )
    first = first.select("key", "day", "first.arrived", "first.row_id")
    rows = first
    if ledger is not None:
        reach = batch.select(_day_number(day).alias("day")).agg(
            F.min(F.when(F.col("day") != _NO_DAY, F.col("day"))).alias("low"), F.max("day").alias("high")
        ).first()
        known = ledger.where(F.col("batch") < batch_id)
        if reach["high"] is None:
            known = known.limit(0)
        else:
            low = _NO_DAY if reach["low"] is None else reach["low"] - keep
            near = F.col("day").between(low, reach["high"] + keep) | (F.col("day") == _NO_DAY)
            known = known.where(near)
        rows = first.unionByName(
            known.select("key", "day", "arrived", F.lit(None).cast("bigint").alias("row_id"))
        )
    near = Window.partitionBy("key").orderBy("day").rangeBetween(-keep, keep)
    judged = rows.withColumn("_first", F.min("arrived").over(near)).where(F.col("row_id").isNotNull())
    judged = judged.select("key", "day", "arrived", "row_id", (F.col("_first") == F.col("arrived")).alias("new"))
    return judged.where("new").select("row_id"), judged.select("key", "day", "arrived")


def run_unseen(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "DOI",
    day: str = "published",
    keep: int = 60,
    since: dt.date | None = None,
) -> None:
    """Append to ``table/papers`` the papers that come for the first time within ``keep`` days (R2).

    Unlike the anti join on the day before, a repeat within one batch goes too.  The ledger of keys and
    days lies in ``table/seen``, by batch and day; a batch writes its folders by its number, so one that is
    run again after a failure overwrites what it wrote and never sees it.  No row is dropped for
    being late: ``since`` says from which day on the ledger is kept, and rows of days before it
    cannot be judged, so they are listed in ``table/late``.
    """
    spark = stream.sparkSession
    seen = "key STRING, arrived struct<batch: bigint, at: " + ARRIVAL_KIND + ">, batch BIGINT, day INT"

    def batch_done(rows: DataFrame, batch_id: int) -> None:
        # Parsed once; the ids of rows are those of the written table.
        rows = write_once(rows.withColumn("row_id", F.monotonically_increasing_id()), "batch")
        current = rows
        if since is not None:
            old = F.coalesce(F.col(day) < F.lit(since), F.lit(False))
            rows.where(old).drop("row_id", ARRIVAL).write.mode("overwrite").parquet(f"{table}/late/batch={batch_id}")
            current = rows.where(~old)
        new, learned = unseen(current, _read(spark, f"{table}/seen", seen), key, day, keep, batch_id)
        new = write_once(new, "new")
        learned = learned.select(F.col("key").cast("string").alias("key"), "day", "arrived")
        learned.write.mode("overwrite").partitionBy("day").parquet(f"{table}/seen/batch={batch_id}")
        fresh = keep_matching(current, new, "row_id", "row_id").drop("row_id", ARRIVAL)
        fresh.write.mode("overwrite").parquet(f"{table}/papers/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(batch_done)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_unseen(spark: SparkSession, table: str, schema: StructType, part: str = "papers") -> DataFrame:
    """The papers (or ``part="late"``) that the runs have written, without the arrival."""
    kept = StructType([f for f in schema.fields if f.name != ARRIVAL])
    found = _read(spark, f"{table}/{part}", kept)
    return spark.createDataFrame([], kept) if found is None else found
