"""Messages per paper and channel, and the outbox they are written to (M5 to M8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.functions import messages as M
from paperwire.schema import OUTBOX, ddl

READY, ERROR = "ready", "error"


def render(papers: DataFrame, channel: str, run_ts: dt.datetime, label: str) -> DataFrame:
    """One channel's messages for numbered papers; ``label`` names the author label column."""
    head = M.header(M.utc(run_ts), F.col("Source"), F.col("position"), F.col("total"))
    text = M.message(
        channel, head, F.col("Title"), F.col("paperLink"), F.col(label), F.col("SummaryAbstract")
    )
    return papers.withColumn("message", text)


def fan_out(
    papers: DataFrame, run_ts: dt.datetime, label: str, channels: tuple[str, ...]
) -> DataFrame:
    """One row per paper and channel (M5, M8).

    The papers are read once; the rows are multiplied in place, after the numbering.
    """
    head = M.header(M.utc(run_ts), F.col("Source"), F.col("position"), F.col("total"))
    ready = papers.select(
        "paper_key", "position", "total", F.col("Title").alias("title"),
        "paperLink", F.col(label).alias("label"), "SummaryAbstract", head.alias("head"),
    )
    posts = []
    for channel in channels:
        text = M.message(
            channel, F.col("head"), F.col("title"), F.col("paperLink"), F.col("label"),
            F.col("SummaryAbstract"),
        )
        posts.append(
            F.struct(
                F.lit(channel).alias("channel"),
                text.alias("message"),
                M.username(channel).alias("username"),
            )
        )
    exploded = ready.select(
        "paper_key", "position", "total", "title", F.inline(F.array(*posts))
    )
    payload = F.when(
        F.col("channel") == "slack", M.payload("slack", F.col("message"))
    ).otherwise(F.col("message"))
    return exploded.withColumn(
        "payload", F.when(F.col("message").isNotNull(), payload)
    ).select(*OUTBOX)


def outbox_errors(outbox: DataFrame) -> DataFrame:
    """Rows that cannot be sent; they do not stop the others (M7)."""
    return outbox.where(F.col("message").isNull())


def write_outbox(outbox: DataFrame, path: str, fmt: str = "json") -> None:
    """Write messages to ``path/state=ready`` and failed rows to ``path/state=error`` (M6, M7).

    Both lie in one folder per channel and are written in one pass.  The whole path is
    overwritten, so a repeated run does not deliver twice.
    """
    state = F.when(F.col("message").isNotNull(), READY).otherwise(ERROR)
    (
        outbox.withColumn("state", state)
        .write.mode("overwrite")
        .partitionBy("state", "channel")
        .format(fmt)
        .save(path)
    )


def _read(spark: SparkSession, path: str, fmt: str, state: str) -> DataFrame:
    rows = spark.read.schema(f"{ddl(OUTBOX)}, state STRING").format(fmt).load(path)
    return rows.where(F.col("state") == state).select(*OUTBOX)


def read_outbox(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Messages ready to be sent, the channels being pruned by folder."""
    return _read(spark, path, fmt, READY)


def read_outbox_errors(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Rows that could not be rendered."""
    return _read(spark, path, fmt, ERROR)
