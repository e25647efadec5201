"""Atom feed entries (arXiv)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperwire import constants as K
from paperwire.functions import text as X
from paperwire.functions.authors import blank_affiliations
from paperwire.functions.windows import arxiv_window
from paperwire.schema import ATOM_BODY, ATOM_ENTRY
from paperwire.sources.account import USED, Account, NoAccount
from paperwire.sources.common import as_papers
from paperwire.sources.landing import (
    CORRUPT,
    HIT,
    ITEM,
    NO_HIT,
    NO_LIST,
    REPLY,
    UNREADABLE,
    good_replies,
    in_days,
)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feed files (S3); one file is one reply, hence of bounded size."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)


def scan_arxiv(landing: DataFrame, *keep: str, account: Account | None = None) -> DataFrame:
    """Entries of landed feed replies (S3): the columns of :func:`read_atom`, after ``keep`` of their reply."""
    replies = good_replies(landing).where(F.col("source") == "arxiv")
    schema = f"{ATOM_BODY}, {CORRUPT} STRING"
    feed = F.from_xml("body", schema, {"columnNameOfCorruptRecord": CORRUPT})
    feeds = replies.select(*keep, feed.alias("feed"))
    if account is not None:
        unread = F.col("feed").isNull() | F.col(f"feed.{CORRUPT}").isNotNull()
        listed = F.col("feed.entry").isNotNull()
        outcome = F.when(listed, USED).when(unread, UNREADABLE).otherwise(NO_LIST)
        feeds = account.by_outcome(feeds, "arxiv", REPLY, outcome, UNREADABLE, NO_LIST)
    return feeds.select(*keep, F.inline("feed.entry"))


def atom_columns(entries: DataFrame, seq: str | None = None, *keep: str) -> DataFrame:
    """Entry fields to Paper columns.

    ``seq`` names a column that gives the place in the list, if there is one already.
    """
    none = F.array().cast("array<string>")
    authors = F.coalesce(F.transform("author", lambda a: a["name"]), none)
    return entries.select(
        *keep,
        *([F.col(seq).alias("source_seq")] if seq else []),
        F.col("id"),
        F.try_to_timestamp(F.substring("published", 1, 10), F.lit("yyyy-MM-dd"))
        .cast("date")
        .alias("published"),
        F.regexp_replace(X.or_blank(F.col("title")), r"\s+", " ").alias("Title"),
        authors.alias("Authors"),
        F.lit(K.SOURCE_ARXIV).alias("Source"),
        X.or_blank(F.col("summary")).alias("Abstract"),
        F.lit("").alias("PMID"),
        blank_affiliations(authors).alias("Affiliation"),
        F.col("`arxiv:doi`").alias("DOI"),
        F.get(F.col("link")["_href"], F.lit(0)).alias("paperLink"),
    )


def arxiv_papers(
    entries: DataFrame,
    term: str,
    run_date: dt.date,
    days: int,
    top: int = K.ARXIV_TOP,
    include_upper: bool = False,
    account: Account | None = None,
) -> DataFrame:
    """The ``top`` most relevant entries of the day window (F2, F6, T1), best first.

    The service's ranking is not public; relevance here is the number of term hits.
    """
    texts = (F.col("Title"), F.col("Abstract"))
    account = account or NoAccount()
    window = arxiv_window(F.col("published"), run_date, days, include_upper)
    of_days = in_days(atom_columns(entries), "arxiv", window, account)
    hit = X.all_words(term, *texts)
    of_days = account.by_outcome(of_days, "arxiv", ITEM, F.when(hit, HIT).otherwise(NO_HIT), NO_HIT, HIT)
    best = (
        of_days.where(hit)
        .withColumn("score", X.relevance(term, *texts))
        .orderBy(F.desc("score"), "id")
        .limit(top)
    )
    # At most ``top`` rows are left, so one task can number them.
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint")
    best = account.passed(best.withColumn("source_seq", place), "arxiv", ITEM, USED)
    return as_papers(best, "arxiv")
