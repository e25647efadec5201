"""Landed HTTP replies: the table they lie in, status guard, pages, scans of the two JSON sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperwire import constants as K
from paperwire.functions import authors as A
from paperwire.functions import text as X
from paperwire.functions.messages import utc
from paperwire.functions.windows import biorxiv_window, single_day
from paperwire.operators.joins import drop_matching, keep_matching
from paperwire.operators.topk import first_rows
from paperwire.schema import (
    ATOM_DAYS,
    BIORXIV_BODY,
    BIORXIV_DAYS,
    CHEMRXIV_BODY,
    CHEMRXIV_DAYS,
    LANDED,
)
from paperwire.session import placed, write_once
from paperwire.sources.account import USED, Account, NoAccount
from paperwire.sources.common import as_papers

GOOD = 200
# Units and outcomes of the account.
REPLY, ITEM = "reply", "item"
SUPERSEDED, BEYOND, UNREADABLE, NO_LIST = "superseded", "page limit", "unreadable", "no list"
UNDATED, OTHER_DAY, NO_HIT, SEEN, CUT = "undated", "other day", "no hit", "seen the day before", "cap"
# Passing counts, from which those of the items left out at a join or a cap follow.
OF_DAYS, TODAY, HIT = "(of the days)", "(of the day)", "(hit)"
#: Where from_json puts a body that it cannot read.
CORRUPT = "_corrupt"


# --- the landing table ------------------------------------------------------------------


def day(text: Column) -> Column:
    """The date that a text begins with, NULL for anything else."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def with_days(replies: DataFrame) -> DataFrame:
    """Add to each reply its map: ``first_day``, ``last_day`` and ``undated`` of its items.

    Taken once, when a reply lands, so that later scans can leave replies of other days out by a
    comparison instead of a parse.  All three are NULL where there is nothing to read.
    """
    dates = (
        F.when(F.col("source") == "biorxiv", F.from_json("body", BIORXIV_DAYS)["collection"]["date"])
        .when(
            F.col("source") == "chemrxiv",
            F.from_json("body", CHEMRXIV_DAYS)["itemHits"]["item"]["publishedDate"],
        )
        .when(F.col("source") == "arxiv", F.from_xml("body", ATOM_DAYS)["entry"]["published"])
    )
    known = X.let(
        F.transform(dates, day),
        lambda days: F.struct(
            F.array_min(days).alias("first_day"),
            F.array_max(days).alias("last_day"),
            F.size(F.filter(days, lambda d: d.isNull())).cast("bigint").alias("undated"),
        ),
    )
    # Filters and projections stay above a generator, so a body is parsed once for all three.
    columns = [c for c in replies.columns if c not in ("first_day", "last_day", "undated")]
    return replies.select(*columns, F.inline(F.array(known)))


def land(replies: DataFrame, path: str, *partition: str) -> None:
    """Append replies to the landing table at ``path``, each with its map."""
    with_days(replies).write.mode("append").partitionBy(*partition).parquet(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """The landing table; replies written without a map have NULLs in its place."""
    return spark.read.schema(LANDED).parquet(path)


def good_replies(landing: DataFrame) -> DataFrame:
    """Replies with status 200; any other gives no rows and no error."""
    return landing.where(F.col("status") == GOOD)


def landed_since(landing: DataFrame, first: dt.date) -> DataFrame:
    """Replies that may hold items published on ``first`` or later.

    A reply is fetched after its items are published, so older ones need not be parsed;
    one day is allowed for differing time zones.  The bound reaches the scan.
    """
    fetched = F.col("fetched")
    return landing.where((fetched >= F.lit(first - dt.timedelta(days=1))) | fetched.isNull())


def landed_until(landing: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Replies fetched up to the run's instant, so that a rerun of an old day sees what that day saw."""
    return landing.where((F.col("fetched") <= utc(run_ts)) | F.col("fetched").isNull())


def holding(landing: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Replies whose map says they may hold items of ``first`` to ``last``.

    Replies with an undated item, and those without a map or an item, are always read.  The
    comparisons reach the scan.
    """
    if "last_day" not in landing.columns:
        return landing
    inside = (F.col("last_day") >= F.lit(first)) & (F.col("first_day") <= F.lit(last))
    unknown = F.col("last_day").isNull() | F.col("undated").isNull() | (F.col("undated") > 0)
    return landing.where(inside | unknown)


def due(landing: DataFrame, source: str, first: dt.date, last: dt.date, run_ts: dt.datetime) -> DataFrame:
    """The replies of one source that a run for the days ``first`` to ``last`` has to look at."""
    rows = landing.where(F.col("source") == source)
    return holding(landed_until(landed_since(rows, first), run_ts), first, last)


def rejects(landing: DataFrame) -> DataFrame:
    """How many replies per source and status the guard left out."""
    return (
        landing.where(~F.col("status").eqNullSafe(F.lit(GOOD)))
        .groupBy("source", "status")
        .agg(F.count("*").alias("replies"))
    )


# --- pages ------------------------------------------------------------------------------

PAGE = ("source", "query_key", "cursor")


def page_replies(landing: DataFrame, page_limit: int | None, place: str) -> DataFrame:
    """``source``, ``place``, ``outcome`` of the good reply that stands for each page, and how many it superseded.

    The last reply with status 200 stands for its page, so a page that first failed, or that was
    landed twice, counts once.  With a limit the first ``page_limit`` of a query's good pages by
    cursor are used.  Only narrow columns are read and moved.
    """
    good = good_replies(landing).select(*PAGE, "fetched", place)
    order = F.struct(F.col("fetched").isNotNull(), "fetched", place)
    pages = good.groupBy(*PAGE).agg(F.max(order).alias("_last"), F.count("*").alias("_replies"))
    outcome = F.lit(USED)
    if page_limit is not None:
        number = F.row_number().over(Window.partitionBy("source", "query_key").orderBy("cursor"))
        outcome = F.when(number <= page_limit, USED).otherwise(BEYOND)
    return pages.select(
        "source", F.col("_last")[place].alias(place), outcome.alias("outcome"), (F.col("_replies") - 1).alias("superseded")
    )


def current_pages(
    landing: DataFrame, page_limit: int | None = None, account: Account | None = None
) -> DataFrame:
    """The one good reply of each page, of the first ``page_limit`` pages of a query.

    The choice is made on narrow columns and written once; bodies are then read by their place.
    Where every good reply is used, as in most runs, no body passes a shuffle.  ``account`` is told
    what became of the others, by status or page.
    """
    place = "_place"
    rows = placed(landing, place)
    chosen = write_once(page_replies(rows, page_limit, place), "pages")
    sums = chosen.groupBy("source").agg(
        F.sum("superseded").alias(SUPERSEDED), F.count_if(F.col("outcome") == BEYOND).alias(BEYOND)
    )
    sums = sums.collect()  # a row per source
    if account is not None:
        for row in sums:
            account.add(row["source"], REPLY, SUPERSEDED, row[SUPERSEDED])
            account.add(row["source"], REPLY, BEYOND, row[BEYOND])
        for row in rejects(landing).collect():  # a row per source and status
            account.add(row["source"], REPLY, f"status {'none' if row['status'] is None else row['status']}", row["replies"])
    if not any(row[SUPERSEDED] or row[BEYOND] for row in sums):
        return good_replies(rows).drop(place)
    used = chosen.where(F.col("outcome") == USED).select(place)
    return keep_matching(good_replies(rows), used, place, place).drop(place)


def first_pages(landing: DataFrame, page_limit: int | None) -> DataFrame:
    """The first ``page_limit`` good pages of each query by cursor (S7); all replies for None."""
    return landing if page_limit is None else current_pages(landing, page_limit)


# --- scans ------------------------------------------------------------------------------


def _items(
    landing: DataFrame, source: str, schema: str, items: str, keep: tuple[str, ...], account: Account
) -> DataFrame:
    """One row per item of the good replies, with its place in the whole listing."""
    replies = good_replies(landing).where(F.col("source") == source)
    reply = F.from_json("body", f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})
    parsed = replies.select("cursor", *keep, reply.alias("reply"))
    listed = F.col(f"reply.{items}").isNotNull()
    unread = F.col("reply").isNull() | F.col(f"reply.{CORRUPT}").isNotNull()
    outcome = F.when(listed, USED).when(unread, UNREADABLE).otherwise(NO_LIST)
    parsed = account.by_outcome(parsed, source, REPLY, outcome, UNREADABLE, NO_LIST)
    return parsed.select("cursor", *keep, F.posexplode(f"reply.{items}").alias("place", "item"))


def _seq() -> Column:
    return (F.col("cursor") + F.col("place")).cast("bigint").alias("source_seq")


def scan_biorxiv(landing: DataFrame, *keep: str, account: Account | None = None) -> DataFrame:
    """Items of ``collection`` (S4), with the columns ``keep`` of their reply."""
    items = _items(landing, "biorxiv", BIORXIV_BODY, "collection", keep, account or NoAccount())
    return items.select(*keep, _seq(), "item.*", day(F.col("item.date")).alias("published"))


def scan_chemrxiv(landing: DataFrame, *keep: str, account: Account | None = None) -> DataFrame:
    """Items of ``itemHits`` (S5), with the columns ``keep`` of their reply."""
    items = _items(landing, "chemrxiv", CHEMRXIV_BODY, "itemHits", keep, account or NoAccount())
    published = day(F.col("item.item.publishedDate")).alias("published")
    return items.select(*keep, _seq(), "item.item.*", published)


def new_since_day_before(
    rows: DataFrame, run_date: dt.date, days: int, key: str, day: str = "published"
) -> DataFrame:
    """Rows of ``[end-1, end]`` whose key is not among those of ``end-1``.

    Every row of ``end-1`` is itself among those keys, so only the rows of ``end`` can
    stay: each of the two days is read once, and the earlier one for its key alone.
    """
    latest = rows.where(single_day(F.col(day), run_date, days))
    before = rows.where(single_day(F.col(day), run_date, days + 1))
    return drop_matching(latest, before.select(key), key)


def biorxiv_columns(items: DataFrame, *keep: str) -> DataFrame:
    """Items to Paper columns."""
    authors = A.split_authors(F.col("authors"))
    return items.select(
        *keep,
        "source_seq",
        "published",
        X.or_blank(F.col("title")).alias("Title"),
        authors.alias("Authors"),
        F.lit(K.SOURCE_BIORXIV).alias("Source"),
        X.or_blank(F.col("abstract")).alias("Abstract"),
        F.lit("").alias("PMID"),
        A.last_author_affiliation(authors, F.col("author_corresponding_institution")).alias(
            "Affiliation"
        ),
        F.col("doi").alias("DOI"),
        X.doi_link(F.col("doi")).alias("paperLink"),
    )


def in_days(items: DataFrame, source: str, days: Column, account: Account) -> DataFrame:
    """Items of the days of a run; undated ones and those of other days are counted."""
    published = F.col("published")
    outcome = F.when(published.isNull(), UNDATED).when(days, OF_DAYS).otherwise(OTHER_DAY)
    return account.by_outcome(items, source, ITEM, outcome, UNDATED, OTHER_DAY, OF_DAYS).where(days)


def biorxiv_papers(
    items: DataFrame, term: str, run_date: dt.date, days: int, account: Account | None = None
) -> DataFrame:
    """New items of the day that hit a keyword: window, anti join, keyword filter, projection.

    The bodies are parsed once: the items of the two days are written, those of the earlier day for
    their DOI alone, and the anti join reads that table.
    """
    account = account or NoAccount()
    of_days = in_days(items, "biorxiv", biorxiv_window(F.col("published"), run_date, days), account)
    latest = single_day(F.col("published"), run_date, days)
    wide = [c for c in items.columns if c not in ("doi", "published")]
    two_days = write_once(
        of_days.select("doi", "published", *[F.when(latest, F.col(c)).alias(c) for c in wide]), "two-days"
    )
    two_days = placed(two_days, "_place")
    before = two_days.where(single_day(F.col("published"), run_date, days + 1))
    today = two_days.where(latest)
    if not isinstance(account, NoAccount):
        # Counted from the written table: what lies below a join may vanish from a plan that is
        # made anew while it runs, and its metrics with it.
        account.add("biorxiv", ITEM, TODAY, today.count())
    new = drop_matching(today, before.select("doi"), "doi", "_place").drop("_place")
    hit = X.any_keyword(term, F.col("title"), F.col("abstract"))
    new = account.by_outcome(new, "biorxiv", ITEM, F.when(hit, USED).otherwise(NO_HIT), NO_HIT)
    return as_papers(biorxiv_columns(new.where(hit)), "biorxiv")


def chemrxiv_columns(items: DataFrame, *keep: str) -> DataFrame:
    """Items to Paper columns."""
    none = F.array().cast("array<string>")
    return items.select(
        *keep,
        "source_seq",
        "published",
        X.or_blank(F.col("title")).alias("Title"),
        F.coalesce(A.full_names(F.col("authors")), none).alias("Authors"),
        F.lit(K.SOURCE_CHEMRXIV).alias("Source"),
        X.or_blank(F.col("abstract")).alias("Abstract"),
        F.lit("").alias("PMID"),
        F.coalesce(A.first_institutions(F.col("authors")), none).alias("Affiliation"),
        F.col("doi").alias("DOI"),
        X.doi_link(F.col("doi")).alias("paperLink"),
    )


def chemrxiv_papers(
    items: DataFrame,
    words: str,
    run_date: dt.date,
    days: int,
    limit: int = K.CHEMRXIV_LIMIT,
    account: Account | None = None,
) -> DataFrame:
    """The first ``limit`` items of the day that hold the exact phrase."""
    account = account or NoAccount()
    today = in_days(items, "chemrxiv", single_day(F.col("published"), run_date, days), account)
    hit = X.phrase(words, F.col("title"), F.col("abstract"))
    today = account.by_outcome(today, "chemrxiv", ITEM, F.when(hit, HIT).otherwise(NO_HIT), NO_HIT, HIT)
    # Limited last, so that the optimizer sees the limit on the sort: a top-k, not a sort.
    best = first_rows(as_papers(chemrxiv_columns(today.where(hit)), "chemrxiv"), limit, "source_seq", "DOI")
    return account.passed(best, "chemrxiv", ITEM, USED)
