"""The whole run: scans, union, numbering, keywords, messages, outbox."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperwire.functions.authors import author_label
from paperwire.operators.counts import source_counts
from paperwire.operators.keywords import Extractor, by_tfidf
from paperwire.operators.numbering import number_rows
from paperwire.operators.outbox import fan_out, write_outbox
from paperwire.operators.union import union_sources
from paperwire.schema import JobConfig
from paperwire.session import write_once
from paperwire.functions.windows import arxiv_days
from paperwire.sources.account import USED, Account, account_rows
from paperwire.sources.atom import arxiv_papers, scan_arxiv
from paperwire.sources.landing import (
    CUT,
    HIT,
    ITEM,
    NO_HIT,
    OF_DAYS,
    OTHER_DAY,
    SEEN,
    TODAY,
    biorxiv_papers,
    chemrxiv_papers,
    current_pages,
    due,
    scan_biorxiv,
    scan_chemrxiv,
)
from paperwire.sources.medline import medline_papers, search


@dataclass(frozen=True)
class Landed:
    """The landed tables of one run; a source that is switched off may be None."""

    medline: DataFrame | None = None
    replies: DataFrame | None = None
    #: Entries of feed files; without them arXiv is read from the replies, those of the window alone.
    atom: DataFrame | None = None
    #: Whether ``medline`` has one record per id already, as a corpus kept by ``upsert`` has.
    medline_current: bool = False


def source_replies(landed: Landed, config: JobConfig, kind: str, account: Account | None) -> DataFrame:
    """The one good reply of each page of a source that the run's days may need."""
    day = config.run_date - dt.timedelta(days=getattr(config, f"{kind}_days"))
    first = last = day
    if kind == "biorxiv":
        first = day - dt.timedelta(days=1)
    elif kind == "arxiv":
        first, last = arxiv_days(config.run_date, config.arxiv_days, config.arxiv_include_upper)
    replies = due(landed.replies, kind, first, last, config.run_ts)
    return current_pages(replies, config.page_limit, account)


def select_papers(landed: Landed, config: JobConfig, account: Account | None = None) -> DataFrame:
    """The papers of the configured sources, in one table; ``account`` is told of what is left out."""
    found = []
    for kind in config.sources:
        if kind == "pubmed":
            # Ids and records come from one corpus, so the search keeps the records at once.
            records = search(
                landed.medline, config.term, config.datetype, config.pubmed_days, config.run_date,
                current=landed.medline_current,
            )
            found.append(medline_papers(records, config.datetype))
        elif kind == "biorxiv":
            items = scan_biorxiv(source_replies(landed, config, kind, account), account=account)
            found.append(
                biorxiv_papers(
                    items, config.term_biorxiv, config.run_date, config.biorxiv_days, account
                )
            )
        elif kind == "chemrxiv":
            items = scan_chemrxiv(source_replies(landed, config, kind, account), account=account)
            found.append(
                chemrxiv_papers(
                    items, config.term_chemrxiv, config.run_date, config.chemrxiv_days,
                    config.chemrxiv_limit, account,
                )
            )
        elif kind == "arxiv":
            entries = landed.atom
            if entries is None:
                entries = scan_arxiv(source_replies(landed, config, kind, account), account=account)
            found.append(
                arxiv_papers(
                    entries, config.term, config.run_date, config.arxiv_days, config.arxiv_top,
                    config.arxiv_include_upper, account,
                )
            )
        else:
            raise ValueError(f"unknown source {kind!r}")
    return union_sources(*found)


def settled(account: Account) -> dict[tuple[str, str, str], int]:
    """The sums of an account, with the items left out at a join or a cap in place of passing counts."""
    sums = account.sums()
    for source in {key[0] for key in sums}:
        today, hit = (sums.pop((source, ITEM, name), None) for name in (TODAY, HIT))
        used, missed = (sums.get((source, ITEM, name), 0) for name in (USED, NO_HIT))
        if today is not None:
            sums[source, ITEM, SEEN] = today - used - missed
            # The window also holds the day before, which is read for its DOIs alone.
            sums[source, ITEM, OTHER_DAY] += sums.pop((source, ITEM, OF_DAYS)) - today
        elif hit is not None:
            sums.pop((source, ITEM, OF_DAYS))
            sums[source, ITEM, CUT] = hit - used
    return sums


def land_papers(papers: DataFrame, name: str = "papers") -> DataFrame:
    """Write the selected papers once, with a ``row_id`` that tells copies apart.

    The corpus is searched once; numbering, keywords and counts read this table.
    """
    return write_once(papers.withColumn("row_id", F.monotonically_increasing_id()), name)


def digest(
    papers: DataFrame, config: JobConfig, extractor: Extractor = by_tfidf("row_id")
) -> DataFrame:
    """The outbox rows of landed papers.

    Only the order columns are numbered; papers, numbers and keywords meet by ``row_id``.
    """
    order = papers.select("source_rank", "source_seq", "row_id")
    numbers = number_rows(order, tie="row_id").select("row_id", "position", "total")
    labelled = (
        extractor(papers)
        .join(numbers, "row_id")
        .withColumn("author_label", author_label(F.col("Authors"), F.col("Affiliation")))
    )
    return fan_out(labelled, config.run_ts, "author_label", config.channels)


def run(
    landed: Landed, config: JobConfig, out: str, extractor: Extractor = by_tfidf("row_id")
) -> None:
    """Search, render and write ``out/outbox``, ``out/counts``, ``out/account`` and ``out/rejects``."""
    account = Account()
    selected = select_papers(landed, config, account)
    papers = land_papers(selected)
    write_outbox(digest(papers, config, extractor), f"{out}/outbox")
    source_counts(papers).write.mode("overwrite").json(f"{out}/counts")
    # A few rows per source each.
    rows = account_rows(papers.sparkSession, settled(account)).coalesce(1)
    rows.write.mode("overwrite").json(f"{out}/account")
    status = F.regexp_extract("outcome", r"^status (\d+)$", 1)
    rejected = rows.where(F.col("outcome").startswith("status ")).select(
        "source", F.nullif(status, F.lit("")).cast("int").alias("status"), F.col("n").alias("replies")
    )
    rejected.write.mode("overwrite").json(f"{out}/rejects")
