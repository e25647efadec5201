"""MEDLINE tagged text and the PubMed id list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.functions import text as X
from paperwire.functions.authors import blank_affiliations
from paperwire.functions.windows import pubmed_window
from paperwire.operators.joins import keep_matching
from paperwire.operators.topk import first_per_group
from paperwire.sources.common import as_papers

Match = Callable[..., Column]

# --- fixed values: date tags by search date type ---
DATE_TAGS = {"edat": "EDAT", "mdat": "LR", "pdat": "DP"}
# Length and form of a date's beginning; a publication date may lack its day, or its month.
DATE_FORMATS = {
    "edat": ((10, "yyyy/MM/dd"),),
    "mdat": ((8, "yyyyMMdd"),),
    "pdat": ((11, "yyyy MMM d"), (10, "yyyy MMM d"), (8, "yyyy MMM"), (4, "yyyy")),
}


def _lines(record: Column) -> Column:
    """A record's lines, each with its continuation lines joined on by one space."""
    trimmed = F.regexp_replace(record, r"[ \t\r]+(?=\n|\z)", "")
    unfolded = F.regexp_replace(trimmed, r"\n {6}", " ")
    return F.transform(
        F.split(unfolded, "\n"),
        lambda line: F.struct(
            F.rtrim(F.substring(line, 1, 4)).alias("tag"),
            F.substr(line, F.lit(7)).alias("val"),
        ),
    )


def _all(tag: str) -> Column:
    tagged = F.filter("lines", lambda line: line.tag == tag)
    return F.transform(tagged, lambda line: line.val)


def _text(tag: str) -> Column:
    """A tag's text; ``''`` where the record lacks it."""
    return F.array_join(_all(tag), " ")


def tag_date(kind: str) -> Column:
    """The date of a record by search date type; a month or a year alone is its first day."""
    forms = [
        F.try_to_timestamp(F.trim(F.substring(_text(DATE_TAGS[kind]), 1, length)), F.lit(form))
        for length, form in DATE_FORMATS[kind]
    ]
    return F.coalesce(*forms).cast("date").alias(kind)


def read_medline(spark: SparkSession, path: str, record_sep: str = "\n\n") -> DataFrame:
    """Records of tagged text files (S2): one row per blank-line separated record.

    The text reader splits large files on the record separator, so a file of any size is
    read by many tasks.  Files with CRLF line ends need ``record_sep="\\r\\n\\r\\n"``.
    A corpus that is searched every day is best kept as a table by :mod:`paperwire.sources.corpus`.
    """
    raw = spark.read.option("lineSep", record_sep).text(path)
    lines = raw.where(F.length(F.trim(F.translate("value", "\r\n\t", "   "))) > 0).select(
        _lines(F.regexp_replace("value", r"\A[\r\n]+", "")).alias("lines")
    )
    dates = [tag_date(kind) for kind in DATE_TAGS]
    fields = F.struct(
        _text("PMID").alias("PMID"),
        _text("TI").alias("TI"),
        _text("AB").alias("AB"),
        _all("AU").alias("AU"),
        _all("AD").alias("AD"),
        _text("SO").alias("SO"),
        *dates,
    )
    # Filters stay above a generator; pushed below a projection they would parse each
    # record anew for every field they mention.
    return lines.select(F.inline(F.array(fields)))


def medline_papers(records: DataFrame, datetype: str = "edat") -> DataFrame:
    """Tag fields to Paper columns (P1, P5 to P8); newest id first, as a search lists them.

    Missing texts are ``''``, missing authors an empty array, missing affiliations one
    ``''`` per author, a citation without DOI a NULL DOI.
    """
    rows = records.select(
        (-F.expr("try_cast(PMID AS BIGINT)")).alias("source_seq"),
        F.col(datetype).alias("published"),
        F.col("TI").alias("Title"),
        F.col("AU").alias("Authors"),
        X.citation_source(F.col("SO")).alias("Source"),
        F.col("AB").alias("Abstract"),
        "PMID",
        F.when(F.size("AD") > 0, F.col("AD"))
        .otherwise(blank_affiliations(F.col("AU")))
        .alias("Affiliation"),
        X.citation_doi(F.col("SO")).alias("DOI"),
        X.pubmed_link(F.col("PMID")).alias("paperLink"),
    )
    return as_papers(rows, "pubmed")


def one_per_id(records: DataFrame) -> DataFrame:
    """One record per id, as a fetch takes one: the last revised, then the first by content.

    A record without an id cannot be fetched.  Each task drops its own copies before the
    shuffle.
    """
    revised = [F.desc_nulls_last("mdat")] if "mdat" in records.columns else []
    content = [c for c in ("TI", "AB", "SO") if c in records.columns]
    return first_per_group(records.where(F.col("PMID") != ""), 1, "PMID", *revised, *content)


def search(
    records: DataFrame,
    term: str,
    datetype: str,
    days: int,
    run_date: dt.date,
    match: Match = X.all_words,
    current: bool = False,
) -> DataFrame:
    """Current records within the window of the chosen date that match the term.

    The last revision of each id is looked at, and no earlier one, so a superseded version that
    still matches is not found.  ``current`` says that ``records`` has one per id already, as a
    corpus table has: then the window prunes its partitions and nothing is shuffled.

    The service's term language is not public; ``match`` says what counts as a hit, e.g.
    ``all_words`` or ``any_keyword``.
    """
    rows = records if current else one_per_id(records)
    hit = match(term, F.col("TI"), F.col("AB"))
    return rows.where(hit & pubmed_window(F.col(datetype), run_date, days))


def search_ids(
    records: DataFrame,
    term: str,
    datetype: str,
    days: int,
    run_date: dt.date,
    match: Match = X.all_words,
    current: bool = False,
) -> DataFrame:
    """The id list of a search."""
    found = search(records, term, datetype, days, run_date, match, current)
    return found.select(F.col("PMID").alias("id"))


def fetch_by_id(records: DataFrame, ids: DataFrame, current: bool = False) -> DataFrame:
    """The current record of each listed id.

    Of a ``current`` corpus bucketed by id the records are not shuffled, only the ids.
    """
    wanted = ids.select(F.col("id").alias("PMID"))
    if current:
        return records.join(wanted.distinct(), "PMID", "left_semi")
    return one_per_id(keep_matching(records, wanted, "PMID"))
