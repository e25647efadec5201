"""About ten keywords per abstract by TF-IDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperwire.functions import text as X
from paperwire.operators.sizing import fits_broadcast, spread_small, tasks_for
from paperwire.session import write_once

KEYWORDS = 10
#: Words whose frequencies are broadcast at most, about 16 MB; the most frequent ones.
COMMON = 200_000

# Adds ``SummaryAbstract`` to papers.
Extractor = Callable[[DataFrame], DataFrame]


# Counted as one more word of every abstract, so that its document frequency is the number
# of abstracts and the texts need not be read again to count them.
EVERY = ""


def term_counts(papers: DataFrame, key: str) -> DataFrame:
    """``key, term, tf``: how often each word occurs in an abstract (E5: if it has one).

    The texts are partitioned by paper first.  That moves less than the far more numerous
    counts would, and these then stay where they are until they meet the frequencies.  More
    text gives more tasks, so the counts of one are sorted in memory.
    """
    texts = papers.where(F.col("Abstract") != "").select(key, "Abstract")
    return (
        texts.repartition(tasks_for(texts), key)
        .select(key, F.explode(X.words(F.col("Abstract"))).alias("term"))
        .where(F.col("term") != EVERY)
        .groupBy(key, "term")
        .agg(F.count("*").alias("tf"))
    )


def document_frequencies(papers: DataFrame, key: str) -> DataFrame:
    """``term, df``: in how many abstracts each word occurs, and their number as ``EVERY``.

    Repeats within an abstract go in its own row, and each task adds up its words before
    the shuffle, so common words cost no more than rare ones.
    """
    texts = papers.where(F.col("Abstract") != "").select(key, "Abstract")
    distinct = F.array_distinct(F.array_append(X.words(F.col("Abstract")), F.lit(EVERY)))
    return (
        spread_small(texts, key)
        .select(F.explode(distinct).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def split_by_frequency(repeated: DataFrame, common: int) -> int:
    """The ``df`` above which there are at most ``common`` words, or 1 if these are all.

    One less than a power of two, so at most 64 rows are looked at.
    """
    level = F.length(F.bin("df")).alias("level")
    words = {r["level"]: r["count"] for r in repeated.groupBy(level).count().collect()}
    room, cut = common, 0
    for found in sorted(words, reverse=True):
        room -= words[found]
        if room < 0:
            cut = found
            break
    return 2**cut - 1 if cut else 1


def contenders(terms: DataFrame, score: Callable[[Column, Column], Column], key: str, keywords: int, cut: int) -> DataFrame:
    """Rows that may be among the best of their paper, where NULL ``df`` is between 1 and ``cut``.

    The bar of a paper is the score that ``keywords`` of its words reach at least.  A word that stays
    below it even if no other paper has it is not among the best.
    """
    least = score(F.col("tf"), F.coalesce("df", F.lit(cut)))
    most = score(F.col("tf"), F.coalesce("df", F.lit(1)))
    # One pass over the paper's words, which are in order already; NULL if there are fewer.
    of_paper = Window.partitionBy(key).orderBy(F.desc("_least"))
    whole = of_paper.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bar = F.nth_value("_least", keywords).over(whole)
    return (
        terms.withColumn("_least", least)
        .withColumn("_bar", bar)
        .where(F.col("_bar").isNull() | (most >= F.col("_bar")))
        .select(*terms.columns)
    )


def weigh(
    terms: DataFrame, frequencies: DataFrame, score: Callable[[Column, Column], Column], key: str,
    keywords: int = KEYWORDS, common: int = COMMON,
) -> DataFrame:
    """Attach ``df`` to the term counts that may be among the best of their paper.

    Words of one abstract only, most of any vocabulary, are left out of the right side: a
    term that finds no partner there is one of them.  Up to ``common`` words, which are nearly all
    occurrences, are answered where the counts lie.  Only what is left, and may still win,
    is shuffled to the other words; none of these is in more than a small share of all rows.
    """
    repeated = frequencies.where((F.col("df") > 1) & (F.col("term") != EVERY))
    cut = 1 if fits_broadcast(repeated) else split_by_frequency(repeated, common)
    told = terms.join(F.broadcast(repeated.where(F.col("df") > cut)), "term", "left")
    if cut == 1:
        return told.withColumn("df", F.coalesce("df", F.lit(1)))
    # Read twice below, and a sort of all counts: written once.
    told = write_once(contenders(told, score, key, keywords, cut), "contenders")
    rare = repeated.where(F.col("df") <= cut)
    found = told.where(F.col("df").isNull()).drop("df").join(rare, "term", "left")
    return told.where(F.col("df").isNotNull()).unionByName(found.withColumn("df", F.coalesce("df", F.lit(1))))


def tfidf_keywords(
    papers: DataFrame,
    key: str = "paper_key",
    keywords: int = KEYWORDS,
    common: int = COMMON,
) -> DataFrame:
    """``key, SummaryAbstract``: the best words of each abstract joined by ``", "``.

    ``key`` names one row.  Score = tf * ln(n / df) to six places, ties in word order.  The
    frequencies are written once, and so are the words that may win if not all frequencies
    can be broadcast; all else is one lazy plan over them and the texts.
    """
    frequencies = write_once(document_frequencies(papers, key), "frequencies")
    total = frequencies.where(F.col("term") == EVERY).select("df").scalar()

    def score(tf: Column, df: Column) -> Column:
        return F.round(tf * F.log(total / df), 6)

    weighed = weigh(term_counts(papers, key), frequencies, score, key, keywords, common)
    scored = weighed.withColumn("score", score(F.col("tf"), F.col("df")))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return (
        scored.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= keywords)
        .groupBy(key)
        # At most ``keywords`` rows per paper.
        .agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("best"))
        .select(key, F.array_join(F.col("best")["term"], ", ").alias("SummaryAbstract"))
    )


def attach_summaries(
    papers: DataFrame, summaries: DataFrame, key: str = "paper_key"
) -> DataFrame:
    """Write each summary back to its paper (J3); ``''`` where there is none (E5).

    ``key`` names one row on either side, so this join has no hot keys.
    """
    return papers.join(summaries, key, "left").withColumn(
        "SummaryAbstract", X.or_blank(F.col("SummaryAbstract"))
    )


def by_tfidf(key: str) -> Extractor:
    """The extractor of the default run."""
    return lambda papers: attach_summaries(papers, tfidf_keywords(papers, key), key)


def by_column(extract: Callable[[Column], Column]) -> Extractor:
    """An extractor from a function of the abstract column, e.g. a pandas UDF.

    It never sees an empty abstract (E5); a mere CASE would not keep those from a UDF.
    """
    abstract = F.col("Abstract")

    def summarise(papers: DataFrame) -> DataFrame:
        full = papers.where(abstract != "")
        empty = papers.where(~(abstract != "") | abstract.isNull())
        return full.withColumn("SummaryAbstract", X.or_blank(extract(abstract))).unionByName(
            empty.withColumn("SummaryAbstract", F.lit(""))
        )

    return summarise
