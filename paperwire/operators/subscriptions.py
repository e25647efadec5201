"""Many subscriptions against many papers: which keyword of a table occurs in which paper.

A join on ``contains`` would compare every paper with every keyword.  Here a keyword is looked up by one
of its three-letter pieces, the rarest: papers that hold the piece are candidates, and only these are
searched for the whole keyword.  Keywords of one or two letters are pieces themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.functions import text as X
from paperwire.operators.sizing import fits_broadcast, spread_small
from paperwire.session import write_once

#: Letters of a piece; papers that are looked at, about, to tell rare pieces from common ones.
PIECE, SAMPLE = 3, 2_000
#: Up to here it is faster to search a text for each piece than to take it apart.
LISTED = 300


def _pieces(text: Column, size: int) -> Column:
    """All distinct runs of ``size`` characters, none of a shorter text.

    The text is taken apart once; a substring or a match at each place would each walk it again.
    """

    def runs(chars: Column) -> Column:
        joined = F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, size)]))
        return F.array_distinct(F.filter(joined, lambda run: F.char_length(run) == size))

    return X.let(F.split(text, ""), runs)


def _own_pieces(keyword: Column) -> Column:
    """The pieces of a keyword; one of fewer letters than ``PIECE`` is its own."""
    return F.when(F.char_length(keyword) < PIECE, F.array(keyword)).otherwise(_pieces(keyword, PIECE))


def _lowered(texts: tuple[str, ...]) -> list[Column]:
    return [F.lower(X.or_blank(F.col(t))) for t in texts]


def _text_pieces(texts: list[Column], sizes: list[int]) -> Column:
    """Runs of the given sizes, one pass over each text for each size.

    A run may begin inside a character of two UTF-16 units; it then has ``?`` in its place.
    """
    return F.concat(*[F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for t in texts for n in sizes])


def _paper_pieces(
    papers: DataFrame, key: str, texts: tuple[str, ...], sizes: list[int], only: list[str] | None = None
) -> DataFrame:
    """``key``, the lowered texts ``_text0, …`` and one row per distinct ``_piece`` of them, of ``only`` these if given."""
    lowered = {f"_text{i}": t for i, t in enumerate(_lowered(texts))}
    dealt = spread_small(papers.select(key, *texts), key).select(key, *[t.alias(n) for n, t in lowered.items()])
    if only is None:
        runs = F.array_distinct(_text_pieces([F.col(n) for n in lowered], sizes))
    else:
        runs = F.filter(F.array(*[F.lit(p) for p in only]), lambda piece: _held(lowered, piece))
    # Outer, as a plain explode first asks whether there is a piece: all are then made twice.
    pieces = dealt.select("*", runs.alias("_runs")).select(key, *lowered, F.explode_outer("_runs").alias("_piece"))
    return pieces.where(~F.col("_piece").startswith("?") | _held(lowered, F.col("_piece")))


def _held(texts: Iterable[str], part: Column) -> Column:
    return reduce(Column.__or__, [F.contains(F.col(t), part) for t in texts])


def _rarest(papers: DataFrame, words: DataFrame, key: str, texts: tuple[str, ...], sizes: list[int], sample: int) -> DataFrame:
    """``keyword, _piece``: one piece of each keyword, the one in the fewest papers of a sample.

    Any piece gives the same matches; a rare one gives fewer candidates.
    """
    share = min(1.0, sample / max(1, papers.count()))
    part = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int(share * (1 << 20))
    pieces = words.select("keyword", F.explode(_own_pieces(F.col("keyword"))).alias("_piece"))
    seen = _paper_pieces(papers.where(part), key, texts, sizes).groupBy("_piece").agg(F.count("*").alias("_papers"))
    known = pieces.join(seen, "_piece", "left")
    best = F.min(F.struct(F.coalesce("_papers", F.lit(0)).alias("n"), F.col("_piece").alias("piece")))
    return known.groupBy("keyword").agg(best.alias("_best")).select("keyword", F.col("_best.piece").alias("_piece"))


def keyword_matches(
    papers: DataFrame,
    keywords: DataFrame,
    key: str = "paper_key",
    texts: tuple[str, ...] = ("Title", "Abstract"),
    sample: int = SAMPLE,
) -> DataFrame:
    """``key, keyword``: every keyword (lowered) that is a substring of a text of the paper, ignoring case.

    ``keywords`` has a column ``keyword``; ``key`` names one paper.  NULL keywords match nothing; an
    empty one matches all papers, as in a single search.
    """
    words = write_once(keywords.where(F.col("keyword").isNotNull()).select(F.lower("keyword").alias("keyword")).distinct(), "keywords")
    sizes = [r["n"] for r in words.where("keyword <> ''").select(F.least(F.char_length("keyword"), F.lit(PIECE)).alias("n")).distinct().collect()]
    every = words.where("keyword = ''").isEmpty()
    found = papers.select(key, F.lit("").alias("keyword"))
    found = found.limit(0) if every else found
    if not sizes:  # three at most
        return found
    chosen = write_once(_rarest(papers, words.where("keyword <> ''"), key, texts, sorted(sizes), sample), "pieces")
    # Short keywords are their own piece; the others are looked for in the text, once per candidate.
    short = F.char_length("keyword") <= PIECE
    # A few pieces are searched for in the row; more of them meet all pieces of a paper.
    listed = [r["_piece"] for r in chosen.select("_piece").distinct().limit(LISTED + 1).collect()]
    pieces = _paper_pieces(papers, key, texts, sorted(sizes), listed if len(listed) <= LISTED else None)
    held = _held([c for c in pieces.columns if c.startswith("_text")], F.col("keyword"))
    if fits_broadcast(chosen):
        # The texts stay where they are.  A paper without a key meets short keywords alone, as in a join by key.
        met = pieces.join(F.broadcast(chosen), "_piece").where(short | (F.col(key).isNotNull() & held))
        return found.unionByName(met.select(key, "keyword"))
    candidates = pieces.select(key, "_piece").join(chosen, "_piece").select(key, "keyword")
    lowered = [t.alias(f"_text{i}") for i, t in enumerate(_lowered(texts))]
    hits = candidates.where(~short).join(papers.select(key, *lowered), key).where(held).select(key, "keyword")
    return found.unionByName(candidates.where(short)).unionByName(hits)


def word_matches(
    papers: DataFrame,
    keywords: DataFrame,
    key: str = "paper_key",
    texts: tuple[str, ...] = ("Title", "Abstract"),
) -> DataFrame:
    """``key, keyword``: keywords (lowered) that are whole words of a text of the paper; an equi-join."""
    words = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    terms = F.array_distinct(F.flatten(F.array(*[X.words(X.or_blank(F.col(t))) for t in texts])))
    return papers.select(key, F.explode(terms).alias("keyword")).join(words, "keyword").select(key, "keyword")


def subscribed(matches: DataFrame, subscriptions: DataFrame, key: str, subscription: str) -> DataFrame:
    """``key, subscription``: papers that hold any keyword of a subscription (``subscription, keyword``), once each."""
    own = subscriptions.select(subscription, F.lower("keyword").alias("keyword"))
    return matches.join(own, "keyword").select(key, subscription).distinct()
