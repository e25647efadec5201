"""Text expressions: matching, citation parts, links, tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperwire import constants as K

# Python's str.strip also removes the four separators U+001C..U+001F.
_BLANK = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)\A{_BLANK}+|{_BLANK}+\z"
_NOT_WORD = r"[^\p{L}\p{N}]+"
# Scripts that put no space between words, with the mark that lengthens a Japanese vowel.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_RUN = rf"[{_UNSPACED}]+|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """``text`` without surrounding white space of any script."""
    return F.regexp_replace(text, _STRIP, "")


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def any_keyword(term: str, *texts: Column) -> Column:
    """True where any space-separated piece of ``term`` is a substring of any text.

    Case is ignored.  An empty piece (double space, empty term) matches every row.  The
    lowered texts sit in one array so that each is lowered once, however many keywords.
    """
    keywords = term.lower().split(" ")
    lowered = F.array(*[F.lower(or_blank(t)) for t in texts])
    return F.exists(
        lowered,
        lambda text: reduce(Column.__or__, [F.contains(text, F.lit(k)) for k in keywords]),
    )


def phrase(words: str, *texts: Column) -> Column:
    """True where the whole phrase is a substring of any text, ignoring case."""
    lowered = F.array(*[F.lower(or_blank(t)) for t in texts])
    return F.exists(lowered, lambda text: F.contains(text, F.lit(words.lower())))


def all_words(term: str, *texts: Column) -> Column:
    """True where every piece of ``term`` occurs in one of the texts, ignoring case."""
    keywords = term.lower().split(" ")
    return let(
        F.lower(F.concat_ws("\n", *texts)),
        lambda text: reduce(Column.__and__, [F.contains(text, F.lit(k)) for k in keywords]),
    )


def relevance(term: str, *texts: Column) -> Column:
    """Number of occurrences of the pieces of ``term``, ignoring case."""
    pieces = [k for k in term.lower().split(" ") if k]

    def hits(text: Column) -> Column:
        counts = [
            ((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).cast(
                "bigint"
            )
            for k in pieces
        ]
        return reduce(Column.__add__, counts, F.lit(0).cast("bigint"))

    return let(F.lower(F.concat_ws("\n", *texts)), hits)


def citation_source(citation: Column) -> Column:
    """The citation text before its DOI."""
    return F.get(F.split(citation, re.escape(K.DOI_MARK)), F.lit(0))


def citation_doi(citation: Column) -> Column:
    """The whole DOI of a citation, NULL where it has none."""
    found = F.regexp_extract(citation, r"\. doi: (\S+?)\.?(?:\s|$)", 1)
    return F.nullif(found, F.lit(""))


def pubmed_link(pmid: Column) -> Column:
    return F.concat(F.lit(K.PUBMED_LINK), pmid, F.lit("/"))


def doi_link(doi: Column) -> Column:
    """Resolver link; NULL for a NULL DOI."""
    return F.concat(F.lit(K.DOI_LINK), doi)


def words(text: Column) -> Column:
    """Lowered terms in text order; may hold ``''`` at the ends.

    Runs of letters and digits of any length, and where a script does not space its words, each pair
    of neighbouring characters (a single one stands for itself).
    """
    lowered = F.lower(text)
    pairs = F.flatten(
        F.transform(
            F.regexp_extract_all(lowered, F.lit(_RUN), F.lit(0)),
            lambda run: F.when(
                run.rlike(rf"^[{_UNSPACED}]") & (F.char_length(run) > 1),
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.char_length(run) - 1, F.lit(1))),
                    lambda i: F.substr(run, i, F.lit(2)),
                ),
            ).otherwise(F.array(run)),
        )
    )
    # Most texts are spaced, and a split is the cheapest way to take those apart.
    return F.when(lowered.rlike(f"[{_UNSPACED}]"), pairs).otherwise(F.split(lowered, _NOT_WORD))
