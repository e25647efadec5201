"""Author lists, affiliations and the author label of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperwire import constants as K
from paperwire.functions.text import let, or_blank


def split_authors(authors: Column) -> Column:
    """One text of authors to an array."""
    return F.split(or_blank(authors), K.AUTHOR_SEPARATOR)


def full_names(authors: Column) -> Column:
    """``first last`` per author object, the one there is where the other is missing."""
    return F.transform(authors, lambda a: F.concat_ws(" ", a.firstName, a.lastName))


def first_institutions(authors: Column) -> Column:
    """Name of each author's first institution, ``''`` where there is none."""
    return F.transform(authors, lambda a: or_blank(F.get(a.institutions, F.lit(0))["name"]))


def blank_affiliations(authors: Column) -> Column:
    """One ``''`` per author."""
    return F.array_repeat(F.lit(""), F.size(authors))


def last_author_affiliation(authors: Column, institution: Column) -> Column:
    """The institution on the last author, ``''`` on the others."""
    return F.concat(
        F.array_repeat(F.lit(""), F.size(authors) - 1), F.array(or_blank(institution))
    )


def with_institution(author: Column, institution: Column) -> Column:
    """``author (institution)``, or the author alone where the institution is blank."""
    return F.when(
        or_blank(institution) != "", F.concat(author, F.lit(" ("), institution, F.lit(")"))
    ).otherwise(author)


def short_list(named: Column, count: Column) -> Column:
    """Up to three authors in full, else ``first, second ... last``.

    ``count`` is the number of authors before pairing, which may exceed ``named``; with
    fewer than two pairs everything there is gets listed.
    """
    size = F.size(named)
    shortened = F.concat(
        F.get(named, F.lit(0)), F.lit(", "), F.get(named, F.lit(1)),
        F.lit(" ... "), F.get(named, size - 1),
    )
    return F.when((count <= 3) | (size < 2), F.array_join(named, ", ")).otherwise(shortened)


def author_label(authors: Column, institutions: Column) -> Column:
    """Label of position-paired arrays; pairs stop at the shorter array."""
    shorter = F.least(F.size(authors), F.size(institutions))
    named = F.zip_with(
        F.slice(authors, F.lit(1), shorter), F.slice(institutions, F.lit(1), shorter),
        with_institution,
    )
    return let(named, lambda pairs: short_list(pairs, F.size(authors)))
