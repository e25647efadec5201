"""Look-back day windows as predicates on a date or timestamp column.

Each is a pair of constant bounds compared with the bare column, so it reaches the scan
as a pushed filter and prunes a table partitioned by that column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(date: dt.date) -> Column:
    return F.lit(date)


def _back(run_date: dt.date, days: int) -> dt.date:
    return run_date - dt.timedelta(days=days)


def days_between(column: Column, first: dt.date, last: dt.date) -> Column:
    """Whole days ``first`` to ``last``, both included."""
    return (column >= _day(first)) & (column < _day(last + dt.timedelta(days=1)))


def pubmed_window(column: Column, run_date: dt.date, days: int) -> Column:
    """The last ``days`` days up to the day of the run (F1); the caller picks edat, mdat or pdat."""
    return days_between(column, _back(run_date, days), run_date)


def arxiv_days(run_date: dt.date, days: int, include_upper: bool = False) -> tuple[dt.date, dt.date]:
    """First and last day of the arXiv window."""
    first = _back(run_date, days)
    return first, first + dt.timedelta(days=1 if include_upper else 0)


def arxiv_window(
    column: Column, run_date: dt.date, days: int, include_upper: bool = False
) -> Column:
    """``[run-days, run-days+1]`` (F2); whether the upper day belongs to it is a choice."""
    return days_between(column, *arxiv_days(run_date, days, include_upper))


def biorxiv_window(column: Column, run_date: dt.date, days: int) -> Column:
    """The day ``run-days`` and the one before it."""
    return days_between(column, _back(run_date, days + 1), _back(run_date, days))


def single_day(column: Column, run_date: dt.date, days: int) -> Column:
    """Exactly the day ``run-days``."""
    return days_between(column, _back(run_date, days), _back(run_date, days))
