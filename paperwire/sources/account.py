"""What became of every reply and item of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ACCOUNT = "source STRING, unit STRING, outcome STRING, n BIGINT"
USED = "used"


class Account:
    """Counts by outcome, taken while the rows pass, so that nothing is read a second time for them.

    A watched table is counted in the job that reads it; ask for the sums after that job, and watch nothing that
    a join above may find to be empty and leave out of the plan, as its counts would never come.  Such counts are
    accumulators: a task that is run again, because its executor was lost after it had ended, is counted
    again.  Deliveries never depend on them.
    """

    def __init__(self) -> None:
        self._known: dict[tuple[str, str, str], int] = {}
        self._watched: list[tuple[str, str, dict[str, str], Observation]] = []

    def add(self, source: str, unit: str, outcome: str, n: int) -> None:
        key = source, unit, outcome
        self._known[key] = self._known.get(key, 0) + n

    def by_outcome(
        self, rows: DataFrame, source: str, unit: str, outcome: Column, *outcomes: str
    ) -> DataFrame:
        """``rows`` unchanged; counts those whose ``outcome`` is one of ``outcomes`` or ``used``."""
        names = {f"c{k}": name for k, name in enumerate(dict.fromkeys((USED, *outcomes)))}
        seen = Observation(f"account-{uuid.uuid4().hex}")
        self._watched.append((source, unit, names, seen))
        return rows.observe(seen, *[F.count_if(outcome == n).alias(c) for c, n in names.items()])

    def passed(self, rows: DataFrame, source: str, unit: str, outcome: str) -> DataFrame:
        """``rows`` unchanged; counts all of them as ``outcome``."""
        return self.by_outcome(rows, source, unit, F.lit(outcome), outcome)

    def sums(self) -> dict[tuple[str, str, str], int]:
        """``n`` by source, unit and outcome.  The watched jobs must have ended."""
        found = dict(self._known)
        for source, unit, names, seen in self._watched:
            for column, outcome in names.items():
                key = source, unit, outcome
                found[key] = found.get(key, 0) + (seen.get.get(column) or 0)
        return found


class NoAccount(Account):
    """Counts nothing and leaves the plans as they are."""

    def by_outcome(self, rows: DataFrame, *_: object) -> DataFrame:
        return rows


def account_rows(spark: SparkSession, sums: dict[tuple[str, str, str], int]) -> DataFrame:
    """``source``, ``unit``, ``outcome``, ``n``: the outcomes that occur, a few rows per source."""
    rows = [(*key, n) for key, n in sorted(sums.items()) if n]
    return spark.createDataFrame(rows, ACCOUNT)
