"""What the operators of this package share: row identity, hash order, bounded joins."""

from __future__ import annotations

import ctypes
import gc
import os
from collections import ChainMap
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperwire.session import shared_folder, write_once

#: A word is a run of bytes other than ASCII white space; the same class everywhere.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that is broadcast. Every such table is counted first.
BROADCAST_ROWS = 200_000
#: Most bytes of a batch of rows handed to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: A key is hot if it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE are.
HOT_SHARE = 2000


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed, and bound the bytes of their batches.

    Both are settings of the session: its ``PYTHONPATH`` for workers, and a lower bound on Arrow batches if it has none.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        path = os.pathsep.join(x for x in (root, known) if x)
        spark.sparkContext.environment["PYTHONPATH"] = path


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is cheap to read, marked for broadcast if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.count() <= limit else df


#: Bits of a sieve, the same at every size, and places a key sets. More keys than it is made for let more rows through.
SIEVE_BITS, SIEVE_PLACES = 1 << 26, 3


def sieve(keys: DataFrame, on: list[str]) -> Callable[[DataFrame], Column]:
    """A test for rows with columns ``on``: true for all that are among ``keys``, and for few others.

    A Bloom filter of fixed size, so that rows without a partner need not be moved to find that out. Its bits are
    set by Spark, one sum for each word of bits; the driver and the workers hold ``SIEVE_BITS``, whatever the
    input. What the test lets through still has to be joined.
    """
    on_workers(keys.sparkSession)

    def places(df: DataFrame) -> list[Column]:
        columns = [df[c] for c in on]
        return [F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(SIEVE_BITS)).cast("int") for k in range(SIEVE_PLACES)]

    place = keys.select(F.explode(F.array(*places(keys))).alias("at"))
    bit = F.expr("shiftleft(1, at & 31)")
    words = place.groupBy(F.expr("shiftright(at, 5)").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(SIEVE_BITS // 32, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint32)
    held = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def among(*at: pa.Array) -> pa.Array:
        found = None
        for column in at:
            p = column.to_numpy(zero_copy_only=False)
            hit = held.value[p >> 5] >> (p & 31).astype(np.uint32) & 1
            found = hit if found is None else found & hit
        return pa.array(found.astype(bool))

    return lambda df: among(*places(df))


def parted(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may be among ``keys``, and those that surely are not; ``df`` is read for each."""
    test = sieve(keys, on)
    return df.where(test(df)), df.where(~test(df))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(df: DataFrame, name: str = "__row") -> DataFrame:
    """Add the place of each row in its Parquet file, the same at every reading; ``name`` must be free.

    What does not come straight from Parquet files is first written to the shared folder.
    """
    def place(rows: DataFrame) -> DataFrame:
        file = rows.metadataColumn("_metadata")
        return rows.select("*", F.struct(file["file_path"].alias("file"), file["row_index"].alias("i")).alias(name))

    try:
        found = place(df)
        found.schema  # noqa: B018  resolves the columns
        return found
    except PySparkException:
        return place(write_once(df, "rows"))


def drop_rows(df: DataFrame, places: DataFrame, name: str = "__row") -> DataFrame:
    """Rows of an ``identified`` table that are not among ``places``, without that column.

    One plan for all sizes: rows that a sieve says are not listed stay where they are, and only the others, little
    more than those to be dropped, are shuffled by place, which has no repeats.
    """
    listed = checkpointed(places.select(name))
    maybe, kept = parted(df, listed, [name])
    return kept.unionByName(maybe.join(listed.hint("shuffle_hash"), name, "left_anti").select(df.columns)).drop(name)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows to one row per ``key``; ``size`` says how many rows each key has.

    Keys with a large share of the rows meet their group by broadcast of fewer than
    ``HOT_SHARE`` rows; the others by a shuffle. Both tables are read twice: checkpoint them.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total / HOT_SHARE
    few = groups.where(hot)
    cold = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.where(~hot), key)
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    return rows.join(F.broadcast(few), key).select(columns).unionByName(cold.select(columns))


def shuffle_key(column: Column, seed: int) -> Column:
    """A hash-random key: 16 hexadecimal digits of MD5, which any SQL engine can repeat."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return F.substring(F.md5(text), 1, 16)


def key_digits(spark: SparkSession) -> int:
    """Leading digits of a shuffle key that cut its range into about 4 or more parts a partition."""
    wanted, digits = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while 16**digits < wanted and digits < 8:
        digits += 1
    return digits


def ranked(rows: DataFrame, part: str, bucket: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each ``part`` from 1 along ``bucket`` and then ``order``.

    Distributed prefix sums: buckets are ranges of a uniform key, so a large part is spread
    over all of them; only the counts of the buckets are summed along a part. ``rows`` is read
    twice: checkpoint it.
    """
    counts = checkpointed(rows.groupBy(part, bucket).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(part).alias("_part"), F.col(bucket).alias("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy(part, bucket).orderBy(*order))
    starts = bounded(checkpointed(starts))
    met = rows.withColumn("_place", place).join(
        starts, F.col(part).eqNullSafe(F.col("_part")) & (F.col(bucket) == F.col("_range"))
    )
    return met.withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_range", "_before", "_place")


_forgetters: list[Callable[[], None]] = []
_stage: int | None = None


def forget_at_new_stage(forget: Callable[[], None] | None = None) -> None:
    """Called by a task's Python function: gives back what the worker remembers from an earlier stage.

    Spark uses workers again, also for other operators; ``forget`` is what to call when the next stage begins.
    Answers do not depend on it.
    """
    global _stage
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage:
        _stage = stage
        for f in _forgetters:
            f()
        _forgetters.clear()
        give_back()
    if forget is not None and forget not in _forgetters:
        _forgetters.append(forget)


def give_back() -> None:
    """Return freed memory to the system, also what the C library keeps for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Remembered:
    """What a worker has worked out for its latest words, in two generations of bounded size.

    Words that still come up move to the young generation when it is full; the rest are forgotten, and worked
    out again if need be. A generation holds about ``limit`` bytes: keys, values (bytes, or tuples of them) and what
    Python adds to each. Words longer than ``longest`` characters are worked out each time. A bound on memory
    alone: answers do not depend on it.
    """

    #: Bytes of an entry beside its characters: two objects and a place in a dictionary.
    ENTRY = 240

    def __init__(self, limit: int, longest: int = 1024):
        self.limit, self.longest = limit, longest
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def _keep(self, found) -> None:
        for word, value in found:
            self.young[word] = value
            size = len(value) if isinstance(value, bytes) else sum(map(len, value)) + 56 * (len(value) + 1)
            self.held += self.ENTRY + len(word) + size

    def get(self, lists: list, make) -> dict:
        """A dictionary that has all words of the lists; ``make`` takes a list of new ones and gives their values."""
        wanted = set().union(*lists)
        new = wanted.difference(self.young)
        if not new:
            return self.young
        if self.held >= self.limit:
            self.old, self.young, self.held = self.young, {}, 0
            new = wanted
        known = new & self.old.keys()
        self._keep([(w, self.old[w]) for w in known])
        long = [w for w in new - known if len(w) > self.longest]
        short = [w for w in new - known if len(w) <= self.longest]
        self._keep(zip(short, make(short)) if short else ())
        if not long:
            return self.young
        return ChainMap(dict(zip(long, make(long))), self.young)
