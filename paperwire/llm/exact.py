"""Exact duplicates by content-defined chunk recipes.

A text without white space is cut where a rolling hash of its last bytes says so; its recipe is
the ordered list of its chunks' identifiers. An identifier is a 64-bit hash that has been verified: the distinct
chunks of all texts are held against one another by 128 bits of SHA-256, and contents that share a hash get
different numbers. Texts are equal if their lists are. A text is read once and neither it nor its chunks
move, whatever the number of copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed, drop_rows, forget_at_new_stage, free_name, identified, join_groups, on_workers

WHITE = b" \t\n\x0b\x0c\r"
#: Least, mean and most bytes of a chunk.
LEAST, MEAN, MOST = 1024, 4096, 16384
#: Bytes of a rolling hash: its window is a power of two.
WINDOW = 32
#: The hash of a byte, spread over 64 bits by the generator's own rule.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
#: Bytes of SHA-256 that verify a chunk's hash.
CHECK = 16


def cuts(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks: a function of the bytes alone."""
    size = len(data)
    if size <= least:
        return [size] if size else []
    ends, start = [], 0
    # Blocks bound the memory of a very long text; each looks back one window.
    block = 1 << 22
    places: list[np.ndarray] = []
    values = np.frombuffer(data, np.uint8)
    for at in range(0, size, block):
        low = max(0, at - WINDOW)
        rolling, width = GEAR[values[low : at + block]], 1
        while width < WINDOW:  # the sum over 2w bytes from two sums over w
            rolling[width:] = rolling[width:] + (rolling[:-width] << np.uint64(width))
            width *= 2
        found = np.flatnonzero((rolling >> np.uint64(40)) % np.uint64(mean) == 0) + low + 1
        places.append(found[found > at])
    for end in np.concatenate(places).tolist():
        while end - start > most:
            start += most
            ends.append(start)
        if end - start >= least:
            ends.append(end)
            start = end
    while size - start > most:
        start += most
        ends.append(start)
    return ends + [size] * (start < size)


def _chunks(data: bytes, bits: int) -> tuple[list[int], list[bytes]]:
    parts, start = [], 0
    for end in cuts(data):
        parts.append(data[start:end])
        start = end
    shift = 64 - bits
    return [np.uint64(xxhash.xxh64_intdigest(p) >> shift).view(np.int64).item() for p in parts], parts


def _stripped(text: bytes | None) -> bytes:
    return (text or b"").translate(None, WHITE)


def recipe(text: Column, bits: int = 64) -> Column:
    """Struct of ``sha256`` of the text without white space, and ``hashes`` and ``checks`` of its chunks in order."""

    @F.arrow_udf("struct<sha256: string, hashes: array<bigint>, checks: array<binary>>")
    def made(texts: pa.Array) -> pa.Array:
        forget_at_new_stage()
        digests, hashes, checks, ends = [], [], [], [0]
        for text in texts:
            data = _stripped(text.as_py())
            digests.append(hashlib.sha256(data).hexdigest())
            found, parts = _chunks(data, bits)
            hashes += found
            checks += [hashlib.sha256(p).digest()[:CHECK] for p in parts]
            ends.append(len(hashes))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((hashes, pa.int64()), (checks, pa.binary()))]
        return pa.StructArray.from_arrays([pa.array(digests, pa.string()), *lists], ["sha256", "hashes", "checks"])

    return made(text.cast("binary"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``numbers``: NULL, or where a hash stands for several contents, the numbers of all of the row's chunks."""
    parts = rows.select(F.explode(F.arrays_zip("hashes", "checks")).alias("_c")).select("_c.hashes", "_c.checks").distinct()
    shared = parts.groupBy("hashes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("hashes").alias("hash"))
    shared = checkpointed(shared)
    if shared.isEmpty():
        return rows.withColumn("numbers", F.lit(None).cast("array<bigint>"))
    order = Window.partitionBy("hashes").orderBy("checks")
    place = parts.join(shared, F.col("hashes") == F.col("hash"), "left_semi").withColumn("number", F.row_number().over(order).cast("bigint"))
    place = place.select(F.col("hashes").alias("hash"), F.col("checks").alias("check"), "number")
    occurs = rows.select("sha256", F.posexplode(F.arrays_zip("hashes", "checks")).alias("at", "_c"))
    occurs = occurs.select(F.col("sha256").alias("_sha"), "at", F.col("_c.hashes").alias("hash"), F.col("_c.checks").alias("check")).distinct()
    met = occurs.join(place, ["hash", "check"]).groupBy("_sha").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("_all"))
    met = met.select("_sha", F.transform("_all", lambda x: x["number"]).alias("numbers"))
    return checkpointed(rows.join(met, rows["sha256"] == met["_sha"], "left").drop("_sha"))


def exact_duplicates(df: DataFrame, text: str = "text", bits: int = 64, row: str = "__row") -> DataFrame:
    """For each row: ``doc_id``, its place ``row``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``df`` is an ``identified`` table. Texts are equal if they are so without ASCII white space; NULL is
    the empty text, and all empty texts are one group. The row with the most code points stays, then
    the smallest id (NULL ids last), then the first in its file, so that of repeated rows one is
    kept. Very long texts are chunked in blocks. Other columns are not read; an empty table stays empty.
    """
    on_workers(df.sparkSession)
    chars = F.coalesce(F.length(text), F.lit(0)).cast("long")
    rows = df.select("doc_id", F.col(row), chars.alias("chars"), recipe(F.col(text), bits).alias("_r"))
    rows = _numbered(checkpointed(rows.select("doc_id", row, "chars", "_r.*")))
    lists = F.struct("hashes", F.coalesce("numbers", F.array().cast("array<bigint>")).alias("numbers"))
    rows = rows.withColumn("_lists", lists)
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    groups = rows.groupBy("_lists").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    found = join_groups(rows, checkpointed(groups), "_lists", "group_size")
    return found.select(
        "doc_id", row, F.col("_best.id").alias("keep_id"), "group_size", (F.col("_best.row") == F.col(row)).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, columns unchanged."""
    place = free_name(df, "__row")
    rows = identified(df, place)
    gone = exact_duplicates(rows, text, row=place).where(~F.col("kept"))
    return drop_rows(rows, gone, place)
