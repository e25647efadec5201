"""Removal of repeated passages: seed and extend.

Seeds are winnowed: of every window of ``length`` words, the run of ``SEED`` words with the least hash, so
any two equal windows share the seed at the same offset. The windows of one seed in a row form a stretch, which
is the seed extended both ways as far as it is the seed of a window. Rows whose stretches are equal as
wholes are told apart by id at once. Where a seed has several stretches they are extended step by step: each
window is the seed with some words on its left and the rest on its right, and windows that agree in all
of them meet by a hash of 96 bits. Windows that follow one another join to the maximal repeat. No pair
of rows is ever listed, so the work is linear in the words, however many rows share a passage.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed, forget_at_new_stage, on_workers, parted
from paperwire.session import write_once

#: Words of a window that must repeat; words of a seed.
LENGTH, SEED = 50, 8
#: Odd multipliers of the two rolling hashes, and words a worker remembers.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CACHE = 250_000
#: Bits of a sorting key that hold the place in the text, for texts of up to 2^30 words.
PLACE = 30


@lru_cache(maxsize=1)
def _words() -> dict[bytes, bytes]:
    return {}


def _hashed(words: list[bytes]) -> np.ndarray:
    """Two hashes of each word, in columns."""
    known = _words()
    new = set(words).difference(known)
    if len(known) + len(new) > CACHE:
        known.clear()
        new = set(words)
    known.update((w, xxhash.xxh3_128_digest(w)) for w in new)
    return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(-1, 2)


@lru_cache(maxsize=8)
def _powers(factor: int, size: int) -> np.ndarray:
    powers = np.full(size, factor, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class Rolling:
    """Hash of any run of words: sums of word hashes times powers, taken apart again by inverses."""

    def __init__(self, hashes: np.ndarray, which: int):
        size = 1 << max(10, (len(hashes) + 1).bit_length())
        factor = FACTORS[which]
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes[:, which] * _powers(factor, size)[: len(hashes)], out=self.sums[1:])
        self.back = _powers(pow(factor, -1, 1 << 64), size)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def stretches(words: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Of each seed: first and last window, the seed's hash, and the hash of all words of these windows."""
    n = len(words) - length + 1
    one = Rolling(_hashed(words), 0)
    at = np.arange(len(words) - seed + 1)
    grams = one.runs(at, at + seed)
    low = np.uint64((1 << PLACE) - 1)
    least, width, span = (grams & ~low) | at.astype(np.uint64), 1, length - seed + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    places = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], n) - 1
    ends, shape = last + length, (places[first] - first).astype(np.uint64)
    # The offset of the seed is part of the stretch.
    return first, last, grams[places[first]], one.runs(first, ends) + shape * np.uint64(FACTORS[0])


def _text_words(text) -> list[bytes]:
    return (text.as_py() or b"").split()


def seeds(text: Column, length: int = LENGTH, seed: int = SEED) -> Column:
    """The stretches of the whole text; ``span`` is the first window and, in the low half, the last."""
    kind = "array<struct<seed: bigint, stretch: bigint, span: bigint>>"

    @F.arrow_udf(kind)
    def found(texts: pa.Array) -> pa.Array:
        forget_at_new_stage(_words.cache_clear)
        columns, ends = [[np.empty(0, np.int64)] for _ in range(3)], [0]
        for text in texts:
            words = _text_words(text)
            if len(words) < length:
                ends.append(ends[-1])
                continue
            first, last, gram, whole = stretches(words, length, seed)
            for column, values in zip(columns, (gram.view(np.int64), whole.view(np.int64), first << 32 | last)):
                column.append(values)
            ends.append(ends[-1] + len(first))
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["seed", "stretch", "span"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return found(text.cast("binary"))


def windows(text: Column, spans: Column, length: int = LENGTH) -> Column:
    """Of each window within the spans ``hash``, and ``rest``: 32 more bits of hash above its place."""
    kind = "array<struct<hash: bigint, rest: bigint>>"

    @F.arrow_udf(kind)
    def found(texts: pa.Array, lists: pa.Array) -> pa.Array:
        forget_at_new_stage(_words.cache_clear)
        hashes, rests, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
        for text, some in zip(texts, lists):
            words = _hashed(_text_words(text))
            at = np.concatenate([np.arange(s >> 32, (s & 0xFFFFFFFF) + 1) for s in some.as_py()])
            hashes.append(Rolling(words, 0).runs(at, at + length).view(np.int64))
            more = Rolling(words, 1).runs(at, at + length) & np.uint64(0xFFFFFFFF << 32)
            rests.append(more.view(np.int64) | at)
            ends.append(ends[-1] + len(at))
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(rests))], ["hash", "rest"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return found(text.cast("binary"), spans)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """A row is known by its id and text; NULL ids come after all others, and are alike."""
    return df.select(
        F.col("doc_id"), F.col(text).alias("_text"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64(text).alias("_hash")
    )


def repeats(df: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``_id``, ``_hash``, ``spans``: for each row with any, the windows that a smaller id holds too."""
    on_workers(df.sparkSession)
    rows = _keyed(df, text)
    found = rows.select("_id", "_hash", F.explode(seeds(F.col("_text"), length, seed)).alias("_s"))
    found = write_once(found.select("_id", "_hash", "_s.*"), "stretches")
    # One row for each different stretch of a seed, with the least and greatest id that has it.
    kinds = found.groupBy("seed", "stretch").agg(F.min("_id").alias("least"), F.max("_id").alias("most"))
    kinds = kinds.repartition("seed")
    several = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seed", F.lit(True).alias("several"))
    kinds = kinds.join(several, "seed", "left").where("several or least < most")
    kinds = checkpointed(kinds.select("seed", "stretch", "least", F.coalesce("several", F.lit(False)).alias("several")))
    met = checkpointed(found.join(kinds, ["seed", "stretch"]).where("_id > least or several").select("_id", "_hash", "span", "least"))
    whole = met.where("_id > least").select("_id", "_hash", "span")
    # The least id of a stretch stands for it where other stretches of the seed may hold some of its windows.
    ask = met.where("_id = least").groupBy("_id", "_hash").agg(F.collect_set("span").alias("spans"))
    ask = checkpointed(ask)
    read, _ = parted(rows, ask, ["_id", "_hash"])
    asked = read.join(ask.hint("shuffle_hash"), ["_id", "_hash"])
    held = asked.select("_id", "_hash", F.explode(windows(F.col("_text"), F.col("spans"), length)).alias("_w"))
    held = write_once(held.select("_id", "_hash", "_w.*"), "windows")
    window = [F.col("hash"), F.expr("shiftright(rest, 32)").alias("more")]
    least = held.groupBy(*window).agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most")
    part = held.select("_id", "_hash", *window, F.expr("rest & 4294967295").alias("at"))
    part = part.join(least.drop("most"), ["hash", "more"]).where("_id > least")
    part = part.select("_id", "_hash", F.expr("shiftleft(at, 32) + at").alias("span"))
    return whole.union(part).groupBy("_id", "_hash").agg(F.collect_set("span").alias("spans"))


def cut_repeats(text: Column, spans: Column, length: int = LENGTH) -> Column:
    """Struct of ``n_words``, ``n_removed``, ``spans`` of words cut (start, end) and ``kept``, the words left."""
    kind = "struct<n_words: bigint, n_removed: bigint, cut: array<array<int>>, kept: binary>"

    @F.arrow_udf(kind)
    def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
        forget_at_new_stage()
        rows = []
        for text, some in zip(texts, lists):
            words = _text_words(text)
            spans, cut = some.as_py() or [], []
            if spans:
                edge = np.zeros(len(words) + 1, np.int32)
                ends = np.array(spans, np.int64)
                np.add.at(edge, ends >> 32, 1)
                np.add.at(edge, (ends & 0xFFFFFFFF) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                steps = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                cut = steps.reshape(-1, 2).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            else:
                kept = b" ".join(words)
            rows.append((len(words), sum(b - a for a, b in cut), cut, kept))
        n, removed, cut, kept = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary())],
            ["n_words", "n_removed", "cut", "kept"],
        )

    return made(text.cast("binary"), spans)


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id`` and for each row ``n_words``, ``n_removed``, ``cut`` (maximal repeats) and ``kept`` (bytes of the words left).

    A word goes if a window over it also starts in a row with a smaller id; all is judged on the input. NULL
    counts as no words; NULL ids come last and do not take from each other; repeated ids do not either.
    Texts shorter than a window are never cut; very long ones are hashed in one piece of up to 2^30 words; an empty
    table stays empty. Windows are equal if 96 bits of their hash are, stretches if 64 bits and the seed's are: a
    bound on error far below that of the hardware, not a comparison of words. A text passes the
    shuffle only if it may have something to cut, at every size. Other columns are not read.
    """
    found = checkpointed(repeats(df, text, length, seed))
    maybe, plain = parted(_keyed(df, text), found, ["_id", "_hash"])
    plain = plain.withColumn("spans", F.lit(None).cast("array<bigint>"))
    rows = plain.unionByName(maybe.join(found.hint("shuffle_hash"), ["_id", "_hash"], "left").select(plain.columns))
    return rows.select("doc_id", cut_repeats(F.col("_text"), F.col("spans"), length).alias("_c")).select("doc_id", "_c.*")
