"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are gathered once each. A tile holds those with the same population counts in each
of a few bands of bits; two fingerprints within the radius differ in population by the radius at
most, summed over the bands, so tiles whose counts differ by more are never compared. The other
pairs of tiles are compared whole, by exclusive-or and bit counts in numpy, in chunks of bounded size. A pair of
chunks gives a spanning forest of its links, which keeps components and is linear in the chunk.
"""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed, forget_at_new_stage, join_groups, on_workers
from paperwire.llm.components import components

SHINGLE, RADIUS, HASH_SEED = 3, 3, 42
#: Bands of bits with a population count of their own; fingerprints in a chunk of a tile, about.
BANDS, CHUNK = 4, 1024


def fingerprint_of(data: bytes, words: int = SHINGLE) -> int:
    """Bit set if set in over half the hashes of the text's shingles; 0 without words."""
    found = data.lower().split()  # on bytes: A-Z and ASCII white space alone
    if not found:
        return 0
    joined, lengths = b" ".join(found), list(map(len, found))
    ends = [x + i for i, x in enumerate(accumulate(lengths))]
    digest, size = xxhash.xxh64_digest, min(words, len(found))
    starts = (0, *(x + 1 for x in ends))
    hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[size - 1 :])]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        block = np.frombuffer(b"".join(hashes[i : i + (1 << 16)]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, words: int = SHINGLE) -> Column:
    """64-bit fingerprint of the whole text, as a signed ``bigint``; NULL counts as empty."""

    @F.arrow_udf("bigint")
    def found(texts: pa.Array) -> pa.Array:
        forget_at_new_stage()
        values = np.array([fingerprint_of(t.as_py() or b"", words) for t in texts], np.uint64)
        return pa.array(values.view(np.int64))

    return found(text.cast("binary"))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links, when they are more than the nodes."""
    if len(i) <= n:
        return i, j
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            nodes = np.flatnonzero(label != np.arange(n))
            return nodes, label[nodes]


def links_of(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of two chunks, or within one, reduced to a forest."""
    own = b is None
    b = a if own else b
    rows, columns = [], []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius)
        i = i + at
        if own:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        columns.append(j + (0 if own else len(a)))
    i, j = _forest(np.concatenate(rows), np.concatenate(columns), len(a) + (0 if own else len(b)))
    nodes = a if own else np.concatenate([a, b])
    return nodes[i], nodes[j]


def links(prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, chunk: int = CHUNK) -> DataFrame:
    """``u``, ``v``: links between distinct fingerprints (column ``fp``), enough for all components.

    The radius must be below the width of a band. Every pair within the radius is compared.
    """
    on_workers(prints.sparkSession)
    width = 64 // bands
    counts = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {width * k}) & {(1 << width) - 1}L")).cast("int") for k in range(bands)]
    base = width + 1
    tile = sum((c * base**k for k, c in enumerate(counts)), F.lit(0).cast("long"))
    rows = prints.select("fp", F.array(*counts).alias("counts"), tile.alias("tile"))
    rows = checkpointed(rows)
    full = rows.groupBy("tile", "counts").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    full = checkpointed(full)
    # Only tiles beyond one chunk are cut; the cut is a function of the fingerprint.
    cut = rows.join(full.select("tile", "chunks"), "tile")
    chunks = cut.groupBy("tile", "counts", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk")).agg(
        F.collect_list("fp").alias("fps")
    )
    chunks = checkpointed(chunks)
    # Of every two opposite steps between tiles one is enough.
    steps = [s for s in product(range(-radius, radius + 1), repeat=bands) if sum(map(abs, s)) <= radius and s >= (0,) * bands]
    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]))
    near = chunks.select("tile", "counts", "chunk").withColumn("step", step)
    near = near.withColumn("other", F.zip_with("counts", "step", lambda x, y: x + y))
    near = near.where(F.forall("other", lambda x: (x >= 0) & (x <= width)))
    other_tile = sum((F.col("other")[k] * base**k for k in range(bands)), F.lit(0).cast("long"))
    near = near.select(F.col("tile").alias("a"), F.col("chunk").alias("ca"), other_tile.alias("b"))
    there = chunks.select(F.col("tile").alias("b"), F.col("chunk").alias("cb"))
    pairs = near.join(there, "b").where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
    left = chunks.select(F.col("tile").alias("a"), F.col("chunk").alias("ca"), F.col("fps").alias("left"))
    right = chunks.select(F.col("tile").alias("b"), F.col("chunk").alias("cb"), F.col("fps").alias("right"))
    both = pairs.join(left, ["a", "ca"]).join(right, ["b", "cb"])
    own = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
    both = both.select("left", F.when(~own, F.col("right")).alias("right"))

    def compare(batches):
        forget_at_new_stage()
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for one, other in zip(batch.column(0), batch.column(1)):
                a = one.values.to_numpy().view(np.uint64)
                b = other.values.to_numpy().view(np.uint64) if other.is_valid else None
                u, v = links_of(a, b, radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return both.mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(df: DataFrame, text: str = "text", words: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id``, the columns ``carry`` and ``keeper``.

    ``component_id`` is the least ``doc_id`` reachable over links of ``radius`` bits; ``keeper`` the least
    struct of (id is NULL, id, carried columns) among them. NULL and empty texts have
    fingerprint 0 and are linked like any other. NULL ids come last; a component of NULL ids has a NULL id.
    Repeated rows share their component. An empty table stays empty. Other columns are not read.
    """
    on_workers(df.sparkSession)
    rows = df.select("doc_id", *carry, fingerprint(F.col(text), words).alias("fp"))
    rows = checkpointed(rows)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), *carry)).alias("keeper")
    nodes = checkpointed(rows.groupBy("fp").agg(least, F.count(F.lit(1)).alias("_size")))
    roots = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = checkpointed(nodes.drop("node"))
    whole = nodes.groupBy("root").agg(F.min("keeper").alias("keeper"), F.count(F.lit(1)).alias("_prints"))
    few = checkpointed(join_groups(nodes.select("fp", "_size", "root"), checkpointed(whole), "root", "_prints"))
    found = join_groups(rows, few.select("fp", "_size", "keeper"), "fp", "_size")
    print_text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", print_text.alias("fingerprint"), F.col("keeper.id").alias("component_id"), "keeper", *carry)
