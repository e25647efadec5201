"""Spelling variants by a frequency-vector trie.

A word's vector holds how many of its letters fall into each of a few groups of letters. One letter more adds one to
one count, one less takes one away, a letter replaced does both at most. Words are arranged in a trie by their
successive counts; a search goes depth first along the counts of a word and may spend one surplus and one
deficit, and the words of the leaves it reaches are verified letter by letter.

The trie is dealt out by its first levels: a word is held by the node of its own first counts, and is looked for
in the nodes within the budget that come after its own, so each pair of words meets once. A node with many
words is cut into chunks by a hash, and a search visits all of them. Words to look for are streamed past a
chunk, so memory is bounded by the chunk.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import bounded, checkpointed, forget_at_new_stage, on_workers

#: Letter groups, and how many of them deal the trie out; words of a chunk.
GROUPS, LEVELS, CHUNK = 10, 4, 20_000
#: Shortest word and least occurrences; how many times a word's a form must occur.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One of so many words of a document is misspelt on purpose.
EVERY = 199
#: Distinct words that a task counts before it hands them on; bytes of words compared at once.
HELD, WIDTH, PAIRS = 200_000, 64, 100_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def misspelt(prefix: int, run: str, every: int = EVERY) -> str:
    """The run, or without one letter if ``every`` divides its hash; ``prefix`` is the CRC-32 of what comes before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(df: DataFrame, text: str = "text", every: int = EVERY, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """``word``, ``n``: words of ``letters`` code points that occur ``least`` times, over all rows.

    Whole texts are read. A NULL text has no words; a NULL id stands as ``null`` before its words.
    """
    on_workers(df.sparkSession)

    def counted(batches):
        forget_at_new_stage()
        sums: Counter[str] = Counter()

        def given():
            made = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                small = (text.as_py() or b"").lower().decode()  # on bytes: A-Z alone
                doc = doc.as_py()
                prefix = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for run, n in Counter(RUN.findall(small)).items():
                    word = misspelt(prefix, run, every)
                    if len(word) >= letters:
                        sums[word] += n
                if len(sums) >= HELD:
                    yield given()
        if sums:
            yield given()

    rows = df.select("doc_id", F.col(text).cast("binary").alias("text")).mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vectors(found: list[str], groups: int = GROUPS) -> np.ndarray:
    """Letters of each word in each group; a letter's group is its code point's remainder."""
    letters = np.frombuffer("".join(found).encode("latin-1"), np.uint8) % groups
    row = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    return np.bincount(row * groups + letters, minlength=len(found) * groups).reshape(-1, groups)


def _packed(counts: np.ndarray) -> np.ndarray:
    """One number for the first counts; counts far apart may share one, neighbours never do."""
    key, bits = np.zeros(len(counts), np.int64), 60 // counts.shape[1]
    for level in range(counts.shape[1]):
        key = key << bits | counts[:, level] & (1 << bits) - 1
    return key


def _routed(levels: int, groups: int):
    steps = np.array([s for s in product((0, 1, -1), repeat=levels) if s.count(1) <= 1 and s.count(-1) <= 1])

    def routed(batches):
        """Of each word: a row of kind 0 for its own node, 2 to look in it, 1 to look in each later node in reach."""
        forget_at_new_stage()
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                counts = vectors(part.column(0).to_pylist(), groups)[:, :levels]
                own, places, keys, kinds = _packed(counts), [], [], []
                everything = np.arange(len(own))
                for kind in (0, 2):
                    places.append(everything)
                    keys.append(own)
                    kinds.append(np.full(len(own), kind))
                for step in steps[1:]:
                    near = counts + step
                    key = _packed(near)
                    hit = np.flatnonzero((near >= 0).all(axis=1) & (key > own))
                    places.append(hit)
                    keys.append(key[hit])
                    kinds.append(np.ones(len(hit), np.int64))
                place = pa.array(np.concatenate(places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds), pa.int32()), part.column(0).take(place), part.column(1).take(place)],
                    ["node", "kind", "word", "n"],
                )

    return routed


class Leaves:
    """Words as bytes from both ends, for comparing many pairs at once."""

    def __init__(self, found: list[str]):
        self.words = found
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        short = [w.encode("latin-1") if len(w) <= WIDTH else b"" for w in found]
        self.left = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)
        self.right = np.frombuffer(b"".join(w.rjust(WIDTH, b"\0") for w in short), np.uint8).reshape(-1, WIDTH)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point was inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def verified(one: Leaves, other: Leaves, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of places, whether the words are one edit apart: their common ends leave one letter at most."""
    la, lb = one.lengths[i], other.lengths[j]
    out = np.zeros(len(i), bool)
    short = np.flatnonzero((la <= WIDTH) & (lb <= WIDTH) & (np.abs(la - lb) <= 1))
    for at in range(0, len(short), PAIRS):
        some = short[at : at + PAIRS]
        a, b, most = i[some], j[some], np.maximum(la[some], lb[some])
        differ = one.left[a] != other.left[b]
        head = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        differ = (one.right[a] != other.right[b])[:, ::-1]
        tail = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        out[some] = (head < most) & (head + tail >= most - 1)
    for k in np.flatnonzero((la > WIDTH) | (lb > WIDTH)):
        out[k] = one_edit(one.words[i[k]], other.words[j[k]])
    return out


class Trie:
    """Words in the order of their vectors: a node is a range of rows that share their first counts."""

    def __init__(self, found: list[str], groups: int = GROUPS):
        counts = vectors(found, groups)
        order = np.lexsort(counts.T[::-1])
        self.order, self.counts, self.groups = order, counts[order], groups
        self.leaves = Leaves(found)

    def search(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a word, place of a vector) whose counts agree but for one surplus and one deficit.

        Depth first; the vectors that have not spent their budget go down the trie together.
        """
        words, asks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def down(level: int, low: int, high: int, ask: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
            if (high - low) * len(ask) <= 256 and level < self.groups:  # few: the rest of the levels at once
                gap = self.counts[low:high, None, level:] - counts[None, ask, level:]
                over = np.where(gap > 0, gap, 0).sum(axis=2) + surplus
                under = np.where(gap < 0, -gap, 0).sum(axis=2) + deficit
                word, at = np.nonzero((over <= 1) & (under <= 1))
                words.append(word + low)
                asks.append(ask[at])
                return
            if level == self.groups:
                words.append(np.repeat(np.arange(low, high), len(ask)))
                asks.append(np.tile(ask, high - low))
                return
            column, wanted = self.counts[low:high, level], counts[ask, level]
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
            for start, end in zip(edges, edges[1:]):
                gap = column[start] - wanted
                over, under = surplus + (gap == 1), deficit + (gap == -1)
                go = np.flatnonzero((np.abs(gap) <= 1) & (over <= 1) & (under <= 1))
                if len(go):
                    down(level + 1, low + start, low + end, ask[go], over[go], under[go])

        if len(self.counts) and len(counts):
            none = np.zeros(len(counts), np.int64)
            down(0, 0, len(self.counts), np.arange(len(counts)), none, none)
        return self.order[np.concatenate(words)], np.concatenate(asks)


def _best(place: np.ndarray, near: np.ndarray, words: list[str], others: list[str], n: np.ndarray) -> tuple[list, list, list, list]:
    """For each place its near words: how many, and the one of largest ``n``, then least in order."""
    rank = np.empty(len(others), np.int64)
    rank[sorted(range(len(others)), key=lambda k: (-n[k], others[k]))] = np.arange(len(others))
    order = np.lexsort((rank[near], place))
    place, near = place[order], near[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    best, count = near[first], np.diff(first, append=len(place))
    return [words[k] for k in place[first]], count.tolist(), n[best].tolist(), [others[k] for k in best]


def _met(groups: int):
    def met(batches):
        """Rows sorted by node, chunk and kind: the words of a chunk, then those to look for."""
        forget_at_new_stage()
        here, held, sizes, trie = None, [], [], None
        for batch in batches:
            node, chunk, kind = (batch.column(k).to_numpy() for k in range(3))
            edges = np.flatnonzero((np.diff(node) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(node)]):
                if start == end:
                    continue
                found, n = batch.column(3).slice(start, end - start).to_pylist(), batch.column(4).slice(start, end - start).to_numpy()
                if here != (at := (node[start], chunk[start])):
                    here, held, sizes, trie = at, [], [], None
                if kind[start] == 0:
                    held += found
                    sizes.append(n)
                    continue
                if not held:
                    continue
                if trie is None:
                    trie, sizes = Trie(held, groups), np.concatenate(sizes)
                for low in range(0, len(found), 4000):
                    asks, counts = found[low : low + 4000], n[low : low + 4000]
                    word, ask = trie.search(vectors(asks, groups))
                    hit = verified(trie.leaves, Leaves(asks), word, ask)
                    word, ask = word[hit], ask[hit]
                    if kind[start] == 2:  # both words are looked for in their own node: once is enough
                        later = np.fromiter((asks[a] < held[w] for w, a in zip(word, ask)), bool, len(word))
                        word, ask = word[later], ask[later]
                    if not len(word):
                        continue
                    sides = _best(ask, word, asks, held, sizes), _best(word, ask, held, asks, counts)
                    columns = [a + b for a, b in zip(*sides)]
                    kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])

    return met


def neighbours(found: DataFrame, levels: int = LEVELS, groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """``word``, ``n_near``, ``best`` and ``best_n`` of each distinct word (``word``, ``n``) that has a word one edit away.

    Letters are U+0001 to U+00FF. Every such pair is found, whatever the size of a node.
    """
    on_workers(found.sparkSession)
    routes = found.select("word", "n").mapInArrow(_routed(levels, groups), "node bigint, kind int, word string, n bigint")
    routes = checkpointed(routes)
    nodes = routes.where("kind = 0").groupBy(F.col("node").alias("_node")).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("_chunks"))
    nodes = bounded(checkpointed(nodes))
    part = F.pmod(F.xxhash64("word"), F.col("_chunks")).cast("int")
    parts = F.when(F.col("kind") == 0, F.array(part)).otherwise(F.sequence(F.lit(0), F.col("_chunks") - 1))
    dealt = routes.join(nodes, F.col("node") == F.col("_node")).select("node", F.explode(parts).alias("chunk"), "kind", "word", "n")
    dealt = dealt.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "kind")
    pairs = dealt.mapInArrow(_met(groups), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    sums = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return sums.select("word", "n_near", F.col("_best.word").alias("best"), (-F.col("_best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the forms (``word``, ``form``) lead in the end.

    Steps double each round. Counts grow along a chain, so it has no ring and no more steps than the
    logarithm of the largest count.
    """
    rows = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        rows = checkpointed(rows.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        more = not rows.where(F.col("_next").isNotNull()).isEmpty()
        rows = rows.drop("_next")
        if not more:
            return rows


def variants(df: DataFrame, text: str = "text", times: int = TIMES, **options) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of each word of all texts that is frequent enough.

    A word's form is the near word of largest ``n``, if that is ``times`` its own; the least in code-point order at a
    tie. NULL and empty texts have no words; NULL ids are alike; very long texts are read whole and very long words
    compared one by one; repeated rows count each time; an empty table gives none. Other columns are not read.
    """
    found = checkpointed(words(df, text, **options))
    near = neighbours(found)
    rows = found.join(near, "word", "left")
    fits = F.col("best_n") >= times * F.col("n")
    rows = checkpointed(
        rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    )
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
