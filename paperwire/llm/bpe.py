"""Byte-level BPE by prefix dynamic programming.

A text is first split by the pattern. In a piece, every byte prefix has exactly one valid
encoding, so it is enough to keep, for each prefix, the last token of that encoding: a token
that ends there fits if the pair of the prefix's own last token and it is one that merging
would leave as it is. Appending bytes only adds entries; cutting bytes only drops some. This
gives exact appends and lets an edit re-encode no more than the pieces around it.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import Remembered, forget_at_new_stage, on_workers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of a generation of pieces, pairs that a worker remembers; bounds on memory, not on the input.
PIECES, PAIRS = 40 << 20, 200_000
#: Texts that look for new pieces together.
BLOCK = 500
#: The rank of a merge that is not in the vocabulary.
NEVER = 1 << 60
#: A piece is settled once this many characters stand after its start (the longest contraction).
REACH = 3


class Vocabulary:
    """Ranks of tokens; which pairs of neighbours merging would leave alone."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # Finds all tokens in a piece; at each end the longest first. Bytes stand as characters 0 to 255.
        self.finder = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.finder.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = Remembered(PIECES)
        self.edges: dict[int, tuple[list, list] | None] = {}

    def history(self, token: int) -> tuple[list, list] | None:
        """What stands at the left and at the right end of a token while it is merged, from byte to whole.

        Each end is a list of (bytes, rank of the merge that makes it), latest first. None if merging the
        token's bytes does not give it back; such a token never stands in an encoding.
        """
        if token not in self.edges:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = [(parts[0], -1)], [(parts[-1], -1)]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 1:
                    right.append((parts[-1], rank))
            self.edges[token] = (left, right) if len(parts) == 1 else None
        return self.edges[token]

    def alone(self, token: int) -> bool:
        return self.history(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the cut between two tokens: no merge over it ever comes first.

        The left token's right end and the right token's left end change in the order of ranks, the left one
        first at equal ranks; a merge of the two over the cut would come before the next change.
        """
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._kept(left, right)
        return known

    def _kept(self, left: int, right: int) -> bool:
        if not (self.alone(left) and self.alone(right)):
            return False
        ends, starts, i, j = self.history(left)[1], self.history(right)[0], 0, 0
        while True:
            over = self.ranks.get(ends[i][0] + starts[j][0], NEVER)
            next_left = ends[i + 1][1] if i + 1 < len(ends) else NEVER
            next_right = starts[j + 1][1] if j + 1 < len(starts) else NEVER
            if over < next_left and over <= next_right and over < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _token_table(path: str) -> pa.Array:
    """Bytes of each token by id."""
    with open(path, "rb") as lines:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines))
    found = dict(pairs)
    return pa.array([found.get(i) for i in range(pairs[-1][0] + 1)], pa.large_binary())


class Prefixes:
    """The last token of each byte prefix of one piece."""

    def __init__(self, words: Vocabulary, data: bytes = b""):
        self.words, self.data, self.last = words, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: entries that are there stay as they are."""
        words, self.data = self.words, self.data + data
        last, pairs, fits = self.last, words.pairs, words.fits
        done = len(last)
        for end, (token, before) in words.finder.iter(self.data.decode("latin-1"), max(0, done - words.longest)):
            if end == done:  # the first token to fit is the only one
                left = last[end - before - 1] if end > before else None
                if words.alone(token) if left is None else pairs.get(left << 20 | token) or fits(left, token):
                    last.append(token)
                    done += 1

    def cut(self, length: int) -> None:
        del self.last[length:]
        self.data = self.data[:length]

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        if self.data in self.words.ranks:  # a piece that is a token, also one merging does not reach
            return [self.words.ranks[self.data]]
        while end:
            found.append(self.last[end - 1])
            end -= len(self.words.tokens[found[-1]])
        return found[::-1]


class Encoded:
    """A text with the prefix tables of its pieces, for appends and edits."""

    def __init__(self, text: str = "", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        self.words, self.pattern = vocabulary(path), regex.compile(pattern)
        self.text, self.starts, self.tables = "", [], []
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters start to end; the number of pieces split anew.

        Work starts at the first piece that could have seen the edit and ends where the old and
        new cuts meet again, since a cut depends on what follows it alone.
        """
        shift, text = len(new) - (end - start), self.text[:start] + new + self.text[end:]
        first = len(self.starts)
        while first and (
            self.starts[first - 1] + REACH > start or (self.starts[first] if first < len(self.starts) else len(self.text)) >= start
        ):
            first -= 1
        at = self.starts[first] if first < len(self.starts) else len(self.text)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, meet = [], [], len(self.starts)
        while at < len(text):
            if at >= start + len(new) and at in old:
                meet = old[at]
                break
            piece = self.pattern.match(text, at)
            if piece is None:  # no pattern of ours leaves a gap, another's might
                at += 1
                continue
            data, near = piece.group().encode(), first + len(tables)
            table = self.tables[near] if near < len(self.tables) else None
            if table is None or not (same := _common(table.data, data)):
                table = Prefixes(self.words, data)
            else:  # the bytes before the change keep their entries
                kept = Prefixes(self.words)
                kept.data, kept.last = table.data[:same], table.last[:same]
                kept.append(data[same:])
                table = kept
            starts.append(at)
            tables.append(table)
            at = piece.end()
        self.starts[first:] = starts + [s + shift for s in self.starts[meet:]]
        self.tables[first:] = tables + self.tables[meet:]
        self.text = text
        return len(tables)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(t.ids() for t in self.tables))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _ids(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    """Token ids of each text, through the pieces a worker remembers."""
    forget_at_new_stage(vocabulary.cache_clear)
    words, split = vocabulary(path), regex.compile(pattern).findall
    ends, found = [0], []

    def make(pieces: list[str]) -> list[bytes]:
        return [array("i", Prefixes(words, piece.encode()).ids()).tobytes() for piece in pieces]

    for at in range(0, len(texts), BLOCK):
        lists = [split(text.as_py() or "") for text in texts[at : at + BLOCK]]
        known = words.pieces.get(lists, make)
        for pieces in lists:
            found.append(b"".join(map(known.__getitem__, pieces)))
            ends.append(ends[-1] + len(found[-1]) // 4)
    values = np.frombuffer(b"".join(found), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _data(lists: pa.Array, path: str) -> pa.Array:
    """The bytes that each list of ids stands for."""
    if not len(lists):
        return pa.array([], pa.binary())
    lists = pa.concat_arrays([lists])  # offsets from the first list on
    start, ends = lists.offsets[0].as_py(), lists.offsets.to_numpy()
    # Taking the tokens one after another lays their bytes side by side; only the offsets differ.
    taken = _token_table(path).take(lists.values[start : int(ends[-1])])
    places = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    offsets = pa.array(places[ends - start].astype(np.int32)).buffers()[1]
    valid = pa.array(lists.is_valid().to_pylist(), pa.bool_()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, offsets, taken.buffers()[2]])


def encode(text: Column, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of the whole text as ``array<int>``; a NULL or empty text has none.

    Spark merges this into a Python function applied to it, and encodes anew for each use; ``round_trip`` gives
    the ids and their bytes in one pass.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _ids(texts, path, pattern)

    return ids(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The bytes of the ids; NULL for NULL. An id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def data(lists: pa.Array) -> pa.Array:
        forget_at_new_stage(_token_table.cache_clear)
        return _data(lists, path)

    return data(ids)


def round_trip(text: Column, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Struct of ``ids`` and ``decoded``: what ``encode`` gives for the text and ``decode`` for those ids."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _ids(texts, path, pattern)
        forget_at_new_stage(_token_table.cache_clear)
        return pa.StructArray.from_arrays([ids, _data(ids, path)], ["ids", "decoded"])

    return both(text)


def with_tokens(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """``df`` with the token ids of a text column and, if ``decoded`` names a column, the bytes they decode to.

    NULL and empty texts get an empty array and no bytes; a very long text is split like any other and its long
    pieces are not remembered; columns of these names are replaced; repeated rows are each encoded; an
    empty table stays empty.
    """
    on_workers(df.sparkSession)
    if decoded is None:
        return df.withColumn(ids, encode(F.col(text), path))
    made = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), round_trip(F.col(text), path).alias("made"))
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in (ids, decoded)]
    return made.select(*kept, F.col("made.ids").alias(ids), F.col("made.decoded").alias(decoded))
