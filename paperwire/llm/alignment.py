"""Alignment of two tokenizers by their spans.

Each tokenizer says which characters (the byte-level one) or bytes (the piece one, in its proto) of the text a
token stands for. These spans are the coarse cuts. Tokens inside one character share a span, and of the
tokens of a byte fallback only the last has one; there the decoded bytes of each token give the cut.
Offsets where tokens of both end cut the text into groups; tokens whose bytes overlap are linked.

Both tokenizers begin anew where white space follows other text, so a text is cut there first. Segments are encoded
once for as long as a worker remembers them; the alignment of a text is that of its segments laid end to end.
The pairs of ids that a text links are written, counted over the corpus by Spark, and looked up again in blocks of
bounded size.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import Remembered, checkpointed, forget_at_new_stage, on_workers
from paperwire.session import write_once

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs looked up at once (about 16 bytes each).
BLOCK = 4_000_000
#: Bytes of segments a worker remembers; texts that look for new ones together; longest segment remembered.
MEMORY, TEXTS, LONGEST = 112 << 20, 200, 1024
#: Segments encoded as one text.
JOINED = 4000
#: A run of white space and what follows, up to the next blank or line feed; other white space stays inside.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones are themselves, others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(others)}


def cuts(spans: list[int], pieces: list[bytes], data: bytes) -> list[int] | None:
    """Byte offset at which each token ends, or None if the tokens' bytes are not those of the text.

    ``spans`` are the ends that the library gives. One that fits the token's bytes is the cut; one that does
    not lies at the end of a character of several tokens, and the decoded bytes tell.
    """
    ends, at = [], 0
    for end, piece in zip(spans, pieces):
        if data[at:end] != piece:
            end = at + len(piece)
            if data[at:end] != piece:
                return None
        ends.append(end)
        at = end
    return ends if at == len(data) else None


def walk(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links (places of an A and a B token that overlap) and groups (ends of each in both lists)."""
    links, groups, i, j = [], [], 0, 0
    while i < len(a) and j < len(b):
        links.append((i, j))
        x, y = a_ends[i], b_ends[j]
        i += x <= y
        j += y <= x
        if x == y:
            groups.append((i, j))
    return links, groups


class Aligned:
    """One text or segment: ids and byte ends of both tokenizers, links and groups. ``fits`` is false where bytes differ."""

    def __init__(self, a: list[int], a_ends: list[int] | None, b: list[int], b_ends: list[int] | None):
        self.fits = a_ends is not None and b_ends is not None
        if not self.fits:
            a, b, a_ends, b_ends = [], [], [], []
        self.a, self.a_ends, self.b, self.b_ends = a, a_ends, b, b_ends
        self.links, self.groups = walk(a, a_ends, b, b_ends)

    def text(self) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        out, i, j = [], 0, 0
        for x, y in self.groups:
            out.append(f"{','.join(map(str, self.a[i:x]))}|{','.join(map(str, self.b[j:y]))}")
            i, j = x, y
        return ";".join(out)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_level_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank, self.span = self.b.piece_to_id("▁"), self.b.get_piece_size()
        self.digits = [str(i) for i in range(max(len(self.a_bytes), self.span))]
        ordinary = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        #: Whether no piece goes on over a blank or holds a line feed, so that texts may be cut there.
        self.separable = not any("▁" in p.lstrip("▁") or "\n" in p for p in ordinary)

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """Parts of a text (its leading blank added) that neither tokenizer looks beyond."""
        return SEGMENT.findall(" " + text) if self.separable else [" " + text]

    def _pieces(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids and byte ends of B. It puts a blank before what it encodes: a segment's own, or one too many before a line feed."""
        asked = [s[1:] if s[0] == " " else s for s in segments]
        found = []
        for segment, proto in zip(segments, self.b.encode(asked, return_type="proto", num_threads=1)):
            ids, ends = [p.id for p in proto.pieces], [p.end for p in proto.pieces]
            if segment == " ":
                ids, ends = [self.blank], [1]
            elif segment[0] == " ":
                ends = [e + 1 for e in ends]
            elif ids and ids[0] == self.blank:  # a line feed stands alone, so the blank does too
                ids, ends = ids[1:], ends[1:]
            found.append((ids, ends))
        return found

    def align(self, segments: list[str]) -> list[Aligned]:
        out = []
        for segment, a, (b, b_spans) in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self._pieces(segments)):
            data, ids = segment.encode(), a.ids
            spans = [end for _, end in a.offsets]
            if len(data) != len(segment):
                sizes = [0, *accumulate(len(c.encode()) for c in segment)]
                spans = [sizes[end] for end in spans]
            a_ends = cuts(spans, [self.a_bytes[i] for i in ids], data)
            out.append(Aligned(ids, a_ends, b, cuts(b_spans, [self.b_bytes[i] for i in b], data)))
        return out


@lru_cache(maxsize=1)
def aligner(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Aligner:
    return Aligner(byte_level, pieces)


@lru_cache(maxsize=1)
def _remembered(name: str) -> Remembered:
    return Remembered(MEMORY, LONGEST)


def _byte_ends(ends: list[int], data: str, size: int) -> np.ndarray:
    """Byte offsets of character offsets."""
    if len(data) == size:
        return np.array(ends, np.int64)
    points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.append(0, np.cumsum(width))[ends]


def _refined(spans: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray | None:
    """Byte offset at which each token ends: that of its span, or inside a character that of its decoded bytes.

    None if the cuts do not fit together: every span must end where some token's bytes do.
    """
    decoded = np.cumsum(lengths)
    if not len(decoded) or decoded[-1] != size:
        return None
    same = spans == decoded
    inside = spans[~same]
    if len(inside) and (decoded[np.minimum(np.searchsorted(decoded, inside), len(decoded) - 1)] != inside).any():
        return None
    return np.where(same, spans, decoded)


def _joined(tool: Aligner, segments: list[str], kind: type) -> list[bytes] | None:
    """What ``_encoded`` gives, for segments laid end to end and encoded as one text; None if bytes differ anywhere.

    Each segment but the first begins with white space behind other text, where both tokenizers begin anew.
    """
    data = "".join(segments)
    raw = data.encode()
    a = tool.a.encode(data, add_special_tokens=False)
    ids = a.ids
    proto = tool.b.encode(data[1:] if data[0] == " " else data, return_type="proto")
    found = list(proto.pieces)
    b, b_ends = [p.id for p in found], [p.end for p in found]
    if data[0] != " ":  # the blank that is put before a line feed
        b, b_ends = b[1:], b_ends[1:]
    a_bytes, b_bytes = list(map(tool.a_bytes.__getitem__, ids)), list(map(tool.b_bytes.__getitem__, b))
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    b_spans = np.array(b_ends, np.int64) + (data[0] == " ")
    a_ends = _refined(_byte_ends([end for _, end in a.offsets], data, len(raw)), tool.a_sizes[ids], len(raw))
    b_ends = _refined(b_spans, tool.b_sizes[b], len(raw))
    if a_ends is None or b_ends is None:
        return None
    # Between two neighbouring ends, of either tokenizer, lies one link.
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs
    twice = ends[1:] == ends[:-1]
    ends, both = np.delete(ends, np.flatnonzero(twice)), ends[1:][twice]
    pairs = np.array(ids, np.int64)[np.searchsorted(a_ends, ends)] * tool.span + np.array(b, np.int64)[np.searchsorted(b_ends, ends)]
    pairs = pairs.astype(kind)
    a_text, b_text = list(map(tool.digits.__getitem__, ids)), list(map(tool.digits.__getitem__, b))
    a_cut, b_cut = (np.searchsorted(e, both, "right").tolist() for e in (a_ends, b_ends))
    groups = [
        f"{a_text[i]}|{b_text[j]}" if x - i == 1 == y - j else f"{','.join(a_text[i:x])}|{','.join(b_text[j:y])}"
        for i, x, j, y in zip([0, *a_cut], a_cut, [0, *b_cut], b_cut)
    ]
    # Where each group begins in the text of all of them.
    begins = np.append(0, np.cumsum(np.fromiter(map(len, groups), np.int64, len(groups)) + 1))
    text = ";".join(groups).encode()
    # The ends of the segments are ends of both; what lies between two of them is one segment's.
    edges = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in segments])
    cut = np.array([np.searchsorted(e, edges, "right") for e in (a_ends, b_ends, both, ends)]).T
    numbers = np.diff(cut, axis=0, prepend=0)
    size = pairs.itemsize
    links, places = (np.cumsum(numbers[:, 3]) * size).tolist(), begins[cut[:, 2]].tolist()
    out, l, g = [], 0, 0
    packed, flat = numbers.astype(np.int64).tobytes(), pairs.tobytes()
    for k, (m, h) in enumerate(zip(links, places)):
        out.append(packed[32 * k : 32 * k + 32] + flat[l:m] + text[g : max(h - 1, g)])
        l, g = m, h
    return out


def _encoded(tool: Aligner, segments: list[str], kind: type) -> list[bytes]:
    """Of each segment four numbers (of 8 bytes), the pairs of its links and its groups as text; nothing where the bytes differ."""
    found: dict[str, bytes] = {}
    whole = [s for s in segments if tool.separable and not s[-1].isspace()]
    todo = [whole[at : at + JOINED] for at in range(0, len(whole), JOINED)]
    while todo:
        some = todo.pop()
        made = _joined(tool, some, kind) if len(some) > 8 else None
        if made is not None:
            found.update(zip(some, made))
        elif len(some) > 8:  # some bytes differ: find out where
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    rest = [s for s in segments if s not in found]
    for segment, x in zip(rest, tool.align(rest) if rest else ()):
        numbers = np.array([len(x.a), len(x.b), len(x.groups), len(x.links)], np.int64)
        links = np.array([x.a[i] * tool.span + x.b[j] for i, j in x.links], kind)
        found[segment] = numbers.tobytes() + links.tobytes() + x.text().encode() if x.fits else b""
    return list(map(found.__getitem__, segments))


def aligned_texts(df: DataFrame, text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and ``links``, the pair of ids of each link.

    A pair is one number: the first id times the size of the second vocabulary, plus the second id.
    """
    on_workers(df.sparkSession)
    tool = aligner(byte_level, pieces)
    small = tool.span * len(tool.a_bytes) < 1 << 31

    def encoded(batches):
        tool, name = aligner(byte_level, pieces), uuid.uuid4().hex
        forget_at_new_stage(_remembered.cache_clear)
        known, kind, width = _remembered(name), *((np.int32, 4) if small else (np.int64, 8))
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, TEXTS):
                some = texts[at : at + TEXTS]
                lists = [tool.segments(t.as_py()) if t.is_valid and t.as_py() else [] for t in some]
                found = known.get(lists, lambda segments: _encoded(tool, segments, kind))
                totals, links, ends, digests = np.zeros((len(lists), 4), np.int64), [], [0], []
                for row, segments in enumerate(lists):
                    values = list(map(found.__getitem__, segments))
                    if not values or b"" in values:  # no tokens
                        digests.append("")
                        ends.append(ends[-1])
                        continue
                    numbers = np.frombuffer(b"".join([v[:32] for v in values]), np.int64).reshape(-1, 4)
                    totals[row] = numbers.sum(axis=0)
                    cut = (32 + numbers[:, 3] * width).tolist()
                    links.append(b"".join([v[32:n] for v, n in zip(values, cut)]))
                    ends.append(ends[-1] + int(totals[row, 3]))
                    digests.append(hashlib.sha256(b";".join([v[n:] for v, n in zip(values, cut)])).hexdigest())
                pairs = pa.array(np.frombuffer(b"".join(links), kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(lists)),
                        *(pa.array(totals[:, k]) for k in range(4)),
                        pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )

    rows = df.select("doc_id", F.col(text).alias("text"))
    numbers = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {numbers}, links array<{'int' if small else 'bigint'}>"
    return rows.mapInArrow(encoded, schema)


def pair_counts(rows: DataFrame, span: int) -> DataFrame:
    """``key``, ``n``, ``best``: how many links of ``rows`` hold each pair, and whether it is the most common of its second id."""
    counts = checkpointed(rows.select(F.explode("links").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    counts = counts.withColumn("b", F.col("key") % span)
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))  # a row per id of a vocabulary
    return counts.join(F.broadcast(most), F.col("b") == F.col("_b")).select("key", "n", (F.col("n") == F.col("_most")).alias("best"))


def _looked_up(rows: DataFrame, block: pa.Table) -> DataFrame:
    """Adds to ``n_best`` and ``count_sum`` what the links of each row come to by a block of pairs."""
    held = rows.sparkSession.sparkContext.broadcast(tuple(block.column(c).to_numpy() for c in ("key", "n", "best")))

    @F.arrow_udf("struct<best: bigint, sum: bigint>")
    def sums(lists: pa.Array) -> pa.Array:
        forget_at_new_stage()
        keys, n, best = held.value
        lists = pa.concat_arrays([lists])
        ends = lists.offsets.to_numpy().astype(np.int64)
        asked = lists.values.to_numpy()[ends[0] : ends[-1]]
        at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
        hit = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        found = []
        for values in (hit & best[at], np.where(hit, n[at], 0)) if len(keys) else (hit, hit):
            running = np.append(0, np.cumsum(values, dtype=np.int64))[ends - ends[0]]
            found.append(pa.array(np.diff(running)))
        return pa.StructArray.from_arrays(found, ["best", "sum"])

    made = rows.withColumn("_sums", sums(F.col("links")))
    return made.withColumns({"n_best": F.col("n_best") + F.col("_sums.best"), "count_sum": F.col("count_sum") + F.col("_sums.sum")}).drop("_sums")


def align(df: DataFrame, text: str = "text", block: int = BLOCK, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``doc_id`` and for each row tokens of both, groups, links, and how common its links are over the corpus.

    A NULL or empty text, and one whose tokens' bytes are not its own, has no tokens: zeros and an empty
    digest, and it adds nothing to the counts. Very long texts are aligned segment by segment; repeated rows
    each count; NULL ids stay; an empty table stays empty. Other columns are not read. Texts are read and
    encoded once; their links are written, counted and looked up. The counted pairs are at most the product of
    the vocabularies; ``block`` of them are held at a time, and with more the links are read once for each block.
    """
    rows = write_once(aligned_texts(df, text, byte_level, pieces), "links")
    counts = checkpointed(pair_counts(rows, aligner(byte_level, pieces).span))
    blocks = max(1, -(-counts.count() // block))
    rows = rows.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    for k in range(blocks):
        table = counts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).toArrow().sort_by("key")
        rows = _looked_up(rows, table)
        if k + 1 < blocks:
            rows = write_once(rows, "links")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
