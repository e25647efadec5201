"""Token ids in ORC files.

Documents lie in id order over files and stripes. Integers are run-length encoded, row indexes hold least and
greatest document id of every few thousand rows and Bloom filters answer for single ids, so a reader skips
files, stripes and row groups by metadata, and reads stripes in parallel.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperwire.llm.common import Remembered, bounded, checkpointed, forget_at_new_stage, on_workers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 1
#: Bytes of a generation of pieces that a worker remembers; texts that look for new ones together.
CACHE, BLOCK = 110 << 20, 2000
# The tokenizer's own cut of lower-case text, in characters before U+0558, where its letters, numbers and white
# space are these; beyond, libraries follow different versions of Unicode.
WHITE, FRACTIONS = r"\t-\r \x85\xa0", "\u00b2\u00b3\u00b9\u00bc-\u00be"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{FRACTIONS}]+|[\d{FRACTIONS}]|(?:[^\w{WHITE}]|_)+"
ONE = re.compile(PATTERN)
# The capital letter that becomes two in lower case, and all that the pattern does not know.
OTHER = re.compile("[\u0130\u0558-\U0010ffff]")
SCHEMA = "doc_id bigint, seq bigint, ids array<int>"
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, last, Remembered(CACHE)


def _special(tokenizer) -> re.Pattern:
    """Finds the tokenizer's special strings."""
    return re.compile("|".join(map(re.escape, (t.content for t in tokenizer.get_added_tokens_decoder().values()))) or r"(?!)")


def _alone(piece: str, special: re.Pattern) -> bool:
    """Whether the tokenizer's own cut leaves the piece whole, so that it has exactly one end."""
    return bool(ONE.fullmatch(piece)) and not OTHER.search(piece) and unicodedata.is_normalized("NFC", piece) and not special.search(piece)


def _pieces_encoded(tokenizer, last: np.ndarray, pieces: list[str]) -> list[bytes]:
    """Ids of each piece. Those that the tokenizer leaves whole are joined to long texts, and taken apart at their ends."""
    special, found = _special(tokenizer), {}
    joined = [p for p in pieces if _alone(p, special)]
    for at in range(0, len(joined), 500):
        some = joined[at : at + 500]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) == len(some):
            data, ends = ids.tobytes(), (ends * 4).tolist()
            found.update((p, data[a:b]) for p, a, b in zip(some, [0, *ends], ends))
    rest = [p for p in pieces if p not in found]
    found.update((p, array("i", e.ids).tobytes()) for p, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
    return [found[p] for p in pieces]


def _numbered(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin, and all words by number: the texts with A to Z in lower case, cut at ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    return parts.offsets.to_numpy(), parts.flatten().dictionary_encode()


def encode(text: Column, path: str = VOCABULARY, end: int = END) -> Column:
    """Ids of the whole text and the end id.

    The tokenizer puts a text in lower case and cuts it into pieces that no token crosses, so pieces are encoded
    apart and remembered. None goes over white space: the words of many texts are counted off first, and each
    different one is cut and put together once for all of them. Where letters are not all of the first alphabets or not in
    composed form, words between ASCII white space take the place of pieces, and a text with one of the tokenizer's
    special strings is encoded whole.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        forget_at_new_stage(_tokenizer.cache_clear)
        tokenizer, last, known = _tokenizer(path)
        special, composed = _special(tokenizer), unicodedata.is_normalized
        words_of, stop, ends, data = re.compile(r"[^\t-\r ]+").findall, array("i", [end]).tobytes(), [np.zeros(1, np.int64)], []

        def plain(text: str) -> bool:
            if special.search(text):
                return False
            return text.isascii() or not OTHER.search(text) and composed("NFC", text) and composed("NFC", text.encode().lower().decode())

        def make(pieces: list[str]) -> list[bytes]:
            return _pieces_encoded(tokenizer, last, pieces)

        for at in range(0, len(texts), BLOCK):
            some = [text or "" for text in texts[at : at + BLOCK].to_pylist()]
            whole = [None if plain(t) else [t] if special.search(t) else words_of(t) for t in some]
            places, words = _numbered([t if w is None else "" for t, w in zip(some, whole)])
            cut = list(map(ONE.findall, words.dictionary.to_pylist()))
            found = known.get(cut + [w for w in whole if w], make)
            odd = [None if w is None else b"".join(map(found.__getitem__, w)) for w in whole]
            values = [found[p[0]] if len(p) == 1 else b"".join(map(found.__getitem__, p)) for p in cut]
            flat = pa.array(values, pa.binary()).take(words.indices)
            sizes = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1]
            bounds = sizes[places].tolist()
            raw = memoryview(flat.buffers()[2] or b"")
            made = [raw[a:b] if o is None else o for o, a, b in zip(odd, bounds, bounds[1:])]
            data += [x for ids in made for x in (ids, stop)]
            ends.append(ends[-1][-1] + np.cumsum([len(ids) // 4 + 1 for ids in made]))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.frombuffer(b"".join(data), np.int32)))

    return ids(text)


def write_tokens(df: DataFrame, path: str, text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Write ``doc_id``, ``seq`` (rising in the order of the files) and ``ids`` in ascending ``doc_id`` order.

    NULL ids come last; equal ids lie in the order of a hash of their texts, repeated rows one after
    another. A NULL or empty text has the end id alone; a very long text is one row, encoded in whole pieces. An empty
    table gives files without rows. Other columns are not written.
    """
    on_workers(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tie"))
    order = [F.col("doc_id").asc_nulls_last(), "_tie"]
    # Ranges are cut before the encoding, which then runs once.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = rows.select("doc_id", F.monotonically_increasing_id().alias("seq"), encode(F.col("_text"), vocabulary, end).alias("ids"))
    made.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Some documents; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def checksum(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        forget_at_new_stage()
        offsets, values = lists.offsets.to_pylist(), lists.values.to_numpy().astype("<u4")
        return pa.array([zlib.crc32(values[a:b].data) for a, b in zip(offsets, offsets[1:])], pa.int64())

    return crc(ids)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, all from the files.

    Starts are distributed prefix sums: along each file, and over the files' sums.
    """
    on_workers(spark)
    rows = read_tokens(spark, path).select("doc_id", "seq", F.size("ids").cast("bigint").alias("n_tokens"), checksum(F.col("ids")).alias("ids_crc32"))
    rows = checkpointed(rows.withColumn("_file", F.expr("shiftright(seq, 33)")))
    files = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = checkpointed(files.select("_file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(bounded(files), "_file").select("doc_id", (F.col("_start") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
