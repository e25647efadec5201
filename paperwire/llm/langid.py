"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. The probability of a word is the sum over
all its segmentations into pieces, found by a forward pass over its bytes; single bytes are pieces too, so every
word has one. Texts are put in lower case, so that shouting does not hide a language. Piece probabilities are learned by expectation maximisation on the word counts of a bounded sample: expected
counts of pieces are worked out per word in tasks and added up by Spark.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import checkpointed, forget_at_new_stage, free_name, identified, on_workers

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: The bound on the sample: rows of each language to learn from, about.
SAMPLE = 3000
#: Rounds of learning, pseudo-count of a piece; bytes of the parts that longer words are learned in.
ROUNDS, SMOOTH, LONGEST = 3, 0.05, 120
#: Words a worker remembers, and their bytes; numbers of the tables worked on at once.
CACHE, CACHE_BYTES, CELLS = 150_000, 24 << 20, 1_000_000
UNDETERMINED = "und"
START = "▁".encode()
STEP = np.uint64(0x100000001B3)


class Pieces:
    """The vocabulary as byte strings; finds them in many words of one length at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = model.is_control, model.is_unknown, model.is_byte, model.is_unused
        names = {model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not any(f(i) for f in skip)}
        self.names = sorted(names | {bytes([b]) for b in range(256)})
        self.size = len(self.names)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array(list(map(len, self.names)))
        for length in sorted(set(lengths.tolist())):
            ids = np.flatnonzero(lengths == length)
            data = np.frombuffer(b"".join(self.names[i] for i in ids), np.uint8).reshape(-1, length)
            for _, hashes in self._runs(data, length):
                pass
            order = np.argsort(hashes[:, 0])
            self.by_length[length] = hashes[order, 0], ids[order]
        self.longest = int(lengths.max())

    @staticmethod
    def _runs(data: np.ndarray, longest: int):
        """Length and hashes of all runs of bytes of that length, by their start."""
        values = data.astype(np.uint64) + np.uint64(1)
        hashes = values
        for length in range(1, min(longest, data.shape[1]) + 1):
            if length > 1:
                hashes = hashes[:, :-1] * STEP + values[:, length - 1 :]
            yield length, hashes

    def edges(self, data: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the piece that starts at each place of each word, or ``size`` where there is none."""
        found = {}
        for length, hashes in self._runs(data, self.longest):
            if length in self.by_length:
                known, ids = self.by_length[length]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                if hit.any():
                    found[length] = np.where(hit, ids[at], self.size)
        return found


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: list[bytes]):
    """Words of each length as a matrix of bytes, with their places in the list."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, CELLS // int(length * min(length, 64)))  # bounds the edges held at once
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), -1)


def log_probabilities(words: list[bytes], model: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """Of each word in each language: the logarithm of the sum over all segmentations.

    ``model`` has a row per piece and a last row of zeros, a column per language.
    """
    vocabulary, out = pieces(path), np.zeros((len(words), model.shape[1]))
    for places, data in _by_length([START + w for w in words]):
        edges, width = vocabulary.edges(data), data.shape[1]
        ahead = {0: np.ones((len(places), model.shape[1]))}
        scale = np.zeros((len(places), model.shape[1]))
        for end in range(1, width + 1):
            total = 0.0
            for length, ids in edges.items():
                if length <= end:
                    total = total + ahead[end - length] * model[ids[:, end - length]]
            ahead[end] = total
            ahead.pop(end - vocabulary.longest, None)
            if end % 16 == 0:  # keep long words within range
                most = np.maximum.reduce(list(ahead.values()))
                scale += np.log(most)
                ahead = {k: v / most for k, v in ahead.items()}
        out[places] = np.log(np.maximum(ahead[width], 1e-300)) + scale
    return out


def parts(word: bytes, most: int = LONGEST) -> list[bytes]:
    """The word with its start mark, a long one in parts of ``most`` bytes or somewhat less, none inside a character."""
    word, at, found = START + word, 0, []
    while len(word) - at > most:
        end = at + most
        while end > at + 1 and word[end] & 0xC0 == 0x80:
            end -= 1
        found.append(word[at:end])
        at = end
    return [*found, word[at:]]


def expected_counts(words: list[bytes], counts: np.ndarray, model: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, by one language's probabilities."""
    vocabulary, used = pieces(path), np.zeros(len(model))
    cut = [parts(w) for w in words]
    counts = np.repeat(counts, list(map(len, cut)))
    for places, data in _by_length([p for some in cut for p in some]):
        edges, width = vocabulary.edges(data), data.shape[1]
        ahead = np.zeros((width + 1, len(places)))
        back = np.zeros((width + 1, len(places)))
        ahead[0] = back[width] = 1
        for end in range(1, width + 1):
            for length, ids in edges.items():
                if length <= end:
                    ahead[end] += ahead[end - length] * model[ids[:, end - length]]
        for start in range(width - 1, -1, -1):
            for length, ids in edges.items():
                if start + length <= width:
                    back[start] += model[ids[:, start]] * back[start + length]
        weight = counts[places] / np.maximum(ahead[width], 1e-300)
        for length, ids in edges.items():
            for start in range(width - length + 1):
                share = ahead[start] * model[ids[:, start]] * back[start + length] * weight
                np.add.at(used, ids[:, start], share)
    used[-1] = 0
    return used


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS, path: str = VOCABULARY):
    """``(languages, model)`` learned from rows with a language and a letter in the text.

    Of each language about ``sample`` rows, chosen by a hash of the row's id and place in its file, are used with
    all their words; fewer rows are all used. The model has as many numbers as pieces times languages, whatever the
    input, and is held by the driver. No labelled rows: no languages.
    """
    on_workers(df.sparkSession)
    place = free_name(df, "__row")
    rows = identified(df, place).where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    own = [F.col(c) for c in ("doc_id",) if c in df.columns]
    rows = rows.select(F.col(lang).alias("lang"), F.lower(text).alias("text"), F.xxhash64(F.lit("sample"), *own, F.col(f"{place}.i")).alias("hash"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], None
    share = F.create_map(*[F.lit(x) for pair in ((k, min(1.0, sample / n)) for k, n in sizes.items()) for x in pair])
    part = F.pmod("hash", F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = rows.where(part < F.element_at(share, F.col("lang"))).select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.where(F.col("word") != "").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = checkpointed(words)
    size = pieces(path).size
    model = np.full((size + 1, len(languages)), 1.0 / size)
    model[-1] = 0

    for _ in range(rounds):
        held = df.sparkSession.sparkContext.broadcast(model)

        def expect(batches, held=held):
            forget_at_new_stage(pieces.cache_clear)
            for batch in batches:
                names, found = np.array(batch.column(0).to_pylist(), object), []
                words = [w.encode() for w in batch.column(1).to_pylist()]
                counts = batch.column(2).to_numpy().astype(float)
                for at, name in enumerate(languages):
                    mine = np.flatnonzero(names == name)
                    if len(mine):
                        used = expected_counts([words[i] for i in mine], counts[mine], held.value[:, at], path)
                        hit = np.flatnonzero(used)
                        found.append((np.full(len(hit), at), hit, used[hit]))
                columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["language", "piece", "used"])

        sums = words.mapInArrow(expect, "language bigint, piece bigint, used double").groupBy("language", "piece").agg(F.sum("used").alias("used"))
        table = sums.toArrow()
        counts = np.full((size + 1, len(languages)), SMOOTH)
        counts[table.column("piece").to_numpy(), table.column("language").to_numpy()] += table.column("used").to_numpy()
        counts[-1] = 0
        model = counts / counts.sum(axis=0)
        held.unpersist()
    return languages, model


def predict(df: DataFrame, languages: list[str], model, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the posterior probability of that language at equal priors.

    Whole texts are scored, also very long ones, a bounded number of new words at a time. ``und`` with score 0 where the text is NULL or has no letter, or no language is
    known. At a tie the first language by name. Columns of these names are replaced; repeated rows
    get the same answer; an empty table stays empty.
    """
    on_workers(df.sparkSession)
    none = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not languages:
        return df.withColumns({c: none[c] for c in ("lang_pred", "score")})
    held, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def scored(texts: pa.Array) -> pa.Array:
        forget_at_new_stage(_remembered.cache_clear)
        forget_at_new_stage(pieces.cache_clear)
        known, rows = _remembered(name)
        best, score, at = [], [], 0
        while at < len(texts):
            new, wanted, held_words = set(), [], 0  # as many texts as bring a bounded number of words
            while at < len(texts) and (not wanted or (len(new) < CACHE // 4 and held_words < CACHE)):
                words = (texts[at].as_py() or b"").split()
                new.update(w for w in words if w not in known)
                wanted.append(words)
                held_words += len(words)
                at += 1
            if len(known) + len(new) > CACHE or sum(map(len, known)) > CACHE_BYTES:
                known.clear()
                rows.clear()
                new = {w for words in wanted for w in words}
            if new:
                new = list(new)
                start = len(known)
                known.update(zip(new, range(start, start + len(new))))
                rows.append(log_probabilities(new, held.value, path))
            table = np.concatenate(rows) if rows else np.zeros((0, len(languages)))
            rows[:] = [table] if len(table) else []
            for words in wanted:
                sums = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best.append(int(sums.argmax()))
                score.append(float(1 / np.exp(sums - sums.max()).sum()))
        return pa.StructArray.from_arrays([pa.array([languages[i] for i in best], pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    found = F.when(has_letter(F.col(text)), scored(F.lower(text).cast("binary"))).otherwise(none)
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(F.struct(*columns).alias("row"), found.alias("found")).select("row.*", "found.*")


@lru_cache(maxsize=1)
def _remembered(model: str) -> tuple[dict[bytes, int], list[np.ndarray]]:
    return {}, []


def held_out(key: Column) -> Column:
    """A third of the rows, by their id, that learning leaves out; NULL ids are not among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
