"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and, of longer words, their beginnings; each is hashed to one of many
buckets. A bucket has a weight and a short vector; the products of the vectors of two terms score the pair, so
an insult beside the mention of a group counts for more than the two apart, which no sum of weights can say.

Follow-the-regularized-leader steps, whose penalty leaves chance words at zero, choose the buckets; their weights
and vectors are then fitted together. The model is fitted on a bounded sample of labelled rows and has a fixed
size; whole texts of all rows are scored in tasks.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire.llm.common import Remembered, checkpointed, forget_at_new_stage, on_workers

#: Buckets, numbers of a vector, letters of a word's beginning.
BUCKETS, FACTORS, BEGINNING = 1 << 18, 4, 5
#: The bound on the sample: labelled rows to learn from, about; up to a quarter of them have the rarer label.
SAMPLE = 16_000
#: Rounds that choose buckets and rounds that fit these; step sizes, penalties, spread of new vectors.
ROUNDS, REFIT, STEP, VECTOR_STEP, LASSO, RIDGE, SPREAD = 6, 20, 0.3, 0.1, 4.0, 1e-4, 0.05
#: Bytes of words a worker remembers; texts that look for new words together.
MEMORY, BLOCK = 48 << 20, 500
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")


def _buckets(word: str, buckets: int) -> bytes:
    found = [zlib.crc32(word.encode("utf-8", "replace")) % buckets]
    if len(word) > BEGINNING:
        found.append(zlib.crc32(f"{word[:BEGINNING]}*".encode("utf-8", "replace")) % buckets)
    return np.array(found, np.int32).tobytes()


def terms_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The distinct buckets of a text's terms, in order."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(np.frombuffer(b"".join(_buckets(w, buckets) for w in words), np.int32))


def terms(text: Column, buckets: int = BUCKETS) -> Column:
    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        forget_at_new_stage()
        return pa.array([terms_of(t.as_py(), buckets) for t in texts], pa.list_(pa.int32()))

    return found(text)


@dataclass
class Machine:
    """Bias, a weight and a vector for each bucket. Without a labelled row: score 0 for all."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, ids: np.ndarray) -> float:
        v = self.vectors[ids]
        total = v.sum(axis=0)
        return self.bias + float(self.weights[ids].sum()) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(ids), -30, 30)))) if np.isfinite(self.bias) else 0.0


def train(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, buckets: int = BUCKETS, factors: int = FACTORS, rounds: int = ROUNDS) -> Machine:
    """Learn from the buckets of each row; ``importance`` is the share of labelled rows it stands for.

    The rows come in the same random order each time, so the same sample gives the same model.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    toxic, total = float(importance @ labels), float(importance.sum())
    if not total:
        return Machine(-np.inf, np.zeros(buckets, np.float32), np.zeros((buckets, factors), np.float32))
    bias, bias_square = np.log((toxic + 1) / (total - toxic + 1)), 1.0

    def slope(margin: float, k: int) -> float:
        return importance[k] * (1 / (1 + np.exp(-min(max(margin, -30), 30))) - labels[k])

    # First the buckets that matter: weights alone, under a penalty that leaves the others at zero.
    weights, z, squares = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            ids = rows[k]
            w = weights[ids]
            g = slope(bias + w.sum(), k)
            bias_square += g * g
            bias -= STEP * g / np.sqrt(bias_square)
            before = squares[ids]
            after = before + g * g
            z[ids] += g - (np.sqrt(after) - np.sqrt(before)) / STEP * w
            squares[ids] = after
            over = np.abs(z[ids]) - LASSO
            weights[ids] = np.where(over > 0, -np.sign(z[ids]) * over / ((1 + np.sqrt(after)) / STEP), 0)
    # Then weights and vectors of these, without the penalty's bias towards zero.
    live = weights != 0
    kept = [ids[live[ids]] for ids in rows]
    vectors = np.where(live[:, None], rng.normal(0, SPREAD, (buckets, factors)), 0)
    steps, vector_steps = np.ones(buckets), np.ones((buckets, factors))
    for _ in range(REFIT):
        for k in rng.permutation(len(rows)):
            ids = kept[k]
            w, v = weights[ids], vectors[ids]
            sums = v.sum(axis=0)
            g = slope(bias + w.sum() + 0.5 * (sums @ sums - (v * v).sum()), k)
            bias_square += g * g
            bias -= STEP * g / np.sqrt(bias_square)
            gw, gv = g + RIDGE * w, g * (sums - v) + RIDGE * v
            steps[ids] += gw * gw
            vector_steps[ids] += gv * gv
            weights[ids] = w - STEP * gw / np.sqrt(steps[ids])
            vectors[ids] = v - VECTOR_STEP * gv / np.sqrt(vector_steps[ids])
    return Machine(float(bias), weights.astype(np.float32), vectors.astype(np.float32))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE, rounds: int = ROUNDS) -> Machine:
    """Learn from rows of ``df`` whose ``doc_id`` has a label 0 or 1 in ``labels``.

    About ``sample`` labelled ids are used, up to a quarter of them with the rarer label, chosen by a hash of
    the id; they count for the ids left out. All ids are used if they are fewer. An id with both labels
    counts as 1; of rows that share an id one is taken. The driver holds the buckets of these rows
    and the model, both of bounded size.
    """
    on_workers(df.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = checkpointed(known)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], np.zeros(0), np.zeros(0), rounds=rounds)
    rare = min(sample // 4, min(counts.values())) if len(counts) == 2 else 0
    quota = {k: rare if len(counts) == 2 and n == min(counts.values()) else sample - rare for k, n in counts.items()}
    share = {k: min(1.0, quota[k] / n) for k, n in counts.items()}
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(part < F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("label")))
    # A bounded number of ids: about ``sample``.
    met = df.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id")
    found = met.select("doc_id", "label", F.xxhash64("_text").alias("_tie"), terms(F.col("_text")).alias("_terms"))
    table = found.groupBy("doc_id").agg(F.min(F.struct("_tie", "label", "_terms")).alias("_row")).orderBy("doc_id").select("_row.label", "_row._terms").toArrow()
    label_of = table.column("label").to_numpy().astype(float)
    rows = [np.asarray(r.values.to_numpy(zero_copy_only=False), np.int64) for chunk in table.column("_terms").chunks for r in chunk]
    weight = np.array([1 / share[int(x)] for x in label_of])
    return train(rows, label_of, weight / weight.mean() if len(weight) else weight, rounds=rounds)


@lru_cache(maxsize=1)
def _remembered(model: str) -> Remembered:
    return Remembered(MEMORY)


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that its text is toxic.

    Whole texts are scored, however long, in lower case. A NULL or empty text has no terms and the score of
    the bias alone. Repeated rows score alike; an empty table stays empty; a column of this name is replaced.
    """
    on_workers(df.sparkSession)
    live = np.flatnonzero(machine.weights)
    held = df.sparkSession.sparkContext.broadcast((machine.bias, len(machine.weights), live, machine.weights[live], machine.vectors[live]))
    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        forget_at_new_stage(_remembered.cache_clear)
        known = _remembered(name)
        bias, buckets, ids, weights, vectors = held.value
        place = np.full(buckets, -1, np.int32)
        place[ids] = np.arange(len(ids))
        small, out = Machine(bias, weights, vectors), []

        def make(words: list[str]) -> list[bytes]:
            """Places of a word's buckets in the model; most words have none."""
            found = (place[np.frombuffer(_buckets(w, buckets), np.int32)] for w in words)
            return [p[p >= 0].tobytes() for p in found]

        for at in range(0, len(texts), BLOCK):
            lists = [set(WORD.findall((t.as_py() or "").lower())) for t in texts[at : at + BLOCK]]
            terms = known.get(lists, make)
            for words in lists:
                out.append(small.score(np.unique(np.frombuffer(b"".join(map(terms.__getitem__, words)), np.int32))))
        return pa.array(out, pa.float64())

    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*columns, scored(F.col(text)).alias(out))


def held_out(key: Column) -> Column:
    """A fifth of the rows, by their id, that learning leaves out; NULL ids are not among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def detect(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row, learned from the rows that are not held out.

    ``labels`` (``doc_id`` and ``label``) is read for learning only. Rows are defined as in ``fit`` and ``score``.
    """
    machine = fit(df.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), text, label)
    rows = score(df.select("doc_id", F.col(text).alias("text")), machine)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
