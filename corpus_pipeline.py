"""The corpus pipeline: five stages over documents, each written and read again before the next.

Language identification, exact and near duplicates, mixing, and tokens. The stages change no column; the
last adds the token ids. In all of them a NULL id or source is a value like any other, repeated rows are rows of
their own until the exact duplicates go, very long texts are read whole, an empty table stays empty, and extra
columns are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.llm import bpe, exact, langid, mixing, simhash
from paperwire.llm.common import drop_rows, free_name, identified
from paperwire.session import write_once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own labels and drops those without a language: NULL or empty, or no letter at all.

    Without a label all rows are without a language, and go.
    """
    languages, model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("document"), F.col("text"))
    found = langid.predict(rows, languages, model)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select("document.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays; at a tie the least id, then the first row."""
    return exact.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash, the one with the least id stays; NULL ids come last, then the first row."""
    place = free_name(docs, "__row")
    rows = identified(docs, place)
    found = simhash.near_duplicates(rows, carry=(place,))
    return drop_rows(rows, found.where(F.col(f"keeper.{place}") != F.col(place)), place)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes as often as its target asks for; the document at the cut is cut there."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, in a column ``ids`` of its own (``ids_`` if there is one)."""
    return bpe.with_tokens(docs, ids=free_name(docs, "ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language scores, SimHash and BPE have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
