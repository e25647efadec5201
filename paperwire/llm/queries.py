"""The operators applied to the test tables, in the columns their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.llm import alignment, bpe, exact, langid, licenses, mixing, sharding, simhash, spelling, substring, token_orc, toxicity, vptree
from paperwire.llm.common import identified
from paperwire.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the bytes that decoding gives back, as digests."""
    rows = bpe.with_tokens(documents(spark, sf_dir).select("doc_id", "text"), decoded="decoded")
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = sharding.interleave(rows, ties=("size", "text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_duplicates(identified(documents(spark, sf_dir)))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.neighbours(rows, rows.where(F.col("vec_id") % 100 == 0))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(documents(spark, sf_dir), path)
    return token_orc.positions(spark, path)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is the top folder, a hundred ids share a folder below it."""
    folder = F.expr("doc_id div 10000"), F.expr("doc_id div 100")
    path = F.concat_ws("/", "source", *[x.cast("string") for x in folder], F.col("doc_id").cast("string"))
    rows = documents(spark, sf_dir).select("doc_id", "text", path.alias("path"))
    return licenses.scan(rows)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    languages, model = langid.fit(rows.where(~F.col("held_out")))
    return langid.predict(rows, languages, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_mixing, op3_sharding, op4_simhash, op5_exact, op6_substring, op7_vptree, op8_token_orc, op9_licenses, op10_language,
        op11_toxicity, op12_spelling, op13_alignment,
    )
}
