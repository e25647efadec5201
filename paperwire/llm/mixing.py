"""Mixing sources to target weights.

Rows of a source are put in the order of a hash-random key. Key ranges are summed apart,
their sums are added up along the source, and the range in which the source's budget ends is
sorted, so that the cut is exact to the word. A budget above the size of the source takes whole
epochs first. The cut is one row per source, and what a row gives follows from its key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperwire.llm.common import WORD, bounded, checkpointed, key_digits, shuffle_key

#: Weights by rank of the source, repeating; the share of all words to take; most repeats of a source.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target of each source from its size: shares by weight, none above ``repeats`` times its size.

    The excess of sources at their limit goes to the others by weight, again and again. In the
    order of size per weight the sources at their limit come first, so one pass finds the level
    at which it ends. One row per source passes a single task.
    """
    order = Window.orderBy(F.col("source").isNotNull().cast("int").desc(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("_limit", repeats * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_limit") / F.col("weight"))
    along = Window.orderBy("_ratio", F.col("source").isNotNull().cast("int").desc(), "source")
    before, everything = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("_level", level).withColumn("_at", F.row_number().over(along))
    free = F.when(F.col("_ratio") > F.col("_level"), F.struct("_at", "_level"))
    final = F.min(free).over(everything)["_level"]
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("weight") * final, F.col("_limit").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the place of a row in the random order; rows that agree in it are alike to the mix."""
    return rows.withColumn("_key", shuffle_key(F.col("doc_id"), seed)).withColumn(
        "_place", F.struct("_key", F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "size")
    )


def plan(rows: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per source: size, target, whole epochs, and where the last, partial epoch ends.

    ``rows`` has ``doc_id``, ``source`` and ``size`` and is read three times: checkpoint it.
    """
    rows = _ordered(rows, seed).withColumn("_bucket", F.substring("_key", 1, key_digits(rows.sparkSession)))
    parts = checkpointed(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")))
    sources = targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), **options)
    budget = F.floor(F.col("target") + 0.5)
    size = F.greatest("source_size", F.lit(1))
    sources = checkpointed(
        sources.withColumn("epochs", F.floor(budget / size)).withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
    )
    # The range of keys where the rest ends.
    running = F.coalesce(F.sum("_words").over(_before("source", "_bucket")), F.lit(0))
    ends = parts.withColumn("_start", running).withColumnRenamed("source", "_source")
    ends = ends.join(bounded(sources), F.col("_source").eqNullSafe(F.col("source"))).where(
        (F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_words")) & (F.col("_rest") > 0)
    )
    ends = bounded(checkpointed(ends.select("_source", F.col("_bucket").alias("_end"), "_start", "_rest")))
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_end")))
    alike = inside.groupBy("source", "_place", "_start", "_rest").agg(F.count(F.lit(1)).alias("_alike"))
    alike = alike.withColumn("_from", F.col("_start") + F.coalesce(F.sum(F.col("_alike") * F.col("_place.size")).over(_before("source", "_place")), F.lit(0)))
    cut = alike.where(
        (F.col("_from") <= F.col("_rest")) & (F.col("_rest") < F.col("_from") + F.col("_alike") * F.col("_place.size"))
    ).select(F.col("source").alias("_source"), F.col("_place").alias("cut"), F.expr("(_rest - _from) div _alike").alias("part"))
    return checkpointed(
        sources.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "epochs", "cut", "part")
    )


def _before(part: str, order: str):
    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _joined(rows: DataFrame, made: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan; ``_extra``: words of the last epoch, ``_whole``: all of them."""
    made = bounded(made.withColumnRenamed("source", "_source"))
    rows = _ordered(rows, seed).join(made, F.col("source").eqNullSafe(F.col("_source")))
    early = F.coalesce(F.col("_place") < F.col("cut"), F.lit(False))
    at = F.coalesce(F.col("_place") == F.col("cut"), F.lit(False))
    extra = F.when(early, F.col("size")).when(at, F.col("part")).otherwise(F.lit(0))
    return rows.withColumn("_extra", extra).withColumn("_whole", early)


def mix(df: DataFrame, text: str = "text", seed: int = SEED, **options) -> DataFrame:
    """How many words each row of ``doc_id``, ``source`` and a text column gives to the mix.

    The order depends on ``doc_id`` alone, so reruns agree. The row at the cut gives the words
    that are missing, and rows alike in id and size share them evenly. A NULL or empty text has size 0 and
    gives nothing; NULL is a source of its own; NULL ids are alike; the words of a very long text are all counted; an
    empty table stays empty. Other columns are not read.
    """
    rows = checkpointed(df.select("doc_id", "source", word_count(F.col(text)).alias("size")))
    found = _joined(rows, plan(rows, seed, **options), seed)
    taken = F.col("epochs") * F.col("size") + F.col("_extra")
    return found.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def take(df: DataFrame, text: str = "text", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: rows of ``df`` repeated as often as ``mix`` takes them, columns unchanged.

    The row at a cut comes once more with its first words only, white space as it was. Rows
    without words, NULL texts among them, cost nothing and come once for each epoch begun; if there is none, they are
    left out. A very long text is cut at any word. Repeated rows are rows of their own; NULL is a source
    and NULL ids are alike; an empty table stays empty.
    """
    narrow = checkpointed(df.select("doc_id", "source", word_count(F.col(text)).alias("size")))
    made = plan(narrow, seed, **options)
    held = df.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"))
    rows = _joined(held, made, seed)
    last = F.when(F.col("_whole"), -1).when(F.col("_extra") > 0, F.col("_extra"))
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int")), F.filter(F.array(last.cast("long")), lambda x: x.isNotNull())
    )
    rows = rows.select("_all", F.explode(copies).alias("_words"))
    pieces = F.regexp_extract_all(F.col(f"_all.`{text}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")
    column = F.when(F.col("_words") < 0, F.col(f"_all.`{text}`")).otherwise(cut)
    return rows.select(*[column.alias(c) if c == text else F.col(f"_all.`{c}`").alias(c) for c in df.columns])
