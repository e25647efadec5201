"""The author label where authors lie one per row instead of in an array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperwire.functions.authors import short_list, with_institution
from paperwire.functions.text import let


# Parts that the authors of one key are first cut into.
SALTS = 8


def author_labels(authors: DataFrame, key: str, *order: str, tasks: int | None = None) -> DataFrame:
    """``key, authors, author_label`` from rows ``key, name, institution``.

    The label shows three authors at most: the first ones, or the first two and the last.  So a
    summary of four rows will do, and summaries of parts merge into that of the whole: the first
    three, and the last, whose place is the count.  Each key is summed up in ``SALTS`` parts, so that no
    task sees all authors of a large one, and the few rows that are left meet by key.  The input
    is read once.  ``tasks`` says into how many both steps are dealt, so that a task's rows do not
    grow with the input; without it the session decides.
    """
    columns = [F.col(c).alias(f"order{i}") for i, c in enumerate(order)]
    place = F.struct(*columns, F.col("name").alias("name"), F.col("institution").alias("institution"))

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(tasks, *keys) if tasks else rows

    named = dealt(
        authors.select(key, place.alias("place"), F.pmod(F.xxhash64(place), F.lit(SALTS)).alias("part")),
        key, "part",
    )
    first, is_last = F.row_number(), F.lead(F.lit(1)).over
    in_part = Window.partitionBy(key, "part").orderBy("place")
    parts = named.select(
        key, "place", first.over(in_part).alias("n"), is_last(in_part).isNull().alias("last")
    ).where("n <= 3 OR last")
    parts = dealt(parts.select(key, "place", F.when(F.col("last"), F.col("n")).alias("n")), key)
    in_key, of_key = Window.partitionBy(key).orderBy("place"), Window.partitionBy(key)
    shown = parts.select(
        key,
        F.struct(first.over(in_key).alias("at"), "place").alias("shown"),
        is_last(in_key).isNull().alias("tail"),
        F.sum("n").over(of_key).alias("authors"),
    ).where("shown.at <= 3 OR tail")
    # Four rows per key at most, already partitioned by it.
    names = shown.groupBy(key).agg(
        F.first("authors").cast("bigint").alias("authors"),
        F.transform(
            F.sort_array(F.collect_list("shown"))["place"],
            lambda p: with_institution(p["name"], p["institution"]),
        ).alias("names"),
    )
    label = F.when(
        F.col("authors") > 3,
        F.concat(F.slice(F.col("names"), 1, 2), F.array(F.element_at("names", -1))),
    ).otherwise(F.col("names"))
    return names.select(
        key,
        "authors",
        let(label, lambda few: short_list(few, F.col("authors"))).alias("author_label"),
    )
