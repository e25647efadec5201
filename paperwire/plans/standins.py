"""The test tables seen as landed papers.

There is no table of papers among them, so each query says which columns stand for a
title, an abstract, a DOI and so on.  Whole tables are mapped, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.functions.text import doi_link
from paperwire.operators.author_rows import author_labels
from paperwire.operators.joins import attach
from paperwire.operators.numbering import number_rows
from paperwire.operators.sizing import tasks_for
from paperwire.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(*parts: str | Column) -> Column:
    """Concatenation; strings are literals, columns are cast to text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def document_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as papers: text = abstract, ``srcN`` = source of rank N."""
    doc = F.col("doc_id")
    doi = text_of("10.5555/", doc)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text_of("doc:", doc).alias("paper_key"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_rank"),
        doc.alias("source_seq"),
        text_of("Document ", doc, " (", F.col("lang"), ")").alias("Title"),
        F.col("source").alias("Source"),
        F.col("text").alias("Abstract"),
        doi.alias("DOI"),
        doi_link(doi).alias("paperLink"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as subscriptions: the longest word of each text, of every fifth also two letters."""
    words = F.split("text", " ")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.char_length(w), w.alias("word"))))["word"]
    short = F.when(F.col("item_id") % 5 == 0, F.substring(longest, 1, 2))
    few = F.array_compact(F.array(longest, short))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(few).alias("keyword"))


def order_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as one author per row: the supplier, with its nation as institution."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name"
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"
    )
    supplied = attach(lines, suppliers, "l_suppkey", "l_partkey")
    return attach(supplied, nations, "s_nationkey", "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("s_name").alias("name"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("n_name")).alias("institution"),
    )


def order_author_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = order_authors(spark, sf_dir)
    return author_labels(
        authors, "l_orderkey", "l_linenumber", "l_partkey", tasks=tasks_for(authors)
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered document papers with the author label of the order of that number and a summary.

    They are numbered first, while that takes two narrow columns of one table.
    """
    authors = order_author_labels(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), "author_label"
    )
    summaries = table(spark, sf_dir, "labels").select(
        "doc_id",
        text_of("quality ", F.col("quality"), ", toxic ", F.col("toxic")).alias("SummaryAbstract"),
    )
    # doc_id names one row in all three tables.
    return (
        number_rows(document_papers(spark, sf_dir).drop("Abstract"))
        .join(authors, "doc_id", "left")
        .join(summaries, "doc_id", "left")
        .withColumn("author_label", F.coalesce("author_label", F.lit("")))
        .withColumn("SummaryAbstract", F.coalesce("SummaryAbstract", F.lit("")))
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as MEDLINE fields; French ones have no DOI, only English ones an ``AD``."""
    doc, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        doc.cast("string").alias("PMID"),
        text_of("Document ", doc, " (", lang, ")").alias("TI"),
        F.col("text").alias("AB"),
        F.array(text_of(source, " A"), text_of(lang, " B")).alias("AU"),
        F.when(lang == "en", F.array(text_of("Inst ", source), text_of("Inst ", lang)))
        .otherwise(none)
        .alias("AD"),
        F.when(lang == "fr", text_of("Journal of ", source, ". 2024."))
        .otherwise(
            text_of(
                "Journal of ", source, ". 2024;1(", doc, "):1-9. doi: 10.5555/", source, ".", doc,
                ". Epub 2024 Jan 1.",
            )
        )
        .alias("SO"),
        F.lit("2024-01-10").cast("date").alias("edat"),
    )


def write_medline(records: DataFrame) -> str:
    """Write MEDLINE fields as a tagged text file; line breaks become continuation lines."""

    def tagged(tag: str, value: Column) -> Column:
        return F.concat(F.lit(f"{tag:<4}- "), value)

    def folded(value: Column) -> Column:
        return F.regexp_replace(F.trim(value), r"\s*\n\s*", "\n      ")

    none = F.array().cast("array<string>")
    authors = F.transform("AU", lambda v: tagged("AU", v))
    addresses = F.transform("AD", lambda v: tagged("AD", v))
    lines = F.concat(
        F.array(tagged("PMID", F.col("PMID")), tagged("TI", F.col("TI"))),
        F.when(F.col("AB") != "", F.array(tagged("AB", folded(F.col("AB"))))).otherwise(none),
        authors,
        addresses,
        F.array(
            tagged("EDAT", F.date_format("edat", "yyyy/MM/dd 06:00")),
            tagged("SO", F.col("SO")),
        ),
    )
    path = fresh_path(records.sparkSession, "medline")
    records.select(F.array_join(lines, "\n").alias("value")).write.option("lineSep", "\n\n").text(
        path
    )
    return path


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as Atom entries."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url.alias("id"),
        F.lit("2024-01-08T12:00:00Z").alias("published"),
        page_title().alias("title"),
        F.col("html").alias("summary"),
        F.array(F.struct(text_of("Page ", F.col("page_id")).alias("name"))).alias("author"),
        F.lit(None).cast("string").alias("arxiv:doi"),
        F.array(
            F.struct(url.alias("_href"), F.lit("alternate").alias("_rel")),
            F.struct(text_of(url, ".pdf").alias("_href"), F.lit("related").alias("_rel")),
        ).alias("link"),
    )


def page_title() -> Column:
    return F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)


def turn_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as Atom entries, one per turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = text_of(conv, ".", turn)

    def link(kind: str, rel: str) -> Column:
        href = text_of(f"http://example.org/{kind}/", name)
        return F.struct(href.alias("_href"), F.lit(rel).alias("_rel"))

    return table(spark, sf_dir, "conversations").select(
        text_of("http://example.org/abs/", name).alias("id"),
        F.lit("2024-01-08T12:00:00Z").alias("published"),
        text_of(F.col("role"), " turn ", name).alias("title"),
        F.col("text").alias("summary"),
        F.array(
            F.struct(text_of("Author ", conv).alias("name")),
            F.struct(text_of("Author ", F.col("role")).alias("name")),
        ).alias("author"),
        F.when(F.col("role") == "user", text_of("10.5555/t", name)).alias("arxiv:doi"),
        F.array(link("abs", "alternate"), link("pdf", "related")).alias("link"),
    )


def turn_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as landed arXiv replies: a feed of one entry per turn."""

    def escaped(value: Column) -> Column:
        out = value
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return out

    def element(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>"))

    authors = F.transform(
        "author",
        lambda a: F.concat(F.lit("<author>"), element("name", a["name"]), F.lit("</author>")),
    )
    links = F.transform(
        "link",
        lambda link: F.concat(
            F.lit('<link href="'), escaped(link["_href"]),
            F.lit('" rel="'), escaped(link["_rel"]), F.lit('"/>'),
        ),
    )
    entry = F.concat_ws(
        "",
        F.lit("<entry>"),
        *[element(name, F.col(name)) for name in ("id", "published", "title", "summary")],
        F.array_join(authors, ""),
        element("arxiv:doi", F.col("`arxiv:doi`")),
        F.array_join(links, ""),
        F.lit("</entry>"),
    )
    feed = F.concat(
        F.lit('<feed xmlns:arxiv="http://arxiv.org/schemas/atom">'), entry, F.lit("</feed>")
    )
    place = F.regexp_extract("id", r"(\d+)\.(\d+)$", 1).cast("bigint") * 1000
    turn = F.regexp_extract("id", r"(\d+)\.(\d+)$", 2).cast("bigint")
    return turn_entries(spark, sf_dir).withColumn("cursor", place + turn).select(
        F.lit("arxiv").alias("source"),
        F.lit("2024-01-08").alias("query_key"),
        "cursor",
        F.col("id").alias("url"),
        F.lit(200).alias("status"),
        feed.alias("body"),
        F.lit("2024-01-11").cast("timestamp").alias("fetched"),
    )


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as bioRxiv items."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("source_seq"),
        text_of("10.5555/b", item).alias("doi"),
        text_of("Item ", item).alias("title"),
        F.col("text").alias("abstract"),
        text_of("Able, ", item, ".; Baker, B.").alias("authors"),
        F.lit("Inst B").alias("author_corresponding_institution"),
        F.lit("2024-01-10").cast("date").alias("published"),
    )


def turn_authors() -> Column:
    """Two author objects: users have an institution, the second author's list is NULL."""
    institution = "array<struct<name:string>>"
    here = F.array(F.struct(text_of("Inst ", F.col("role")).alias("name")))
    return F.array(
        F.struct(
            F.col("role").alias("firstName"),
            F.col("conv_id").cast("string").alias("lastName"),
            F.when(F.col("role") == "user", here)
            .otherwise(F.array().cast(institution))
            .alias("institutions"),
        ),
        F.struct(
            F.lit("Turn").alias("firstName"),
            F.col("turn").cast("string").alias("lastName"),
            F.lit(None).cast(institution).alias("institutions"),
        ),
    )


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chemRxiv items."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("source_seq"),
        text_of("10.5555/c", conv, ".", turn).alias("doi"),
        text_of(F.col("role"), " ", turn).alias("title"),
        F.col("text").alias("abstract"),
        turn_authors().alias("authors"),
        F.lit("2024-01-10").cast("date").alias("published"),
    )


def event_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as landed bioRxiv replies: one item a page, DOI by user, errors rejected."""
    event, user = F.col("event_id"), F.col("user_id")
    item = F.struct(
        text_of("10.5555/u", user).alias("doi"),
        F.col("event_type").alias("title"),
        F.col("props").alias("abstract"),
        text_of("Ab, ", event, ".; Cd, ", user, ".").alias("authors"),
        text_of("Inst ", user).alias("author_corresponding_institution"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
    )
    return table(spark, sf_dir, "events").select(
        F.lit("biorxiv").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("query_key"),
        event.alias("cursor"),
        text_of("landing/", event).alias("url"),
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "signup", 404)
        .otherwise(200)
        .alias("status"),
        F.to_json(F.struct(F.array(item).alias("collection"))).alias("body"),
        F.col("ts").cast("timestamp").alias("fetched"),
    )


def document_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as landed chemRxiv replies: one item a page, one query per language."""
    doc, lang = F.col("doc_id"), F.col("lang")
    institution = "array<struct<name:string>>"
    author = F.struct(
        F.lit("Doc").alias("firstName"),
        doc.cast("string").alias("lastName"),
        F.when(lang == "en", F.array(F.struct(F.col("source").alias("name"))))
        .otherwise(F.array().cast(institution))
        .alias("institutions"),
    )
    item = F.struct(
        text_of("Document ", doc, " (", lang, ")").alias("title"),
        F.col("text").alias("abstract"),
        text_of("10.5555/", doc).alias("doi"),
        F.lit("2024-01-10").alias("publishedDate"),
        F.array(author).alias("authors"),
    )
    return table(spark, sf_dir, "documents").select(
        F.lit("chemrxiv").alias("source"),
        lang.alias("query_key"),
        doc.alias("cursor"),
        text_of("landing/", doc).alias("url"),
        F.lit(200).alias("status"),
        F.to_json(F.struct(F.array(F.struct(item.alias("item"))).alias("itemHits"))).alias("body"),
        F.lit("2024-01-11").cast("timestamp").alias("fetched"),
    )


def uneven_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as bioRxiv replies that fail in every way: unreadable, without a list, undated, landed twice or late.

    Of every fifty events one has a body that is no JSON, one a body without the list, one an item without
    a date; of every twenty one page came with status 503 an hour before, and one again an hour after.
    """
    event = F.col("cursor")
    replies = event_replies(spark, sf_dir)
    no_date = F.regexp_replace("body", r',"date":"[^"]*"', "")
    body = (
        F.when(event % 50 == 7, "<html>busy</html>")
        .when(event % 50 == 8, '{"messages":[{"status":"no posts found"}]}')
        .when(event % 50 == 9, no_date)
        .otherwise(F.col("body"))
    )
    replies = replies.withColumn("body", body)
    hour = F.expr("INTERVAL 1 HOUR")
    failed = replies.where(event % 20 == 4).select(
        "source", "query_key", "cursor", "url", F.lit(503).alias("status"), F.lit("").alias("body"),
        (F.col("fetched") - hour).alias("fetched"),
    )
    again = replies.where(event % 20 == 5).withColumn("fetched", F.col("fetched") + hour)
    return replies.unionByName(failed).unionByName(again)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as bioRxiv replies of twenty items each, of several days; every tenth event has no date."""
    event, user = F.col("event_id"), F.col("user_id")
    item = F.struct(
        text_of("10.5555/u", user).alias("doi"),
        F.col("event_type").alias("title"),
        F.col("props").alias("abstract"),
        text_of("Ab, ", event, ".; Cd, ", user, ".").alias("authors"),
        text_of("Inst ", user).alias("author_corresponding_institution"),
        F.when(event % 173 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
    )
    pages = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 20").alias("page")).agg(
        # Twenty items a page at most.
        F.array_sort(F.collect_list(F.struct(event.alias("event_id"), item.alias("item")))).alias("items")
    )
    return pages.select(
        F.lit("biorxiv").alias("source"),
        F.lit("all").alias("query_key"),
        (F.col("page") * 20).alias("cursor"),
        text_of("landing/", F.col("page")).alias("url"),
        F.lit(200).alias("status"),
        F.to_json(F.struct(F.col("items")["item"].alias("collection"))).alias("body"),
        F.lit("2024-01-11").cast("timestamp").alias("fetched"),
    )


def revised_records(spark: SparkSession, sf_dir: str, revision: int) -> DataFrame:
    """``documents`` as MEDLINE records in three batches.

    The first has all; the second revises every third (a new title, the next day); the third
    brings back the first title of every sixth with an older revision date, and every fourth once more.
    """
    doc = F.col("doc_id")
    records = document_records(spark, sf_dir).withColumn("doc_id", F.col("PMID").cast("bigint"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 10).cast("int"))
    first = records.withColumn("edat", day).withColumn("mdat", F.lit("2024-01-02").cast("date"))
    if revision == 1:
        return first
    if revision == 2:
        return first.where(doc % 3 == 0).select(
            "*", F.concat(F.lit("Revised "), F.col("TI")).alias("_title")
        ).withColumns(
            {"TI": F.col("_title"), "edat": F.date_add("edat", 1), "mdat": F.lit("2024-01-04").cast("date")}
        ).drop("_title")
    old = first.where(doc % 6 == 0).withColumn("mdat", F.lit("2024-01-03").cast("date"))
    again = first.where(doc % 4 == 1).withColumns(
        {"TI": F.concat(F.lit("Last "), F.col("TI")), "mdat": F.lit("2024-01-05").cast("date")}
    )
    return old.unionByName(again)


def write_landing(replies: DataFrame, partition: str | None = None) -> str:
    """Replies as some other program may have landed them, without the days of their items."""
    path = fresh_path(replies.sparkSession, "landing")
    writer = replies.write
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return path
