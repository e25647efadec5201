"""The registered queries: each operator over whole test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperwire.functions import authors as A
from paperwire.functions import messages as M
from paperwire.functions import text as X
from paperwire.functions import windows as D
from paperwire.operators import keywords, outbox, requests, subscriptions
from paperwire.operators.counts import source_counts
from paperwire.operators.joins import attach, distinct_values, keep_matching
from paperwire.operators.numbering import number_rows, position_label
from paperwire.operators.topk import first_per_group, first_rows
from paperwire.operators.union import in_digest_order, union_sources
from paperwire.plans import digest as G
from paperwire.plans import standins as S
from paperwire.schema import JobConfig
from paperwire.session import fresh_path, write_once
from paperwire.sources import atom, corpus, landing, medline
from paperwire.sources.account import Account, account_rows
from paperwire.sources.common import as_papers
from paperwire.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]

TERM = "lytion eauou"
PHRASE = "of the"
WORDS = "tion the"
RUN_TS = dt.datetime(2024, 1, 11, 15, 30)
RUN_DATE = RUN_TS.date()
ORDERS_DATE = dt.date(2001, 8, 2)
ORDERS_DAYS = 365
# Short words, and scripts without spaces between words.
SCRIPTS = ("AI 3D x", "自動化ラボ用AIロボット", "機械学習データ 2", "ภาษาไทย lab")


# --- filters ---------------------------------------------------------------------------


def kw_any_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.document_papers(spark, sf_dir)
    hit = X.any_keyword(TERM, F.col("Title"), F.col("Abstract"))
    return papers.where(hit).select("doc_id", "Title", "Source")


def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.document_papers(spark, sf_dir)
    hit = X.phrase(PHRASE, F.col("Title"), F.col("Abstract"))
    return papers.where(hit).select("doc_id", "Title", "Source")


def _subscription_sums(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("subscriptions"), F.sum("item_id").alias("items"))


def subscription_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 for a table of subscriptions: how many match each paper by a substring, short keywords among them."""
    papers = S.document_papers(spark, sf_dir)
    wanted = S.subscriptions(spark, sf_dir)
    found = subscriptions.keyword_matches(papers, wanted, "doc_id")
    return _subscription_sums(subscriptions.subscribed(found, wanted, "doc_id", "item_id"))


def subscription_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same subscriptions by whole words."""
    papers = S.document_papers(spark, sf_dir)
    wanted = S.subscriptions(spark, sf_dir)
    found = subscriptions.word_matches(papers, wanted, "doc_id")
    return _subscription_sums(subscriptions.subscribed(found, wanted, "doc_id", "item_id"))


def term_and_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 with F1: look-back window on the event time, all words of the term in the type."""
    events = S.table(spark, sf_dir, "events")
    window = D.pubmed_window(F.col("ts"), dt.date(2024, 1, 31), 7)
    return events.where(X.all_words("pur chase", F.col("event_type")) & window).select(
        "event_id", "user_id", "event_type"
    )


def date_window_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 (both readings of its upper bound), F3 and F3b: rows per window and day."""
    ts = F.col("ts")
    windows = {
        "arxiv": D.arxiv_window(ts, RUN_DATE, 3),
        "arxiv_upper": D.arxiv_window(ts, RUN_DATE, 3, include_upper=True),
        "biorxiv": D.biorxiv_window(ts, RUN_DATE, 1),
        "chemrxiv": D.single_day(ts, RUN_DATE, 1),
    }
    # One scan of the widest span; a row may lie in several windows.
    inside = F.filter(
        F.array(*[F.when(w, F.lit(name)) for name, w in windows.items()]), lambda x: x.isNotNull()
    )
    span = D.days_between(ts, RUN_DATE - dt.timedelta(days=3), RUN_DATE - dt.timedelta(days=1))
    events = S.table(spark, sf_dir, "events").where(span)
    return (
        events.select(F.explode(inside).alias("window"), F.date_format(ts, "yyyyMMdd").alias("day"))
        .groupBy("window", "day")
        .agg(F.count("*").alias("papers"))
    )


def search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 over ``orders``: the order date is the Entrez date, the priority the title."""
    records = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("PMID"),
        F.col("o_orderpriority").alias("TI"),
        F.col("o_orderstatus").alias("AB"),
        F.col("o_orderdate").alias("edat"),
    )
    return medline.search_ids(records, "high", "edat", ORDERS_DAYS, ORDERS_DATE)


# --- joins and sets --------------------------------------------------------------------


def anti_join_prev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events")
    new = landing.new_since_day_before(events, RUN_DATE, 1, "user_id", day="ts")
    return new.select("event_id", "user_id", "event_type")


def distinct_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = landing.scan_biorxiv(S.event_replies(spark, sf_dir))
    return distinct_values(items, "doi")


def id_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = S.table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    documents = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return keep_matching(documents, ids, "doc_id", "doc_id")


def author_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.order_author_labels(spark, sf_dir)


# --- projections -----------------------------------------------------------------------


def author_label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I14 on arrays of unequal length: ``l_linenumber`` authors, up to seven institutions."""
    lines = S.table(spark, sf_dir, "lineitem")
    authors = F.transform(
        F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: S.text_of("A", i)
    )
    given = (F.col("l_quantity") % 8).cast("int")
    institutions = F.transform(
        F.array_repeat(F.col("l_suppkey"), given),
        lambda s, i: F.when(i % 2 == 0, S.text_of("I", s, "-", i)).otherwise(""),
    )
    papers = lines.select(
        "l_orderkey",
        "l_linenumber",
        given.cast("bigint").alias("institutions"),
        authors.alias("Authors"),
        institutions.alias("Affiliation"),
    )
    return papers.select(
        "l_orderkey",
        "l_linenumber",
        "institutions",
        A.author_label(F.col("Authors"), F.col("Affiliation")).alias("author_label"),
    )


def author_split_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P15 and P16 on an author text of ``l_linenumber`` names."""
    numbers = F.sequence(F.lit(1), F.col("l_linenumber"))
    text = F.array_join(F.transform(numbers, lambda i: S.text_of("A, ", i, ".")), "; ")
    names = A.split_authors(text)
    padded = A.last_author_affiliation(names, S.text_of("Inst ", F.col("l_suppkey")))
    return S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.array_join(names, "|").alias("authors"),
        F.size(names).cast("bigint").alias("n_authors"),
        F.array_join(A.blank_affiliations(names), "|").alias("blank"),
        F.array_join(padded, "|").alias("padded"),
    )


def first_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two author objects a row, with filled, empty and NULL institution lists."""
    authors = F.array(
        F.struct(
            F.col("l_returnflag").alias("firstName"),
            F.col("l_partkey").cast("string").alias("lastName"),
            F.when(
                F.col("l_linestatus") == "O",
                F.array(
                    F.struct(S.text_of("Inst ", F.col("l_suppkey")).alias("name")),
                    F.struct(F.lit("Second").alias("name")),
                ),
            )
            .otherwise(F.array().cast("array<struct<name:string>>"))
            .alias("institutions"),
        ),
        F.struct(
            F.col("l_linestatus").alias("firstName"),
            F.col("l_suppkey").cast("string").alias("lastName"),
            F.lit(None).cast("array<struct<name:string>>").alias("institutions"),
        ),
    )
    return S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.array_join(A.full_names(authors), "|").alias("authors"),
        F.array_join(A.first_institutions(authors), "|").alias("institutions"),
    )


def json_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to items; the abstract is itself a JSON text."""
    items = landing.scan_biorxiv(S.event_replies(spark, sf_dir))
    return items.select(
        "source_seq",
        "doi",
        "title",
        F.date_format("published", "yyyy-MM-dd").alias("day"),
        F.from_json("abstract", "k BIGINT")["k"].alias("k"),
    )


def raw_record_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", "url", S.page_title().alias("title"))


def doi_citation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = S.document_records(spark, sf_dir)
    doi = X.citation_doi(F.col("SO"))
    return records.select(
        "PMID",
        X.citation_source(F.col("SO")).alias("citation"),
        doi.alias("doi"),
        X.pubmed_link(F.col("PMID")).alias("pubmed_link"),
        X.doi_link(doi).alias("doi_link"),
    )


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("　 \t"), F.col("text"), F.lit("\n　\r"))
    return S.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.strip(padded).alias("stripped")
    )


def jst_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return S.table(spark, sf_dir, "events").select(
        "event_id",
        M.header(ts, F.col("event_type"), F.col("event_id"), F.col("user_id")).alias("header"),
        F.date_format(ts, "yyyyMMdd").alias("day"),
    )


# --- sources ---------------------------------------------------------------------------


def flat(papers: DataFrame) -> DataFrame:
    """Paper rows with arrays as text, for comparison by value."""
    return papers.select(
        "paper_key", "source_kind", F.col("source_rank").cast("bigint").alias("source_rank"),
        "source_seq", "Title", F.array_join("Authors", "|").alias("Authors"), "Source",
        "Abstract", "PMID", F.array_join("Affiliation", "|").alias("Affiliation"), "DOI",
        "paperLink",
    )


def medline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as tagged text and read back."""
    path = S.write_medline(S.document_records(spark, sf_dir))
    return flat(medline.medline_papers(medline.read_medline(spark, path)))


def blank_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, E5: of every seventh record the abstract is missing; it gives a blank one and no request."""
    records = S.document_records(spark, sf_dir)
    blank = records.withColumn("AB", F.when(F.col("PMID").cast("bigint") % 7 != 0, F.col("AB")).otherwise(""))
    papers = write_once(medline.medline_papers(medline.read_medline(spark, S.write_medline(blank))), "papers")
    asked = requests.prompt_requests(papers).select("paper_key", F.lit(True).alias("asked"))
    marked = attach(papers, asked, "paper_key", "paper_key")
    return marked.select("PMID", "Abstract", F.coalesce("asked", F.lit(False)).alias("asked"))


def atom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns landed as Atom feeds and read back."""
    path = S.write_landing(S.turn_replies(spark, sf_dir))
    entries = atom.atom_columns(atom.scan_arxiv(landing.read_landing(spark, path)))
    return entries.select(
        "id", F.date_format("published", "yyyy-MM-dd").alias("day"), "Title",
        F.array_join("Authors", "|").alias("Authors"), "Source", "Abstract", "PMID",
        F.array_join("Affiliation", "|").alias("Affiliation"), "DOI", "paperLink",
    )


def landing_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = landing.rejects(S.event_replies(spark, sf_dir))
    return rejected.withColumn("status", F.col("status").cast("bigint"))


def landing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of each query of the landed chemRxiv replies."""
    path = S.write_landing(S.document_replies(spark, sf_dir))
    pages = landing.first_pages(landing.read_landing(spark, path), 2)
    papers = as_papers(landing.chemrxiv_columns(landing.scan_chemrxiv(pages)), "chemrxiv")
    return flat(papers)


def landing_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One good reply per page, of the first three good pages a day; failed and repeated pages among them."""
    landed = landing.read_landing(spark, S.write_landing(S.uneven_replies(spark, sf_dir), "query_key"))
    pages = landing.current_pages(landing.landed_until(landed, RUN_TS), 3)
    fetched = F.date_format("fetched", "yyyy-MM-dd HH:mm").alias("fetched")
    return pages.select("query_key", "cursor", F.col("status").cast("bigint").alias("status"), fetched, "body")


def landing_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every reply and item of a bioRxiv run over all that has landed up to its instant."""
    landed = landing.read_landing(spark, S.write_landing(S.uneven_replies(spark, sf_dir), "query_key"))
    account = Account()
    pages = landing.current_pages(landing.landed_until(landed, RUN_TS), account=account)
    items = landing.scan_biorxiv(pages, account=account)
    G.land_papers(landing.biorxiv_papers(items, "Click vie", RUN_DATE, 1, account))
    return account_rows(spark, G.settled(account))


def landing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map that each reply gets when it lands."""
    path = fresh_path(spark, "landing")
    landing.land(S.event_pages(spark, sf_dir), path)
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")]
    return landing.read_landing(spark, path).select("cursor", *days, "undated")


def landing_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 over mapped replies: those of other days are left out by their map, before any body is parsed."""
    path = fresh_path(spark, "landing")
    landing.land(S.event_pages(spark, sf_dir), path)
    day = RUN_DATE - dt.timedelta(days=2)
    replies = landing.due(landing.read_landing(spark, path), "biorxiv", day, day, RUN_TS)
    items = landing.scan_biorxiv(replies).where(D.single_day(F.col("published"), RUN_DATE, 2))
    return items.select("source_seq", "doi", "title")


def pubmed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of revisions; the ids of a search, then their current records."""
    name = f"corpus_{uuid.uuid4().hex}"
    corpus.open_corpus(spark, name, fresh_path(spark, "corpus"))
    for revision in (1, 2, 3):
        corpus.upsert(spark, name, S.revised_records(spark, sf_dir, revision))
    records = corpus.read_corpus(spark, name)
    ids = medline.search_ids(records, "tion the", "edat", 5, RUN_DATE, current=True)
    found = medline.fetch_by_id(records, ids, current=True)
    return found.select("PMID", "TI", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("edat", "mdat")])


def chemrxiv_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 phrase hits of the day."""
    path = S.write_landing(S.document_replies(spark, sf_dir))
    items = landing.scan_chemrxiv(landing.read_landing(spark, path))
    return flat(landing.chemrxiv_papers(items, PHRASE, RUN_DATE, 1))


def biorxiv_new_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed replies to the day's new papers."""
    path = S.write_landing(S.event_replies(spark, sf_dir), "query_key")
    items = landing.scan_biorxiv(landing.read_landing(spark, path))
    return flat(landing.biorxiv_papers(items, "Click vie", RUN_DATE, 1))


def arxiv_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most relevant entries of the window."""
    entries = S.turn_entries(spark, sf_dir)
    return flat(atom.arxiv_papers(entries, WORDS, RUN_DATE, 3))


def _four_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.page_entries(spark, sf_dir)
    return union_sources(
        medline.medline_papers(S.document_records(spark, sf_dir)),
        as_papers(landing.biorxiv_columns(S.benchmark_items(spark, sf_dir)), "biorxiv"),
        as_papers(landing.chemrxiv_columns(S.turn_items(spark, sf_dir)), "chemrxiv"),
        as_papers(atom.atom_columns(pages, "page_id"), "arxiv"),
    )


def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(in_digest_order(_four_sources(spark, sf_dir)))


# --- counts, order, numbering ----------------------------------------------------------


def source_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = source_counts(S.document_papers(spark, sf_dir))
    return counts.withColumn("source_rank", F.col("source_rank").cast("bigint"))


def top10_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.document_papers(spark, sf_dir)
    score = X.relevance(TERM, F.col("Title"), F.col("Abstract"))
    scored = papers.select("doc_id", "Title", score.alias("score"))
    return first_rows(scored, 10, F.desc("score"), "doc_id")


def topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = S.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return first_per_group(documents, 5, "source", F.desc("n_chars"), "doc_id")


def digest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_rows(S.document_papers(spark, sf_dir))
    return numbered.select(
        "doc_id", "position", "total",
        position_label(F.col("position"), F.col("total")).alias("label"),
    )


# --- enrichment ------------------------------------------------------------------------


def prompt_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_json(requests.prompt_requests(S.document_papers(spark, sf_dir)))


def response_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as model answers, one JSON reply each, padded with white space."""
    answer = S.text_of("　 quality ", F.col("quality"), ", toxic ", F.col("toxic"), "\n")
    choice = F.struct(
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")).alias("message")
    )
    responses = S.table(spark, sf_dir, "labels").select(
        S.text_of("doc:", F.col("doc_id")).alias("paper_key"),
        F.to_json(F.struct(F.array(choice).alias("choices"))).alias("body"),
    )
    papers = S.document_papers(spark, sf_dir).select("doc_id", "paper_key")
    attached = keywords.attach_summaries(papers, requests.answers(responses))
    return attached.select("doc_id", F.col("SummaryAbstract").alias("summary"))


def tfidf_keywords10(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = S.document_papers(spark, sf_dir).select("doc_id", "paper_key", "Abstract")
    attached = keywords.attach_summaries(papers, keywords.tfidf_keywords(papers))
    return attached.select("doc_id", F.col("SummaryAbstract").alias("keywords"))


def tfidf_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with words of one and two letters and with scripts that put no space between words."""
    extra = F.element_at(F.array(*[F.lit(x) for x in SCRIPTS]), (F.col("doc_id") % 4 + 1).cast("int"))
    few = F.concat_ws(" ", F.slice(F.split("Abstract", " "), 1, 6), extra)
    papers = S.document_papers(spark, sf_dir).select("doc_id", "paper_key", few.alias("Abstract"))
    attached = keywords.attach_summaries(papers, keywords.tfidf_keywords(papers))
    return attached.select("doc_id", F.col("SummaryAbstract").alias("keywords"))


def request_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions are written, half of them are answered, and only the rest is asked again."""
    papers = S.document_papers(spark, sf_dir).select("doc_id", "paper_key", "Abstract")
    asked = requests.with_id(requests.prompt_requests(papers, key="doc_id"))
    path = fresh_path(spark, "requests")
    requests.write_requests(asked, path, file_bytes=1 << 20)
    sent = spark.read.schema("custom_id STRING, body STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>>")
    told = S.text_of("answer ", F.char_length(F.col("body.messages")[1]["content"]))
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), told.alias("content")).alias("message"))
    answers = sent.json(path).where(F.col("custom_id") < "8").select(
        F.col("custom_id").alias(requests.REQUEST_ID), F.to_json(F.struct(F.array(choice).alias("choices"))).alias("body")
    )
    replies = write_once(answers, "replies")
    rest = fresh_path(spark, "requests")
    attached = requests.asking(rest, replies, spread="doc_id")(papers)
    again = sent.json(rest).select(F.col("custom_id").alias(requests.REQUEST_ID), F.lit(True).alias("again"))
    marked = attach(asked.select("doc_id", requests.REQUEST_ID), again, requests.REQUEST_ID, "doc_id")
    open_ = marked.where("again").select("doc_id", "again")
    return attached.join(open_, "doc_id", "left").select(
        "doc_id", F.col("SummaryAbstract").alias("summary"), F.coalesce("again", F.lit(False)).alias("asked_again")
    )


# --- messages and outbox ---------------------------------------------------------------


def _message(channel: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        papers = S.labelled_documents(spark, sf_dir)
        rendered = outbox.render(papers, channel, RUN_TS, "author_label")
        return rendered.select(
            "doc_id", "message", M.payload(channel, F.col("message")).alias("payload")
        )

    return query


def outbox_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6: every paper to four channels, written by channel and read back."""
    papers = S.labelled_documents(spark, sf_dir)
    rows = outbox.fan_out(papers, RUN_TS, "author_label", ("teams", "line", "slack", "discord"))
    path = fresh_path(spark, "outbox")
    outbox.write_outbox(rows, path)
    return outbox.read_outbox(spark, path)


def channel_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: two channels only."""
    papers = S.labelled_documents(spark, sf_dir)
    rows = outbox.fan_out(papers, RUN_TS, "author_label", ("line", "discord"))
    return rows.select("channel", "paper_key", "position", "message", "username")


def outbox_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: papers without a label have no DOI here, hence no link and no message."""
    labels = S.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    papers = attach(
        S.document_papers(spark, sf_dir).drop("Abstract"), labels, "doc_id", "doc_id"
    )
    unlinked = papers.withColumn("paperLink", F.when(F.col("known"), F.col("paperLink")))
    ready = number_rows(unlinked).select(
        "*", F.lit("").alias("author_label"), F.lit("").alias("SummaryAbstract")
    )
    rows = outbox.fan_out(ready, RUN_TS, "author_label", ("slack",))
    return outbox.outbox_errors(rows).select("channel", "paper_key", "position", "total", "title")


# --- streaming -------------------------------------------------------------------------


def incremental_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies land one day per folder; the stream appends the matching papers."""
    path = S.write_landing(S.event_replies(spark, sf_dir), "query_key")
    papers = intake.paper_stream(intake.landing_stream(spark, path), "Click vie")
    out = fresh_path(spark, "papers")
    intake.run_available(papers, out, fresh_path(spark, "stream"))
    return flat(spark.read.schema(papers.schema).parquet(out))


def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: each DOI once, the repeats of later files and later runs being dropped.

    The days land out of order: the second run brings files of days before those of the first.
    """
    replies = S.event_replies(spark, sf_dir)
    path, out, state = (fresh_path(spark, name) for name in ("landing", "papers", "stream"))
    for days in (F.col("query_key") >= "2024-01-16", F.col("query_key") < "2024-01-16"):
        replies.where(days).write.mode("append").partitionBy("query_key").parquet(path)
        papers = intake.paper_stream(intake.landing_stream(spark, path, 20), "")
        intake.run_unseen(papers, out, state, keep=60)
    return intake.read_unseen(spark, out, papers.schema).select("DOI")


def incremental_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 for chemRxiv and arXiv: their replies land and the streams append the matching papers."""
    found = []
    for source, term, replies in (
        ("chemrxiv", PHRASE, S.document_replies(spark, sf_dir)),
        ("arxiv", WORDS, S.turn_replies(spark, sf_dir)),
    ):
        path = S.write_landing(replies)
        papers = intake.paper_stream(intake.landing_stream(spark, path), term, source)
        out = fresh_path(spark, "papers")
        intake.run_available(papers, out, fresh_path(spark, "stream"))
        found.append(flat(spark.read.schema(papers.schema).parquet(out)))
    # arXiv's papers have no place in a list here.
    return union_sources(*found).withColumn("source_seq", F.coalesce("source_seq", F.lit(-1).cast("bigint")))


# --- whole runs ------------------------------------------------------------------------


def new_papers_to_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's new papers, numbered and rendered: scan, anti join, filter, label, Slack text."""
    items = landing.scan_biorxiv(S.event_replies(spark, sf_dir))
    papers = G.land_papers(landing.biorxiv_papers(items, "Click vie", RUN_DATE, 1))
    ready = number_rows(papers, tie="row_id").select(
        "*",
        A.author_label(F.col("Authors"), F.col("Affiliation")).alias("author_label"),
        F.lit("").alias("SummaryAbstract"),
    )
    return outbox.render(ready, "slack", RUN_TS, "author_label").select(
        "paper_key", "position", "message"
    )


def digest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything: four landed sources to an outbox of four channels."""
    medline_path = S.write_medline(S.document_records(spark, sf_dir))
    replies = union_sources(
        S.event_replies(spark, sf_dir),
        S.document_replies(spark, sf_dir),
        S.turn_replies(spark, sf_dir),
    )
    landed_replies = landing.read_landing(spark, S.write_landing(replies, "source"))
    landed = G.Landed(
        medline=medline.read_medline(spark, medline_path),
        replies=landed_replies,
        atom=atom.scan_arxiv(landed_replies),
    )
    config = JobConfig(
        term=WORDS, term_biorxiv="Click vie", term_chemrxiv=PHRASE, run_ts=RUN_TS
    )
    path = fresh_path(spark, "digest")
    G.run(landed, config, path)
    return outbox.read_outbox(spark, f"{path}/outbox")


QUERIES: dict[str, Query] = {
    "kw_any_filter": kw_any_filter,
    "phrase_filter": phrase_filter,
    "subscription_matches": subscription_matches,
    "subscription_words": subscription_words,
    "term_and_date": term_and_date,
    "date_window_lookback": date_window_lookback,
    "search_ids": search_ids,
    "anti_join_prev_day": anti_join_prev_day,
    "distinct_doi": distinct_doi,
    "id_semi_join": id_semi_join,
    "author_label": author_label,
    "author_label_arrays": author_label_arrays,
    "author_split_pad": author_split_pad,
    "first_institution": first_institution,
    "json_normalise": json_normalise,
    "raw_record_title": raw_record_title,
    "doi_citation_split": doi_citation_split,
    "strip_text": strip_text,
    "jst_header": jst_header,
    "medline_scan": medline_scan,
    "blank_abstracts": blank_abstracts,
    "atom_scan": atom_scan,
    "landing_rejects": landing_rejects,
    "landing_pages": landing_pages,
    "landing_current": landing_current,
    "landing_account": landing_account,
    "landing_days": landing_days,
    "landing_pruned": landing_pruned,
    "pubmed_corpus": pubmed_corpus,
    "chemrxiv_papers": chemrxiv_papers,
    "biorxiv_new_papers": biorxiv_new_papers,
    "arxiv_top": arxiv_top,
    "union_sources": union_of_sources,
    "source_running_count": source_running_count,
    "top10_relevance": top10_relevance,
    "topk_per_source": topk_per_source,
    "digest_position": digest_position,
    "prompt_request": prompt_request,
    "response_attach": response_attach,
    "tfidf_keywords10": tfidf_keywords10,
    "tfidf_scripts": tfidf_scripts,
    "request_resume": request_resume,
    "msg_teams": _message("teams"),
    "msg_line": _message("line"),
    "msg_slack": _message("slack"),
    "msg_discord": _message("discord"),
    "outbox_fanout": outbox_fanout,
    "channel_switch": channel_switch,
    "outbox_errors": outbox_errors,
    "incremental_intake": incremental_intake,
    "incremental_dedup": incremental_dedup,
    "incremental_sources": incremental_sources,
    "new_papers_to_slack": new_papers_to_slack,
    "digest_run": digest_run,
}
