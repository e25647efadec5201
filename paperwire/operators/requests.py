"""Model requests and answers as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperwire import constants as K
from paperwire.functions.text import or_blank, strip
from paperwire.operators.joins import attach, drop_matching
from paperwire.operators.keywords import Extractor
from paperwire.schema import ANSWER_BODY
from paperwire.session import write_once


def prompt_text(prompt: str, abstract: Column) -> Column:
    """The instruction, an ideographic space and the abstract."""
    return F.concat(F.lit(prompt + K.PROMPT_GAP), abstract)


def prompt_requests(
    papers: DataFrame, prompt: str = K.BASE_PROMPT, model: str = K.MODEL, key: str = "paper_key"
) -> DataFrame:
    """One request record per non-empty abstract."""

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return papers.where(F.col("Abstract") != "").select(
        key,
        F.lit(model).alias("model"),
        F.array(
            said("system", F.lit(K.SYSTEM_MESSAGE)),
            said("user", prompt_text(prompt, F.col("Abstract"))),
        ).alias("messages"),
        F.lit(K.TEMPERATURE).alias("temperature"),
        F.lit(K.MAX_TOKENS).alias("max_tokens"),
        F.lit(K.TOP_P).alias("top_p"),
        F.lit(K.FREQUENCY_PENALTY).alias("frequency_penalty"),
        F.lit(K.PRESENCE_PENALTY).alias("presence_penalty"),
    )


def request_json(requests: DataFrame) -> DataFrame:
    """``paper_key, body``: each request as one line of JSON."""
    return requests.select("paper_key", F.to_json(F.struct(*requests.columns)).alias("body"))


# --- the ledger: requests in files, replies by the id of what was asked ----------------

#: Bytes of a request file, about.
FILE_BYTES = 64 << 20
REQUEST_ID = "request_id"
#: What is sent to the model; the other columns of a request say whose it is.
CONTENT = (
    "model", "messages", "temperature", "max_tokens", "top_p", "frequency_penalty", "presence_penalty",
)


def with_id(requests: DataFrame) -> DataFrame:
    """Requests with an id of their content: equal questions have one id, in every run."""
    content = [c for c in requests.columns if c in CONTENT]
    return requests.withColumn(REQUEST_ID, F.sha2(F.to_json(F.struct(*content)), 256))


def reply_texts(replies: DataFrame) -> DataFrame:
    """``request_id, SummaryAbstract`` of the replies (``request_id, body``) that hold an answer."""
    content = F.get(F.from_json("body", ANSWER_BODY)["choices"], F.lit(0))["message"]["content"]
    texts = replies.select(REQUEST_ID, strip(content).alias("content"))
    # A question that was answered twice keeps its smallest answer.
    return texts.groupBy(REQUEST_ID).agg(F.min("content").alias("SummaryAbstract")).where(
        F.col("SummaryAbstract").isNotNull()
    )


def unanswered(requests: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Each question once that no reply has answered yet; a failed reply leaves it open."""
    asked = requests.select(REQUEST_ID, *[c for c in requests.columns if c in CONTENT])
    if replies is not None:
        # Equal questions are many where abstracts are copied: the join is hot-safe.
        asked = drop_matching(asked, reply_texts(replies).select(REQUEST_ID), REQUEST_ID)
    return asked.dropDuplicates([REQUEST_ID])


def write_requests(
    requests: DataFrame, path: str, replies: DataFrame | None = None, file_bytes: int = FILE_BYTES
) -> int:
    """Write what is still to be asked as JSON lines in files of bounded size; how many there are.

    A line has the ``custom_id`` by which its reply is found again and the ``body`` to send.  The
    folder is overwritten: after replies have come in, a second call leaves only the rest.
    """
    content = [c for c in requests.columns if c in CONTENT]
    line = F.to_json(F.struct(F.col(REQUEST_ID).alias("custom_id"), F.struct(*content).alias("body")))
    lines = write_once(unanswered(requests, replies).select(line.alias("value")), "requests")
    sizes = lines.agg(F.count("*").alias("n"), F.max(F.octet_length("value")).alias("most")).first()
    if not sizes["n"]:
        lines.limit(0).write.mode("overwrite").text(path)
        return 0
    per_file = max(1, file_bytes // (sizes["most"] + 1))
    lines.write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)
    return sizes["n"]


def asking(
    path: str,
    replies: DataFrame | None = None,
    prompt: str = K.BASE_PROMPT,
    model: str = K.MODEL,
    spread: str = "row_id",
) -> Extractor:
    """An extractor in two phases: takes the answers there are and writes the open questions to ``path``.

    Run it without replies, send what it wrote, run it again with the replies: it asks only for
    what is missing, and papers without an answer get ``''``.
    """

    def extract(papers: DataFrame) -> DataFrame:
        requests = with_id(prompt_requests(papers, prompt, model))
        write_requests(requests, path, replies)
        if replies is None:
            return papers.withColumn("SummaryAbstract", F.lit(""))
        asked = papers.withColumn("Abstract", or_blank(F.col("Abstract")))
        ids = with_id(prompt_requests(asked, prompt, model, spread)).select(spread, REQUEST_ID)
        known = attach(ids, reply_texts(replies), REQUEST_ID, spread).drop(REQUEST_ID)
        # ``spread`` names one row on either side.
        return papers.join(known, spread, "left").withColumn(
            "SummaryAbstract", or_blank(F.col("SummaryAbstract"))
        )

    return extract


def answered(responses: DataFrame, spread: str = "row_id") -> Extractor:
    """An extractor that takes the summaries from a table of model replies."""
    return lambda papers: attach(papers, answers(responses), "paper_key", spread).withColumn(
        "SummaryAbstract", or_blank(F.col("SummaryAbstract"))
    )


def answers(responses: DataFrame) -> DataFrame:
    """``paper_key, SummaryAbstract`` from ``paper_key, body``.

    A paper asked more than once keeps its smallest non-null answer, so that it stays one row.
    """
    content = F.get(F.from_json("body", ANSWER_BODY)["choices"], F.lit(0))["message"]["content"]
    return (
        responses.select("paper_key", strip(content).alias("content"))
        .groupBy("paper_key")
        .agg(or_blank(F.min("content")).alias("SummaryAbstract"))
    )
