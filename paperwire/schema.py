"""Declared schemas (nothing is inferred) and the job's parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from paperwire import constants as K

PAPER = {
    "paper_key": "STRING",
    "source_kind": "STRING",
    "source_rank": "INT",
    "source_seq": "BIGINT",
    "published": "DATE",
    "Title": "STRING",
    "Authors": "ARRAY<STRING>",
    "Source": "STRING",
    "Abstract": "STRING",
    "PMID": "STRING",
    "Affiliation": "ARRAY<STRING>",
    "DOI": "STRING",
    "paperLink": "STRING",
}

LANDING = """
    source STRING, query_key STRING, cursor BIGINT, url STRING, status INT, body STRING,
    fetched TIMESTAMP
"""

# With the days of a reply's items, written when it lands.
LANDED = f"{LANDING}, first_day DATE, last_day DATE, undated BIGINT"
BIORXIV_DAYS = "collection ARRAY<STRUCT<date: STRING>>"
CHEMRXIV_DAYS = "itemHits ARRAY<STRUCT<item: STRUCT<publishedDate: STRING>>>"
ATOM_DAYS = "entry ARRAY<STRUCT<published: STRING>>"

BIORXIV_BODY = """
    collection ARRAY<STRUCT<doi: STRING, title: STRING, abstract: STRING, authors: STRING,
        author_corresponding_institution: STRING, date: STRING>>
"""

CHEMRXIV_BODY = """
    itemHits ARRAY<STRUCT<item: STRUCT<title: STRING, abstract: STRING, doi: STRING,
        publishedDate: STRING,
        authors: ARRAY<STRUCT<firstName: STRING, lastName: STRING,
            institutions: ARRAY<STRUCT<name: STRING>>>>>>>
"""

ATOM_ENTRY = """
    id STRING, published STRING, title STRING, summary STRING,
    author ARRAY<STRUCT<name: STRING>>, `arxiv:doi` STRING,
    link ARRAY<STRUCT<_href: STRING, _rel: STRING>>
"""

ATOM_BODY = """
    entry ARRAY<STRUCT<id: STRING, published: STRING, title: STRING, summary: STRING,
        author: ARRAY<STRUCT<name: STRING>>, `arxiv:doi`: STRING,
        link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>>>
"""

OUTBOX = {
    "channel": "STRING",
    "paper_key": "STRING",
    "position": "BIGINT",
    "total": "BIGINT",
    "title": "STRING",
    "message": "STRING",
    "payload": "STRING",
    "username": "STRING",
}

ANSWER_BODY = "choices ARRAY<STRUCT<message: STRUCT<role: STRING, content: STRING>>>"


@dataclass(frozen=True)
class JobConfig:
    """What a user may set for one run; ``run_ts`` is one naive UTC instant for all of it."""

    term: str
    term_biorxiv: str
    term_chemrxiv: str
    run_ts: dt.datetime = field(
        default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    )
    datetype: str = "edat"
    pubmed_days: int = 1
    arxiv_days: int = 3
    biorxiv_days: int = 1
    chemrxiv_days: int = 1
    arxiv_include_upper: bool = False
    page_limit: int | None = None
    arxiv_top: int = K.ARXIV_TOP
    chemrxiv_limit: int = K.CHEMRXIV_LIMIT
    prompt: str = K.BASE_PROMPT
    model: str = K.MODEL
    sources: tuple[str, ...] = K.SOURCE_ORDER
    channels: tuple[str, ...] = tuple(K.MESSAGES)

    @property
    def run_date(self) -> dt.date:
        return self.run_ts.date()


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())
