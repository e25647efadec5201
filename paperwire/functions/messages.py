"""Message texts as column expressions."""

from __future__ import annotations

import datetime as dt
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperwire import constants as K


def fill(template: str, **fields: Column) -> Column:
    """``template`` with its ``{names}`` replaced by columns; NULL if any of them is."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(fields[name])
    return F.concat(*parts)


def utc(moment: dt.datetime) -> Column:
    """A naive UTC datetime as a TIMESTAMP_NTZ literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def header_time(ts: Column) -> Column:
    """A UTC timestamp as the header's local time text."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(K.HEADER_ZONE), ts)
    return F.date_format(local, K.HEADER_TIME_FORMAT)


def header(ts: Column, source: Column, position: Column, total: Column) -> Column:
    return fill(
        K.HEADER,
        time=header_time(ts),
        source=source,
        position=position.cast("string"),
        total=total.cast("string"),
    )


def message(
    channel: str, head: Column, title: Column, link: Column, authors: Column, keywords: Column
) -> Column:
    """The text one channel gets for one paper (M1 to M4)."""
    return fill(
        K.MESSAGES[channel],
        header=head, title=title, link=link, authors=authors, keywords=keywords,
    )


def payload(channel: str, text: Column) -> Column:
    """What is posted: a JSON object for Slack (I16), the text itself elsewhere."""
    return F.to_json(F.struct(text.alias("text"))) if channel == "slack" else text


def username(channel: str) -> Column:
    return F.lit(K.DISCORD_USERNAME if channel == "discord" else None).cast("string")
