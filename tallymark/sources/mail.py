"""Raw mail messages to a message table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from email import message_from_bytes
from email.errors import HeaderParseError
from email.header import decode_header
from email.message import Message
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.fixed import MISSING_DATE
from tallymark.schemas import MESSAGE

_MISSING = dt.datetime.fromisoformat(f"{MISSING_DATE}T00:00:00+00:00")


def decode_bytes(raw: bytes, declared: str | None = None) -> str:
    """UTF-8 where valid, else the declared charset, else Latin-1, which accepts any byte."""
    for charset in ("utf-8", declared, "latin-1"):
        try:
            if charset:
                return raw.decode(charset)
        except (LookupError, UnicodeError):
            continue
    return ""


def decode_header_text(value: object, first_chunk: bool = False) -> str:
    """A header with all its encoded words decoded, or as it stands if they are malformed.

    ``first_chunk`` keeps what comes before the first change of encoding only.
    """
    text = "" if value is None else str(value)
    try:
        chunks = decode_header(text)
    except (HeaderParseError, ValueError):
        return text
    words = [decode_bytes(c, charset) if isinstance(c, bytes) else c for c, charset in chunks]
    return words[0] if first_chunk else "".join(words)


def parse_date(text: str) -> dt.datetime:
    """The moment a date header names, in UTC; the sentinel if it names none that exists."""
    try:
        moment = parsedate_to_datetime(text)
        return (moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc)
    except (TypeError, ValueError, OverflowError, IndexError):
        return _MISSING


@dataclass
class _Contents:
    """What one walk over the parts of a message finds."""

    body: str | None = None
    attachments: int = 0


def _contents(message: Message) -> _Contents:
    found = _Contents()
    for part in message.walk():
        if part.get_content_maintype() == "multipart":
            continue
        placed = part.get_content_disposition()
        if placed is not None and part.get_filename():
            found.attachments += 1
        readable = part is message or (part.get_content_type() in ("text/plain", "text/html") and placed != "attachment")
        if found.body is None and readable:
            content = part.get_payload(decode=True)
            found.body = decode_bytes(content or b"", part.get_content_charset())
    return found


def read_message(raw: bytes | None, first_chunk: bool = False) -> dict:
    """The fields of one message. None of them can fail: what can't be read is empty or the sentinel."""
    raw = b"" if raw is None else bytes(raw)
    message = message_from_bytes(raw)
    date_text = str(message.get("Date", ""))
    try:
        found = _contents(message)
    except (LookupError, ValueError, TypeError, AttributeError, HeaderParseError):
        # Part headers beyond repair: everything after the head is the body.
        found = _Contents(decode_bytes(raw.partition(b"\n\n")[2]))
    return {
        "subject": decode_header_text(message.get("Subject"), first_chunk),
        "from": decode_header_text(message.get("From"), first_chunk),
        "date": parse_date(date_text),
        "date_str": date_text,
        "size": len(raw),
        "attachments": found.attachments,
        "multipart": message.is_multipart(),
        "body": found.body or "",
    }


def parse_messages(
    df: DataFrame, content: str = "content", keep: tuple[str, ...] = (), first_chunk: bool = False
) -> DataFrame:
    """One message row per row of raw bytes; ``keep`` columns pass through. Null content is an empty message."""
    schema = T.StructType([df.schema[name] for name in keep] + MESSAGE.fields)
    fields = [field.name for field in MESSAGE.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([read_message(raw, first_chunk) for raw in batch[content]], columns=fields)
            # Microseconds: years before 1678 do not fit a nanosecond column.
            rows["date"] = rows["date"].astype("datetime64[us, UTC]")
            for name in reversed(keep):
                rows.insert(0, name, batch[name].to_numpy())
            yield rows

    return df.select(*keep, content).mapInPandas(parse, schema)


def read_messages(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """Message files below a folder, one message each; every message is kept."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return parse_messages(files)
