"""Cleaning, counting and composing message text.

Patterns use explicit character classes so that Java and RE2 engines read them
alike. ``SPACE`` lists what counts as white space for Unicode-aware text
handling; ``BREAK`` is the part of it that ends a line.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import MAX_TOKENS, MISSING_DATE

SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
BREAK = r"\x0a-\x0d\x1c-\x1e\x85\x{2028}\x{2029}"
BLANK = r"\x09\x1f\x20\p{Zs}"

# The characters of SPACE, for the trim functions.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680])) + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

URL = rf"https?://[^{SPACE}]+"
# Comments, scripts and styles in one left-to-right pass, so that a comment
# mark inside a script (or the reverse) does not open anything.
HIDDEN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
)
# Possessive repeats (``*+``) keep the matcher from recursing or backtracking
# over a stray ``<`` in front of a long text full of quotes.
TAG = r"""<[/!?A-Za-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
BROKEN_TAG = r"<[/!?A-Za-z][^>]*>"
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _text(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _only_if(text: Column, mark: str, changed: Column) -> Column:
    """Run patterns only on text that holds ``mark``: most plain text has none."""
    return F.when(text.contains(mark), changed).otherwise(text)


def remove_urls(column: str | Column) -> Column:
    """Delete web addresses; null becomes empty."""
    text = F.coalesce(_text(column), F.lit(""))
    return _only_if(text, "http", F.regexp_replace(text, F.lit(URL), F.lit("")))


def collapse_newlines(column: str | Column) -> Column:
    return F.regexp_replace(_text(column), F.lit(r"[\n\r]+"), F.lit("\n"))


def collapse_spaces(column: str | Column) -> Column:
    return F.regexp_replace(_text(column), F.lit(rf"[{SPACE}]+"), F.lit(" "))


def trim_all(column: str | Column) -> Column:
    """Strip every kind of white space from both ends, not only spaces."""
    return F.btrim(_text(column), F.lit(SPACES))


def trim_lines(column: str | Column) -> Column:
    """Strip each line, drop one closing line break, then join the lines by spaces.

    Inside the text that is the same as collapsing white space. Only the ends
    differ: a line break before the first word leaves a space, and so does one
    after the last word unless it closes the text.
    """
    text = _text(column)
    inner = trim_all(text)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(F.ltrim(text, F.lit(SPACES))))
    after = F.substring(
        text, F.length(F.rtrim(text, F.lit(SPACES))) + F.lit(1), F.length(text)
    )
    opened = (F.length(inner) > 0) & before.rlike(rf"[{BREAK}]")
    closed = collapse_newlines(after).rlike(rf"(?s)[{BREAK}].")
    return F.concat(
        F.when(opened, F.lit(" ")).otherwise(F.lit("")),
        collapse_spaces(inner),
        F.when(closed, F.lit(" ")).otherwise(F.lit("")),
    )


def _without_hidden(text: Column) -> Column:
    return _only_if(text, "<", F.regexp_replace(text, F.lit(HIDDEN), F.lit("")))


def _without_tags(text: Column) -> Column:
    # Behind the last > there are no tags. Leaving that part out keeps the
    # patterns from running to the end of the text for every stray <.
    tail = F.substring_index(text, ">", -1)
    bare = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    for pattern in (TAG, BROKEN_TAG):
        bare = F.regexp_replace(bare, F.lit(pattern), F.lit(""))
    return _only_if(text, "<", F.concat(bare, tail))


def strip_markup(column: str | Column) -> Column:
    """Remove comments, scripts, styles and tags; entities stay encoded."""
    return _without_tags(_without_hidden(F.coalesce(_text(column), F.lit(""))))


@F.pandas_udf(T.StringType())
def _unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(html.unescape, na_action="ignore")


def decode_entities(column: str | Column) -> Column:
    """Decode character references exactly.

    The common ones are replaced inside the JVM. Only text that holds anything
    else is sent to a Python worker; for the other rows the worker sees a null.
    ``&amp;`` goes last, so a doubly encoded reference is decoded once.
    """
    text = _text(column)
    common = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
    rest = F.regexp_replace(text, F.lit("&(?:lt|gt|quot|#39|nbsp|amp);"), F.lit(""))
    plain = text
    for reference, character in {**common, "&amp;": "&"}.items():
        plain = F.replace(plain, F.lit(reference), F.lit(character))
    rare = F.when(text.contains("&") & rest.rlike("&[#A-Za-z]"), text)
    return F.coalesce(_unescape(rare), plain)


def clean_html(column: str | Column) -> Column:
    """Visible text of an HTML body on one line; null becomes empty."""
    return trim_lines(decode_entities(strip_markup(column)))


def clean_text(column: str | Column) -> Column:
    """Addresses go first, then markup: an address may take a closing tag with it."""
    return clean_html(remove_urls(column))


def clean_or_raw(column: str | Column) -> Column:
    """Cleaned text, or the raw body when nothing visible is left."""
    return _or_raw(trim_all(clean_text(column)), _text(column))


def _or_raw(cleaned: Column, raw: Column) -> Column:
    return F.when(F.length(cleaned) == 0, raw).otherwise(cleaned)


def with_clean_text(df: DataFrame, body: str, name: str, *, or_raw: bool = False) -> DataFrame:
    """Add the cleaned text of ``body`` step by step.

    Same result as :func:`clean_text` (or :func:`clean_or_raw`). The steps are
    columns of their own, so the patterns run once per row although the decoder
    needs their result in three places.
    """
    steps = (
        df.withColumn("__shown", _without_hidden(remove_urls(body)))
        .withColumn("__bare", _without_tags(F.col("__shown")))
        .withColumn("__decoded", decode_entities("__bare"))
        .withColumn("__line", trim_lines("__decoded"))
    )
    if or_raw:
        steps = steps.withColumn("__line", trim_all("__line"))
        steps = steps.withColumn("__line", _or_raw(F.col("__line"), F.col(body)))
    return steps.withColumn(name, F.col("__line")).drop("__shown", "__bare", "__decoded", "__line")


def count_tokens(column: str | Column, *, is_cleaned: bool = True) -> Column:
    """Words and punctuation marks; ``is_cleaned=False`` cleans first."""
    text = _text(column) if is_cleaned else clean_text(column)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def count_tokens_with(make_encoder: Callable[[], Callable[[str], list]]) -> Callable:
    """Token count by a user's encoder; the encoder is built once per task."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for batch in texts:
            yield batch.fillna("").map(lambda text: len(encode(text)))

    return count


def truncate_to_tokens(column: str | Column, tokens: str | Column, limit: int = MAX_TOKENS) -> Column:
    """Keep the share of characters that ``limit`` tokens take up."""
    text, count = _text(column), _text(tokens)
    keep = F.floor(F.length(text).cast("double") * F.lit(limit) / (count + F.lit(1)))
    return F.substring(text, F.lit(1), keep.cast("int"))


def compose(subject: str | Column, sender: str | Column, text: str | Column) -> Column:
    """Model input: two header lines and the text. A null header prints as None."""
    return F.concat(
        F.lit("Subject: "),
        F.coalesce(_text(subject), F.lit("None")),
        F.lit("\nFrom: "),
        F.coalesce(_text(sender), F.lit("None")),
        F.lit("\n"),
        _text(text),
    )


def drop_invalid_utf8(column: str | Column) -> Column:
    """Drop characters that are not valid UTF-8 (they turn into U+FFFD, which is removed)."""
    return F.replace(F.make_valid_utf8(_text(column)), F.lit("�"), F.lit(""))


def decode_bytes(column: str | Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 (which never fails) where that is not valid."""
    raw = _text(column)
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))


def parse_date(column: str | Column, pattern: str) -> Column:
    """Header date as a timestamp; missing or unreadable dates get a sentinel."""
    return F.coalesce(
        F.try_to_timestamp(_text(column), F.lit(pattern)),
        F.lit(f"{MISSING_DATE} 00:00:00+00:00").cast("timestamp"),
    )


DEFAULT_PROMPT = """\
Assign this message to exactly one of the classes below. Use "Other" when none fits.
Also give an alternative class in one to three words and a one-word subject.

Classes:
{classes}

From: {from}
Date: {date}
Subject: {subject}

{text}
"""


def render_prompt(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template from columns, in one concat."""
    pieces: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in fields]
        places = [place for place in places if place[0] >= 0]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)
