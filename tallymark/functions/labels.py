"""Class labels: normalising, mapping and validating them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixed import (
    ALTERNATIVE_LABEL_PATTERN,
    CLASSES,
    FAILED,
    KEEP_CLASSES,
    SUBJECT_SUGGESTION_PATTERN,
)
from tallymark.functions.text import _text, trim_all
from tallymark.schemas import REPLY


def drop_parenthesis(column: str | Column) -> Column:
    """Remove from the first ``(`` to the last ``)`` of the same line, once; trim."""
    return trim_all(
        F.regexp_replace(_text(column), F.lit(r"(?s)^(.*?)\([^\n]*\)(.*)$"), F.lit("$1$2"))
    )


def normalise_label(column: str | Column) -> Column:
    """Class name without its parenthesis; the reply ``na`` is a failure."""
    label = drop_parenthesis(column)
    return F.when(label == "na", F.lit(FAILED)).otherwise(label)


def map_values(column: str | Column, mapping: Mapping[str, str], unmapped: str = "keep") -> Column:
    """Replace values through a small literal map.

    ``unmapped`` is ``keep`` (value stays), ``null`` or ``error``. For mappings
    that come as a table use :func:`map_by_table`.
    """
    value = _text(column)
    table = F.create_map(*(F.lit(item) for item in chain.from_iterable(mapping.items())))
    found = F.try_element_at(table, value)
    if unmapped == "keep":
        return F.coalesce(found, value)
    if unmapped == "null":
        return found
    if unmapped == "error":
        failure = F.raise_error(F.concat(F.lit("no mapping for "), value)).cast("string")
        return F.when(found.isNull() & value.isNotNull(), failure).otherwise(found)
    raise ValueError(f"unknown mode {unmapped!r}")


def map_by_table(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    source: str,
    target: str,
    unmapped: str = "keep",
) -> DataFrame:
    """Replace values through a mapping frame; swap source and target to reverse it."""
    lookup = mapping.select(F.col(source).alias(column), F.col(target).alias("__mapped"))
    joined = df.join(lookup, column, "left")
    found, value = F.col("__mapped"), F.col(column)
    if unmapped == "keep":
        found = F.coalesce(found, value)
    elif unmapped == "error":
        failure = F.raise_error(F.concat(F.lit("no mapping for "), value)).cast("string")
        found = F.when(found.isNull() & value.isNotNull(), failure).otherwise(found)
    elif unmapped != "null":
        raise ValueError(f"unknown mode {unmapped!r}")
    return joined.withColumn(column, found).drop("__mapped").select(*df.columns)


def is_kept_class(column: str | Column, kept: Sequence[str] = KEEP_CLASSES) -> Column:
    return _text(column).isin(list(kept))


def any_equals(columns: Sequence[str], value: str) -> Column:
    """True when any of the columns equals ``value``; nulls do not match."""
    tests = (F.coalesce(F.col(name) == value, F.lit(False)) for name in columns)
    return reduce(lambda left, right: left | right, tests)


def _record(column: str | Column) -> Column:
    schema = ", ".join(f"{name} variant" for name in REPLY.fieldNames())
    return F.from_json(_text(column), schema, {"mode": "PERMISSIVE"})


def _texts(record: Column) -> Column:
    def text(name: str) -> Column:
        found = F.try_variant_get(record[name], "$", "string")
        return F.when(F.schema_of_variant(record[name]) == "STRING", found).alias(name)

    return F.struct(*[text(name) for name in REPLY.fieldNames()])


def parse_reply(column: str | Column) -> Column:
    """JSON reply as a struct of texts.

    Fields that are missing or hold anything but a JSON string are null, and so
    are all fields of text that is no JSON record.
    """
    return _texts(_record(column))


def reply_is_valid(reply: Column, classes: Sequence[str] = CLASSES) -> Column:
    """All three fields present, the class known and the free fields well formed."""
    return F.coalesce(
        reply["class_label"].isin(list(classes))
        & reply["alternative_label"].rlike(ALTERNATIVE_LABEL_PATTERN.replace("$", r"\z"))
        & reply["subject_suggestion"].rlike(SUBJECT_SUGGESTION_PATTERN.replace("$", r"\z")),
        F.lit(False),
    )


def with_reply(
    df: DataFrame, column: str, classes: Sequence[str] = CLASSES, valid: str | None = None
) -> DataFrame:
    """Add the three text columns of a prediction; a bad reply fails all of them.

    Step by step, so that each reply is parsed once. ``valid`` names a flag column.
    """
    parsed = (
        df.withColumn("__record", _record(column))
        .withColumn("__reply", _texts(F.col("__record")))
        .withColumn("__valid", reply_is_valid(F.col("__reply"), classes))
    )

    def pick(field: str) -> Column:
        return F.when(F.col("__valid"), F.col(f"__reply.{field}")).otherwise(F.lit(FAILED))

    out = parsed.withColumns(
        {
            "primary_category": pick("class_label"),
            "subject_suggestion": pick("subject_suggestion"),
            "alternative_category": pick("alternative_label"),
        }
    )
    if valid is not None:
        out = out.withColumn(valid, F.col("__valid"))
    return out.drop("__record", "__reply", "__valid")
