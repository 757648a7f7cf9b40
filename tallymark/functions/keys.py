"""Message identity and repeatable random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.schemas import NATURAL_KEY


def message_id(parts: Sequence[str] = NATURAL_KEY) -> Column:
    """Digest of the key parts, for grouping: nulls form a group of their own.

    Every part carries its length, so moving text between parts changes the id.
    A 64-character id shuffles in place of the whole body.
    """
    marked = []
    for part in parts:
        text = F.col(part).cast("string")
        marked.append(
            F.coalesce(
                F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text),
                F.lit("null"),
            )
        )
    return F.sha2(F.concat_ws("|", *marked), 256)


def match_id(parts: Sequence[str] = NATURAL_KEY) -> Column:
    """As :func:`message_id`, for joins: null when any part is null, so it matches nothing."""
    complete = F.lit(True)
    for part in parts:
        complete = complete & F.col(part).isNotNull()
    return F.when(complete, message_id(parts))


def order_hash(key: str | Column, seed: int) -> Column:
    """Seeded pseudo-random order: any engine with md5 gives the same one."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f":{seed}")))


def hash_prefix(hashed: Column, digits: int = 3) -> Column:
    """Leading hex digits of an order hash: even buckets that follow its order."""
    return F.substring(hashed, 1, digits)
