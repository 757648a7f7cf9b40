"""Reading the tables these operators work on, and running Arrow functions over them."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words: everything else belongs to a word.
SPACE = " \t\n\x0b\x0c\r"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever stands in their names."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Rows that go to Python at a time: texts are long, and batches of them stay in memory on both sides.
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Spark removes the shuffle files of a finished query, not only once its driver happens to collect garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the queries that start and end inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def map_rows(
    df: DataFrame,
    columns: Sequence[str | Column],
    function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``function`` over batches that hold ``columns`` only, in the given order.

    Batches are read by position, so further columns of ``df``, whatever their
    names, neither reach Python nor clash with the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    bound_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def map_whole(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``function`` over batches of all columns of ``df``, which come back by their places under the names they had."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(name, field.dataType) for name, field in zip(plain, df.schema)])
    return map_rows(df, [c.alias(name) for c, name in zip(columns_of(df), plain)], function, schema).toDF(*df.columns)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks."""
    holder = sys.modules.setdefault("tallymark_worker_state", types.ModuleType("tallymark_worker_state"))
    return holder.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, so that one batch of very long texts stays small."""
    texts = batch.column(column)
    start = held = 0
    for i in range(len(texts)):
        text = texts[i]
        held += len(text.as_buffer()) if text.is_valid else 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(texts):
        yield batch.slice(start)
