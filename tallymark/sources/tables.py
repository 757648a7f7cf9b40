"""Reading and writing parquet tables and folder trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import DENIED_FOLDERS, DISPLAY_NAMES, EARLIEST_DATE
from tallymark.functions.labels import map_values, normalise_label
from tallymark.operators.filters import dated, timestamp_utc


def scan(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet files, a folder or a glob; only the named columns are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*[f"`{name}`" for name in columns]) if columns else df


#: Splits from which on a table is never dealt out anew.
SMALL_SCAN = 32


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small table out by key when its scan would leave cores idle.

    For work that is heavy per row (cleaning, parsing). Tables of ``SMALL_SCAN`` splits or
    more pass through without a shuffle, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, SMALL_SCAN) else df


def scan_model_tree(
    spark: SparkSession,
    root: str,
    denied: Sequence[str] = DENIED_FOLDERS,
    *,
    pattern: str = "*.parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """All files below ``root``, with the folder of each file as ``model_key``.

    Files directly in ``root`` and denied folders are left out. The folder is
    file metadata, so whole files are skipped before they are opened. A
    ``name=value`` folder, as written by ``partitionBy``, counts as its value.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    key = F.regexp_replace(folder, "^[^=]*=", "")
    top = root.rstrip("/").rsplit("/", 1)[-1]
    return df.withColumn("model_key", key).filter(
        ~F.col("model_key").isin([*denied, top.split("=", 1)[-1]])
    )


def integrate(
    df: DataFrame,
    names: Mapping[str, str] = DISPLAY_NAMES,
    *,
    category: str = "primary_category",
    after: str = EARLIEST_DATE,
) -> DataFrame:
    """Predictions of all models as one table: typed dates, plain classes, display names."""
    return dated(
        df.withColumns(
            {
                "date": timestamp_utc("date"),
                category: normalise_label(category),
                "model": map_values("model_key", names, unmapped="error"),
            }
        ),
        after=after,
    ).drop("model_key")


def write(
    df: DataFrame,
    path: str,
    *,
    by: Sequence[str] = (),
    level: int = 4,
    mode: str = "errorifexists",
) -> None:
    """Zstandard parquet at a chosen level, optionally one folder per key.

    With keys, rows are first rebalanced by them: adaptive execution merges
    small partitions and splits that of a hot key, so that the tasks neither
    write one file per key each nor leave a key to a single task.
    """
    if by:
        df = df.hint("rebalance", *[F.col(name) for name in by])
    writer = (
        df.write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", str(level))
        .option("maxRecordsPerFile", 5_000_000)
    )
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_pipe_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A markdown pipe table. Columns are taken in order; the types come from ``schema``.

    The first line is the heading. The file is read as one text, as suits a
    hand-written table of model parameters.
    """
    return parse_pipe_table(spark.read.text(path, wholetext=True), "value", schema)


def parse_pipe_table(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows of the pipe tables held as whole texts in ``column``."""
    rule = r"^\s*\|?[\s:|-]*-[\s:|-]*$"
    lines = F.filter(F.split(F.col(column), r"\r?\n"), lambda line: F.trim(line) != "")
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda line: ~line.rlike(rule))
    cells = F.transform(
        F.split(F.col("line"), r"\|"), lambda cell: F.regexp_replace(cell, r"^\s+|\s+$", "")
    )
    rows = df.select(F.explode(body).alias("line")).select(cells.alias("cells"))
    inner = F.slice(F.col("cells"), 2, F.size("cells") - 2)
    return rows.select(
        *[
            F.get(inner, F.lit(i)).try_cast(field.dataType).alias(field.name)
            for i, field in enumerate(schema.fields)
        ]
    )
