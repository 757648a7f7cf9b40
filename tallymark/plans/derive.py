"""Message, vote and label tables derived from the given tables.

Whole-number arithmetic only, so that any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.fixed import CLASSES, DISPLAY_NAMES
from tallymark.sources.tables import spread

#: Folder names of the models that vote; position in the list is the model number.
MODEL_KEYS = ["granite3_1-dense-8b", "tulu3", "llama3_1", "falcon3_7b"]
MODELS = [DISPLAY_NAMES[key] for key in MODEL_KEYS]
#: Every class a derived vote can have.
CLASS_NAMES = [f"c{i}" for i in range(11)] + ["N/A"]
START = 1_704_067_200  # 2024-01-01 in seconds
SENTINEL = -5_364_662_400  # 1800-01-01 in seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _class(number: Column) -> Column:
    return F.concat(F.lit("c"), number.cast("string"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mail messages, one an hour; every fiftieth has no date."""
    doc = F.col("doc_id")
    seconds = F.when(doc % 50 == 0, F.lit(SENTINEL)).otherwise(F.lit(START) + doc * F.lit(3600))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        F.substring("text", 1, 20).alias("subject"),
        F.col("source").alias("from"),
        F.col("text").alias("body"),
        F.timestamp_seconds(seconds).alias("date"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (document, model): class, failure marker or null for not seen."""
    doc, k = F.col("doc_id"), F.col("k")
    return _votes(table(spark, sf_dir, "documents").select("doc_id"), doc, k).select(
        "doc_id",
        "k",
        "model_key",
        "model",
        F.when((doc + k) % 29 == 0, None)
        .when(doc % 97 == 0, F.lit("N/A"))
        .otherwise(F.col("category"))
        .alias("category"),
        "duration",
    )


def plain_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`votes`, with every model having seen every document."""
    doc, k = F.col("doc_id"), F.col("k")
    return _votes(table(spark, sf_dir, "documents").select("doc_id"), doc, k)


def _votes(docs: DataFrame, doc: Column, k: Column, shift: Column | None = None) -> DataFrame:
    models = F.array(
        *[
            F.struct(F.lit(i).alias("k"), F.lit(key).alias("model_key"), F.lit(name).alias("model"))
            for i, (key, name) in enumerate(zip(MODEL_KEYS, MODELS))
        ]
    )
    at = doc + shift if shift is not None else doc
    category = (
        F.when((at * 13 + k) % 23 == 0, F.lit("N/A"))
        .when((at * 31 + k * 17) % (k + 5) == 0, _class((doc % 11 + k + 1) % 11))
        .otherwise(_class(doc % 11))
    )
    duration = (((doc * 37 + k * 101) % 1000) * (k + 1)).cast("double") / F.lit(100.0)
    return docs.select("*", F.inline(models)).withColumns({"category": category, "duration": duration})


def resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty repeated votes of every model on every labelled document."""
    docs = table(spark, sf_dir, "labels").select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("sample")
    )
    doc, k = F.col("doc_id"), F.col("k")
    return _votes(docs, doc, k, shift=F.col("sample") * (k + 1))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels of the labelled documents."""
    return table(spark, sf_dir, "labels").select("doc_id", _class(F.col("doc_id") % 11).alias("truth"))


def labelled_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on labelled documents. Both sides are slim and join on the document number."""
    return truth(spark, sf_dir).join(votes(spark, sf_dir), "doc_id", "left")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies as JSON text; every seventh is broken in one of four ways."""
    doc = F.col("doc_id")
    classes = F.array(*[F.lit(name) for name in CLASSES])
    known = F.element_at(classes, (doc % 11 + 1).cast("int"))
    bad = doc % 7 == 0
    kind = F.floor(doc / F.lit(7)) % 4
    record = F.to_json(
        F.struct(
            F.when(bad & (kind == 0), F.lit("Unknown class")).otherwise(known).alias("class_label"),
            F.when(bad & (kind == 1), F.lit("Two Words!")).otherwise(F.col("lang")).alias("alternative_label"),
            F.when(bad & (kind == 2), F.lit(None).cast("string"))
            .otherwise(F.lit("note"))
            .alias("subject_suggestion"),
        )
    )
    reply = F.when(bad & (kind == 3), F.concat(F.lit("no json, "), F.col("lang"))).otherwise(record)
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cluster labelings: a permutation of each other with some noise."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        label.alias("c1"),
        F.when(F.col("vec_id") % 9 == 0, label).otherwise((label * 3 + 1) % 10).alias("c2"),
    )


def separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a class that can be learned: the signs of two elements."""
    first, second = F.element_at("embedding", 1), F.element_at("embedding", 2)
    quadrant = (first > 0).cast("int") * 2 + (second > 0).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("q"), quadrant.cast("string")).alias("label")
    )


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text starts with their own address."""
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        "page_id", F.concat(F.col("url"), F.lit(" "), F.col("html")).alias("body")
    )
