"""Batch classification by a predictor the user supplies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import CLASSES, RESAMPLE_TEMPERATURE, RESAMPLES
from tallymark.functions.labels import with_reply
from tallymark.functions.text import DEFAULT_PROMPT, render_prompt, with_clean_text
from tallymark.operators.joins import pending_work, work_list
from tallymark.operators.sampling import stratified_sample

Predictor = Callable[[str, str, float], str]


def prompts(df: DataFrame, template: str = DEFAULT_PROMPT, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Add ``prompt``: the template filled with the message and its cleaned body."""
    filled = template.replace("{classes}", "\n".join(f"- {name}" for name in classes))
    fields = {
        "from": F.col("from"),
        "date": F.to_date("date"),
        "subject": F.col("subject"),
        "text": F.col("__clean"),
    }
    cleaned = with_clean_text(df, "body", "__clean", or_raw=True)
    return cleaned.withColumn("prompt", render_prompt(filled, fields)).drop("__clean")


def ask(
    df: DataFrame,
    make_predictor: Callable[[], Predictor],
    *,
    prompt: str = "prompt",
    temperature: float = 0.0,
) -> DataFrame:
    """Add the raw ``reply`` and ``inference_duration`` of every row.

    The predictor is built once per task and takes (prompt, model,
    temperature). A call that raises gives a null reply and keeps its duration.
    """
    schema = T.StructType(
        df.drop(prompt).schema.fields
        + [T.StructField("reply", T.StringType()), T.StructField("inference_duration", T.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predictor()
        for batch in batches:
            replies, seconds = [], []
            for text, model in zip(batch[prompt], batch["model"]):
                start = time.perf_counter()
                try:
                    replies.append(predict(text, model, temperature))
                except Exception:  # any failure of the model is a failed row
                    replies.append(None)
                seconds.append(time.perf_counter() - start)
            yield batch.drop(columns=prompt).assign(reply=replies, inference_duration=seconds)

    return df.mapInPandas(run, schema)


def classify_prompts(
    work: DataFrame,
    make_predictor: Callable[[], Predictor],
    *,
    temperature: float = 0.0,
    classes: Sequence[str] = CLASSES,
    tasks: int | None = None,
) -> DataFrame:
    """Predictions for rows of (prompt, model); bad replies become failures.

    Calls cost far more than moving a prompt, so the rows are dealt out evenly
    over ``tasks``; otherwise the calls for a small sample would share one task.
    """
    tasks = tasks or max(
        work.sparkSession.sparkContext.defaultParallelism,
        int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    spread = work.repartition(tasks, F.xxhash64(*[c for c in work.columns if c != "prompt"], "prompt"))
    asked = ask(spread, make_predictor, temperature=temperature)
    return with_reply(asked, "reply", classes).drop("reply")


def classify_messages(
    messages: DataFrame,
    models: Sequence[str],
    make_predictor: Callable[[], Predictor],
    *,
    template: str = DEFAULT_PROMPT,
    resamples: int | None = None,
    classes: Sequence[str] = CLASSES,
    **how,
) -> DataFrame:
    """Predictions of every model for every message; a message is cleaned once."""
    work = work_list(prompts(messages, template, classes), models, resamples)
    return classify_prompts(work, make_predictor, classes=classes, **how)


def classify_pending(
    messages: DataFrame,
    models: Sequence[str],
    done: DataFrame,
    make_predictor: Callable[[], Predictor],
    *,
    key: str,
    template: str = DEFAULT_PROMPT,
    classes: Sequence[str] = CLASSES,
    **how,
) -> DataFrame:
    """Predictions for the (message, model) pairs that have none yet, to be appended.

    Pending pairs are found on keys alone, then gathered per message (at most
    one entry per model), so only messages with work are cleaned, and once.
    """
    pairs = pending_work(work_list(messages.select(key), models), done, [key, "model"])
    pending = pairs.groupBy(key).agg(F.collect_set("model").alias("__models"))
    waiting = prompts(messages.join(pending, key), template, classes)
    work = waiting.withColumn("model", F.explode("__models")).drop("__models")
    return classify_prompts(work, make_predictor, classes=classes, **how)


def repeat_scoring(
    labelled: DataFrame,
    models: Sequence[str],
    make_predictor: Callable[[], Predictor],
    *,
    key: str,
    label: str,
    per_class: int,
    resamples: int = RESAMPLES,
    seed: int = 5,
    temperature: float = RESAMPLE_TEMPERATURE,
    **how,
) -> DataFrame:
    """Ask every model repeatedly about a stratified sample of labelled messages."""
    sample = stratified_sample(labelled, label, per_class, key, seed)
    return classify_messages(
        sample, models, make_predictor, resamples=resamples, temperature=temperature, **how
    )
