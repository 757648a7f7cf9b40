"""Whole reports made of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallymark.operators.joins import attach_dimension
from tallymark.operators.metrics import confusion, scores, speed_and_failures


def scorecard(votes: DataFrame, labelled: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Quality of each model on labelled messages with its failure rate and speed on all.

    ``labelled`` is the vote table joined with human labels (``truth``).
    """
    by = list(by)
    quality = scores(confusion(labelled, "truth", "category", by), by)
    return attach_dimension(quality, speed_and_failures(votes, by), by)


def full_metrics(card: DataFrame, params: DataFrame, entropy: DataFrame) -> DataFrame:
    """Scorecard with parameter counts (every scored model is kept) and self-consistency."""
    sized = params.select("model", "params_b").join(card, "model", "right")
    return attach_dimension(sized, entropy, "model")
