"""Probabilities for classifiers that give margins only, by sigmoids fitted on held-out margins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.sampling import folds
from tallymark.session import cut_lineage

#: Slope and offset of one class: its probability is ``1 / (1 + exp(-(slope margin + offset)))``.
Curve = tuple[float, float]

#: Passes over the margins at most, and the mean slope of the loss at which a curve is found.
PASSES = 50
FLAT = 1e-7


def held_out_margins(
    train: DataFrame, fit: Callable[[DataFrame], Model], *, key: str, label: str, raw: str = "rawPrediction", k: int = 4, seed: int = 0
) -> DataFrame:
    """``label`` and the array ``margins`` of every row, by a model that did not see the row.

    Folds are even within every class. The row of a class that has no other stays in all training
    parts and has no margins. What comes before the classifier, such as a projection, is the caller's.
    """
    alone = [r[label] for r in train.groupBy(label).count().filter("count = 1").collect()]
    dealt = folds(train, label, key, k, seed, "__fold")
    fold = F.when(F.col(label).isin(alone), F.lit(-1)).otherwise(F.col("__fold")) if alone else F.col("__fold")
    dealt = cut_lineage(dealt.withColumn("__fold", fold))
    parts = [
        fit(dealt.filter(F.col("__fold") != at)).transform(dealt.filter(F.col("__fold") == at)).select(label, vector_to_array(raw).alias("margins"))
        for at in range(k)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def _sums(margins: DataFrame, label: str, targets: Sequence[tuple[float, float]], curves: Sequence[Curve]) -> dict[int, dict]:
    """Loss, its slope and its curvature at one curve of each class; one row a class reaches the driver."""

    def of_class(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("class") + 1)

    long = margins.select(F.col(label).cast("int").alias("own"), F.posexplode("margins").alias("class", "margin")).filter(F.col("class") < len(curves))
    z = of_class([a for a, _ in curves]) * F.col("margin") + of_class([b for _, b in curves])
    target = F.when(F.col("own") == F.col("class"), of_class([t for t, _ in targets])).otherwise(of_class([t for _, t in targets]))
    long = long.select("class", "margin", z.alias("z"), target.alias("t"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    # log(1 + exp(z)) - t z without overflow
    loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("t") * F.col("z")
    bend = p * (F.lit(1.0) - p)
    found = long.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(loss).alias("loss"),
        F.sum((p - F.col("t")) * F.col("margin")).alias("ga"),
        F.sum(p - F.col("t")).alias("gb"),
        F.sum(bend * F.col("margin") * F.col("margin")).alias("haa"),
        F.sum(bend * F.col("margin")).alias("hab"),
        F.sum(bend).alias("hbb"),
    )
    return {r["class"]: r.asDict() for r in found.collect()}


def fit_curves(margins: DataFrame, label: str, classes: int) -> list[Curve]:
    """A sigmoid for every class, own rows against all others, by Newton steps that all classes take in one pass.

    Targets stand a little off 0 and 1, by the counts of the class, so that separated classes have a
    finite slope. A step that raises the loss is halved. Classes without margins get probability a half.
    """
    counted = margins.filter(F.size("margins") > 0).groupBy(F.col(label).cast("int").alias("own")).count().collect()
    rows = {r["own"]: r["count"] for r in counted}
    total = sum(rows.values())
    own = [rows.get(c, 0) for c in range(classes)]
    targets = [((n + 1.0) / (n + 2.0), 1.0 / (total - n + 2.0)) for n in own]
    tried = [(0.0, math.log((n + 1.0) / (total - n + 1.0))) for n in own]
    best: list[tuple[float, Curve, Curve] | None] = [None] * classes  # loss, curve, step that is tried from there
    ready = [False] * classes
    for _ in range(PASSES):
        for c, s in _sums(margins, label, targets, tried).items():
            if ready[c]:
                continue
            if best[c] is not None and s["loss"] > best[c][0] + 1e-12 * abs(best[c][0]):
                loss, at, (da, db) = best[c]
                best[c] = (loss, at, (da / 2, db / 2))
                ready[c] = abs(da) + abs(db) < 1e-12
            else:
                haa, hbb, hab = s["haa"] + 1e-9 * s["n"], s["hbb"] + 1e-9 * s["n"], s["hab"]
                det = haa * hbb - hab * hab
                step = ((hab * s["gb"] - hbb * s["ga"]) / det, (hab * s["ga"] - haa * s["gb"]) / det)
                best[c] = (s["loss"], tried[c], step)
                ready[c] = max(abs(s["ga"]), abs(s["gb"])) <= FLAT * s["n"]
        open_ = [c for c in range(classes) if best[c] is not None and not ready[c]]
        if not open_:
            break
        for c in range(classes):
            if best[c] is not None:
                _, (a, b), (da, db) = best[c]
                tried[c] = (a, b) if ready[c] else (a + da, b + db)
    return [(0.0, 0.0) if found is None else found[1] for found in best]


def calibrated(raw: str, curves: Sequence[Curve]) -> Column:
    """Probability vector of a row's margins: the classes' sigmoids, scaled to sum to 1."""
    each = F.zip_with(
        vector_to_array(raw),
        F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in curves]),
        lambda margin, curve: F.lit(1.0) / (F.lit(1.0) + F.exp(-(curve["a"] * margin + curve["b"]))),
    )
    whole = F.aggregate(each, F.lit(0.0), lambda total, p: total + p)
    return array_to_vector(F.transform(each, lambda p: F.when(whole > 0, p / whole).otherwise(F.lit(1.0 / len(curves)))))
