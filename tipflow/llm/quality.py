"""Operator 9: quality classifier by regularised quadratic discriminant analysis.

Document statistics (``stats.FEATURES``: logarithms of sizes, square roots of shares) are the inputs.
Spark sums the moments of both classes over all labelled rows.  Each class's covariance is shrunk
towards the pooled one, and that towards its mean variance; features are standardised first.
The score is the logistic of the difference of the class log densities, with squared Mahalanobis
distances from Cholesky factors that are computed once and sent with the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tipflow.llm import stats
from tipflow.llm.common import written

SHRINK = 0.7     # towards the pooled covariance (chosen by cross-validation over the learning rows)
RIDGE = 0.05     # of that towards its mean variance
CUT = 0.3


class Discriminant:
    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float):
        """moments: of class 0 and 1 the number, sums, and sums of products."""
        numbers = np.array([moments.get(c, (0,))[0] for c in (0, 1)], float)
        self.share = float(numbers[1] / numbers.sum()) if numbers.sum() else 0.5
        self.classes = []
        if not numbers.all():
            return
        total = sum(moments[c][1] for c in (0, 1)) / numbers.sum()
        spread = sum(moments[c][2] for c in (0, 1)) / numbers.sum() - np.outer(total, total)
        self.center, self.scale = total, np.sqrt(np.maximum(np.diag(spread), 1e-12))
        means = [(moments[c][1] / numbers[c] - self.center) / self.scale for c in (0, 1)]
        raw = [(moments[c][2] / numbers[c] - np.outer(*[moments[c][1] / numbers[c]] * 2))
               / np.outer(self.scale, self.scale) for c in (0, 1)]
        pooled = sum(n * r for n, r in zip(numbers, raw)) / numbers.sum()
        pooled = (1 - ridge) * pooled + ridge * np.eye(len(pooled)) * max(np.trace(pooled) / len(pooled), 1e-6)
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - shrink) * raw[c] + shrink * pooled)
            self.classes.append((means[c], np.linalg.inv(factor), -np.log(np.diag(factor)).sum()
                                 + np.log(numbers[c] / numbers.sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        low, high = (log - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, log in self.classes)
        return 1 / (1 + np.exp(-np.clip(high - low, -500, 500)))


def fit(rows: DataFrame, label: str, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """From all ``rows (features, label)`` whose label is 0 or 1."""
    k = len(stats.FEATURES)
    f = [F.element_at("features", i + 1) for i in range(k)]
    sums = [F.sum(x) for x in f]
    products = [F.sum(f[i] * f[j]) for i in range(k) for j in range(i + 1)]
    moments = {}
    for row in rows.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).agg(
            F.count("*"), *sums, *products).collect():
        square = np.zeros((k, k))
        square[np.tril_indices(k)] = row[2 + k:]
        moments[row[0]] = (row[1], np.array(row[2:2 + k], float), square + np.tril(square, -1).T)
    return Discriminant(moments, shrink, ridge)


def scored(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """(keep..., score) of ``rows (features)`` by any model with ``score(matrix)``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep).schema.add("score", DoubleType())

    def run(batches):
        for batch in batches:
            if len(batch):
                column = batch.column("features")
                x = column.flatten().to_numpy().reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(x))],
                                                 names=schema.names)

    return rows.select(*keep, "features").mapInArrow(run, schema)


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``rows`` with the label of their doc_id; a doc_id with several labels counts with each once."""
    own = labels.select(F.col("doc_id").alias("_labelled"), F.col(label).alias("_label")).where(
        "_labelled is not null and _label is not null").distinct()
    return rows.join(own, F.col("doc_id") == F.col("_labelled")).drop("_labelled")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs (doc_id, text)``.

    ``labels (doc_id, <label> 0 or 1)``: other values and nulls teach nothing, nor do rows that are held
    out.  Null and empty texts are scored by their statistics, all 0.  If a class has no labelled row,
    every score is the share of label 1 (0.5 without labels).  Repeated rows count and answer
    each by itself.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = written(stats.measured(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")),
                                  ["doc_id", "held_out"]).select("doc_id", "held_out", "features"), "statistics")
    model = fit(labelled(rows.where("not held_out"), labels, label), "_label")
    return scored(rows, model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
