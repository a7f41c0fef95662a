"""A calibrated random forest for small tables of labelled rows.

The forest is trained on at most ``max_rows`` labelled rows, chosen by a hash of
their key so that a run can be repeated; three in ten of those are held out and
give an isotonic map from the forest's vote to the share of right answers. Categories
are nominal features: the ``MAX_CATEGORIES`` most frequent among the training rows and one
for all others. A forest can't be calibrated on fewer than ``LEAST_ROWS`` labelled rows or
one class; then the most frequent label is predicted with a probability of 0.5, which is
never confident."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CATEGORIES = 255
LEAST_ROWS = 20


def isotonic(score: np.ndarray, right: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators fit; upper ends of the score's steps and the rates there."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, r in zip(score[order], right[order]):
        blocks.append([float(s), float(r), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s1, r1, n1 = blocks.pop()
            blocks[-1] = [s1, blocks[-1][1] + r1, blocks[-1][2] + n1]
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


def _rate(ends: list[float], rates: list[float], score: np.ndarray) -> np.ndarray:
    return np.array(rates)[np.minimum(np.searchsorted(ends, score), len(rates) - 1)]


def calibration_error(score: np.ndarray, right: np.ndarray, bins: int = 5) -> float:
    """Mean distance of calibrated probabilities and shares of right answers over equally full bins.

    Each half of the rows is calibrated by the other."""
    p = np.empty(len(score))
    for half in (0, 1):
        own = np.arange(len(score)) % 2 == half
        p[own] = _rate(*isotonic(score[~own], right[~own]), score[own])
    parts = np.array_split(np.argsort(p, kind="stable"), bins)
    return float(sum(abs(p[i].mean() - right[i].mean()) * len(i) for i in parts if len(i)) / len(p))


@dataclass
class CalibratedForest:
    """``model`` is None when fewer than two classes were seen: then ``only`` is predicted."""

    labels: list[str]
    inputs: list[str]
    categories: dict[str, list[str]]
    model: RandomForestClassificationModel | None
    only: str | None
    ends: list[float]
    rates: list[float]
    n_training: int
    n_held_out: int
    held_out_accuracy: float
    calibration_error: float

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``predicted`` and its calibrated ``probability``."""
        if self.model is None:
            return df.withColumns({"predicted": F.lit(self.only).cast("string"), "probability": F.lit(0.0 if self.only is None else 0.5)})
        votes = vector_to_array("_probability")
        top = F.array_max(votes)
        rate = F.lit(self.rates[-1])
        for end, r in list(zip(self.ends, self.rates))[-2::-1]:
            rate = F.when(top <= end, F.lit(r)).otherwise(rate)
        name = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.array_position(votes, top).cast("int"))
        out = self.model.transform(_assembled(df, self.inputs, self.categories))
        return out.withColumns({"predicted": name, "probability": rate}).drop("_features", "_probability", "_raw", "_prediction", *map(_index, self.categories))


def _index(category: str) -> str:
    return f"_index_{category}"


def _assembled(df: DataFrame, inputs: list[str], categories: dict[str, list[str]]) -> DataFrame:
    for name, values in categories.items():
        known = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(float(i)))]) if values else None
        index: Column = F.coalesce(F.element_at(known, F.col(name)), F.lit(float(len(values)))) if values else F.lit(0.0)
        # two values at least, for a nominal feature of one isn't allowed
        df = df.withColumn(_index(name), index).withMetadata(_index(name), {"ml_attr": {"type": "nominal", "num_vals": max(2, len(values) + 1)}})
    return VectorAssembler(inputCols=[*inputs, *map(_index, categories)], outputCol="_features").transform(df)


def train(
    df: DataFrame, label: str, inputs: list[str], key: list[str], labels: list[str], categories: list[str] | None = None, max_rows: int = 4000, trees: int = 20, depth: int = 7, seed: int = 17
) -> CalibratedForest:
    """Fit on the rows of ``df`` whose ``label`` is set; ``inputs`` must be free of NULL and NaN."""
    names = categories or []
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    rows = (
        df.where(F.col(label).isNotNull())
        .select(*inputs, *[F.col(c).cast("string").alias(c) for c in names], (index - 1).cast("double").alias("_label"), F.xxhash64(*key).alias("_order"))
        .orderBy("_order")
        .limit(max_rows)
        .toPandas()
    )
    seen = sorted(set(rows["_label"].dropna()))
    if len(seen) < 2 or len(rows) < LEAST_ROWS:
        only = labels[int(rows["_label"].mode().iloc[0])] if len(seen) else None
        return CalibratedForest(labels, inputs, {}, None, only, [1.0], [0.5], len(rows), 0, float("nan"), float("nan"))
    spark = df.sparkSession
    held = np.arange(len(rows)) % 10 >= 7
    known = {c: rows.loc[~held, c].dropna().value_counts().index[:MAX_CATEGORIES].tolist() for c in names}
    schema = ", ".join([*(f"{c} double" for c in inputs), *(f"{c} string" for c in names), "_label double", "_held boolean"])
    data = spark.createDataFrame(rows.drop(columns="_order").assign(_held=held).astype({c: object for c in names}).where(lambda d: d.notna(), None), schema).coalesce(2)
    assembled = _assembled(data, inputs, known)
    bins = max(32, max((len(v) + 1 for v in known.values()), default=0))
    forest = RandomForestClassifier(
        labelCol="_label", featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed
    ).fit(assembled.where("not _held"))
    # the summary holds the session and would be sent along with the model
    forest._java_obj.setSummary(spark._jvm.scala.Option.apply(None))
    test = forest.transform(assembled.where("_held")).select("_label", "_prediction", F.array_max(vector_to_array("_probability")).alias("top")).toPandas()
    right, top = (test["_label"] == test["_prediction"]).to_numpy(float), test["top"].to_numpy(float)
    ends, rates = isotonic(top, right)
    n = len(right)
    rates = [min(r, (n + 1) / (n + 2)) for r in rates]  # no rate of 1 from a finite sample
    return CalibratedForest(labels[: forest.numClasses], inputs, known, forest, None, ends, rates, int((~held).sum()), n, float(right.mean()), calibration_error(top, right))
