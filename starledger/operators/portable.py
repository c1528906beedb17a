"""Models as tables that need no library to be applied: nodes of trees or weights, sealed by a hash over content, features and shapes.

A model's folder holds ``nodes`` (Parquet) and ``card`` (JSON lines, one). What is applied is what was sealed: another order, number or name of
features, another shape, or a changed cell of the nodes is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seal
from ..functions.numbers import strict
from ..scratch import new_path

#: Nodes of a model that is sent to tasks, at most.
MOST_NODES = 2_000_000
_NODES = "tree int, node int, feature int, threshold double, left int, right int, values array<double>"


@dataclass(frozen=True)
class Card:
    """What a model is: kind (forest or linear), task, features in order, classes (0 for a regression), shapes and the hash of its nodes and of all this."""

    kind: str
    task: str
    features: tuple[str, ...]
    classes: int
    input_shape: tuple[int | None, int]
    outputs: tuple[str, ...]
    content_hash: str

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


def _hash(nodes: DataFrame, card: dict) -> str:
    """The seal of the node rows together with the card's other fields."""
    rows = nodes.select("tree", "node", "feature", "threshold", "left", "right", F.to_json("values").alias("values"))
    own = json.dumps(card, sort_keys=True)
    both = rows.withColumn("card", F.lit(own))
    found = seal(both, ["card"], both.columns).first()
    return found["seal"] if found else ""


def _forest_nodes(spark: SparkSession, stage, task: str) -> DataFrame:
    """Nodes from the table that the library itself saves a forest as."""
    path = new_path(spark, "forest")
    stage.save(path)
    raw = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    values = "impurityStats" if task == "classification" else "prediction"
    return raw.select(
        F.col("treeID").cast("int").alias("tree"), F.col("id").cast("int").alias("node"), F.when(~leaf, F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), F.when(~leaf, F.col("leftChild")).cast("int").alias("left"), F.when(~leaf, F.col("rightChild")).cast("int").alias("right"),
        F.when(leaf, F.col(values) if task == "classification" else F.array(values)).alias("values"),
    )


def export(model: PipelineModel, spark: SparkSession, features: list[str], task: str, path: str) -> Card:
    """Write a fitted forest or linear model; ValueError for other kinds."""
    stage = model.stages[-1]
    classes = int(getattr(stage, "numClasses", 0)) if task == "classification" else 0
    if hasattr(stage, "trees"):
        kind, nodes = "forest", _forest_nodes(spark, stage, task)
    elif hasattr(stage, "coefficientMatrix"):
        kind = "linear"
        rows = [(i, 0, None, None, None, None, [float(stage.interceptVector[i]), *map(float, stage.coefficientMatrix.toArray()[i])]) for i in range(stage.coefficientMatrix.numRows)]
        nodes = spark.createDataFrame(rows, _NODES)
    elif hasattr(stage, "coefficients"):
        kind, nodes = "linear", spark.createDataFrame([(0, 0, None, None, None, None, [float(stage.intercept), *map(float, stage.coefficients)])], _NODES)
    else:
        raise ValueError(f"{type(stage).__name__} has no portable form")
    nodes.write.parquet(f"{path}/nodes")
    fields = {"kind": kind, "task": task, "features": list(features), "classes": classes, "input_shape": [None, len(features)], "outputs": ["prediction"]}
    card = Card(kind, task, tuple(features), classes, (None, len(features)), ("prediction",), _hash(spark.read.parquet(f"{path}/nodes"), fields))
    spark.createDataFrame([(card.text(),)], "value string").coalesce(1).write.text(f"{path}/card")
    return card


@dataclass(frozen=True)
class Portable:
    card: Card
    nodes: pd.DataFrame

    def _forest(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), max(1, self.card.classes)))
        for _, t in self.nodes.groupby("tree"):
            t = t.sort_values("node")
            feature = t["feature"].fillna(-1).to_numpy(int)
            threshold, left, right = t["threshold"].to_numpy(float), t["left"].fillna(-1).to_numpy(int), t["right"].fillna(-1).to_numpy(int)
            values = np.array([v if v is not None else [0.0] * total.shape[1] for v in t["values"]], float)
            at, open_ = np.zeros(len(x), int), np.arange(len(x))
            while len(open_ := open_[feature[at[open_]] >= 0]):
                n = at[open_]
                at[open_] = np.where(x[open_, feature[n]] <= threshold[n], left[n], right[n])
            got = values[at]
            if self.card.classes:
                weight = got.sum(axis=1, keepdims=True)
                got = np.divide(got, weight, out=np.zeros_like(got), where=weight > 0)
            total += got
        return total.argmax(axis=1).astype(float) if self.card.classes else total[:, 0] / self.nodes["tree"].nunique()

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of features in the card's order; ValueError for another number of them."""
        if x.ndim != 2 or x.shape[1] != self.card.input_shape[1]:
            raise ValueError(f"rows have the shape {x.shape[1:]}, the model takes {self.card.input_shape[1:]}")
        if self.card.kind == "forest":
            return self._forest(x)
        w = np.array(self.nodes.sort_values("tree")["values"].tolist(), float)
        z = x @ w[:, 1:].T + w[:, 0]
        if not self.card.classes:
            return z[:, 0]
        return (z[:, 0] > 0).astype(float) if len(w) == 1 else z.argmax(axis=1).astype(float)


def load(spark: SparkSession, path: str, content_hash: str | None = None) -> Portable:
    """A model whose nodes and card are what was sealed; ``content_hash`` is the hash that the caller was given. ValueError otherwise."""
    found = json.loads(spark.read.text(f"{path}/card", wholetext=True).first()["value"])
    given = found.pop("content_hash", None)
    if set(found) != {"kind", "task", "features", "classes", "input_shape", "outputs"}:
        raise ValueError("the card lacks a field or has one too many")
    nodes = spark.read.schema(_NODES).parquet(f"{path}/nodes")
    if given != _hash(nodes, found) or content_hash not in (None, given):
        raise ValueError("the model isn't the one that was sealed")
    if found["input_shape"] != [None, len(found["features"])] or found["outputs"] != ["prediction"]:
        raise ValueError("shapes and outputs don't agree with the features")
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"a model has at most {MOST_NODES} nodes")
    card = Card(found["kind"], found["task"], tuple(found["features"]), found["classes"], tuple(found["input_shape"]), tuple(found["outputs"]), given)
    return Portable(card, nodes.toPandas())


def infer(model: Portable, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, prediction); ValueError unless ``features`` are the model's in its order; a feature that isn't finite stops the query and names the row."""
    if tuple(features) != model.card.features:
        raise ValueError(f"the model takes {list(model.card.features)} in this order, not {list(features)}")
    sent = rows.sparkSession.sparkContext.broadcast(model)  # MOST_NODES rows at most

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({key: p[key], "prediction": sent.value.predict(p[list(features)].to_numpy(float))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *strict(features, key)).mapInPandas(run, f"{key} {kind}, prediction double")
