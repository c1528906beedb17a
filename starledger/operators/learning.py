"""Clustering, anomalies, models and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import complete, ratio
from ..scratch import Scratch
from .components import components
from .ordering import positions
from .series import robust_scale


def standardized(df: DataFrame, fields: list[str]) -> DataFrame:
    """Complete rows with z-scored fields; population deviation, 0 where a field doesn't vary."""
    rows = df.where(complete(fields))
    moments = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in fields], *[F.stddev_pop(f).alias(f"s_{f}") for f in fields])
    j = rows.crossJoin(F.broadcast(moments))  # one row
    return j.select(*[c for c in df.columns if c not in fields], *[F.coalesce(F.try_divide(F.col(f).cast("double") - F.col(f"m_{f}"), F.col(f"s_{f}")), F.lit(0.0)).alias(f) for f in fields])


def kmeans(df: DataFrame, key: str, fields: list[str], k: int = 3, starts: int = 10, seed: int = 17) -> DataFrame:
    """(key, label) of the start with the least cost."""
    z = VectorAssembler(inputCols=fields, outputCol="features").transform(standardized(df, fields)).select(key, "features")
    z = Scratch(df.sparkSession, "kmeans").keep(z, "rows")
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(z) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(z).select(key, F.col("prediction").alias("label"), "features")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Counts a label and the silhouette of what is no noise (label -1), null for a single cluster."""
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    real = labelled.where("label >= 0")
    several = real.select("label").distinct().limit(2).count() > 1
    score = ClusteringEvaluator(predictionCol="label", featuresCol="features").evaluate(real.select("label", "features")) if several else None
    return counts.withColumn("silhouette", F.lit(score).cast("double"))


def pca(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, x, y): two axes; the second is 0 for one field; signs are arbitrary."""
    z = standardized(df, fields)
    if len(fields) == 1:
        return z.select(key, F.col(fields[0]).alias("x"), F.lit(0.0).alias("y"))
    v = VectorAssembler(inputCols=fields, outputCol="features").transform(z).select(key, "features")
    out = PCA(k=2, inputCol="features", outputCol="axes").fit(v).transform(v)
    a = vector_to_array("axes")
    return out.select(key, a[0].alias("x"), a[1].alias("y"))


def dbscan(df: DataFrame, key: str, fields: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """(key, label): the smallest core key of a cluster, or null for noise.

    Points of one place are one point with a weight. Places meet in cells as wide as eps; a cell and its neighbours
    are an equi-join; cells are of the first three fields, the distance is of all. Core places within eps are one cluster;
    border places join the nearest core's. Fields count as they are: standardize them first where scales differ.
    """
    if not fields or not 0 < eps <= 20:
        raise ValueError("a field at least, and eps from 0 to 20")
    scratch = Scratch(df.sparkSession, "dbscan")
    rows = scratch.keep(df.where(complete(fields)).select(key, *[F.col(f).cast("double").alias(f) for f in fields]), "rows")
    places = rows.groupBy(*fields).agg(F.min(key).alias("p"), F.count(F.lit(1)).alias("w"))
    cell = [F.floor(F.col(f) / eps).cast("long").alias(f"c{i}") for i, f in enumerate(fields[:3])]
    at = scratch.keep(places.select("p", "w", *fields, *cell), "places")
    near = at
    for i in range(len(cell)):
        near = near.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + d for d in (-1, 0, 1)])))
    other = near.select(*[F.col(f"c{i}") for i in range(len(cell))], F.col("p").alias("q"), F.col("w").alias("v"), *[F.col(f).alias(f"o_{f}") for f in fields])
    d2 = sum((F.pow(F.col(f) - F.col(f"o_{f}"), 2) for f in fields), F.lit(0.0))
    pairs = scratch.keep(at.join(other, [f"c{i}" for i in range(len(cell))]).select("p", "q", "v", d2.alias("d2")).where(f"d2 <= {eps * eps!r}"), "pairs")
    core = pairs.groupBy("p").agg(F.sum("v").alias("held")).where(f"held >= {least}").select("p")
    core = scratch.keep(core, "core")
    edges = pairs.where("p < q").join(core, "p", "left_semi").join(core.toDF("q"), "q", "left_semi").select(F.col("p").alias("a"), F.col("q").alias("b"))
    comp = components(edges, scratch, "clusters")
    labels = core.join(comp.toDF("p", "label"), "p", "left").withColumn("label", F.coalesce("label", "p"))
    border = pairs.join(core, "p", "left_anti").join(labels.toDF("q", "label"), "q").groupBy("p").agg(F.min_by("label", F.struct("d2", "q")).alias("label"))
    found = at.select("p", *fields).join(labels.unionByName(border), "p", "left")
    return rows.join(found, fields).select(key, "label")


def robust_anomalies(df: DataFrame, key: str, fields: list[str], threshold: float = 3.5, scratch: Scratch | None = None) -> DataFrame:
    """(key, score) of rows whose largest robust z is above ``threshold``; a field that doesn't spread counts with 1."""
    scratch = scratch or Scratch(df.sparkSession, "robust")
    z = standardized(df, fields)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = scratch.keep(z.select(key, F.explode(cells).alias("c")).select(key, "c.*"), "cells")
    scale = robust_scale(long, ["field"], "value", scratch)  # a row for each field
    raw = F.col("mad") / 1.4826022185056018
    spread = F.when(raw <= 1e-12, 1.0).otherwise(raw)
    score = F.abs(0.6744897501960817 * (F.col("value") - F.col("center")) / spread)
    return long.join(F.broadcast(scale), "field").groupBy(key).agg(F.max(score).alias("score")).where(F.col("score") > threshold)


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth == 0 or not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _path(tree[0])
        return
    f, cut, left, right = tree
    go = x[rows, f] < cut
    _depths(left, x, rows[go], depth + 1, out)
    _depths(right, x, rows[~go], depth + 1, out)


def isolation_forest(df: DataFrame, key: str, fields: list[str], contamination: float = 0.05, trees: int = 200, sample: int = 256, seed: int = 5) -> DataFrame:
    """(key, score, anomaly): trees of bounded samples grown in the driver, all rows scored in Arrow batches; the share ``contamination`` of highest scores is anomalous."""
    if not 0 < contamination <= 0.25:
        raise ValueError("contamination must be above 0, and 0.25 at most")
    scratch = Scratch(df.sparkSession, "forest")
    rows = scratch.keep(df.where(complete(fields)).select(key, *[F.col(f).cast("double").alias(f) for f in fields]), "rows")
    few = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(16 * sample).select(*fields).toPandas().to_numpy()  # at most 16 samples' rows
    rng = np.random.default_rng(seed)
    size = min(sample, len(few))
    grown = [_tree(few[rng.choice(len(few), size, replace=False)], rng, math.ceil(math.log2(max(2, size)))) for _ in range(trees)]
    sent = df.sparkSession.sparkContext.broadcast(grown)  # of a size set by the parameters

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            x, total = p[fields].to_numpy(), np.zeros(len(p))
            for t in sent.value:
                _depths(t, x, np.arange(len(p)), 0, total)
            yield pd.DataFrame({key: p[key], "score": 2 ** (-total / trees / max(1e-9, _path(size)))})

    kind = rows.schema[key].dataType.simpleString()
    scored = scratch.keep(rows.mapInPandas(score, f"{key} {kind}, score double").withColumn("all", F.lit(0)), "scores")
    placed = positions(scored.withColumn("down", -F.col("score")), ["all"], ["down", key], scratch)
    return placed.select(key, "score", (F.col("position") < F.ceil(F.col("group_size") * contamination)).alias("anomaly"))


# --- splits, folds, models --------------------------------------------------------------------------------


def split(df: DataFrame, key: str, share: float = 0.2, strata: list[str] | None = None, group: str | None = None, seed: int = 3) -> DataFrame:
    """``part``: stratified (an exact share of each stratum, by hash order), by group or entity (all rows of a group together), or random by hash."""
    if group:
        return df.withColumn("part", F.when(F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(10_000)) < share * 10_000, "test").otherwise("train"))
    if not strata:
        return df.withColumn("part", F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < share * 10_000, "test").otherwise("train"))
    placed = positions(df.withColumn("__h", F.xxhash64(key, F.lit(seed))), strata, ["__h", key])
    return placed.withColumn("part", F.when(F.col("position") < F.round(F.col("group_size") * share), "test").otherwise("train")).drop("__h", "position", "group_size")


def folds(df: DataFrame, key: str, k: int = 5, strata: list[str] | None = None, group: str | None = None, seed: int = 3) -> DataFrame:
    """``fold`` from 0: whole groups by hash, or even in each stratum."""
    if not 2 <= k <= 10:
        raise ValueError("2 to 10 folds")
    if group or not strata:
        return df.withColumn("fold", F.pmod(F.xxhash64(group or key, F.lit(seed)), F.lit(k)).cast("int"))
    placed = positions(df.withColumn("__h", F.xxhash64(key, F.lit(seed))), strata, ["__h", key])
    return placed.withColumn("fold", (F.col("position") % k).cast("int")).drop("__h", "position", "group_size")


_MODELS = {
    ("classification", "forest"): lambda: RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=200, minInstancesPerNode=2, maxDepth=8, seed=7),
    ("classification", "linear"): lambda: LogisticRegression(featuresCol="features", labelCol="label", maxIter=100),
    ("regression", "forest"): lambda: RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=200, minInstancesPerNode=2, maxDepth=8, seed=7),
    ("regression", "linear"): lambda: LinearRegression(featuresCol="features", labelCol="label"),
}


def fit(train: DataFrame, features: list[str], label: str, task: str, model: str = "forest", trees: int | None = None) -> PipelineModel:
    """Labels are numbers (classes 0, 1, …); classes are weighted against their counts."""
    rows = train.where(complete(features) & F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    stage = _MODELS[task, model]()
    if trees and model == "forest":
        stage = stage.setNumTrees(trees)
    if task == "classification":
        c = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__c"))
        all_ = c.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
        rows = rows.join(F.broadcast(c), "label").crossJoin(F.broadcast(all_)).withColumn("__weight", F.col("__n") / (F.col("__k") * F.col("__c")))  # a row for each class
        stage = stage.setWeightCol("__weight")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), stage]).fit(rows)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Of a forest; nothing for a linear model."""
    last = model.stages[-1]
    return sorted(zip(features, (float(v) for v in last.featureImportances), strict=True), key=lambda p: (-p[1], p[0])) if hasattr(last, "featureImportances") else []


def infer(model: PipelineModel, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, prediction); a feature that isn't finite stops the query and names the row."""
    from ..functions.numbers import strict

    return model.transform(rows.select(key, *strict(features, key))).select(key, "prediction")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, probability: str | None = None) -> DataFrame:
    """One row: n, accuracy, macro_f1 over the classes seen, and with the probability of class 1 log_loss and brier."""
    cells = confusion(df, actual, predicted)
    long = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p"), "n", (F.col("actual") == F.col("predicted")).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"), "n", F.lit(False).alias("hit")))).alias("x")).select("x.*")
    per = long.groupBy("c").agg(F.sum(F.col("a") * F.col("n")).alias("na"), F.sum(F.col("p") * F.col("n")).alias("np"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("na") + F.col("np")), F.lit(0.0))
    out = per.agg(F.sum("na").alias("n"), ratio(F.sum("tp"), F.sum("na")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
    if probability:
        p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col(probability)))
        y = F.col(actual).cast("double")
        out = out.crossJoin(df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col(probability) - y) ** 2).alias("brier")))  # one row each
    return out


def majority(train: DataFrame, label: str) -> DataFrame:
    """(label): the most frequent class, ties to the smallest."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.max_by(label, F.struct("c", -F.col(label))).alias(label))


def cross_validate(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, model: str = "linear", strata: list[str] | None = None) -> DataFrame:
    """(folds, mean_accuracy, sd_accuracy), the deviation of the population."""
    d = Scratch(df.sparkSession, "folds").keep(folds(df, key, k, strata or [label]), "rows")
    each = []
    for i in range(k):
        m = fit(d.where(F.col("fold") != i), features, label, "classification", model)
        r = m.transform(d.where(F.col("fold") == i)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        each.append((i, r))
    out = df.sparkSession.createDataFrame(each, "fold int, accuracy double")
    return out.agg(F.count(F.lit(1)).alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy"))


def holdout(df: DataFrame, key: str, features: list[str], label: str, task: str = "classification", model: str = "forest", share: float = 0.2) -> DataFrame:
    """(metric, value, baseline) on rows held out (an exact share of each class, or random for a regression).

    The baseline is the most frequent class or the mean label of the training rows.
    """
    rows = df.where(complete(features) & F.col(label).isNotNull()).select(key, *features, F.col(label).cast("double").alias(label))
    parts = Scratch(df.sparkSession, "holdout").keep(split(rows, key, share, [label] if task == "classification" else None), "parts")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("the split leaves a part without rows")
    out = fit(train, features, label, task, model).transform(test)
    if task == "classification":
        usual = majority(train, label).first()[0]
        names = ["accuracy", "macro_f1"]
        got = classification_metrics(out, label, "prediction").select(*names).first()
        base = classification_metrics(out.withColumn("usual", F.lit(usual)), label, "usual").select(*names).first()
    else:
        usual = train.agg(F.avg(label)).first()[0]
        names = ["mae", "rmse", "r2"]
        spread = test.agg(F.var_pop(label)).first()[0]

        def errors(c):
            e = out.agg(F.avg(F.abs(c - F.col(label))).alias("mae"), F.avg((c - F.col(label)) ** 2).alias("mse")).first()
            return e["mae"], math.sqrt(e["mse"]), 1 - e["mse"] / spread if spread else None

        got, base = errors(F.col("prediction")), errors(F.lit(usual))
    return df.sparkSession.createDataFrame(list(zip(names, got, base, strict=True)), "metric string, value double, baseline double")


def forecast(df: DataFrame, group: str, order: str, value: str, lags: int = 3, horizon: int = 3, trees: int | None = None) -> DataFrame:
    """(group, step, forecast): one forest over all objects' lags; each step feeds the next, for all objects at once."""
    from .series import lag_features

    names = [f"lag_{i}" for i in range(1, lags + 1)]
    rows = lag_features(df, [group], order, value, lags)
    model = fit(rows, names, "label", "regression", "forest", trees)
    last = rows.groupBy(group).agg(F.max_by(F.struct("label", *names[:-1]), order).alias("r"))
    now = last.select(group, *[F.col(f"r.{c}").alias(n) for c, n in zip(("label", *names[:-1]), names, strict=True)])
    scratch, out = Scratch(df.sparkSession, "forecast"), None
    for step in range(1, horizon + 1):
        got = scratch.keep(model.transform(now).select(group, F.col("prediction").alias("forecast"), *names), f"step{step}")
        one = got.select(group, F.lit(step).alias("step"), "forecast")
        out = one if out is None else out.unionByName(one)
        now = got.select(group, F.col("forecast").alias(names[0]), *[F.col(a).alias(b) for a, b in zip(names, names[1:], strict=False)])
    return out


def as_columns(df: DataFrame, array: str, n: int, prefix: str = "f") -> DataFrame:
    """The first n items of an array (a flattened image, a vector) as feature columns."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)])

