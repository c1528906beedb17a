"""Portable models give what the library's models give, and refuse what wasn't sealed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.operators import learning, portable
from starledger.scratch import new_path

NAMES = ["a", "b", "c"]


def rows(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int) + (x[:, 2] > 1).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(c), float(r.sum() + r[0] * r[1])) for i, (r, c) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, y int, z double")


@pytest.mark.parametrize("task, label, model", [("classification", "y", "forest"), ("classification", "y", "linear"), ("classification", "two", "linear"), ("regression", "z", "forest"), ("regression", "z", "linear")])
def test_predictions_equal_the_librarys(spark, task, label, model):
    df = rows(spark).withColumn("two", (F.col("y") > 0).cast("int"))
    fitted = learning.fit(df, NAMES, label, task, model, trees=12)
    path = new_path(spark, "portable-test")
    card = portable.export(fitted, spark, NAMES, task, path)
    assert (card.kind, card.features, card.input_shape) == (model, tuple(NAMES), (None, 3))
    got = {r["k"]: r["prediction"] for r in portable.infer(portable.load(spark, path, card.content_hash), df, "k", NAMES).collect()}
    want = {r["k"]: r["prediction"] for r in learning.infer(fitted, df, "k", NAMES).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(set(want.values())) > 1


def test_what_was_not_sealed_is_refused(spark):
    df = rows(spark)
    fitted = learning.fit(df, NAMES, "z", "regression", "forest", trees=3)
    path = new_path(spark, "portable-test")
    card = portable.export(fitted, spark, NAMES, "regression", path)
    model = portable.load(spark, path)
    for names in (["b", "a", "c"], ["a", "b"], ["a", "b", "y"]):
        with pytest.raises(ValueError, match="in this order"):
            portable.infer(model, df, "k", names)
    with pytest.raises(ValueError, match="shape"):
        model.predict(np.zeros((2, 4)))
    with pytest.raises(ValueError, match="sealed"):
        portable.load(spark, path, "sha256:" + "0" * 64)
    with pytest.raises(Exception, match="3"):
        portable.infer(model, df.withColumn("a", F.when(F.col("k") == 3, float("nan")).otherwise(F.col("a"))), "k", NAMES).collect()

    def altered(nodes=lambda n: n, text=lambda c: c):
        other = new_path(spark, "portable-test")
        nodes(spark.read.parquet(f"{path}/nodes")).write.parquet(f"{other}/nodes")
        spark.createDataFrame([(json.dumps(text(json.loads(card.text()))),)], "value string").coalesce(1).write.text(f"{other}/card")
        return other

    assert portable.load(spark, altered()).card == card
    changed = [
        altered(nodes=lambda n: n.withColumn("threshold", F.when((F.col("tree") == 1) & (F.col("node") == 0), F.col("threshold") + 1e-9).otherwise(F.col("threshold")))),
        altered(nodes=lambda n: n.where("not (tree = 2 and node = 0)")), altered(text=lambda c: c | {"features": ["b", "a", "c"]}), altered(text=lambda c: c | {"input_shape": [None, 4]}),
    ]
    for i, other in enumerate(changed):
        with pytest.raises(ValueError, match="sealed"):
            raise ValueError(f"{i} wasn't refused: {portable.load(spark, other).nodes}")
    with pytest.raises(ValueError, match="field"):
        portable.load(spark, altered(text=lambda c: {k: v for k, v in c.items() if k != "outputs"}))
