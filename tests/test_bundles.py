"""Bundles are readmitted whole, and any change is located."""

import json

import pytest
from pyspark.sql import functions as F

from starledger.operators.bundles import Part, build, readmit
from starledger.scratch import new_path


def tables(spark):
    a = spark.createDataFrame([(i, f"n{i}", None if i % 7 == 0 else i / 3, [i, None]) for i in range(600)], "id int, name string, v double, xs array<int>")
    e = spark.createDataFrame([("x", 1, "1"), ("x", 2, "null"), ("y", 1, None), ("y", 1, None)], "src string, no int, text string")
    return a, e


def parts(a, e):
    return [Part("cells", a, ("id",)), Part("evidence", e, ("src", "no")), Part("empty", a.limit(0), ("id",))]


def defects(spark, ps, path, root):
    return sorted(((r["part"], r["problem"], r["key"], r["column"]) for r in readmit(spark, ps, path, root).collect()), key=str)


def test_readmission_locates_changes(spark):
    a, e = tables(spark)
    path = new_path(spark, "bundle-test")
    root = build(spark, parts(a, e), path)
    assert defects(spark, parts(a.repartition(5).select("xs", "v", "id", "name"), e.repartition(3)), path, root) == []
    assert build(spark, parts(a.repartition(3), e), new_path(spark, "bundle-test")) == root
    changed = a.withColumn("v", F.when(F.col("id") == 5, F.col("v") + 1e-12).otherwise(F.col("v"))).withColumn("name", F.when(F.col("id").isin(5, 9), "z").otherwise(F.col("name"))).where("id != 100")
    changed = changed.withColumn("xs", F.when(F.col("id") == 7, F.array(F.lit(7), F.lit(0))).otherwise(F.col("xs"))).unionByName(a.where("id = 3").withColumn("id", F.lit(9999)))
    other = e.withColumn("text", F.when(F.col("text") == "null", None).otherwise(F.col("text"))).where("src != 'y'").union(e.where("src = 'y'").limit(1))
    key = lambda *v: "\u001f".join(f"=[{x}]" for x in v)
    assert defects(spark, parts(changed, other), path, root) == sorted([
        ("cells", "changed_cell", key(5), "name"), ("cells", "changed_cell", key(5), "v"), ("cells", "changed_cell", key(9), "name"), ("cells", "changed_cell", key(7), "xs"), ("cells", "missing_row", key(100), None),
        ("cells", "extra_row", key(9999), None), ("evidence", "changed_cell", key('"x"', 2), "text"), ("evidence", "repeated_row", key('"y"', 1), None),
    ], key=str)


def test_parts_columns_and_seals(spark):
    a, e = tables(spark)
    path = new_path(spark, "bundle-test")
    root = build(spark, parts(a, e), path)
    ps = [Part("cells", a.drop("xs"), ("id",)), Part("other", e, ("src", "no")), Part("empty", a.limit(1), ("id",))]
    found = defects(spark, ps, path, root)
    assert [f[:2] for f in found] == [("cells", "columns"), ("empty", "extra_row"), ("evidence", "missing_part"), ("other", "extra_part")]
    assert defects(spark, parts(a, e), path, "sha256:" + "0" * 64) == [(None, "seal", None, None)]
    with pytest.raises(ValueError, match="one name"):
        build(spark, [ps[0], ps[0]], new_path(spark, "bundle-test"))


def test_altered_seals_are_found(spark):
    a, e = tables(spark)
    path, other = new_path(spark, "bundle-test"), new_path(spark, "bundle-test")
    root = build(spark, parts(a, e), path)
    rows = spark.read.parquet(f"{path}/rows")
    rows.withColumn("row_hash", F.when(F.col("key") == "=[5]", F.sha2("row_hash", 256)).otherwise(F.col("row_hash"))).write.partitionBy("part").parquet(f"{other}/rows")
    spark.read.parquet(f"{path}/leaves").write.parquet(f"{other}/leaves")
    manifest = spark.read.text(f"{path}/manifest", wholetext=True)
    manifest.coalesce(1).write.text(f"{other}/manifest")
    assert defects(spark, parts(a, e), other, root) == [(None, "leaves", None, None)]
    forged = json.loads(manifest.first()["value"])
    forged["parts"]["cells"]["rows"] = 1
    third = new_path(spark, "bundle-test")
    rows.write.partitionBy("part").parquet(f"{third}/rows")
    spark.read.parquet(f"{path}/leaves").write.parquet(f"{third}/leaves")
    spark.createDataFrame([(json.dumps(forged),)], "value string").coalesce(1).write.text(f"{third}/manifest")
    assert defects(spark, parts(a, e), third, root) == [(None, "seal", None, None)]
