"""Bundles of tables under a tree of seals, and their readmission, which names what differs.

A cell's hash goes into its row's, rows into a bucket's by the first digits of their key's hash, buckets into a part's, parts into the root. To readmit a
bundle the tree is derived anew from the tables; only buckets whose seals differ are looked into, row by row and cell by cell.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a bucket, about.
_BUCKET = 1000


@dataclass(frozen=True)
class Part:
    """A table of a bundle and the columns that name its rows."""

    name: str
    rows: DataFrame
    key: tuple[str, ...]

    def columns(self) -> list[str]:
        return sorted(c for c in self.rows.columns if c not in self.key)


def _text(c: str) -> Column:
    """A cell as text that tells null, and values of any type, apart."""
    return F.coalesce(F.concat(F.lit("="), F.to_json(F.array(F.col(f"`{c}`")), {"ignoreNullFields": "false"})), F.lit("null"))


def _rows(part: Part, digits: int) -> DataFrame:
    """(part, bucket, key, cells array of hashes by column, row_hash)."""
    key = F.concat_ws("\u001f", *[_text(c) for c in part.key])
    cells = F.array(*[F.substring(F.sha2(F.concat(F.lit(f"{c}\u001f"), _text(c)), 256), 1, 32) for c in part.columns()]).cast("array<string>")
    out = part.rows.select(F.lit(part.name).alias("part"), key.alias("key"), cells.alias("cells"))
    return out.select("part", F.substring(F.sha2("key", 256), 1, digits).alias("bucket"), "key", "cells", F.sha2(F.concat_ws(",", "key", F.array_join("cells", ",")), 256).alias("row_hash"))


def _leaves(rows: DataFrame) -> DataFrame:
    """(part, bucket, rows, seal): a bucket's rows in the order of their hashes, equal ones counted."""
    counted = rows.groupBy("part", "bucket", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(":", "row_hash", F.col("n").cast("string"))
    return counted.groupBy("part", "bucket").agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("seal"))


def _stems(leaves: DataFrame) -> dict[str, tuple[int, str]]:
    """Rows and seal of each part, from its buckets' seals: first of 256 stems a part, so that no row lists all buckets."""
    stem = leaves.withColumn("stem", F.substring("bucket", 1, 2))
    some = stem.groupBy("part", "stem").agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit("="), "seal"))), ","), 256).alias("seal"))
    whole = some.groupBy("part").agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("stem", F.lit("="), "seal"))), ","), 256).alias("seal"))
    return {r["part"]: (r["rows"], r["seal"]) for r in whole.collect()}


def _root(parts: dict) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def build(spark: SparkSession, parts: list[Part], path: str) -> str:
    """Seal a bundle: write hashes of its rows, its leaves and a manifest into a folder; the root's seal. A part without rows has a seal too."""
    if len({p.name for p in parts}) < len(parts):
        raise ValueError("two parts have one name")
    found = {}
    for p in parts:
        digits = 2 + max(0, math.ceil(math.log(max(1, p.rows.count()) / (256 * _BUCKET), 16)))
        _rows(p, digits).write.partitionBy("part").mode("append").parquet(f"{path}/rows")
        found[p.name] = {"digits": digits, "key": list(p.key), "columns": p.columns()}
    rows = _sealed_rows(spark, path)
    leaves = _leaves(rows)
    leaves.write.parquet(f"{path}/leaves")
    seals = _stems(spark.read.parquet(f"{path}/leaves"))
    for name, entry in found.items():
        entry["rows"], entry["seal"] = seals.get(name, (0, hashlib.sha256(b"").hexdigest()))
    manifest = {"parts": found, "root": _root(found)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest["root"]


def _sealed_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket string, key string, cells array<string>, row_hash string, part string").parquet(f"{path}/rows")


_DEFECTS = "part string, problem string, key string, column string"


def readmit(spark: SparkSession, parts: list[Part], path: str, root: str) -> DataFrame:
    """(part, problem, key, column): how tables differ from the bundle that was sealed under ``root``; no rows if they don't.

    Problems: seal (the manifest isn't the one of this root), leaves (its rows or leaves aren't the ones that it sums up), missing_part, extra_part, columns, missing_row, extra_row,
    repeated_row (a key has another number of rows) and changed_cell, which names the column. The key is the key columns' cells as JSON.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()["value"])
    known = manifest["parts"]
    if _root(known) != root or manifest["root"] != root:
        return spark.createDataFrame([(None, "seal", None, None)], _DEFECTS)
    scratch = Scratch(spark, "readmit")
    stored = _sealed_rows(spark, path)
    leaves = spark.read.schema("part string, bucket string, rows long, seal string").parquet(f"{path}/leaves")
    again = scratch.keep(_leaves(stored), "again")
    seals = _stems(leaves)
    torn = stored.where(F.col("row_hash") != F.sha2(F.concat_ws(",", "key", F.array_join("cells", ",")), 256)).limit(1).count()
    unlike = torn + leaves.exceptAll(again.select(leaves.columns)).limit(1).count() + again.select(leaves.columns).exceptAll(leaves).limit(1).count()
    if unlike or any((e["rows"], e["seal"]) != seals.get(n, (0, hashlib.sha256(b"").hexdigest())) for n, e in known.items()):
        return spark.createDataFrame([(None, "leaves", None, None)], _DEFECTS)
    given = {p.name: p for p in parts}
    plain = [(n, "missing_part", None, None) for n in known if n not in given] + [(n, "extra_part", None, None) for n in given if n not in known]
    both = [p for n, p in given.items() if n in known]
    other = [p for p in both if (p.columns(), list(p.key)) != (known[p.name]["columns"], known[p.name]["key"])]
    plain += [(p.name, "columns", None, None) for p in other]
    out = spark.createDataFrame(plain, _DEFECTS)
    for p in both:
        if p in other:
            continue
        e = known[p.name]
        now = scratch.keep(_rows(p, e["digits"]), f"rows-{p.name}")
        fresh = _leaves(now).select("bucket", F.col("seal").alias("now"))
        differ = leaves.where(F.col("part") == p.name).select("bucket", "seal").join(fresh, "bucket", "full").where(~F.col("seal").eqNullSafe(F.col("now"))).select("bucket")
        # rows of buckets that differ only; a key's rows are compared as one
        one = lambda d: d.join(differ, "bucket", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("cells").alias("cells"), F.min("cells").alias("least"))
        was, got = one(stored.where(F.col("part") == p.name)), one(now)
        j = was.toDF("key", "n0", "c0", "l0").join(got.toDF("key", "n1", "c1", "l1"), "key", "full")
        problem = F.when(F.col("n1").isNull(), "missing_row").when(F.col("n0").isNull(), "extra_row").when(F.col("n0") != F.col("n1"), "repeated_row").when((F.col("c0") != F.col("c1")) | (F.col("l0") != F.col("l1")), "changed_cell")
        wrong = j.withColumn("problem", problem).where("problem is not null")
        names = F.array(*[F.lit(c) for c in e["columns"]]).cast("array<string>")
        changed = F.filter(F.transform(names, lambda c, i: F.when((F.get("c0", i) != F.get("c1", i)) | (F.get("l0", i) != F.get("l1", i)), c)), lambda c: c.isNotNull())
        columns = F.when(F.col("problem") == "changed_cell", changed).otherwise(F.array(F.lit(None).cast("string")))
        out = out.unionByName(wrong.select(F.lit(p.name).alias("part"), "problem", "key", F.explode(columns).alias("column")))
    return out
