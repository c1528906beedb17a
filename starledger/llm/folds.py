"""Labelled rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, unlabelled: int = 0) -> DataFrame:
    """(label, text): at most ``most`` labelled documents that satisfy ``learn`` and ``unlabelled`` others without their labels, the same ones each time.

    A document labelled twice counts once, with its largest label; null labels, ids and texts are left out,
    and of rows that share a doc_id one is used.
    """
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(*by).limit(most)
    )
    if unlabelled:
        # an id is among the first of all or has a label that is learned from, so so many suffice
        first = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(*by).limit(most + unlabelled)
        rest = first.join(chosen, "doc_id", "left_anti").orderBy(*by).limit(unlabelled)
        chosen = chosen.unionByName(rest.withColumn("label", F.lit(None).cast("int")))
    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``most`` and ``unlabelled`` rows of two numbers are sent around
    return found.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
