"""Identities: hashes of canonical JSON, stable ids and seals, all independent of row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(columns: dict[str, Column]) -> Column:
    """Keys in order, nulls kept, NaN refused."""
    parts = []
    for name in sorted(columns):
        c = columns[name]
        value = F.to_json(F.array(c), {"ignoreNullFields": "false"})  # an array, so that a bare value gets JSON's spelling
        value = F.regexp_replace(value, r"^\[([\s\S]*)\]$", "$1")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_hash(columns: dict[str, Column]) -> Column:
    """sha256: and the hex digest of the canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(columns), 256))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and 24 hex digits of a hash over the parts' texts; parts are kept apart by a unit separator."""
    texts = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    return F.concat(F.lit(f"{prefix}."), F.substring(F.sha2(F.concat_ws("\u001f", *texts), 256), 1, 24))


def member_id(prefix: str, members: Column) -> Column:
    """The same for an array, whatever its order."""
    return stable_id(prefix, F.array_join(F.array_sort(members.cast("array<string>")), "\u001e"))


def seal(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """One hash over the rows of each group, independent of order, for groups of any size.

    Row hashes are bucketed by their first digits; buckets are sealed on their own and then together, so no
    task gathers a whole group: the second step has at most 4096 rows a group.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    hashed = df.select(*group, row.alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    # equal rows are counted before they meet
    counted = hashed.groupBy(*group, "bucket", "h").agg(F.count(F.lit(1)).alias("n"))
    part = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string")))), ","), 256)
    parts = counted.groupBy(*group, "bucket").agg(part.alias("p"), F.sum("n").alias("n"))
    return parts.groupBy(*group).agg(F.sum("n").alias("rows"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "p"))), ","), 256)).alias("seal"))


def sorted_set(c: Column) -> Column:
    """Distinct strings in the order of their lower-case forms."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(c), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"])


def has_duplicates(c: Column) -> Column:
    """Some item occurs twice when case is ignored."""
    return F.size(F.array_distinct(F.transform(c, F.lower))) < F.size(c)
