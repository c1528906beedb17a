"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Each round at least halves the nodes that still have edges, so this covers any table.
MAX_ROUNDS = 64


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b); comp is the component's smallest node.

    A round points every node at its smallest neighbour, then replaces both ends of each edge by what
    they point at. Loops and repeats fall away, so a star vanishes in one round, however large its hub:
    the hub's rows meet in partial aggregates and in joins that can be split. Loops and null ends are
    ignored, and a table without edges has no components.
    """
    edges = edges.where("a < b or a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges, f"{tag}-edges0")
    maps = []
    for i in range(MAX_ROUNDS):
        if edges.isEmpty():
            scratch.drop(f"{tag}-edges{i}")
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        up = both.groupBy("node").agg(F.min("other").alias("up")).select("node", F.least("node", "up").alias("up"))
        up = scratch.keep(up, f"{tag}-map{i}")
        maps.append(up)
        nxt = (
            edges.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b")
            .where("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
        nxt = scratch.keep(nxt, f"{tag}-edges{i + 1}")
        scratch.drop(f"{tag}-edges{i}")
        edges = nxt
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if not maps:
        return scratch.spark.createDataFrame([], edges.toDF("node", "comp").schema)
    out = maps[0].withColumnRenamed("up", "comp")
    # a map has only the nodes that still had edges in its round; a node that is not its own parent may point beyond them
    for up in maps[1:]:
        out = out.join(up.toDF("comp", "next"), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    return out
