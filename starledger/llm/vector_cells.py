"""A query set against all vectors, in cells of bounded size.

Rows are packed into arrays where they lie, each pack gets a row (queries) or column (candidates) of a grid, and a
cell of the grid holds the packs of its row and column. A cell returns its best few for each of its queries;
one window over those gives the answer. The grid is sized from two counts, so neither side of a cell grows
with the table, and nothing of the vectors passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a pack, and of either side of a cell at most (on average).
PACK, COLUMN, ROW = 2048, 32_768, 8_192
#: Components of a cell's candidates at most (on average): longer vectors get more cells.
COLUMN_PARTS = 64 * COLUMN

_ARROW = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary())])
_SCHEMA = "cell int, dim int, ids binary, vectors binary, codes binary"
#: What stands for a row: its id, a hash of its vector (rows equal in both are interchangeable), and for a query how often it is asked.
_ROW = np.dtype([("id", "<i8"), ("hash", "<i8"), ("times", "<i8")])
Code = Callable[[np.ndarray], np.ndarray]


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, embedding) without null ids, vectors that are null, empty or hold null or non-finite parts, and zero vectors unless wanted."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    out = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine)
    if not zero_too:
        out = out.where(F.exists(x, lambda v: v != 0))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("embedding").alias("hash"))


def _packer(cells: int, code: Code | None, sent):
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        part = TaskContext.get().partitionId()
        for b in it:
            column = b.column("embedding")
            column = column if isinstance(column, pa.ListArray) else pa.array(column.to_pylist())
            ids = np.zeros(b.num_rows, _ROW)
            ids["id"], ids["hash"] = b.column("vec_id").to_numpy(), b.column("hash").to_numpy()
            ids["times"] = b.column("times").to_numpy() if "times" in b.schema.names else 1
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(ends)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                for at in range(0, len(rows), PACK):
                    own, v = ids[rows[at : at + PACK]], x[at : at + PACK]
                    place = (part * 0x9E3779B1 + made * 0x85EBCA6B) % (1 << 32)
                    made += 1
                    codes = code(v, sent.value) if code else None
                    yield pa.RecordBatch.from_pylist([{
                        "cell": ((place ^ place >> 15) * 0x2C1B3C6D % (1 << 32) >> 8) % cells, "dim": dim, "ids": own.tobytes(), "vectors": v.tobytes(), "codes": codes.tobytes() if codes is not None else None,
                    }], schema=_ARROW)

    return pack


def _joined(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Rows by id, their vectors and, where they have some, their codes, of one dimension."""
    packs = [r for r in t.to_pylist() if r["dim"] == dim]
    if not packs:
        return np.empty(0, _ROW), np.empty((0, dim)), None
    rows = [np.frombuffer(r["ids"], _ROW) for r in packs]
    x = np.concatenate([np.frombuffer(r["vectors"]).reshape(-1, dim) for r in packs])
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(len(i), -1) for r, i in zip(packs, rows, strict=True)]) if packs[0]["codes"] is not None else None
    rows = np.concatenate(rows)
    order = np.argsort(rows["id"], kind="stable")
    return rows[order], x[order], codes[order] if codes is not None else None


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    near = near[np.isfinite(scores[near])]
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search(vectors: DataFrame, asked: str, most: int, score_type: str, prepare: Callable, find: Callable, code: Code | None = None, model=None) -> DataFrame:
    """(query_id, query_hash, times, vec_id, hash, score): candidates with the ``most`` best scores for every row that satisfies ``asked``, its own row among them.

    ``vectors`` is what ``usable`` returns. ``prepare(rows' vectors, codes, model)`` makes what a cell's candidates need,
    ``find(prepared, ids, vectors, query, most, model)`` returns places and scores of a query's best. ``code(vectors, model)``, if given, makes
    the bytes that are sent beside each vector. Equal rows that ask are asked once, and ``times`` says how many they are; vectors meet only
    vectors of their length.
    """
    spark = vectors.sparkSession
    # the model has a fixed size
    sent = spark.sparkContext.broadcast(model)
    queries = vectors.where(asked).groupBy("vec_id", "hash").agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("times"))
    n, parts = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    q = queries.count()
    width = 2 * spark.sparkContext.defaultParallelism
    columns = max(1, math.ceil(n / COLUMN), math.ceil(parts / COLUMN_PARTS), min(math.ceil(n / PACK), width))
    rows = max(1, math.ceil(q / ROW))
    left = vectors.mapInArrow(_packer(columns, code, sent), _SCHEMA).withColumnRenamed("cell", "g").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    right = queries.mapInArrow(_packer(rows, None, sent), _SCHEMA).withColumnRenamed("cell", "h").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    out = pa.schema([(c, pa.int64()) for c in ("query_id", "query_hash", "times", "vec_id", "hash")] + [("score", pa.int64() if score_type == "long" else pa.float64())])

    def meet(candidates: pa.Table, asked_here: pa.Table) -> pa.Table:
        parts = [[] for _ in out]
        for dim in sorted(set(asked_here.column("dim").to_pylist())):
            ids, x, codes = _joined(candidates, dim)
            own, y, _ = _joined(asked_here, dim)
            if not len(ids):
                continue
            ready = prepare(x, codes, sent.value)
            for i, v in zip(own, y, strict=True):
                places, scores = find(ready, ids["id"], x, v, most, sent.value)
                for part, value in zip(parts, (*i.tolist(), ids["id"][places], ids["hash"][places], scores), strict=True):
                    part.append(value if isinstance(value, np.ndarray) else np.full(len(places), value))
        return pa.table([pa.array(np.concatenate(c or [np.empty(0)]).astype(f.type.to_pandas_dtype())) for c, f in zip(parts, out, strict=True)], schema=out)

    found = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, f"query_id long, query_hash long, times long, vec_id long, hash long, score {score_type}")
    place = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("hash")))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of what ``search`` found, without each query's own row, for each time that it is asked."""
    by = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("hash"))
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("hash") == F.col("query_hash"))
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1).withColumn("own", own.cast("int"))
    # of rows equal to the query's one is its own
    out = out.withColumn("passed", F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("own = 0 or passed > 1")
    out = out.withColumn("rank", F.col("rank") - F.least("passed", F.lit(1)).cast("int")).where(F.col("rank") <= k)
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")
