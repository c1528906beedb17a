"""Pixels many to a row, by tiles of an image, and groups of neighbouring places that may reach across tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are packed at a time.
_AT_ONCE = 1 << 18
#: Rows of places are told apart by it: places are below its half.
_WIDE = 1 << 32


def starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def packed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values binary): rows of equal keys that lie together, as many as are at hand, in one row; ``values`` are doubles.

    Rows are put together before any shuffle, so what follows moves and sorts few rows. A key has several rows.
    """
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _AT_ONCE:
                yield from made(held)
                held, n = [], 0
        if n:
            yield from made(held)

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        codes = [pc.fill_null(t.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy() for k in keys]
        order = np.lexsort(codes[::-1])
        at = starts(*(c[order] for c in codes))
        data = [t.column(v).to_numpy()[order] for v in values]
        ends = np.append(at[1:], len(order))
        out = [t.column(k).take(pa.array(order[at])).combine_chunks() for k in keys] + [pa.array([d[a:z].tobytes() for a, z in zip(at, ends, strict=True)], pa.binary()) for d in data]
        yield from pa.table(out, [*keys, *values]).to_batches(max_chunksize=256)

    return rows.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).mapInArrow(pack, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{v}` binary" for v in values)]))


def unpacked(t: pa.Table, name: str) -> np.ndarray:
    """The doubles of all rows of one key."""
    return np.frombuffer(b"".join(t.column(name).to_pylist()))


def groups(x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
    """For each place the first place, by y and x, of those that steps of up to ``reach`` pixels each way connect it to: its number among the places."""
    key = y.astype(np.int64) * _WIDE + x.astype(np.int64)
    places, first, of = np.unique(key, return_index=True, return_inverse=True)
    a, b = [], []
    for dy in range(reach + 1):
        for dx in range(-reach if dy else 1, reach + 1):
            sought = places + dy * _WIDE + dx
            at = np.searchsorted(places, sought)
            hit = np.flatnonzero(places[np.minimum(at, len(places) - 1)] == sought)
            a.append(hit)
            b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(places))
    while len(a):
        up = np.arange(len(places))
        np.minimum.at(up, a, b)
        np.minimum.at(up, b, a)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return first[label][of]


def links(border: DataFrame, image: str, name: str, reach: int) -> DataFrame:
    """(a, b): names of groups that have places (x, y) within ``reach`` of each other."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(reach + 1) for dx in range(-reach if dy else 0, reach + 1)])
    one = border.select(image, F.col(name).alias("a"), "x", "y", F.explode(steps).alias("s")).select(image, "a", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    other = border.select(image, "x", "y", F.col(name).alias("b"))
    # shuffled: steps make many rows of few, which a size by the table's file doesn't show
    return one.hint("shuffle_merge").join(other, [image, "x", "y"]).where("a != b").select("a", "b").distinct()
