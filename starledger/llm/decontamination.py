"""Benchmark passages in documents by Wu-Manber search over words.

Patterns are the windows of consecutive words of benchmark items. All windows of one length share a table of shifts: for each block of
two words, how far the last word of any window that holds the block is from the block's end. A cursor looks at the block that ends
where it stands and skips as many words as no window can end in. Where the shift is zero, the block's bucket names the windows that end in
it; their first two words are compared, then all. Cursors walk stretches of a batch of texts side by side in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plainwords import numbers, slices, spread, words
from .shared import Scratch

#: Words that one cursor walks over, bytes of texts searched at once, pairs of place and window compared at once.
_WALK, _BYTES, _PAIRS = 256, 4_000_000, 1_000_000
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark is searched for in parts, each in a pass of its own.
PART = 4_000_000
_ADDED = ("n_words", "hits", "items")
_KIND = "n_words long, hits array<struct<start: long, end: long>>, items array<string>"


class Windows:
    """The tables for all windows of one length; ``found`` gives the ends of their occurrences."""

    def __init__(self, windows: np.ndarray):
        self.windows, self.m = windows, windows.shape[1]
        self.b = min(2, self.m)
        self.mask = (1 << max(12, (4 * len(windows)).bit_length())) - 1
        self.shift = np.full(self.mask + 1, self.m - self.b + 1, np.int32)
        for end in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self._block(windows[:, end - self.b + 1], windows[:, end]), self.m - 1 - end)
        last = self._block(windows[:, self.m - self.b], windows[:, self.m - 1])
        self.bucketed = np.argsort(last, kind="stable")
        self.bucket = np.append(0, np.cumsum(np.bincount(last, minlength=self.mask + 1)))

    def _block(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        if self.b == 1:
            return word.astype(np.int64) & self.mask
        mixed = (before.astype(np.int64) * 0x9E3779B1 + word) * 0x2C1B3C6D
        return (mixed ^ mixed >> 23) & self.mask

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of last words, and the windows that end there."""
        at = np.arange(self.m - 1, len(ids), _WALK)
        stop = np.minimum(at + _WALK, len(ids))
        ends = []
        while len(at):
            step = self.shift[self._block(ids[at - self.b + 1], ids[at])]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate([np.empty(0, np.int64), *ends])
        last = self._block(ids[ends - self.b + 1], ids[ends])
        first, count = self.bucket[last], self.bucket[last + 1] - self.bucket[last]
        places, which = [ends[:0]], [ends[:0]]
        for a, z in slices(count, _PAIRS):
            place, window = np.repeat(ends[a:z], count[a:z]), self.bucketed[spread(first[a:z], count[a:z])]
            # the two first words, then the others from the last one on
            for j in [*range(self.b), *range(self.m - 1, self.b - 1, -1)]:
                same = ids[place - (self.m - 1 - j)] == self.windows[window, j]
                place, window = place[same], window[same]
            places.append(place)
            which.append(window)
        return np.concatenate(places), np.concatenate(which)


class Searcher:
    """All windows of ``k`` words of the items (id, text); an item of fewer words, but not none, is one window."""

    def __init__(self, items: list[tuple[str | None, str | None]], k: int):
        self.known: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        place = {n: i for i, n in enumerate(self.names)}
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, text in items:
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for ws in words(text) for w in ws], np.int32)
            if len(ids):
                m = min(k, len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(ids, m)
                by_length.setdefault(m, []).append((rows, np.full(len(rows), place.get(name, -1))))
        self.tables = []
        for parts in by_length.values():
            distinct, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate([o for _, o in parts])], axis=1), axis=0)
            owner, starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            self.tables.append((Windows(distinct), owner, starts))

    def search(self, texts: list[str | None]) -> pa.RecordBatch:
        """n_words, merged stretches of hit words, and names of items for each text."""
        each = [numbers(t, self.known) for t in texts]
        n_words = np.array([len(e) for e in each], np.int64)
        # a word that no window holds parts the texts
        ids = np.concatenate([x for e in each for x in (e, np.zeros(1, np.int32))])
        first = np.append(0, np.cumsum(n_words + 1))
        edges = np.zeros(len(ids) + 1, np.int32)
        owned = [np.empty((0, 2), np.int64)]
        for table, owner, starts in self.tables:
            ends, which = table.found(ids)
            places = np.unique(ends)
            edges[places - table.m + 1] += 1
            edges[places + 1] -= 1
            pairs = np.unique(np.stack([np.searchsorted(first, ends, "right") - 1, which], axis=1), axis=0)
            count = starts[pairs[:, 1] + 1] - starts[pairs[:, 1]]
            owned.append(np.stack([np.repeat(pairs[:, 0], count), owner[spread(starts[pairs[:, 1]], count)]], axis=1))
        hit = np.cumsum(edges[:-1]) > 0
        turns = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        begin, end = turns[::2], turns[1::2]
        text = np.searchsorted(first, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - first[text]), pa.array(end - first[text])], ["start", "end"])
        owned = np.unique(np.concatenate(owned), axis=0)
        owned = owned[owned[:, 1] >= 0]
        names = pa.array(self.names, pa.string()).take(pa.array(owned[:, 1]))
        at = np.arange(len(texts) + 1)
        return pa.RecordBatch.from_arrays([
            pa.array(n_words),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(text, at).astype(np.int32)), spans),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(owned[:, 0], at).astype(np.int32)), names),
        ], list(_ADDED))


def _searched(docs: DataFrame, text: str, items: list, k: int, keep: list[str]) -> DataFrame:
    # a part of the benchmark of at most PART bytes, or one item
    sent = docs.sparkSession.sparkContext.broadcast(Searcher(items, k))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(_KIND).fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            column = b.column(text)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, z in slices(sizes, _BYTES):
                got = sent.value.search(column.slice(a, z - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, z - a) for c in keep), *got.columns], [*keep, *_ADDED])

    return docs.mapInArrow(run, schema)


def _merged(hits: Column) -> Column:
    """Stretches in order, those that touch or overlap as one."""
    kind = "array<struct<start: long, end: long>>"

    def add(done: Column, h: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (h["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(h))).cast(kind)

    return F.aggregate(F.array_sort(hits), F.array().cast(kind), add)


def matches(docs: DataFrame, benchmark: DataFrame, k: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", part: int = PART) -> DataFrame:
    """Add to every row n_words, hits (stretches [start, end) of words inside occurrences of windows) and items (item ids as sorted strings).

    Null and empty texts have no words and no hits; whole texts are searched, however long. Items that share an id count once; a
    window of an item without an id hits words, but names no item. Repeated rows are searched alike, empty tables give no
    rows or no hits, other columns stay; ValueError if one of them has a name of the added columns.
    """
    clash = set(_ADDED) & set(docs.columns)
    if clash:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    wanted = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= part:
        return _searched(docs, text, [tuple(r) for r in wanted.collect()], k, docs.columns)
    # twice the parts that would do, as items are dealt by hash; one part at a time is on the driver
    parts = math.ceil(2 * total / part)
    scratch, row = Scratch(docs.sparkSession, "decontamination"), "row"
    while row in docs.columns:
        row += "_"
    copy = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = None
    for p in range(parts):
        items = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        one = scratch.keep(_searched(copy.select(row, text), text, [tuple(r) for r in items], k, [row]), f"part{p}")
        found = one if found is None else found.unionByName(one)
    by_row = found.groupBy(row).agg(
        F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return copy.join(by_row, row).select(*docs.columns, *_ADDED)
