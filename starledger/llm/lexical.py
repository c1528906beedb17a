"""Ranked lexical search by windowed bucket scoring.

The documents of a batch are numbered by doc_id and cut into windows of fixed size. A row of the index is a window: postings of the asked
terms with their counts. To score, the postings that an item asks for are traversed window by window: their shares are
added into an array of one bucket a document, which stays in the processor's cache, a bitset says which buckets are occupied, and
these are harvested into a heap of the best. Counts over all documents are summed between the two passes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plainwords import numbers, slices, words
from .shared import Scratch

#: Documents of a window (8 bytes a bucket), bytes of texts numbered together.
WINDOW, _BYTES = 2048, 8_000_000
#: Bytes of item texts that are broadcast at once; more items are ranked in parts, each in passes of their own.
PART = 4_000_000
_INDEX = "ids binary, lengths binary, terms binary, ends binary, places binary, counts binary, docs long, words long, df binary"
_COLUMNS = ["ids", "lengths", "terms", "ends", "places", "counts", "docs", "words", "df"]


def _window(ids: list[int | None], texts: list[str | None], known: dict[bytes, int]) -> dict:
    """Postings by term: places of documents, ascending, and how often each holds the term; and what the window adds to the totals."""
    lengths = np.zeros(len(ids), np.int64)
    pairs = []
    for i, t in enumerate(texts):
        w = numbers(t, known)
        lengths[i] = len(w)
        pairs.append(w[w > 0].astype(np.int64) * WINDOW + i)
    pair, tf = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]), return_counts=True)
    terms, first = np.unique(pair // WINDOW, return_index=True)
    ends = np.append(first, len(pair))[1:]
    made = {
        "ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes() + np.array([i is None for i in ids], np.int8).tobytes(),
        "lengths": lengths.tobytes(), "terms": (terms - 1).astype(np.int32).tobytes(), "ends": ends.astype(np.int32).tobytes(),
        "places": (pair % WINDOW).astype(np.uint16).tobytes(), "counts": tf.astype(np.int64 if tf.max(initial=0) >> 31 else np.int32).tobytes(),
        "docs": int((lengths > 0).sum()), "words": int(lengths.sum()),
        "df": np.diff(ends, prepend=0).astype(np.int32).tobytes(),
    }
    return made


def _indexed(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    # terms of a part of the items
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c, pa.int64() if c in ("docs", "words") else pa.binary()) for c in _COLUMNS])
        for b in it:
            ids = b.column("doc_id")
            b = b.take(pc.sort_indices(ids))
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, z in slices(np.ones(len(sizes), np.int64), WINDOW):
                # texts are taken a few at a time, so that a window of long ones isn't held as strings
                texts = (t for c, d in slices(sizes[a:z], _BYTES) for t in b.column("text").slice(a + c, d - c).to_pylist())
                yield pa.RecordBatch.from_pylist([_window(b.column("doc_id").slice(a, z - a).to_pylist(), texts, sent.value)], schema=kind)

    return docs.mapInArrow(run, _INDEX)


class Ranker:
    """Weights of terms and, for each item, its terms with repeats; finds the k best documents of windows."""

    def __init__(self, asked: list[tuple[int, dict[int, int]]], weights: list[int], documents: int, total: int, k: int):
        self.asked, self.weights, self.documents, self.total, self.k = asked, np.array(weights, np.int64), documents, total, k
        self.heaps: list[list[tuple[int, bool, int, int]]] = [[] for _ in asked]
        self.arrived = 0

    def add(self, row: dict) -> None:
        n = len(row["lengths"]) // 8
        ids, lengths = np.frombuffer(row["ids"][: 8 * n], np.int64), np.frombuffer(row["lengths"], np.int64)
        missing = np.frombuffer(row["ids"][8 * n :], np.int8)
        terms, ends = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["ends"], np.int32)
        places = np.frombuffer(row["places"], np.uint16)
        tf = np.frombuffer(row["counts"], np.int32 if len(row["counts"]) == 4 * len(places) else np.int64).astype(np.int64)
        m = 75 + (25 * lengths * self.documents) // max(1, self.total)
        weight = np.repeat(self.weights[terms], np.diff(ends, prepend=0))
        shares = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[places]))
        occupied = np.zeros((len(terms), WINDOW // 8), np.uint8)
        for i, (a, z) in enumerate(zip(np.append(0, ends), ends, strict=False)):
            there = np.zeros(WINDOW, bool)
            there[places[a:z]] = True
            occupied[i] = np.packbits(there)
        place = {t: i for i, t in enumerate(terms.tolist())}
        buckets = np.zeros(WINDOW, np.int64)
        for (_, bag), heap in zip(self.asked, self.heaps, strict=True):
            buckets[:] = 0
            bits = np.zeros(WINDOW // 8, np.uint8)
            for term, times in bag.items():
                i = place.get(term)
                if i is not None:
                    a, z = ends[i - 1] if i else 0, ends[i]
                    # a term's places differ, so no addition is lost
                    buckets[places[a:z]] += times * shares[a:z]
                    bits |= occupied[i]
            self._harvest(heap, np.flatnonzero(np.unpackbits(bits)), buckets, ids, missing)

    def _harvest(self, heap: list, places: np.ndarray, buckets: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.k else 1
        places = places[buckets[places] >= least]
        if len(places) > self.k:
            cut = np.partition(buckets[places], len(places) - self.k)[len(places) - self.k]
            places = places[buckets[places] >= cut]
        # the smallest tuple of a heap is its worst document: lowest score, then a missing or larger id
        for p in places.tolist():
            self.arrived += 1
            one = (int(buckets[p]), not missing[p], -int(ids[p]), self.arrived)
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        for (item, _), heap in zip(self.asked, self.heaps, strict=True):
            for score, has, minus, _ in heap:
                yield item, -minus if has else None, score


def best(found: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank; groups are ranked in pieces first, so no task reads all that many tasks found."""
    piece = Window.partitionBy(by, "piece").orderBy(*order)
    few = found.withColumn("place", F.row_number().over(piece)).where(F.col("place") <= k).drop("place", "piece")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _part(spark: SparkSession, docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score, rank) for items (number, texts)."""
    known: dict[bytes, int] = {}
    asked = []
    for number, texts in items:
        # _window numbers terms from 0, words() from 1
        asked.append((number, dict(Counter(known.setdefault(w, len(known) + 1) - 1 for t in texts for ws in words(t) for w in ws))))
    index = Scratch(spark, "lexical").keep(_indexed(docs, known), "index")
    documents, total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(known), np.int64)
        for b in it:
            for r in b.to_pylist():
                held[np.frombuffer(r["terms"], np.int32)] += np.frombuffer(r["df"], np.int32)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["term", "df"])

    df = [0] * len(known)
    # one row a term of this part of the items
    for term, n in index.select("terms", "df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df]
    sent = spark.sparkContext.broadcast((asked, weights, documents, total, k))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(*sent.value)
        for b in it:
            for i in range(b.num_rows):
                ranker.add(b.slice(i, 1).to_pylist()[0])
        rows = list(ranker.found())
        piece = [TaskContext.get().partitionId() % 64] * len(rows)
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array(piece, pa.int32())], ["item", "doc_id", "score", "piece"])

    found = index.select("ids", "lengths", "terms", "ends", "places", "counts").mapInArrow(run, "item long, doc_id long, score long, piece int")
    return best(found, "item", [F.desc("score"), F.asc_nulls_last("doc_id")], k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", part: int = PART) -> DataFrame:
    """(item, rank, doc_id, score): the k documents with the highest scores above 0 for each item, equal scores by ascending doc_id.

    Terms are runs of ASCII digits and letters (A-Z as a-z) and characters beyond ASCII. Every row of ``docs`` is a document, also where ids
    repeat; one without an id comes after others of its score, null and empty texts have no terms. Items that share an id (null is an id too) are
    one item with the terms of its distinct texts; items without terms have no rows. Whole texts of any length count. All documents
    give counts; only postings of asked terms are kept. What the driver and a broadcast hold are the items' texts, ``part`` bytes at a time
    (a larger single item makes a part of its own). An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.select(F.col(item).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if total <= part else math.ceil(2 * total / part)
    out = None
    for p in range(parts):
        rows = (wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)).collect()
        by_id: dict = {}
        for r in rows:
            by_id.setdefault(r["id"], []).append(r["text"])
        names = spark.createDataFrame(list(enumerate(by_id)), f"item long, {item} {wanted.schema['id'].dataType.simpleString()}")
        got = _part(spark, docs, list(enumerate(by_id.values())), k)
        got = got.join(F.broadcast(names), "item").select(item, "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out
