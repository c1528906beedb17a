"""Runs of repeated words in whole texts by Crochemore's partition refinement, many texts at a time in numpy.

Positions are classed by the factor of length l that starts there. From l to l + 1 a class is split by the classes of the next
positions, and of the parts that a class was split into at the last length all but the largest are enough to split by (smaller-half
strategy), so a position is looked at O(log n) times. Members of a class are linked in order. Two neighbours at a distance of l in a class
of length l are a square whose root isn't a power itself; squares of one period that start one after the other make a run.
A link is judged once, when it breaks: it was a square if its distance lies among the lengths through which it held.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .plainwords import slices, spread

#: Bytes of texts whose positions are refined together.
_BYTES = 4_000_000
_STRETCH = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RUN = "struct<start: long, length: long, period: long>"


def new_numbers() -> dict[bytes, int]:
    """Gives each new word the next number."""
    return defaultdict(count().__next__)


def word_numbers(raw: bytes, known: dict[bytes, int]) -> np.ndarray:
    """A number for each word of a text, the same for equal words."""
    parts, at = [np.empty(0, np.int32)], 0
    while at < len(raw):
        end = at + _STRETCH
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts)


class _Links:
    """Classes of positions: their sizes, their members in order as links, and a list that holds a class's members and some that left it."""

    def __init__(self, key: np.ndarray):
        n = len(key)
        order = np.argsort(key, kind="stable").astype(np.int32)
        new = np.append(True, np.diff(key[order]) != 0) if n else np.empty(0, bool)
        self.cls = np.empty(n, np.int32)
        self.cls[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.classes = len(first)
        self.size, self.start, self.held = (np.zeros(n + 1, np.int32) for _ in range(3))
        self.start[: self.classes] = first
        self.size[: self.classes] = self.held[: self.classes] = np.diff(np.append(first, n))
        self.members, self.used = order, n
        self.next, self.prev = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.since = np.ones(n, np.int32)
        self._chain(order, new, 1)
        self.moving = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _chain(self, at: np.ndarray, new: np.ndarray, length: int) -> None:
        """Link positions in order, apart from where a class begins."""
        a, b = at[:-1][~new[1:]], at[1:][~new[1:]]
        self.prev[at[new]] = -1
        self.next[at[np.append(new[1:], True)]] = -1
        self.next[a], self.prev[b], self.since[a] = b, a, length

    def judge(self, at: np.ndarray, last: int) -> None:
        """Keep the links from these positions that were squares at some length up to ``last``."""
        at = at[self.next[at] >= 0]
        gap = self.next[at] - at
        was = (self.since[at] <= gap) & (gap <= last)
        if was.any():
            self.squares.append((at[was], gap[was]))

    def remove(self, at: np.ndarray, length: int) -> None:
        """Take positions, sorted by class and place, out of their chains at this length."""
        before, after = self.prev[at], self.next[at]
        self.moving[at] = True
        head = (before < 0) | ~self.moving[before]
        tail = (after < 0) | ~self.moving[after]
        left, right = before[head], after[tail]
        self.judge(np.concatenate([at, left[left >= 0]]), length - 1)
        has = left >= 0
        self.next[left[has]] = right[has]
        self.since[left[has]] = length
        self.prev[right[right >= 0]] = left[right >= 0]
        self.moving[at] = False

    def add(self, at: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
        """Make a class of each group of positions; the numbers of the new classes."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        ids = self.classes + np.arange(len(first), dtype=np.int32)
        self.classes += len(first)
        if self.used + len(at) > len(self.members):
            self.members = np.concatenate([self.members, np.empty(max(len(at), len(self.members) // 2), np.int32)])
        self.members[self.used : self.used + len(at)] = at
        self.start[ids], self.size[ids], self.held[ids] = self.used + first, size, size
        self.used += len(at)
        self.cls[at] = np.repeat(ids, size)
        self._chain(at, new, length)
        return ids

    def enumerate(self, classes: np.ndarray) -> np.ndarray:
        """All members of classes; what left them is dropped from their lists, so it is passed over once."""
        held = self.held[classes].astype(np.int64)
        at = self.members[spread(self.start[classes].astype(np.int64), held)]
        own = np.repeat(classes, held)
        at = at[self.cls[at] == own]
        size = self.size[classes].astype(np.int64)
        self.members[spread(self.start[classes].astype(np.int64), size)] = at
        self.held[classes] = size
        return at


def _sorted(*keys: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Rows of numbers below ``most`` in order."""
    bits = max(1, int(most).bit_length())
    if bits * len(keys) > 63:
        order = np.lexsort(keys[::-1])
        return tuple(k[order] for k in keys)
    packed = keys[0].astype(np.int64)
    for k in keys[1:]:
        packed = packed << bits | k
    packed.sort()
    return tuple((packed >> bits * (len(keys) - 1 - i) & (1 << bits) - 1).astype(np.int32) for i in range(len(keys)))


def squares(key: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares with a root that isn't a power, none of more than 2 * ``longest`` positions.

    Positions with equal keys are equal; squares don't cross a key that occurs once.
    """
    links = _Links(key)
    n, small, last = len(key), np.arange(len(key), dtype=np.int32), 1
    for length in range(2, longest + 1):
        at = small[small > 0] - 1
        at = at[links.size[links.cls[at]] > 1]
        if not len(at):
            break
        last = length
        c, d, at = _sorted(links.cls[at], links.cls[at + 1], at, most=n)
        new_class = np.append(True, c[1:] != c[:-1])
        new = new_class | np.append(True, d[1:] != d[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        parent = c[first]
        of = np.flatnonzero(new_class[first])
        moved, largest = np.add.reduceat(size, of), np.maximum.reduceat(size, of)
        group_of = np.repeat(np.arange(len(of)), np.diff(np.append(of, len(first))))
        rest = links.size[parent[of]] - moved
        # the first of the largest parts of each class needn't split others; where nothing is left it stays as the class
        big = np.flatnonzero(size == largest[group_of])
        big = big[np.append(True, group_of[big][1:] != group_of[big][:-1])]
        stays = np.zeros(len(first), bool)
        stays[big[rest == 0]] = True
        splits = np.ones(len(first), bool)
        splits[big[(rest == 0) | (largest > rest)]] = False
        goes = np.repeat(~stays, size)
        if not goes.any():
            small = at[:0]
            break
        links.remove(_sorted(c[goes], at[goes], most=n)[1], length)
        np.subtract.at(links.size, parent[~stays], size[~stays])
        links.add(at[goes], new[goes], length)
        leftover = parent[of][(rest > 0) & (largest > rest)]
        small = at[np.repeat(splits, size)]
        if len(leftover):
            small = np.concatenate([small, links.enumerate(leftover)])
        small.sort()
    links.judge(np.arange(n, dtype=np.int32), last)
    found = links.squares
    return (np.concatenate([s for s, _ in found]), np.concatenate([g for _, g in found])) if found else (small[:0], small[:0])


def runs(texts: list[np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of at least ``least`` words, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.append(0, np.cumsum(sizes + 1))
    total = int(first[-1])
    words = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    key = np.empty(total, np.int64)
    for i, t in enumerate(texts):
        key[first[i] : first[i + 1] - 1] = t.astype(np.int64) + words * i
        # an end that equals nothing
        key[first[i + 1] - 1] = words * len(texts) + i
    at, gap = squares(key, int(sizes.max(initial=0)) // 2)
    gap, at = _sorted(gap, at, most=total + 1)
    new = np.append(True, (np.diff(at) != 1) | (np.diff(gap) != 0)) if len(at) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    start, period = at[begin].astype(np.int64), gap[begin].astype(np.int64)
    length = np.diff(np.append(begin, len(at))) - 1 + 2 * period
    enough = length >= least
    start, length, period = start[enough], length[enough], period[enough]
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - first[text])[order], length[order], period[order]


def _collapsed(raw: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words of a text, joined by one space, without those that a run holds after its first period."""
    if not len(start) and len(raw) <= _STRETCH:
        return b" ".join(raw.split())
    x = np.frombuffer(raw + b" ", np.uint8)
    space = _SPACE[x]
    begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    # each word takes the white space behind it along
    ends = np.flatnonzero(space & ~np.append(True, space[:-1])) + 1
    edges = np.zeros(len(begins) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    marks = np.zeros(len(x) + 1, np.int8)
    marks[begins[kept]] += 1
    marks[ends[kept]] -= 1
    return np.where(space, np.uint8(0x20), x)[np.cumsum(marks[:-1], dtype=np.int8) > 0][:-1].tobytes()


def find_runs(docs: DataFrame, text: str = "text", least: int = 12, collapse: bool = True) -> DataFrame:
    """Add to every row runs (start, length and period in words, by start and period) and, unless it isn't wanted, the collapsed text.

    Words are parted by the bytes 09-0D and 20 and compared exactly. A run is a stretch of at least ``least`` words and twice its smallest
    period that no neighbouring word extends. Null and empty texts have no runs and collapse to an empty text; whole texts are
    searched, one of n words in O(n log n) steps and about 60 n bytes. Repeated rows have equal runs, an empty table stays empty, other columns
    stay; ValueError if one of them has a name of the added columns.
    """
    added = ["runs", "collapsed"] if collapse else ["runs"]
    clash = set(added) & set(docs.columns)
    if clash:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"runs array<{RUN}>" + ", collapsed string" * collapse).fields])
    place = docs.columns.index(text)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        known = new_numbers()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(place).to_pylist()]
        of, start, length, period = runs([word_numbers(r, known) for r in raw], least)
        ends = np.searchsorted(of, np.arange(len(raw) + 1))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        columns = [*b.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans)]
        if collapse:
            parts = (slice(a, z) for a, z in zip(ends[:-1], ends[1:], strict=True))
            columns.append(pa.array([_collapsed(r, start[s], length[s], period[s]).decode("utf-8", "surrogatepass") for r, s in zip(raw, parts, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names, *added])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            # texts of like length together, as the longest one says how many lengths are gone through
            sizes = pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
            order = np.argsort(-sizes, kind="stable")
            for a, z in slices(sizes[order], _BYTES):
                yield batch(b.take(pa.array(order[a:z])))

    return docs.mapInArrow(run, schema)
