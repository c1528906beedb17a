"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

``pieces`` tokenizes whole texts in Arrow batches and cuts only what is longer than a sequence. ``pack`` deals
the pieces round-robin into groups of bounded size, so no key can make a group large, and packs each group:
best-fit by falling length first, then a local search over the underfull bins. Pieces of one length are alike, so
the search knows lengths only. Its moves, each of which must raise the sum of squared fills, are a move of one
piece, an exchange of one piece for another, and an exchange of two pieces for one, either way, between any two
underfull bins. A bin that gives its last piece is saved. It ends at the group's lower bound, ceil(tokens / capacity),
or when no move is left; then some bins are packed anew and searched again, ``REOPENED`` times.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered by a worker, in each of two generations.
_REMEMBERED = 600_000
_COMBINING = re.compile("[\u0300-\u036f]")
#: Letters outside this range may be taken apart by normalization.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_BATCH_CHARS = 3_000_000
#: Pieces that are packed together.
GROUP = 20_000
#: Times that some bins of a group are packed anew where the local search ends above the lower bound.
REOPENED = 100


class WordIds:
    """Ids of whole texts as bytes (little-endian unsigned 32-bit), the library called once for each new word.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in turn. It also
    drops case, so A-Z are lowered first (unless combining marks follow letters, as they compose by case).
    New words go to the library together: those of Latin letters, and those of Latin letters and one stop, are parted again by
    the ids that end a word, any others by a symbol of one id between them (normalization may take their letters apart);
    what holds that symbol or a special token goes alone, and so do words that don't part as expected.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # a symbol of one id: case and composition don't make or change it
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        symbols = (chr(c) for c in range(0x2190, 0x1FB00) if unicodedata.category(chr(c)) == "So")
        self.mark, self.mark_id = next((c, ids[0]) for c in symbols if len(ids := self.lib.encode(f" {c} ", add_special_tokens=False).ids) == 1)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self.lib.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        old, young = self.old, self.young
        letters, stopped, new = [], [], []
        for w in words:
            known = old.get(w)
            if known is not None:
                young[w] = known
            elif "<|" in w or not w or self.mark in w or "İ" in w:
                young[w] = self._alone(w)
            elif not w.isascii() and _BEYOND_LATIN.search(w):
                new.append(w)
            elif w.isalpha():
                letters.append(w)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                stopped.append(w)
            else:
                new.append(w)
        self._together(letters, " ", lambda ids: np.flatnonzero(self.ends[ids]) + 1)
        self._together(stopped, " ", lambda ids: np.flatnonzero(self.ends[ids])[1::2] + 1)
        self._together(new, f" {self.mark} ", lambda ids: np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)

    def _together(self, words: list[str], between: str, cuts, skipped: int = 0) -> None:
        """``cuts(ids)``: where each word's ids end; so many ids stand between two words."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.lib.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = cuts(ids)
            if len(ends) != len(part) or ends[-1] != len(ids):
                self.young.update((w, self._alone(w)) for w in part)
                continue
            starts = np.append(0, ends[:-1] + skipped)
            raw = ids.tobytes()
            for w, a, b in zip(part, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                self.young[w] = raw[a:b]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [(t if _COMBINING.search(t) else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")).replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > _REMEMBERED:
            self.old, self.young = self.young, {}
        needed = set().union(*split) if split else set()
        self._learn(needed - self.young.keys())
        look = self.young.__getitem__
        return [b"".join(map(look, words)) for words in split]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cutter(path: str, capacity: int, end_id: int):
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in it:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text")
            start = 0
            while start < len(docs):
                part, chars = [], 0
                while start + len(part) < len(docs) and chars < _BATCH_CHARS:
                    part.append(texts[start + len(part)].as_py() or "")
                    chars += len(part[-1])
                rows = []
                for doc, ids in zip(docs[start : start + len(part)], words.ids(part), strict=True):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
                start += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, each ended by ``end_id``.

    A null text is an empty one, a null doc_id stays null, repeated rows are cut each for itself, a text of any length is cut
    whole, an empty table gives none, and columns other than doc_id and text are ignored.
    """
    if not Path(tokenizer).exists():
        raise FileNotFoundError(tokenizer)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _cutter(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class _Room:
    """Bins by free space, for best fit."""

    def __init__(self, capacity: int):
        self.free: list[int] = []
        self.at: dict[int, list[int]] = {}

    def put(self, free: int, b: int) -> None:
        if free not in self.at:
            bisect.insort(self.free, free)
            self.at[free] = []
        self.at[free].append(b)

    def take(self, size: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.free, size)
        if i == len(self.free):
            return None
        free = self.free[i]
        b = self.at[free].pop()
        if not self.at[free]:
            del self.at[free]
            self.free.pop(i)
        return free, b


def best_fit(sizes: list[int], capacity: int, key=None) -> list[list[int]]:
    """Bins of sizes: each size, largest (or largest ``key``) first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    room = _Room(capacity)
    for s in sorted(sizes, key=key, reverse=True):
        found = room.take(s)
        if found is None:
            bins.append([s])
            free, b = capacity, len(bins) - 1
        else:
            free, b = found
            bins[b].append(s)
        if free > s:
            room.put(free - s, b)
    return bins


class _Underfull:
    """The bins with room, found by the sizes in them and, if ``pairs``, by the sums of two of their sizes."""

    def __init__(self, bins: list[list[int]], capacity: int, pairs: bool):
        self.bins, self.capacity, self.pairs = bins, capacity, pairs
        self.fill = [sum(b) for b in bins]
        self.holders: list[dict[int, set[int]]] = [{}, {}]
        self.held = np.zeros((2, capacity + 1), bool)
        self.keys: dict[int, tuple[set[int], set[int]]] = {}
        for i in range(len(bins)):
            self.put(i)

    def _sums(self, b: list[int]) -> dict[int, tuple[int, int]]:
        return {s + t: (s, t) for i, s in enumerate(b) for t in b[:i]} if self.pairs else {}

    def put(self, i: int) -> None:
        self.keys[i] = (set(self.bins[i]), set(self._sums(self.bins[i])))
        for holders, held, keys in zip(self.holders, self.held, self.keys[i], strict=True):
            for k in keys:
                holders.setdefault(k, set()).add(i)
                held[k] = True

    def take(self, i: int) -> None:
        for holders, held, keys in zip(self.holders, self.held, self.keys.pop(i), strict=True):
            for k in keys:
                holders[k].discard(i)
                if not holders[k]:
                    del holders[k]
                    held[k] = False

    def gain(self, i: int) -> tuple[int, tuple[int, ...], int, int, int] | None:
        """What fills bin i the most and raises the sum of squares: gain, sizes to give, giver, size or sum to get, of how many."""
        b, fill = self.bins[i], self.fill[i]
        one = {0: (), **{s: (s,) for s in b}}
        best = None
        for many, options in ((0, {**self._sums(b), **one}), (1, one)):
            below = np.maximum.accumulate(np.where(self.held[many], np.arange(self.capacity + 1), -1))
            for given, sizes in options.items():
                k = int(below[min(self.capacity, given + self.capacity - fill)])
                while k > given and (best is None or k - given > best[0]):
                    giver = min(self.holders[many][k], key=self.fill.__getitem__)
                    if self.fill[giver] < fill + k - given:
                        best = (k - given, sizes, giver, k, many)
                        break
                    k = int(below[k - 1])
        return best

    def exchange(self, i: int, gain: int, given: tuple[int, ...], giver: int, key: int, many: int) -> None:
        self.take(giver)
        theirs, own = self.bins[giver], self.bins[i]
        for s in self._sums(theirs)[key] if many else (key,):
            theirs.remove(s)
            own.append(s)
        for s in given:
            own.remove(s)
            theirs.append(s)
        self.fill[i] += gain
        self.fill[giver] -= gain
        if theirs:
            self.put(giver)


def climb(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, fuller bins first, until no more bin can be saved or no move is left.

    Exchanges of two pieces are looked for where those of one piece don't suffice.
    """
    least = math.ceil(sum(map(sum, bins)) / capacity)
    full = [b for b in bins if sum(b) == capacity]
    loose = [b for b in bins if sum(b) < capacity]
    for pairs in (False, True):
        open_ = _Underfull(loose, capacity, pairs)
        moved = True
        while moved and len(full) + len(open_.keys) > least:
            moved = False
            for i in sorted(open_.keys, key=open_.fill.__getitem__, reverse=True):
                if i not in open_.keys:
                    continue
                open_.take(i)
                while open_.fill[i] < capacity and (step := open_.gain(i)):
                    open_.exchange(i, *step)
                    moved = True
                if open_.fill[i] < capacity:
                    open_.put(i)
                else:
                    full.append(open_.bins[i])
        loose = [open_.bins[i] for i in open_.keys]
    return full + loose


def improve(bins: list[list[int]], capacity: int, reopened: int = REOPENED, seed: int = 5) -> list[list[int]]:
    """Swap-based local search from a packing; never more bins than before.

    Where ``climb`` ends above the lower bound, up to ten underfull and ten full bins are packed anew in a shaken order, climbed again
    and taken over if they need fewer bins or have no smaller sum of squares; ``reopened`` times at most.
    """
    least = math.ceil(sum(map(sum, bins)) / capacity)
    rng = random.Random(seed)
    if len(bins) > least:
        bins = climb([list(b) for b in bins], capacity)
    for _ in range(reopened):
        if len(bins) <= least:
            break
        rng.shuffle(bins)
        bins.sort(key=lambda b: sum(b) == capacity)
        loose = sum(sum(b) < capacity for b in bins)
        chosen, rest = bins[: min(10, loose)] + bins[loose : loose + 10], bins[min(10, loose) : loose] + bins[loose + 10 :]
        tried = climb(best_fit([s for b in chosen for s in b], capacity, key=lambda s: s * rng.uniform(0.6, 1)), capacity)
        if (-len(tried), sum(sum(b) ** 2 for b in tried)) >= (-len(chosen), sum(sum(b) ** 2 for b in chosen)):
            bins = rest + tried
        else:
            bins = rest + chosen
    return bins


_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packer(capacity: int):
    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)  # a group of about GROUP pieces
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        sizes = t.column("length").to_numpy()
        first = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        whole = np.flatnonzero(sizes >= capacity)
        sequence[whole] = first + np.arange(len(whole))
        rest = np.flatnonzero(sizes < capacity)
        waiting: dict[int, list[int]] = {}
        for i in rest.tolist():
            waiting.setdefault(int(sizes[i]), []).append(i)
        bins = improve(best_fit(sizes[rest].tolist(), capacity), capacity)
        for number, b in enumerate(bins, first + len(whole)):
            at = 0
            for s in b:
                i = waiting[s].pop()
                sequence[i], offset[i] = number, at
                at += s
        out = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.cast(_PACKED).combine_chunks().to_batches()

    return pack


def pack(piece_table: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` tokens; offsets are gapless from 0.

    The table is counted first: read it from files, not from a long plan. Pieces of one length, also those of repeated rows, may
    change places; each keeps a place of its own. A null doc_id is kept; an empty table gives an empty result.
    """
    groups = max(1, math.ceil(piece_table.count() / group))
    return piece_table.repartition(groups).mapInArrow(
        _packer(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
