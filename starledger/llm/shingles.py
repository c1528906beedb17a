"""Word shingles of whole texts as sorted 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
#: Words whose hash is remembered; beyond it the memory starts anew.
_REMEMBERED = 300_000
#: Bytes of text hashed at once.
_CHUNK = 2_000_000


def _fold(columns: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(columns[0]), seed, np.uint64)
    for c in columns:
        out = (out ^ c) * _MIX
        out ^= out >> _SHIFT
    return out


class Shingler:
    """Distinct ``k``-word shingles; A-Z count as a-z and the bytes 09-0D and 20 part words.

    A text of fewer words is one shingle, one without words (or null) is an empty set.
    """

    def __init__(self, k: int = 5):
        self.k, self.hashes = k, {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.hashes
        if len(known) > _REMEMBERED:
            known.clear()
        for w in set(words) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        words, ends, size = [], [], 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            words += raw.split()
            ends.append(len(words))
            size += len(raw)
            if size > _CHUNK:
                out += self._cut(words, ends)
                words, ends, size = [], [], 0
        return out + self._cut(words, ends) if ends else out

    def _cut(self, words: list[bytes], ends: list[int]) -> list[np.ndarray]:
        k, h = self.k, self._words(words)
        n = max(0, len(h) - k + 1)
        grams = _fold([h[i : n + i] for i in range(k)], k) if n else h[:0]
        out, start = [], 0
        for end in ends:
            if end - start >= k:
                out.append(np.unique(grams[start : end - k + 1]))
            elif end > start:
                out.append(_fold([h[i : i + 1] for i in range(start, end)], end - start))
            else:
                out.append(h[:0])
            start = end
        return out
