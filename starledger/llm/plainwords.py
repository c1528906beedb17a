"""Words of ASCII digits, letters (A-Z as a-z) and everything beyond ASCII, as numbers of a known vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_INSIDE = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _INSIDE else 0x20 for b in range(256))
#: Bytes whose words are held as objects at once.
STRETCH = 1_000_000


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text in order, in lists of about a megabyte; none for null."""
    clean = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + STRETCH)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def numbers(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a whole text; 0 for words that aren't known."""
    parts = [np.fromiter((known.get(w, 0) for w in ws), np.int32, len(ws)) for ws in words(text)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most, or that hold one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
