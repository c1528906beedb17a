"""Words of UTF-8 bytes as numpy sees them: where they start, where a long text may be cut, what identifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, P, np.uint64))


def stretches(inside: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut a text, given by which of its bytes are inside words, into parts of about ``most`` bytes that cut no word."""
    start = 0
    while start < len(inside):
        end = start + most
        if end < len(inside):
            past = int(np.argmin(inside[end:]))
            end = len(inside) if inside[end + past] else end + past
        yield start, min(end, len(inside))
        start = end


def starts_and_terms(x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start, how far each byte is from its word's start, and each byte's share of its word's hash."""
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    mark = np.zeros(len(x), np.int64)
    mark[starts] = starts
    since = np.arange(len(x)) - np.maximum.accumulate(mark)
    power = _POWERS[np.minimum(since, 63)]
    far = inside & (since > 63)
    if far.any():
        power[far] = np.power(P, since[far].astype(np.uint64) + np.uint64(1))
    return starts, since, np.where(inside, (x.astype(np.uint64) + np.uint64(1)) * power, np.uint64(0))
