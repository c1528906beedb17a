"""Exact top-k search by Fagin's threshold algorithm.

In each cell every dimension has its candidates in a sorted list. A query reads its lists from the end that raises
its score, all to one depth; what they show for the first time is scored in full; the values at that depth bound
what no list has shown yet. It stops when that bound is below the kth result (an equal score may still win by its
id), or when all are seen. Depths grow fourfold, so each step is a few numpy calls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_cells import best, ranked, search, usable

_FIRST_DEPTH, _GROWTH = 16, 4


def sorted_lists(x: np.ndarray, _codes=None, _model=None) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension the places in ascending order of value, and the values in that order."""
    order = np.argsort(x, axis=0, kind="stable").T.copy()
    return order, np.take_along_axis(x.T, order, axis=1)


def threshold_search(lists, ids: np.ndarray, x: np.ndarray, query: np.ndarray, k: int, _model=None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best candidates for one query."""
    order, values = lists
    n = len(ids)
    scores = np.full(n, -np.inf)
    seen, left = np.zeros(n, bool), n
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    shown, depth = 0, min(n, _FIRST_DEPTH)
    while left:
        if not len(up) + len(down):  # every score is 0
            new = np.flatnonzero(~seen)
        else:
            fresh = np.zeros(n, bool)
            fresh[order[up, n - depth : n - shown]] = True
            fresh[order[down, shown:depth]] = True
            new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        scores[new] = x[new] @ query
        left -= len(new)
        if depth == n:
            break
        bound = values[up, n - depth] @ query[up] + values[down, depth - 1] @ query[down]
        if n - left > k and np.partition(scores, n - k)[n - k] > bound:
            break
        shown, depth = depth, min(n, depth * _GROWTH)
    places = best(scores, ids, k)
    return places, scores[places]


def top_k(vectors: DataFrame, asked: str = "vec_id % 20 = 0", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): exact k highest integer inner products.

    Components become floor(scale * x). Scores are exact while sums of products stay below 2^53. Vectors that are
    null or hold null or non-finite parts take no part; ties go to the smaller vec_id. A row is not its own neighbour, but a row that repeats
    its vec_id is, and each of two such rows asks for itself. Other columns are ignored; a table with no other vectors gives no rows.
    """
    whole = usable(vectors, zero_too=True).select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double")).alias("embedding"), "hash")
    return ranked(search(whole, asked, k + 1, "long", sorted_lists, threshold_search), k)
