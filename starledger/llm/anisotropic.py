"""Nearest neighbours for the inner product by score-aware quantisation.

Each component of a vector is coded by one of 16 centres: four bits. The loss of a code weighs
the residual parallel to the vector more than the rest, since that part moves large inner products; codes are
improved one component at a time against the loss of the whole vector, and centres by least squares under the same
loss, on a bounded sample. A query sums table entries over codes (two codes a byte), and the best candidates by these sums are ranked by the
exact product in double precision. How far a sum can be off is bounded by the length of the candidate's residual, so every other
candidate that may reach the kth product found so far is ranked exactly too: codes that suit a table badly cost time, not neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_cells import PACK, best, ranked, search, usable

#: Vectors that centres are learned from, at most.
SAMPLE = 8_192
#: So many times k candidates of a cell are ranked exactly before others are ruled out.
RERANK = 8
_CENTRES = 16
#: Cosine from which scores matter: sets the weight of the parallel part.
_THRESHOLD = 0.2
_EPSILON = float(np.finfo(np.float32).eps)


@dataclass
class Codebook:
    """centres: components x 16 x 1; weight: of the parallel residual against the orthogonal one."""

    dim: int
    centres: np.ndarray
    weight: float

    @property
    def scale(self) -> float:
        """Sums and residuals are kept in this unit, so that they fit single precision."""
        return float(np.abs(self.centres).max()) or 1.0

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1, 1)

    def assign(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """A code for each component."""
        p = self._parts(x)
        u = p / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        n, m, _ = p.shape
        codes = np.empty((n, m), np.int64)
        along = np.empty((n, m))
        for s in range(m):
            r = p[:, s, None, :] - self.centres[s]
            codes[:, s] = (r**2).sum(axis=2).argmin(axis=1)
            along[:, s] = (r[np.arange(n), codes[:, s]] * u[:, s]).sum(axis=1)
        for _ in range(rounds):
            total = along.sum(axis=1)
            for s in range(m):
                r = p[:, s, None, :] - self.centres[s]
                part = (r * u[:, s, None, :]).sum(axis=2)
                loss = (r**2).sum(axis=2) + (self.weight - 1) * (part + (total - along[:, s])[:, None]) ** 2
                codes[:, s] = loss.argmin(axis=1)
                now = part[np.arange(n), codes[:, s]]
                total += now - along[:, s]
                along[:, s] = now
        return codes

    def pack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two codes in each byte, and the length of each vector's residual, rounded up."""
        codes = self.assign(x)
        left = np.linalg.norm(x - self.centres[np.arange(self.dim), codes, 0], axis=1) / self.scale * (1 + 1e-6)
        codes = codes.astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, ::2] << 4 | codes[:, 1::2], np.nextafter(left.astype(np.float32), np.float32(np.inf))

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code the share of the inner product that its 256 values stand for."""
        q = self._parts(query[None])[0]
        t = np.einsum("scd,sd->sc", self.centres / self.scale, q)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros((1, _CENTRES))])
        return (t[::2, :, None] + t[1::2, None, :]).reshape(len(t) // 2, -1).astype(np.float32)


def learn(sample: np.ndarray, rounds: int = 6, seed: int = 11) -> Codebook:
    """Centres by alternating assignment and weighted least squares."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    weight = max(1.0, (dim - 1) * _THRESHOLD**2 / (1 - _THRESHOLD**2))
    book = Codebook(dim, np.zeros((dim, _CENTRES, 1)), weight)
    p = book._parts(sample)
    u = p / np.maximum(np.linalg.norm(sample, axis=1), 1e-30)[:, None, None]
    n, m, _ = p.shape
    for s in range(m):  # spread starts: each next one is drawn by its squared distance to those before
        d = np.full(n, np.inf)
        at = int(rng.integers(n))
        for c in range(_CENTRES):
            book.centres[s, c] = p[at, s]
            d = np.minimum(d, ((p[:, s] - p[at, s]) ** 2).sum(axis=1))
            at = int(rng.choice(n, p=d / d.sum())) if d.sum() > 0 else int(rng.integers(n))
    for _ in range(rounds):
        codes = book.assign(sample, 1)
        along = ((p - book.centres[np.arange(m), codes]) * u).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(m):
            for c in range(_CENTRES):
                of = codes[:, s] == c
                if not of.any():
                    continue
                x, d = p[of, s], u[of, s]
                rest = total[of] - along[of, s] + (x * d).sum(axis=1)
                left = of.sum() * np.eye(1) + (weight - 1) * d.T @ d
                book.centres[s, c] = np.linalg.solve(left, x.sum(axis=0) + (weight - 1) * d.T @ rest)
    return book


def _code(x: np.ndarray, book: Codebook) -> np.ndarray:
    """Codes and the residual's length as bytes; vectors of another length than the codebook's have no codes and an infinite residual."""
    with np.errstate(over="ignore"):
        codes, left = book.pack(x) if x.shape[1] == book.dim else (np.empty((len(x), 0), np.uint8), np.full(len(x), np.inf, np.float32))
    return np.concatenate([codes, left[:, None].view(np.uint8)], axis=1)


def _columns(_x: np.ndarray, codes: np.ndarray, _book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Codes by column, and residuals."""
    return np.ascontiguousarray(codes[:, :-4].T), np.ascontiguousarray(codes[:, -4:]).view(np.float32)[:, 0]


def _exact(x: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike wherever its row lies, so that equal vectors tie."""
    return np.concatenate([(x[rows[at : at + PACK]] * query).sum(axis=1) for at in range(0, len(rows), PACK)])


def scan(ready, ids: np.ndarray, x: np.ndarray, query: np.ndarray, most: int, book: Codebook, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the best: ``first`` by the tables' sums, then all that the bound on a sum's error doesn't rule out."""
    columns, left = ready
    n, first = len(ids), max(first, most)
    rows = np.arange(n)
    if n > first and len(columns):
        unit = float(np.linalg.norm(query)) * book.scale
        tables = book.tables(query / np.linalg.norm(query))
        near = np.zeros(n, np.float32)
        for t, c in zip(tables, columns, strict=True):
            near += t[c]
        found = _exact(x, np.argpartition(near, n - first)[n - first :], query)
        least = float(np.partition(found, first - most)[first - most]) / unit
        # what single precision can lose in the tables, their sum and this bound
        least -= _EPSILON * ((len(tables) + 4) * float(np.abs(tables).max(axis=1).sum()) + 2 * abs(least))
        # not "at least": sums that aren't numbers rule nothing out
        rows = np.flatnonzero(~(near + left < np.float32(least)))
    scores = _exact(x, rows, query)
    places = best(scores, ids[rows], most)
    return rows[places], scores[places]


def nearest(vectors: DataFrame, asked: str = "vec_id % 20 = 0", k: int = 20, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product, all rows being candidates.

    Centres are learned from at most ``sample`` vectors of the commonest length, and every row is coded. Each cell ranks ``rerank`` times k
    candidates of a query exactly, then every one whose product may be higher than the kth of those, as its code and residual say, so no
    nearest one is missed. Vectors of other lengths are compared exactly among themselves. Null, zero and non-finite vectors take no part;
    ties go to the smaller vec_id. A row is not its own neighbour, but a row that repeats its vec_id is, and each of two such rows asks for
    itself. Other columns are ignored; a table with no other vectors gives no rows.
    """
    whole = usable(vectors, zero_too=False).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "hash")
    rows = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding").to_pylist()
    dims = [len(r) for r in rows]
    dim = max(set(dims), key=lambda d: (dims.count(d), d)) if dims else 2
    chosen = np.array([r for r in rows if len(r) == dim]) if dims else np.ones((1, 2))
    chosen = chosen[np.lexsort(chosen.T[::-1])]
    return ranked(search(whole, asked, k + 1, "double", _columns, partial(scan, first=rerank * k), _code, learn(chosen)), k)
