"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character 3- and 5-grams,
followed by a softmax over two classes. Vectors and output weights are trained together by stochastic
gradient descent in numpy, in one task on the counts of a bounded sample of labelled documents;
the model (a few megabytes, whatever the corpus) then goes to the tasks that score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .folds import labelled_sample
from .scoring import fitted
from .wordbytes import MIX, P, starts_and_terms, stretches

#: Labelled documents to learn from, at most.
SAMPLE = 6_000
_WORDS, _PAIRS, _CHARS = 1 << 13, 1 << 13, 1 << 13
#: Word pairs of a word with itself share one vector; the last bucket.
BUCKETS = _WORDS + _PAIRS + 2 * _CHARS + 1
DIM = 16
EPOCHS = 8
#: Bytes of text whose grams are counted at once.
_CHUNK = 400_000


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    h = h * MIX
    h ^= h >> np.uint64(31)
    return ((h * MIX) >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64)


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of one text's grams, with repeats, a part of a long text at a time. White space is any byte up to 20 hex.

    Parts end between words; pairs and character grams that lie across an end belong to the part in which they start or end.
    """
    every = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
    dark = every > 32
    if not dark.any():
        return
    before = None
    for start, end in stretches(dark, _CHUNK):
        x = every[start:end]
        starts, _, terms = starts_and_terms(x, dark[start:end])
        if len(starts):
            words = np.add.reduceat(terms, starts)
            yield _bucket(words, _WORDS)
            if before is not None:
                words = np.append(before, words)
            pair = _bucket(words[:-1] * P + words[1:], _PAIRS) + _WORDS
            pair[words[:-1] == words[1:]] = BUCKETS - 1
            yield pair
            before = words[-1]
        for i, n in enumerate((3, 5)):
            wide = every[start : end + n - 1].astype(np.uint64) + np.uint64(1)
            m = len(wide) - n + 1
            if m > 0:
                h = wide[:m].copy()
                for j in range(1, n):
                    h = h * P + wide[j : m + j]
                yield _bucket(h, _CHARS) + _WORDS + _PAIRS + i * _CHARS


def counts(texts: list[str | None]) -> np.ndarray:
    """A row for each text: how often it has each gram. A text without words is a row of zeros."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, t in zip(out, texts, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        parts = grams(raw) if len(raw) > _CHUNK else [np.concatenate([*grams(raw), np.empty(0, np.int64)])]
        for part in parts:
            row += np.bincount(part, minlength=BUCKETS)
    return out


def shares(texts: list[str | None]) -> np.ndarray:
    out = counts(texts)
    return out / np.maximum(1.0, out.sum(axis=1, keepdims=True))


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1."""
        out = np.empty(len(texts))
        for at in range(0, len(texts), 128):
            z = (shares(texts[at : at + 128]) @ self.vectors) @ self.weights + self.bias
            out[at : at + 128] = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30).astype(np.float64)))
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, seed: int = 7) -> Model:
    """rows: (buckets, counts) of each document. Rates adapt to each vector; minibatches of 32."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if len(labels):
        share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, None)
        bias += np.log(share).astype(np.float32)
    seen_v, seen_w = np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32)
    scale = np.float32(50)  # shares are small; sums of scaled shares keep gradients in range
    for _ in range(epochs if len(set(labels.tolist())) == 2 else 0):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 32):
            part = order[at : at + 32]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] / np.float32(max(1, rows[i][1].sum(dtype=np.int64))) for i in part])
            used, local = np.unique(idx, return_inverse=True)
            dense = np.zeros((len(part), len(used)), np.float32)
            dense[np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part]), local] = val * scale
            hidden = dense @ vectors[used]
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p /= len(part)
            grad_w, grad_v = hidden.T @ p, dense.T @ (p @ weights.T)
            seen_w += grad_w**2
            weights -= rate * grad_w / np.sqrt(seen_w)
            bias -= 0.1 * rate * p.sum(axis=0)
            seen_v[used] += (grad_v**2).mean(axis=1)
            vectors[used] -= 0.2 * rate * grad_v / np.sqrt(seen_v[used])[:, None]
    return Model(vectors * scale, weights, bias)


def _packed(row: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets in 16 bits and their counts in as few bytes as the largest needs."""
    at = np.flatnonzero(row)
    n = row[at].astype(np.uint32)
    return at.astype(np.uint16).tobytes(), n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def _featurize(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            packed = [_packed(r) for r in counts(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(c, pa.binary()) for c in zip(*packed, strict=True))], ["label", "buckets", "counts"])


def _trained(sample: pa.Table | None) -> Model:
    if sample is None:
        return train([], np.empty(0, np.int64))
    y = sample.column("label").to_numpy().astype(np.int64)
    rows = []
    for i in range(len(y)):
        at, n = (np.frombuffer(sample.column(c)[i].as_buffer(), np.uint8) for c in ("buckets", "counts"))
        rows.append((at.view(np.uint16), n.view(f"u{2 * len(n) // len(at)}") if len(at) else n))
    order = sorted(range(len(y)), key=lambda i: (y[i], *(xxhash.xxh3_128_digest(x) for x in rows[i])))  # as arrival order varies
    return train([rows[i] for i in order], y[order])


def fit(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE) -> Model:
    """Learn from at most ``most`` labelled documents, in one task; without both labels among them, scores are the prior.

    Null texts, ids and labels aren't learned from, a document labelled or present twice counts once, and columns other than
    doc_id, text and the label are ignored. Empty tables give an even prior.
    """
    return fitted(labelled_sample(docs, labels, "quality", learn, most).mapInArrow(_featurize, "label int, buckets binary, counts binary"), _trained)
