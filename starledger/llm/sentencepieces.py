"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no vocabulary piece can span: before a run of word marks and around characters that stand in
no longer piece. The parts repeat much, so each worker encodes a batch's new parts and remembers them. New
parts are encoded together in numpy: an agenda of adjacent symbol pairs for each part, scored by the piece they
would make; each round takes from every agenda its best pair (ties: leftmost), joins it and puts the two new
pairs on the agenda, until no pair makes a piece. Long parts have their agenda in a heap. Every part is then
encoded by the sentencepiece library as well, in the same Arrow batch, and any difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_REMEMBERED = 400_000
_BATCH_CHARS = 2_000_000
#: Parts of up to so many symbols are encoded together.
_WIDE = 24
_NONE = np.iinfo(np.int32).max


class PairAgenda:
    """Encoder of one vocabulary."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece as spm

        self.lib = sp = spm.SentencePieceProcessor(model_file=path)
        self.check = check
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], "<u4")
        joined = {p for p in plain if len(p) > 1}
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces with a word mark inside aren't supported")
        # symbols: pieces keep their ids, characters that only stand in longer pieces get numbers above
        self.symbol = {p: i for p, i in plain.items()}
        for c in sorted({c for p in joined for c in p} - plain.keys()):
            self.symbol[c] = n + len(self.symbol)
        self.inner = {c for p in joined for c in p}
        self.pieces = n
        top = max(self.symbol.values(), default=0) + 1
        self.unknown = top  # any character outside the vocabulary: joins nothing
        self.base = top + 1
        by_score = sorted(joined, key=lambda p: -sp.get_score(plain[p]))
        rank, last = {}, None
        for p in by_score:  # equal scores share a rank
            s = sp.get_score(plain[p])
            if s != last:
                place, last = len(rank), s
            rank[p] = place
        keys, ranks, made = [], [], []
        for p in joined:
            for i in range(1, len(p)):
                a, b = self.symbol.get(p[:i]), self.symbol.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(rank[p])
                    made.append(plain[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int32)[order], _NONE)
        self.made = np.append(np.array(made, np.int32)[order], 0)
        self.pair = dict(zip(keys, zip(ranks, made, strict=True), strict=True))
        self.cutter = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- parts of a text

    def parts(self, text: str) -> list[str]:
        text = MARK + text.replace(" ", MARK)
        if "\n" in self.inner or "\x00" in text or MARK + MARK in text:
            return self.cutter.findall(text) if "\n" not in self.inner else re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        return [p for p in text.replace(MARK, "\x00" + MARK).replace("\n", "\x00\n\x00").split("\x00") if p]

    # -- agendas

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), at

    def _together(self, parts: list[str]) -> list[np.ndarray]:
        """Symbols left of parts of at most _WIDE characters."""
        number, unknown = self.symbol, self.unknown
        n = np.array([len(p) for p in parts])
        width = int(n.max())
        sym = np.full((len(parts), width), -1, np.int32)
        sym[np.arange(width) < n[:, None]] = [number.get(c, unknown) for p in parts for c in p]
        rank = np.full((len(parts), width), _NONE, np.int32)
        at = np.zeros((len(parts), width), np.int64)
        if width > 1:
            both = sym[:, 1:] >= 0
            rank[:, :-1][both], at[:, :-1][both] = self._look(sym[:, :-1][both], sym[:, 1:][both])
        live = np.arange(len(parts))
        while len(live):
            best = rank[live].argmin(axis=1)
            live, best = (x[rank[live, best] != _NONE] for x in (live, best))
            if not len(live):
                break
            new = self.made[at[live, best]]
            # close the gap that the right symbol of each pair leaves
            cols = np.arange(width)
            src = np.minimum(cols + (cols > best[:, None]), width - 1)
            rows = live[:, None]
            s, r, a = sym[rows, src], rank[rows, src], at[rows, src]
            s[:, -1], r[:, -1] = -1, _NONE
            i = np.arange(len(live))
            s[i, best] = new
            for left in (best - 1, best):
                ok = (left >= 0) & (left + 1 < width)
                ok[ok] &= s[i[ok], left[ok] + 1] >= 0
                r[i[left >= 0], left[left >= 0]] = _NONE
                j, k = i[ok], left[ok]
                r[j, k], a[j, k] = self._look(s[j, k], s[j, k + 1])
            sym[live], rank[live], at[live] = s, r, a
        return [row[row >= 0] for row in sym]

    def _alone(self, part: str) -> list[int]:
        """Symbols left of one long part, its agenda in a heap."""
        sym = [self.symbol.get(c, self.unknown) for c in part]
        before, after = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            found = self.pair.get(sym[i] * self.base + sym[j])
            if found:
                heapq.heappush(agenda, (found[0], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = self.pair[a * self.base + b][1], -1
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in sym if s >= 0]

    def _ids(self, part: str, symbols) -> bytes:
        """Ids of symbols; what is no piece becomes the bytes of its characters."""
        ids = np.asarray(symbols, np.int64)
        if (ids < self.pieces).all():
            return ids.astype("<u4").tobytes()
        out, at = [], 0
        for s in ids.tolist():
            if s < self.pieces:
                out.append(np.array([s], "<u4").tobytes())
                at += len(self.lib.id_to_piece(s))
            else:
                out.append(self.bytes[np.frombuffer(part[at].encode(), np.uint8)].tobytes())
                at += 1
        return b"".join(out)

    def _compare(self, parts: list[str], ids: list[bytes]) -> None:
        ask = ["\n" + p.replace(MARK, " ") for p in parts]
        for p, mine, theirs in zip(parts, ids, self.lib.encode(ask, num_threads=1), strict=True):
            theirs = theirs[2:]  # the word mark and the line break before the part
            if mine != np.array(theirs, "<u4").tobytes():
                raise ValueError(f"the library encodes {p!r} as {theirs}")

    def _learn(self, parts: set[str]) -> None:
        new = []
        for p in parts:
            known = self.old.get(p)
            if known is not None:
                self.young[p] = known
            else:
                new.append(p)
        new.sort(key=len)
        for start in range(0, len(new), 4000):
            some = new[start : start + 4000]
            short = [p for p in some if len(p) <= _WIDE]
            symbols = (self._together(short) if short else []) + [self._alone(p) for p in some[len(short) :]]
            ids = [self._ids(p, s) for p, s in zip(some, symbols, strict=True)]
            if self.check:
                self._compare(some, ids)
            self.young.update(zip(some, ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as bytes (little-endian unsigned 32-bit), without begin and end."""
        cut = [self.parts(t) if t else [] for t in texts]
        if len(self.young) > _REMEMBERED:
            self.old, self.young = self.young, {}
        self._learn(set().union(*cut) - self.young.keys() if cut else set())
        look = self.young.__getitem__
        return [b"".join(map(look, c)) for c in cut]


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _runner(path: str, digest: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = PairAgenda(path)
        lib = agenda.lib
        begin, end = (np.array([i], "<u4").tobytes() for i in (lib.bos_id(), lib.eos_id()))
        for b in it:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text")
            start = 0
            while start < len(docs):
                part, chars = [], 0
                while start + len(part) < len(docs) and chars < _BATCH_CHARS:
                    part.append(texts[start + len(part)].as_py() or "")
                    chars += len(part[-1])
                rows = []
                for doc, ids in zip(docs[start : start + len(part)], agenda.encode(part), strict=True):
                    ids = begin + ids + end
                    back = np.frombuffer(ids, "<u4").tolist()
                    text = lib.decode(back)
                    rows.append((doc, len(back), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (doc, back, text))
                start += len(part)
                schema = _DIGEST if digest else _OUT
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row (doc_id, text); a null text is empty, ids have begin and end."""
    return _mapped(docs, model, False, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` reduced to digests inside the task."""
    return _mapped(docs, model, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, model: str, digest: bool, schema: str) -> DataFrame:
    if not Path(model).exists():
        raise FileNotFoundError(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_runner(model, digest), schema)
