"""Binary tables of FITS files as a Spark data source: split by rows, columns decoded as asked, filters on whole numbers before decoding.

A file's rows all have one width, so a task finds its rows from the header alone and reads their bytes; no file is held whole.
Types: L boolean, B and I smallint, J int, K bigint, E float, D double, nA string, and arrays of these. Integers with TSCAL or
TZERO are doubles; TNULL cells and undefined booleans are null, a NaN stays a NaN.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, WriterCommitMessage,
)

from .files import load, opened, shares, visible_files

#: Type letter: numpy type of a cell, Spark type. Fixed values of the format.
FORMS = {
    "L": ("u1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()),
    "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType()),
}
#: Bytes of other cells: bits, complex numbers, descriptors. Fixed values of the format.
OTHERS = {"X": 1 / 8, "C": 8, "M": 16, "P": 8, "Q": 16}
BLOCK, CARD = 2880, 80
#: Bytes of rows read at once, and of a written file.
CHUNK, FILE = 4 << 20, 32 << 20


def cards(read) -> tuple[dict[str, str], int]:
    """A header's values by keyword and its length in bytes; ``read(at, n)`` gives the file's bytes from its start."""
    found: dict[str, str] = {}
    at = 0
    while True:
        block = read(at, BLOCK)
        if len(block) < BLOCK:
            raise ValueError("a FITS header ends early")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key, body = card[:8].strip(), card[10:]
            if key == "END":
                return found, at
            if card[8:10] == "= ":
                text = re.match(r"\s*'((?:[^']|'')*)'", body)
                found[key] = text[1].replace("''", "'").rstrip() if text else body.split("/")[0].strip()


def _bytes(h: dict[str, str]) -> int:
    axes = [int(h[f"NAXIS{i}"]) for i in range(1, int(h.get("NAXIS", "0")) + 1)]
    n = abs(int(h.get("BITPIX", "8"))) // 8 * int(np.prod(axes)) * int(h.get("GCOUNT", "1")) if axes else 0
    return -(-(n + int(h.get("PCOUNT", "0"))) // BLOCK) * BLOCK


@dataclass
class Column:
    name: str
    letter: str
    repeat: int
    offset: int
    scale: float = 1.0
    zero: float = 0.0
    null: int | None = None

    @property
    def dtype(self) -> str:
        return f"S{self.repeat}" if self.letter == "A" else FORMS[self.letter][0]

    @property
    def kind(self) -> T.DataType:
        if self.letter == "A":
            return T.StringType()
        one = T.DoubleType() if self.letter in "BIJK" and (self.scale, self.zero) != (1.0, 0.0) else FORMS[self.letter][1]
        return one if self.repeat == 1 else T.ArrayType(one)

    def whole(self) -> bool:
        return self.repeat == 1 and isinstance(self.kind, (T.ShortType, T.IntegerType, T.LongType))

    def missing(self, raw: np.ndarray) -> np.ndarray:
        if self.letter == "L":
            return raw == 0
        return raw == self.null if self.null is not None and self.letter in "BIJK" else np.zeros(raw.shape, bool)

    def decode(self, raw: np.ndarray) -> pa.Array:
        """Cells of the rows as an Arrow array."""
        if self.letter == "A":
            return pa.array([c.split(b"\0")[0].decode("ascii", "replace").rstrip(" ") for c in raw.tolist()], pa.string())
        flat = np.ascontiguousarray(raw).reshape(-1)
        gone = self.missing(flat)
        if self.letter == "L":
            flat = flat == ord("T")
        elif isinstance(self.kind, T.DoubleType) and self.letter != "D" or isinstance(self.kind, T.ArrayType) and isinstance(self.kind.elementType, T.DoubleType):
            flat = flat.astype(np.float64) * self.scale + self.zero
        elif self.letter == "B":
            flat = flat.astype(np.int16)
        else:
            flat = flat.astype(flat.dtype.newbyteorder("="))
            if self.letter in "ED" and (self.scale, self.zero) != (1.0, 0.0):
                flat = (flat * self.scale + self.zero).astype(flat.dtype)
        cells = pa.array(flat, mask=gone)
        return cells if self.repeat == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * self.repeat), cells)


@dataclass
class Layout:
    """Where a table's rows lie and what is in them."""

    data: int
    width: int
    rows: int
    columns: list[Column] = field(default_factory=list)

    @classmethod
    def of(cls, read, hdu: int) -> Layout:
        at = 0
        for _ in range(hdu):
            h, n = cards(lambda o, k, at=at: read(at + o, k))
            at += n + _bytes(h)
        h, n = cards(lambda o, k: read(at + o, k))
        if h.get("XTENSION") != "BINTABLE":
            raise ValueError(f"part {hdu} is no binary table")
        out, offset = cls(at + n, int(h["NAXIS1"]), int(h["NAXIS2"])), 0
        for i in range(1, int(h["TFIELDS"]) + 1):
            repeat, letter = re.match(r"(\d*)([A-Z])", h[f"TFORM{i}"]).groups()
            repeat = int(repeat) if repeat else 1
            if letter in FORMS or letter == "A":
                null = h.get(f"TNULL{i}")
                c = Column(h.get(f"TTYPE{i}", f"col{i}").lower(), letter, repeat, offset, float(h.get(f"TSCAL{i}", "1").replace("D", "E")), float(h.get(f"TZERO{i}", "0").replace("D", "E")), int(null) if null else None)
                if repeat:
                    out.columns.append(c)
                offset += repeat * (1 if letter == "A" else np.dtype(c.dtype).itemsize)
            elif letter in OTHERS:
                offset += -(-repeat // 8) if letter == "X" else repeat * OTHERS[letter]
            else:
                raise ValueError(f"column {i} has the unknown form {h[f'TFORM{i}']}")
        if offset != out.width:
            raise ValueError(f"columns take {offset} bytes, a row has {out.width}")
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind) for c in self.columns])


@dataclass
class Work(InputPartition):
    parts: list[tuple[str, int, int]]


class FitsReader(DataSourceReader):
    def __init__(self, path: str, hdu: int, split: int, schema: T.StructType, whole: set[str]):
        self.path, self.hdu, self.split, self.schema, self.whole = path, hdu, split, schema, whole
        self.filters: list[Filter] = []

    def partitions(self) -> Sequence[InputPartition]:
        return [Work(p) for p in shares(visible_files(self.path), self.split)]

    def _kept(self, f: Filter, raw: np.ndarray, columns: dict[str, Column]) -> np.ndarray:
        if isinstance(f, Not):
            inner = f.child
            known = np.ones(len(raw), bool) if isinstance(inner, (IsNull, IsNotNull)) else ~columns[inner.attribute[0].lower()].missing(raw[inner.attribute[0].lower()])
            return ~self._kept(inner, raw, columns) & known
        name = f.attribute[0].lower()
        x, gone = raw[name], columns[name].missing(raw[name])
        if isinstance(f, IsNull):
            return gone
        if isinstance(f, IsNotNull):
            return ~gone
        if isinstance(f, In):
            return np.isin(x, np.array([v for v in f.value if v is not None], np.int64)) & ~gone
        test = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}[type(f)]
        return test(x, f.value) & ~gone

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for path, share, of in partition.parts:
            with system.open_input_file(path) as file:
                layout = Layout.of(lambda at, n, file=file: file.read_at(n, at), self.hdu)
                columns = {c.name: c for c in layout.columns}
                named = "path" not in columns
                missing = [f.name for f in self.schema if f.name.lower() not in columns and not (named and f.name == "path")]
                if missing:
                    raise ValueError(f"{path} lacks {missing}")
                for f in self.schema:
                    if named and f.name == "path":
                        continue
                    if columns[f.name.lower()].kind != f.dataType:
                        raise ValueError(f"{path}: {f.name} is {columns[f.name.lower()].kind.simpleString()}, not {f.dataType.simpleString()}")
                asked = {f.name.lower() for f in self.schema}
                used = [c for c in layout.columns if c.name in asked]
                kind = np.dtype({"names": [c.name for c in used], "formats": [c.dtype if c.repeat == 1 or c.letter == "A" else (c.dtype, (c.repeat,)) for c in used], "offsets": [c.offset for c in used], "itemsize": layout.width})
                first, stop = layout.rows * share // of, layout.rows * (share + 1) // of
                step = max(1, CHUNK // layout.width)
                for at in range(first, stop, step):
                    n = min(step, stop - at)
                    content = file.read_at(n * layout.width, layout.data + at * layout.width)
                    if len(content) < n * layout.width:
                        raise ValueError(f"{path} ends before row {at + n}")
                    raw = np.frombuffer(content, kind)
                    for f in self.filters:
                        raw = raw[self._kept(f, raw, columns)]
                    if len(raw):
                        cells = [pa.array([path] * len(raw)) if f.name == "path" and named else columns[f.name.lower()].decode(raw[f.name.lower()]) for f in self.schema]
                        yield pa.RecordBatch.from_arrays(cells, [f.name for f in self.schema])


class FilteringReader(FitsReader):
    """Takes the conditions that Spark pushes."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of whole numbers are answered from the raw cells; everything else is left to Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            taken = isinstance(inner, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull)) and len(inner.attribute) == 1 and inner.attribute[0].lower() in self.whole
            if taken:
                self.filters.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _card(key: str, value: str | int) -> str:
    shown = str(value) if isinstance(value, int) or value == "T" else "'" + value.replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {shown:>20}".ljust(CARD)


def header(entries: list[tuple[str, str | int]]) -> bytes:
    text = "".join(_card(k, v) for k, v in entries) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


_LETTERS = {T.BooleanType(): "L", T.ShortType(): "I", T.IntegerType(): "J", T.LongType(): "K", T.FloatType(): "E", T.DoubleType(): "D"}


class FitsWriter(DataSourceArrowWriter):
    """Files of about 32 MB of rows. A task's files get their names when the job commits; those of failed tasks stay hidden."""

    def __init__(self, path: str, schema: T.StructType):
        self.path = path
        self.columns = []
        for f in schema:
            if f.dataType not in _LETTERS:
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} can't be a column of a FITS table")
            self.columns.append((f.name, _LETTERS[f.dataType]))
        self.row = np.dtype([(n, FORMS[c][0]) for n, c in self.columns])

    def _file(self, rows: list[np.ndarray]) -> bytes:
        body = b"".join(r.tobytes() for r in rows)
        entries = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", self.row.itemsize), ("NAXIS2", sum(map(len, rows))), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(self.columns))]
        for i, (n, c) in enumerate(self.columns, 1):
            entries += [(f"TTYPE{i}", n.upper()), (f"TFORM{i}", c)]
        return header([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + header(entries) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        task, files, rows, size = TaskContext.get(), [], [], 0

        def flush() -> None:
            name = f"part-{task.partitionId():05d}-{len(files):03d}-{uuid.uuid4().hex[:12]}.fits"
            with system.open_output_stream(f"{path}/.{name}") as out:
                out.write(self._file(rows))
            files.append((f"{path}/.{name}", f"{path}/{name}"))

        for b in iterator:
            if any(c.null_count for c in b.columns):
                raise ValueError("a FITS table has no nulls: fill them before writing")
            made = np.empty(b.num_rows, self.row)
            for (n, letter), c in zip(self.columns, b.columns, strict=True):
                x = c.to_numpy(zero_copy_only=False)
                made[n] = np.where(x.astype(bool), ord("T"), ord("F")) if letter == "L" else x
            rows.append(made)
            size += made.nbytes
            if size >= FILE:
                flush()
                rows, size = [], 0
        if rows:
            flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for hidden, name in m.files if m else []:
                system.move(hidden, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else []:
                system.delete_file(hidden)


class FitsSource(DataSource):
    """Options: path (a file or folder), hdu (1), split (bytes of a file for each task, 16 MB), push (false: take filters from Spark)."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _layout(self) -> Layout:
        path = self.options["path"]
        system, _ = opened(path)
        files = visible_files(path)
        if not files:
            raise FileNotFoundError(f"no FITS files in {path}")
        with system.open_input_file(files[0][0]) as file:
            return Layout.of(lambda at, n: file.read_at(n, at), int(self.options.get("hdu", 1)))

    def schema(self) -> T.StructType:
        return self._layout().schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        # only columns that are whole numbers in this schema; a file of other types is refused when it is read
        whole = {f.name.lower() for f in schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))}
        kind = FilteringReader if self.options.get("push", "").lower() == "true" else FitsReader
        return kind(self.options["path"], int(self.options.get("hdu", 1)), int(self.options.get("split", 16 << 20)), schema, whole)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsWriter(self.options["path"], schema)


def read_table(spark: SparkSession, path: str, columns: str | None = None, hdu: int = 1, split: int = 16 << 20, push: bool = False) -> DataFrame:
    """A table of FITS files; ``columns`` (names with types) are all that is decoded. Other columns are skipped by their width.

    A column ``path string`` that no file has is the file that a row is from. ``push``: conditions on whole numbers are answered before rows are
    decoded. Spark 4.1 keeps pushed conditions with the table that it loaded, so a DataFrame with ``push`` must be used under one
    condition only: read it anew for another.
    """
    if push:
        # Spark refuses a source that takes filters unless this is on
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return load(spark, FitsSource, path, columns, hdu=hdu, split=split, push=push)


def write_table(df: DataFrame, path: str) -> None:
    """Rows without nulls as FITS files in a folder, one or more for each task."""
    df.sparkSession.dataSource.register(FitsSource)
    df.write.format(FitsSource.name()).mode("append").save(path)
