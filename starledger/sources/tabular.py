"""Uploaded tables: CSV, JSON, XLSX and Parquet, with one set of rules and no size caps.

Cells of CSV files keep a kind each, as one column may mix them. A header is checked before anything is planned.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files


def checked_header(names: list[str]) -> list[str]:
    """Trimmed, unique, not blank, 1 to 256; ValueError otherwise."""
    out = [n.strip().removeprefix("﻿") for n in names]
    if not 1 <= len(out) <= 256 or any(not n for n in out) or len({n.lower() for n in out}) < len(out):
        raise ValueError("a table needs 1 to 256 distinct column names that aren't blank")
    return out


def kind_of(cell: Column) -> Column:
    """Null for a blank cell, else integer, number or string."""
    t = F.trim(cell)
    return F.when(t == "", None).when(t.rlike(r"^[+-]?\d+$") & t.try_cast("long").isNotNull(), "integer").when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number").when(t.isNotNull(), "string")


def read_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """A CSV file or folder with a header; blank cells are null. ``typed``: columns whose cells are all integers or numbers get that type.

    Extra cells and bad quoting stop the query; the types take one pass of counts.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    names = checked_header(raw.columns)
    rows = raw.toDF(*names).select(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names])
    if not typed:
        return rows
    counts = rows.agg(*[F.count_if(kind_of(F.col(f"`{n}`")) == k).alias(f"{k}{i}") for i, n in enumerate(names) for k in ("integer", "number", "string")]).first()
    if counts is None:
        return rows

    def cast(i: int, n: str) -> Column:
        whole, real, text = (counts[f"{k}{i}"] for k in ("integer", "number", "string"))
        c = F.col(f"`{n}`")
        return (c if text or not whole + real else c.cast("double") if real else c.cast("long")).alias(n)

    return rows.select(*[cast(i, n) for i, n in enumerate(names)])


def cell_kinds(rows: DataFrame, key: str) -> DataFrame:
    """(key, field, value, kind) of text cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns if c != key])
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.*").withColumn("kind", kind_of(F.col("value")))


def read_json(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Files that are an array of objects or ``{"rows": [...]}``; (row, present) where row maps keys to JSON text, so that an absent key differs from null.

    Each file is one value, so it is as large as a task can hold; use lines for more.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.get_json_object("value", "$.rows"), F.col("value"))
    items = F.from_json(rows, "array<string>")
    each = whole.select(F.explode(items).alias("j"))
    m = F.from_json("j", "map<string,string>")
    out = each.select(m.alias("row")).withColumn("present", F.map_keys("row"))
    return out if fields is None else out.select(*[F.col("row")[f].alias(f) for f in fields], "present")


def read_parquet(spark: SparkSession, path: str, iso: bool = False) -> DataFrame:
    """A Parquet table; ``iso``: decimals become doubles, dates and times ISO text."""
    df = spark.read.parquet(path)
    checked_header(df.columns)
    if not iso:
        return df

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
        return c

    return df.select(*[plain(f) for f in df.schema])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(file: BinaryIO) -> Iterator[list[str | None]]:
    """Cells of a workbook's only sheet as text, cached values, a row at a time; rows without a value are left out."""
    with zipfile.ZipFile(file) as z:
        sheets = [n for n in z.namelist() if n.startswith("xl/worksheets/sheet")]
        if len(sheets) != 1:
            raise ValueError("a workbook must have one sheet")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _elements(z, "xl/sharedStrings.xml", "si")]
        for row in _elements(z, sheets[0], "row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_MAIN}c"):
                place = 0
                for ch in (x for x in c.get("r", "") if x.isalpha()):
                    place = place * 26 + ord(ch) - 64
                v, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                value = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else v.text if v is not None else None
                cells[(place or len(cells) + 1) - 1] = shared[int(value)] if c.get("t") == "s" and value is not None else value
            if any(v is not None for v in cells.values()):
                yield [cells.get(i) for i in range(max(cells) + 1)]


def _elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part one after the other; what was passed is let go."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, ("start", "end"))
        above: list[ElementTree.Element] = []
        for kind, e in events:
            if kind == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == f"{_MAIN}{tag}":
                yield e
                above[-1].remove(e)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        # a compressed sheet can't be entered in its middle, so a workbook is one task's, which goes through it row by row
        whole = [[(p, n)] for p, n in files.visible_files(self.path) if n > self.split]
        small = files.shares([(p, n) for p, n in files.visible_files(self.path) if n <= self.split], self.split)
        return [InputPartition([p for p, *_ in part]) for part in [*whole, *small]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = files.opened(self.path)
        for path in partition.value:
            file = files.RangeFile(system, path)
            try:
                rows = sheet_rows(file)
                header = checked_header([x or "" for x in next(rows, [])])
                for i, r in enumerate(rows, 1):
                    if any(v is not None for v in r[len(header) :]):
                        raise ValueError(f"{path}: a row has more cells than the header")
                    yield path, i, {h: v for h, v in zip(header, r, strict=False) if v is not None}
            finally:
                file.close()


class WorkbookSource(DataSource):
    """Options: path (a file or folder), split (bytes of small workbooks put together in a task)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, row_no int, cells map<string,string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], int(self.options.get("split", 16 << 20)))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells map) of workbooks; the first row is the header, cells beyond it are an error, and so is a workbook without rows."""
    return files.load(spark, WorkbookSource, path)
