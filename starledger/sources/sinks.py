"""Sinks: guarded CSV, canonical JSON, provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_safe
from .files import opened


def write_csv(df: DataFrame, path: str, private: bool = False, row: str = "row_id") -> None:
    """Text that looks like a formula is quoted; ``private`` keeps the row id."""
    shown = [f for f in df.schema if private or f.name != row]
    df.select(*[csv_safe(F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)).alias(f.name) for f in shown]).write.csv(path, header=True)


def write_json(df: DataFrame, path: str, only: list[str] | None = None) -> None:
    """JSON lines with keys in order, nulls kept; ``only``: a provenance subset."""
    names = sorted(c for c in df.columns if only is None or c in only)
    df.select(*[F.col(f"`{c}`") for c in names]).write.option("ignoreNullFields", "false").json(path)


def write_files(df: DataFrame, folder: str) -> int:
    """Rows (name, content binary) as files of a folder, written where the rows are; how many there are. A name that a task writes twice has equal bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        for b in it:
            for i in range(b.num_rows):
                name = b.column("name")[i].as_py()
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(b.column("content")[i].as_py())
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    return df.select("name", "content").mapInArrow(run, "name string").count()
