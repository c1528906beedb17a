"""Models fitted in one task, and scores of whole texts by them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fitted(sample: DataFrame, train: Callable[[pa.Table | None], object]):
    """What ``train`` makes of a sample of bounded size, in one task: the driver gets the finished model only.

    ``train`` gets None where the sample is empty.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        model = train(pa.Table.from_batches(batches) if sum(b.num_rows for b in batches) else None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train(None)


def score(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; a null or empty text has the model's score of no grams.

    Repeated rows are scored alike, an empty table stays empty, other columns stay; ValueError if ``out`` is among them. The model, of
    fixed size, is broadcast; Spark drops it when nothing refers to the result any more.
    """
    if out in docs.columns:
        raise ValueError(f"documents already have a column {out}")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    place = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = sent.value.score(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)
