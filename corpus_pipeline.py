"""A corpus pipeline: toxicity, quality, near duplicates, packing; every stage works on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm import quality, toxicity
from starledger.llm.folds import remainder
from starledger.llm.ngram_jaccard import one_of_each
from starledger.llm.queries import CUT, packed
from starledger.llm.scoring import score
from starledger.llm.shared import Scratch, table


def _kept(docs: DataFrame, model, rule) -> DataFrame:
    """Rows whose score fulfils the rule, with the columns they had."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, out=name).where(rule(F.col(name))).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut; a null text is scored as an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return _kept(docs, model, lambda s: s < CUT)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return _kept(docs, model, lambda s: s >= CUT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.75 or more connect, the row with the smallest doc_id; rows without words stay.

    Each row is judged by its own text, also where a doc_id repeats or is null; of equal rows one stays.
    """
    return one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packed(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("best_fit_packing", pack),
]

#: Learned scores and tokenization have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
