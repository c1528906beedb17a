"""The pipeline against its stages applied by brute force, and its stages on odd tables."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from llm.test_text_operators import brute_components  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from starledger.llm.queries import packed  # noqa: E402
from starledger.llm.scoring import score  # noqa: E402
from starledger.llm import quality, toxicity  # noqa: E402
from starledger.llm.folds import remainder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]


def test_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic = {r["doc_id"]: r["score"] for r in score(docs, toxicity.fit(docs, labels, remainder(4) != 2)).collect()}
    kept = docs.where(F.col("doc_id").isin([d for d, s in toxic.items() if s < 0.3]))
    good = {r["doc_id"]: r["score"] for r in score(kept, quality.fit(kept, labels, remainder(5) != 0)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect() if good[r["doc_id"]] >= 0.3]
    last = [d for d, _, c in brute_components(rows) if d == c]
    want = packed(spark, docs.where(F.col("doc_id").isin(last))).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    got = cp.run(spark, SMALL).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_columns(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = docs.withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x"))
    extra = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (900001, "", "en", "s", 0, 1, "x"), (900001, "", "en", "s", 0, 1, "x")], odd.schema)
    out = cp.STAGES[stage][1](spark, odd.unionByName(extra), SMALL)
    assert out.columns == odd.columns
    assert cp.STAGES[stage][1](spark, odd.limit(0), SMALL).count() == 0
