"""Top-k and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from starledger.llm import anisotropic, threshold_topk

KIND = "vec_id long, embedding array<float>, score double, rank int"


def rows(seed=1, n=700, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:150] = x[50]  # a third alike, and ties
    out = [(i, [float(v) for v in x[i]], 0.5, 1) for i in range(n)]
    out += [(1001, None, 0.5, 1), (1002, [], 0.5, 1), (1003, [1.0, None] * 6, 0.5, 1), (1004, [float("nan")] * dim, 0.5, 1), (1005, [float("inf")] * dim, 0.5, 1), (1006, [0.0] * dim, 0.5, 1), (1008, [1.0] * 5, 0.5, 1), (None, [1.0] * dim, 0.5, 1)]
    return out


def brute(data, k, whole, zero):
    fine = [(i, v) for i, v, *_ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    if whole:
        fine = [(i, [math.floor(64 * x) for x in v]) for i, v in fine]
    out = []
    for at, (q, own) in enumerate(fine):
        if q % 20 == 0:
            scores = [((np.array(own, float) * np.array(v, float)).sum(), i) for other, (i, v) in enumerate(fine) if other != at and len(v) == len(own)]
            out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1]))[:k], 1)]
    return out


def repeated(data):
    """Rows that repeat a vec_id: an equal one twice, one with another vector, and one of a query that no other vector resembles."""
    return data + [data[40], data[40], (40, data[41][1], 0.5, 1), (60, data[60][1], 0.5, 1)]


@pytest.mark.parametrize("k", [1, 20, 2000])
def test_top_k_is_exact(spark, k):
    data = repeated(rows())
    got = threshold_topk.top_k(spark.createDataFrame(data, KIND).repartition(6), k=k).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(data, k, True, True))


def test_top_k_of_nothing(spark):
    assert threshold_topk.top_k(spark.createDataFrame([], KIND)).count() == 0
    assert threshold_topk.top_k(spark.createDataFrame([(20, [1.0], 0.5, 1)], KIND)).count() == 0
    assert anisotropic.nearest(spark.createDataFrame([], KIND)).count() == 0


def test_nearest_recall_and_scores(spark):
    data = rows(2, 3000, 16)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in anisotropic.nearest(spark.createDataFrame(data, KIND).repartition(4), k=20).collect()}
    want = {(q, i): s for q, _, i, s in brute(data, 20, False, False)}
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in set(got) & set(want))


def test_nearest_ranks_ties_and_repeated_rows(spark):
    """With as many reranked as there are candidates, the result is that of brute force, order included."""
    data = repeated(rows(3, 400, 8))
    got = anisotropic.nearest(spark.createDataFrame(data, KIND).repartition(3), k=20, rerank=30).collect()
    want = brute(data, 20, False, False)
    assert sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got) == sorted((q, r, round(s, 9)) for q, r, _, s in want)
    by_score = {}
    for r in got:
        by_score.setdefault((r["query_id"], r["score"]), []).append((r["rank"], r["vec_id"]))
    assert all([i for _, i in sorted(g)] == sorted(i for _, i in g) for (q, _), g in by_score.items() if q not in (40, 60))


def unlike_their_sample(kind):
    """Vectors that four bits a component tell apart badly, or whose products leave single precision."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 16))
    if kind == "near copies":
        x[:600] = x[0] + 1e-4 * rng.normal(size=(600, 16))
    else:
        x *= {"huge": 3e37, "tiny": 1e-38}[kind]
    return [(i, [float(v) for v in row], 0.5, 1) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["near copies", "huge", "tiny"])
def test_nearest_misses_none_whatever_the_rows(spark, kind):
    data = unlike_their_sample(kind)
    got = sorted(tuple(r) for r in anisotropic.nearest(spark.createDataFrame(data, KIND).repartition(3), k=20).collect())
    want = sorted(brute(data, 20, False, False))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_nearest_misses_none_when_the_sample_shows_nothing(spark):
    data = repeated(rows(4, 900, 8))
    got = anisotropic.nearest(spark.createDataFrame(data, KIND).repartition(3), k=5, sample=1, rerank=1).collect()
    assert sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in got) == sorted((q, r, round(s, 9)) for q, r, _, s in brute(data, 5, False, False))


def test_nearest_recall_on_the_embeddings(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    table = spark.read.parquet(d)
    data = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in anisotropic.nearest(table).collect()}
    x = {i: np.array(v, float) for i, v in data}
    ids, every = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    hit = n = 0
    for q in (i for i in ids if i % 20 == 0):
        s = np.where(ids == q, -np.inf, every @ x[q])
        top = ids[np.lexsort((ids, -s))[:20]]
        hit += sum((q, i) in got for i in top.tolist())
        n += len(top)
    assert hit >= 0.9 * n and n
