"""Best pairs from tiers of score against all pairs."""

import random

import pytest

from starledger.operators import papers


def plain(rows, k):
    out = []
    for s in rows:
        for t in rows:
            if s[0] != t[0]:
                same = [int(a is not None and a == b) for a, b in zip(s[2:5], t[2:5], strict=True)]
                out.append((-len(set(s[1]) & set(t[1])), *[-x for x in same], s[0], t[0]))
    return sorted(out)[:k]


@pytest.mark.parametrize("k, names", [(7, 4), (60, 30)])
def test_tiers_give_the_best_pairs(spark, monkeypatch, k, names):
    monkeypatch.setattr(papers, "FEW_PAIRS", 0)
    r = random.Random(k)
    rows = [(i, [f"o{r.randrange(names)}" for _ in range(r.randrange(3))], r.choice("ab"), r.choice(["u", "v", None]), r.choice("xyz"), [1], "accepted") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, objects array<string>, metric string, unit string, type string, evidence array<int>, status string")
    got = [(-x["shared"], -x["metric_match"], -x["unit_match"], -x["same_type"], x["source_id"], x["target_id"]) for x in papers.top_pairs(df, k).collect()]
    assert got == plain(rows, k)


def test_one_common_object_needs_no_product(spark, monkeypatch):
    """40,000 claims of one object are 1.6 billion pairs; the first ten come from the first sources."""
    monkeypatch.setattr(papers, "FEW_PAIRS", 1000)
    df = spark.range(40_000).selectExpr("id", "array('o', concat('p', id)) AS objects", "'m' AS metric", "cast(id % 2 AS string) AS unit", "cast(id AS string) AS type", "array(1) AS evidence", "'accepted' AS status")
    got = [(x["source_id"], x["target_id"], x["shared"], x["metric_match"], x["unit_match"], x["same_type"]) for x in papers.top_pairs(df, 10).collect()]
    assert got == [(0, 2 * i, 1, 1, 1, 0) for i in range(1, 11)]
