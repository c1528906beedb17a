"""The contract's gate on metrics and candidates made for each result."""

import pytest

from starledger.operators import contract_gate
from starledger.operators.contract_gate import Check, Contract

METRICS = "scope string, target string, metric_id string, numerator long, denominator long, status string, value decimal(18,6)"
VALUES = "field_id string, kind string, in_snapshot boolean, retained boolean"


def _results(spark, metrics, checks, held=()):
    from decimal import Decimal

    rows = [(m.split("_")[0], t, m, 0, 0, s, None if v is None else Decimal(v)) for m, t, s, v in metrics]
    out = contract_gate.checked(spark.createDataFrame(rows, METRICS), spark.createDataFrame(list(held), "condition string, holds boolean"), checks)
    return {r.constraint_id: r for r in out.collect()}, contract_gate.verdict(out).first()


def test_results_of_metrics(spark):
    metrics = [
        ("dataset_completeness", "dataset", "determinate", "0.9"), ("dataset_missingness", "dataset", "determinate", "0.1"), ("source_scope_completeness", "dataset", "insufficient_source", None),
        ("field_unit_consistency", "a", "not_applicable", None), ("field_unit_consistency", "b", "determinate", "1"), ("row_completeness", "1", "determinate", "0.2"), ("row_completeness", "2", "empty_denominator", None),
    ]
    checks = [
        Check("a", "dataset_completeness", "gte", "0.9"), Check("b", "dataset_missingness", "equals", "0.1"), Check("c", "source_scope_completeness", "gte", "1"), Check("d", "field_unit_consistency", "gte", "1"),
        Check("e", "field_unit_consistency", "gte", "1", "insufficient"), Check("f", "row_completeness", "gte", "0.5"), Check("g", "object_match_coverage", "gte", "0"), Check("h", condition="source_scope_allowed"),
    ]
    found, verdict = _results(spark, metrics, checks, [("source_scope_allowed", False)])
    assert [(c, found[c].result) for c in "abcdefgh"] == [("a", "pass"), ("b", "pass"), ("c", "insufficient"), ("d", "pass"), ("e", "insufficient"), ("f", "fail"), ("g", "insufficient"), ("h", "fail")]
    assert (found["f"].targets, found["f"].failed, found["f"].insufficient) == (2, 1, 1)
    assert tuple(verdict) == (8, 2, 3, "fail")
    assert tuple(_results(spark, metrics, checks[:3])[1]) == (3, 0, 1, "insufficient")
    assert tuple(_results(spark, metrics, checks[:2])[1]) == (2, 0, 0, "pass")


@pytest.mark.parametrize("wrong", [[], [Check("a", "dataset_completeness", "gte")], [Check("a", "completeness", "gte", "1")], [Check("a")], [Check("a", "row_completeness", "lt", "1")], [Check("a", condition="x")], [Check("a", condition=contract_gate.CONDITIONS[0])] * 2])
def test_wrong_checks_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        _results(spark, [], wrong)


def test_conditions(spark):
    values = spark.createDataFrame([("a", "structured", True, False), ("b", "document", False, False)], VALUES)
    sources = spark.createDataFrame([("x",), (None,)], "source_id string")
    holds = lambda v, s, c: {r.condition: r.holds for r in contract_gate.conditions(v, s, c).collect()}
    got = holds(values, sources, Contract(("a", "b"), ("x",), "source"))
    assert got == {"unit_policy_canonical": False, "requested_fields_exact": True, "source_scope_allowed": False, "evidence_locator_present": False, "source_snapshot_present": True, "document_source_authorized": False}
    got = holds(values, sources.where("source_id is not null"), Contract(("a",), ("x",), require_locator=False, documents_allowed=True))
    assert got == {"unit_policy_canonical": True, "requested_fields_exact": False, "source_scope_allowed": True, "evidence_locator_present": True, "source_snapshot_present": True, "document_source_authorized": True}
    empty = holds(values.limit(0), sources.limit(0), Contract(("a",), ()))
    assert empty == {"unit_policy_canonical": True, "requested_fields_exact": False, "source_scope_allowed": True, "evidence_locator_present": False, "source_snapshot_present": False, "document_source_authorized": True}
