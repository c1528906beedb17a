"""Benchmarks of parses, integrations and graphs against plain Python."""

import pytest

from starledger.operators import anchors, benchmarks

TEXTS = [(1, "The  Quick\nBrown Straße fox"), (2, None), (3, ""), (4, "quick brown quick"), (None, "aaa aab"), (4, "other row")]
ANCHORS = ["quick brown", "QUICK", "strasse", "rown s", "aab", "aa", " ", None, "absent", "Quick  brown"]


def plain():
    out = set()
    for k, t in TEXTS:
        text = anchors.folded(t)
        out |= {(k, anchors.folded(a)) for a in ANCHORS if a and a.strip() and anchors.folded(a) in text}
    return out


@pytest.mark.parametrize("part", [anchors.PART, 12])
def test_anchors_equal_substrings(spark, part):
    texts, wanted = spark.createDataFrame(TEXTS, "k int, t string"), spark.createDataFrame([(a,) for a in ANCHORS], "anchor string")
    got = [tuple(r) for r in anchors.held_anchors(texts, "k", "t", wanted, part=part).distinct().collect()]
    assert set(got) == plain() and len(got) == len(set(got))
    assert anchors.held_anchors(texts, "k", "t", wanted.limit(0)).count() == 0 and anchors.held_anchors(texts.limit(0), "k", "t", wanted).count() == 0


def test_recovery(spark):
    texts = spark.createDataFrame(TEXTS[:5], "k int, t string")
    expected = spark.createDataFrame([(1, "h", "Quick brown"), (1, "h", "nothing"), (1, "v", "FOX"), (3, "h", "x"), (4, "h", ""), (9, "h", ""), (9, "h", "x"), (4, "v", None)], "k int, kind string, anchor string")
    got = {(r["k"], r["kind"]): (r["recovered"], r["expected"], r["rate"]) for r in anchors.recovery(texts, "k", "t", expected).collect()}
    assert got == {(1, "h"): (1, 2, 0.5), (1, "v"): (1, 1, 1.0), (3, "h"): (0, 1, 0.0), (4, "h"): (1, 1, 1.0), (9, "h"): (0, 2, 0.0)}


def test_parse_metrics(spark):
    blocks = spark.createDataFrame([(1, 0, "native", True), (1, 0, "visual", False), (1, 2, "native", True), (3, 0, "native", False)], "k int, page int, backend string, located boolean")
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)], "k int, page int")
    got = {r["k"]: tuple(r)[1:] for r in anchors.parse_metrics(blocks, pages, "k").collect()}
    assert got == {1: (3, 2, 2 / 3, 4, 0.5, 0.25), 2: (0, 0, None, 1, 0.0, 0.0), 3: (1, 0, 0.0, 0, 0.0, 0.0)}
    means = {r["metric"]: tuple(r)[1:] for r in anchors.mean_of_measured(anchors.parse_metrics(blocks, pages, "k"), ["locator_validity"]).collect()}
    assert means == {"locator_validity": (2, 3, 1 / 3)}


def _case(name, category="integration", rows=None, error=None, expected=None, unstable=False):
    def run(permuted):
        if error:
            raise error
        return {n: t.limit(1) if unstable and permuted else benchmarks.permuted(t, permuted) for n, t in rows.items()}

    return benchmarks.Case(name, category, run, expected)


class Coded(ValueError):
    code = "TOO_LARGE"


def test_fingerprints_are_of_multisets(spark):
    rows = [(1, None, [1, 2]), (1, None, [1, 2]), (None, "x", None), (2, "y", [])]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>")
    one = lambda d: benchmarks.fingerprint(d).first()["fingerprint"]
    assert one(df) == one(benchmarks.permuted(df, True)) == one(df.select("c", "a", "b"))
    others = [rows[:3], rows[1:], rows + rows[:2], [*rows[:3], (2, None, [])], [(None, "x", [1, 2]), *rows[1:]], [(1, "x", None), rows[1], (None, None, [1, 2]), rows[3]]]
    prints = [one(spark.createDataFrame(o, "a int, b string, c array<int>")) for o in others] + [one(df.limit(0)), one(df)]
    assert len(set(prints)) == len(prints)
    nulls = [one(spark.createDataFrame([r], "a int, b int")) for r in ((None, 1), (1, None), (None, None))]
    assert len(set(nulls)) == 3


def test_integration_benchmark(spark):
    t = lambda rows, shape: spark.createDataFrame(rows, shape)
    o = benchmarks.OBSERVED
    good = {
        "rows": t([("left", "1"), ("left", "2"), ("left", "2")], o["rows"]), "fields": t([("1", "teff", "5000"), ("2", "teff", "6000")], o["fields"]), "pairs": t([("1", "a"), ("2", "b"), ("2", "b"), ("3", "x")], o["pairs"]),
        "units": t([("u1", "1.5"), ("u2", "9")], o["units"]), "conflicts": t([("ids", "4", "d")], o["conflicts"]), "evidence": t([("1", True), ("2", True), ("3", False)], o["evidence"]),
    }
    probe = {"repairs": t([("d1", "resolved"), ("d2", "unresolved"), ("d3", "resolved"), ("d4", "unresolved")], o["repairs"]), "pairs": t([("9", "z")], o["pairs"])}
    cases = [
        _case("a", rows=good), _case("p", "repair_probe", rows=probe), _case("f1", "failure_injection", error=Coded("x"), expected="TOO_LARGE"), _case("f2", "failure_injection", error=KeyError("x"), expected="TOO_LARGE"),
        _case("f3", "failure_injection", rows={"rows": good["rows"]}, expected="TOO_LARGE"), _case("u", rows={"rows": good["rows"]}, unstable=True),
    ]
    expected = {
        "rows": t([("a", "left", "1"), ("a", "left", "3")], f"case_id string, {o['rows']}"), "fields": t([("a", "1", "teff", "5000"), ("a", "2", "teff", "6001"), ("a", "3", "teff", "1")], f"case_id string, {o['fields']}"),
        "pairs": t([("a", "1", "a"), ("a", "2", "b"), ("a", "5", "e"), ("a", "5", "e"), ("p", "9", "z"), ("f1", "1", "1")], f"case_id string, {o['pairs']}"), "units": t([("a", "u1", "1.5"), ("a", "u2", "8")], f"case_id string, {o['units']}"),
        "conflicts": t([("a", "ids", "4", "d", True), ("a", "ids", "1", "a", False), ("a", "ids", "7", "g", True)], f"case_id string, {o['conflicts']}, detected boolean"),
        "repairs": t([("p", "d1", True), ("p", "d2", True), ("p", "d3", False), ("p", "d4", False), ("p", "d5", False)], "case_id string, defect string, repairable boolean"),
    }
    runs, metrics = benchmarks.integration(spark, cases, expected)
    got = {r["metric"]: (r["numerator"], r["denominator"]) for r in metrics.collect()}
    assert got == dict(zip(benchmarks.METRICS, [(1, 2), (1, 3), (2, 3), (2, 3), (1, 2), (2, 3), (1, 2), (1, 3), (2, 3), (3, 4), (1, 3)], strict=True))
    assert {r["case_id"]: (r["error"], r["stable"], r["passed"]) for r in runs.collect()} == {
        "a": (None, True, True), "p": (None, True, True), "f1": ("TOO_LARGE", None, True), "f2": ("KeyError", None, False), "f3": (None, True, False), "u": (None, False, False),
    }
    with pytest.raises(Exception, match="no adjudication"):
        benchmarks.integration(spark, cases, expected | {"units": expected["units"].limit(0)})[1].collect()
    none = benchmarks.integration(spark, cases[1:], expected)[1].where("metric = 'entity_alignment_recall'")
    with pytest.raises(ValueError, match="one id"):
        benchmarks.integration(spark, [cases[0], cases[0]], expected)
    assert none.first()["rate"] is None


def test_graph_benchmark(spark):
    cases = spark.createDataFrame(
        [("s1", "scientific_graph", "passed", "passed", True, True), ("s2", "scientific_graph", "passed", "passed", True, False), ("s3", "scientific_graph", "passed", "failed", False, True), ("r", "rejection_case", "failed", "failed", True, True), ("z", "size_boundary", "failed", "passed", True, True)],
        "case_id string, kind string, expected_status string, status string, schema_valid boolean, stable_order boolean",
    )
    items = [("s1", p, s, k) for p in ("node", "edge", "evidence_use") for s in ("expected", "actual") for k in ("a", "b", "b")]
    items += [("s2", "node", "expected", k) for k in "aab"] + [("s2", "node", "actual", k) for k in "abcc"] + [("s2", "accepted_relation", "expected", "x"), ("s1", "nonaccepted_relation", "expected", "n"), ("s2", "nonaccepted_relation", "expected", "m"), ("s2", "nonaccepted_relation", "actual", "m"), ("r", "node", "expected", "q")]
    results = benchmarks.graph_cases(cases, spark.createDataFrame(items, "case_id string, part string, side string, key string"))
    r = {x["case_id"]: x for x in results.collect()}
    assert (r["s2"]["node_matched"], r["s2"]["node_expected"], r["s2"]["node_actual"], r["s2"]["node_unexpected"], r["s3"]["node_expected"]) == (2, 3, 4, 2, 0)
    assert r["s1"]["exact"] and not r["s2"]["exact"]
    got = {x["metric"]: (x["numerator"], x["denominator"]) for x in benchmarks.graph_rates(results).collect()}
    assert got == {
        "full_graph_exact_match_rate": (1, 3), "node_exact_match_rate": (5, 6), "edge_exact_match_rate": (3, 3), "evidence_coverage_rate": (3, 3), "accepted_relation_coverage_rate": (0, 1), "reasoning_trace_coverage_rate": (0, 0),
        "nonaccepted_relation_exclusion_rate": (1, 2), "stable_identity_order_rate": (1, 2), "data_mapping_fixture_pass_rate": (0, 0), "rejection_case_pass_rate": (1, 1), "size_boundary_pass_rate": (0, 1), "schema_pass_rate": (4, 5),
    }
    assert benchmarks.graph_rates(results).where("rate is null").count() == 2
