"""Benchmarks: what scenarios and graphs give, held against adjudicated expectations.

Every rate has its own numerator and denominator. Cases are few and named by a manifest; the tables that they give may be of any size and
are only joined on keys and counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..scratch import Scratch


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (rows, fingerprint): a hash of the rows as a multiset, whatever their order and partitions.

    Two 64-bit hashes of each row are summed and xored where the rows lie, so only sums are shuffled; repeated rows count. Map columns have no hash.
    """
    names = sorted(columns or df.columns)
    cells = [F.col(f"`{c}`") for c in names]
    # a null moves no hash on, so its place is hashed too
    gaps = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in names])
    a, b = F.xxhash64(gaps, *cells), F.xxhash64(F.lit("other"), *cells, gaps)
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("string")
    mixed = lambda c: F.coalesce(F.bit_xor(c), F.lit(0)).cast("string")
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.sha2(F.concat_ws("|", F.lit(",".join(names)), n.cast("string"), total(a), total(b), mixed(a), mixed(b)), 256).alias("fingerprint"))


@dataclass(frozen=True)
class Case:
    """A scenario. ``run(permuted)`` gives named tables; ``permuted`` asks for the same input in another order."""

    case_id: str
    category: str  # integration, repair_probe or failure_injection
    run: Callable[[bool], dict[str, DataFrame]]
    expected_error: str | None = None


@dataclass(frozen=True)
class Outcome:
    case: Case
    tables: dict[str, DataFrame]
    error: str | None
    stable: bool | None  # null where nothing could be run again


def error_code(e: BaseException) -> str:
    """A failure's own code, Spark's condition, or the name of its kind."""
    code = getattr(e, "code", None)
    if isinstance(code, str):
        return code
    condition = getattr(e, "getCondition", None)
    return (condition() if condition else None) or type(e).__name__


def observe(spark: SparkSession, case: Case) -> Outcome:
    """Run a case twice, the second time on permuted input; its tables are written, so that an error shows here and is captured."""
    scratch = Scratch(spark, f"case-{case.case_id}")
    try:
        tables = {n: scratch.keep(t, n) for n, t in case.run(False).items()}
    except Exception as e:  # noqa: BLE001 - a scenario may fail in any way, and how is what is measured
        return Outcome(case, {}, error_code(e), None)
    try:
        again = {n: fingerprint(t).first()["fingerprint"] for n, t in case.run(True).items()}
    except Exception:  # noqa: BLE001
        return Outcome(case, tables, None, False)
    return Outcome(case, tables, None, again == {n: fingerprint(t).first()["fingerprint"] for n, t in tables.items()})


def permuted(df: DataFrame, yes: bool) -> DataFrame:
    """The rows in another order and other partitions."""
    return df.repartition(7, F.rand(11)).sortWithinPartitions(F.rand(5)) if yes else df


def _all(outcomes: list[Outcome], name: str, shape: DataFrame | str, spark: SparkSession, categories: tuple[str, ...] | None = None) -> DataFrame:
    """A table of all cases that give it, with case_id."""
    out = spark.createDataFrame([], f"case_id string, {shape}")
    for o in outcomes:
        if name in o.tables and (categories is None or o.case.category in categories):
            out = out.unionByName(o.tables[name].select(F.lit(o.case.case_id).alias("case_id"), *out.columns[1:]))
    return out


def _share(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count_if(ok).alias("numerator"), F.count(F.lit(1)).alias("denominator"))


def _held(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows with whether their keys are observed; a null key never is."""
    return expected.join(observed.select(*keys).distinct().withColumn("seen", F.lit(True)), keys, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


#: Tables that cases may give, and expectations, with their columns besides case_id. The metrics' names.
OBSERVED = {
    "rows": "side string, key string", "fields": "key string, field string, value string", "pairs": "left_id string, right_id string", "units": "probe string, value string",
    "conflicts": "code string, left_id string, right_id string", "repairs": "defect string, outcome string", "evidence": "owner string, resolved boolean",
}
METRICS = (
    "source_retrieval_completeness", "field_value_correctness", "entity_alignment_precision", "entity_alignment_recall", "unit_normalization_success", "conflict_detection", "repair_success", "false_repair_rate",
    "evidence_coverage", "reproducibility_hash_stability", "failure_recovery",
)


def integration(spark: SparkSession, cases: list[Case], expected: dict[str, DataFrame], required: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, metrics) of an integration's scenarios.

    cases: (case_id, category, error, expected_error, stable, passed); metrics: (metric, numerator, denominator, rate), all eleven. ``expected`` has
    rows (case_id, side, key), fields (…, key, field, value), pairs (…, left_id, right_id), units (…, probe, value), conflicts (…, code, left_id,
    right_id, detected) and repairs (…, defect, repairable). Precision and recall are over integration cases, null where there is no pair; for any
    other metric an empty denominator is an error, as a benchmark without adjudications measures nothing (with ``required`` false, a null rate). False repairs are defects
    that mustn't be repaired and are. A failure is recovered if its code is the expected one.
    """
    if len({c.case_id for c in cases}) < len(cases):
        raise ValueError("two cases have one id")
    outcomes = [observe(spark, c) for c in cases]
    seen = {n: _all(outcomes, n, shape, spark) for n, shape in OBSERVED.items()}
    pairs = _all(outcomes, "pairs", OBSERVED["pairs"], spark, ("integration",)).distinct()
    known = [c.case_id for c in cases if c.category == "integration"]
    truth = expected["pairs"].where(F.col("case_id").isin(known)).select("case_id", "left_id", "right_id").distinct()
    # pairs and expectations are gone through once for both metrics
    match = Scratch(spark, "benchmark").keep(_held(truth, pairs, ["case_id", "left_id", "right_id"]).agg(F.count_if("seen").alias("numerator"), F.count(F.lit(1)).alias("denominator")), "pairs")
    conflict = _held(expected["conflicts"], seen["conflicts"], ["case_id", "code", "left_id", "right_id"])
    repaired = expected["repairs"].join(seen["repairs"].select("case_id", "defect", "outcome"), ["case_id", "defect"], "left")
    resolved = F.coalesce(F.col("outcome") == "resolved", F.lit(False))
    runs = spark.createDataFrame(
        [(o.case.case_id, o.case.category, o.error, o.case.expected_error, o.stable, (o.error == o.case.expected_error) and o.stable is not False) for o in outcomes],
        "case_id string, category string, error string, expected_error string, stable boolean, passed boolean",
    )
    found = {
        "source_retrieval_completeness": _share(_held(expected["rows"], seen["rows"], ["case_id", "side", "key"]), F.col("seen")),
        "field_value_correctness": _share(_held(expected["fields"], seen["fields"], ["case_id", "key", "field", "value"]), F.col("seen")),
        "entity_alignment_precision": match.select("numerator").crossJoin(pairs.agg(F.count(F.lit(1)).alias("denominator"))),  # one row each
        "entity_alignment_recall": match,
        "unit_normalization_success": _share(_held(expected["units"], seen["units"], ["case_id", "probe", "value"]), F.col("seen")),
        "conflict_detection": _share(conflict, F.col("seen") == F.col("detected")),
        "repair_success": _share(repaired.where("repairable"), resolved),
        "false_repair_rate": _share(repaired.where("not repairable"), resolved),
        "evidence_coverage": _share(seen["evidence"], F.col("resolved")),
        "reproducibility_hash_stability": _share(runs.where("stable is not null"), F.col("stable")),
        "failure_recovery": _share(runs.where("category = 'failure_injection'"), F.coalesce(F.col("error") == F.col("expected_error"), F.lit(False))),
    }
    out = None
    for name in METRICS:
        one = found[name].select(F.lit(name).alias("metric"), F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"))
        if required and not name.startswith("entity_alignment"):
            empty = F.raise_error(F.lit(f"{name} has no adjudication")).cast("long")
            one = one.withColumn("denominator", F.when(F.col("denominator") > 0, F.col("denominator")).otherwise(empty))
        out = one if out is None else out.unionByName(one)
    return runs, out.withColumn("rate", ratio(F.col("numerator"), F.col("denominator")))


# --- graphs ---------------------------------------------------------------------------------------------

#: Kinds of cases, and the metrics with what their denominators count.
SCIENTIFIC, REJECTION, SIZE, MAPPING = "scientific_graph", "rejection_case", "size_boundary", "data_mapping_fixture"
GRAPH_METRICS = {
    "full_graph_exact_match_rate": "paper_benchmark_scientific_graph_cases", "node_exact_match_rate": "paper_benchmark_expected_nodes", "edge_exact_match_rate": "paper_benchmark_expected_edges",
    "evidence_coverage_rate": "paper_benchmark_edge_evidence_uses", "accepted_relation_coverage_rate": "paper_benchmark_accepted_relations", "reasoning_trace_coverage_rate": "paper_benchmark_reasoning_traces",
    "nonaccepted_relation_exclusion_rate": "paper_benchmark_nonaccepted_relations", "stable_identity_order_rate": "schema_valid_expected_pass_cases", "data_mapping_fixture_pass_rate": "data_mapping_fixture_cases",
    "rejection_case_pass_rate": "rejection_fixture_cases", "size_boundary_pass_rate": "size_boundary_fixture_cases", "schema_pass_rate": "all_cases",
}
PARTS = ("node", "edge", "evidence_use", "accepted_relation", "reasoning_trace", "nonaccepted_relation")


def matched_items(items: DataFrame) -> DataFrame:
    """(case_id, part, matched, expected, actual, unexpected) of items (case_id, part, side, key) as multisets: a key that is expected twice has to be there twice."""
    n = items.groupBy("case_id", "part", "key").agg(F.count_if(F.col("side") == "expected").alias("e"), F.count_if(F.col("side") == "actual").alias("a"))
    m = F.least("e", "a")
    return n.groupBy("case_id", "part").agg(F.sum(m).alias("matched"), F.sum("e").alias("expected"), F.sum("a").alias("actual"), F.sum(F.col("a") - m).alias("unexpected"))


def graph_cases(cases: DataFrame, items: DataFrame) -> DataFrame:
    """What each case (case_id, kind, expected_status, status, schema_valid, stable_order) gives, with the counts of ``matched_items`` by part."""
    counts = [F.coalesce(F.sum(F.when(F.col("part") == p, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for p in PARTS for c in ("matched", "expected", "actual", "unexpected")]
    wide = matched_items(items).groupBy("case_id").agg(*counts)
    out = cases.join(wide, "case_id", "left").fillna(0)
    whole = lambda p: (F.col(f"{p}_matched") == F.col(f"{p}_expected")) & (F.col(f"{p}_expected") == F.col(f"{p}_actual"))
    out = out.withColumn("as_expected", F.col("schema_valid") & (F.col("status") == F.col("expected_status")))
    return out.withColumn("exact", F.col("as_expected") & whole("node") & whole("edge") & whole("evidence_use"))


def graph_rates(results: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, rate, scope), twelve rows, from ``graph_cases``; a rate over nothing is null.

    Counts of nodes, edges, evidence uses, relations and traces are over scientific cases only. A relation that wasn't accepted is excluded
    if the graph doesn't have it. Stable order is asked of valid cases that are expected to pass.
    """
    def of(kind: str) -> Column:
        return F.col("kind") == kind

    def counted(part: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(of(SCIENTIFIC), F.col(f"{part}_{c}"))), F.lit(0))

    def passed(kind: str) -> tuple[Column, Column]:
        return F.count_if(of(kind) & F.col("as_expected")), F.count_if(of(kind))

    ordered = F.col("schema_valid") & (F.col("expected_status") == "passed")
    parts = {"node_exact_match_rate": "node", "edge_exact_match_rate": "edge", "evidence_coverage_rate": "evidence_use", "accepted_relation_coverage_rate": "accepted_relation", "reasoning_trace_coverage_rate": "reasoning_trace"}
    values = {m: (counted(p, "matched"), counted(p, "expected")) for m, p in parts.items()} | {
        "full_graph_exact_match_rate": (F.count_if(of(SCIENTIFIC) & F.col("exact")), F.count_if(of(SCIENTIFIC))),
        "nonaccepted_relation_exclusion_rate": (counted("nonaccepted_relation", "expected") - counted("nonaccepted_relation", "matched"), counted("nonaccepted_relation", "expected")),
        "stable_identity_order_rate": (F.count_if(ordered & F.col("stable_order")), F.count_if(ordered)),
        "data_mapping_fixture_pass_rate": passed(MAPPING), "rejection_case_pass_rate": passed(REJECTION), "size_boundary_pass_rate": passed(SIZE),
        "schema_pass_rate": (F.count_if("schema_valid"), F.count(F.lit(1))),
    }
    wide = results.agg(*[F.struct(F.lit(m).alias("metric"), values[m][0].cast("long").alias("numerator"), values[m][1].cast("long").alias("denominator"), F.lit(s).alias("scope")).alias(m) for m, s in GRAPH_METRICS.items()])
    long = wide.select(F.inline(F.array(*GRAPH_METRICS)))
    return long.select("metric", "numerator", "denominator", ratio(F.col("numerator"), F.col("denominator")).alias("rate"), "scope")
