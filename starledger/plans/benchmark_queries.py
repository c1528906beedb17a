"""Benchmarks of parses, integrations and graphs over the test tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import anchors, benchmarks, bundles, match
from ..scratch import Scratch, new_path, table
from . import match_queries
from .catalog import query

_FOLD = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_SENTENCES = f"a AS (SELECT item_id, unnest(string_split(text, '. ')) AS anchor FROM benchmark), f AS (SELECT item_id, {_FOLD.format('anchor')} AS anchor FROM a), d AS (SELECT doc_id, {_FOLD.format('text')} AS text FROM documents)"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("anchor"))


@query(f"WITH {_SENTENCES} SELECT DISTINCT doc_id, anchor FROM d JOIN (SELECT DISTINCT anchor FROM f WHERE anchor <> '') s ON contains(d.text, s.anchor)")
def held_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the benchmark that documents hold"""
    return anchors.held_anchors(table(spark, sf_dir, "documents"), "doc_id", "text", _sentences(spark, sf_dir)).distinct()


@query(f"""
    WITH {_SENTENCES}, e AS (SELECT doc_id, item_id, anchor FROM f JOIN d ON doc_id % 40 = item_id % 40), r AS (SELECT e.doc_id, count_if(contains(d.text, anchor)) AS recovered, count(*) AS expected FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
    SELECT doc_id, 'heading' AS kind, CAST(recovered AS BIGINT) AS recovered, CAST(expected AS BIGINT) AS expected, round(recovered / expected, 6) AS rate FROM r
""")
def anchor_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is expected to hold the sentences of the items of its remainder"""
    docs = table(spark, sf_dir, "documents")
    want = _sentences(spark, sf_dir).withColumn("r", F.col("item_id") % 40).join(docs.select("doc_id", (F.col("doc_id") % 40).alias("r")), "r").select("doc_id", F.lit("heading").alias("kind"), "anchor")
    return anchors.recovery(docs, "doc_id", "text", want).withColumn("rate", F.round("rate", 6))


_BLOCKS = """
    b AS (SELECT doc_id, line - 1 AS line, (line - 1) // 20 AS page, lines[line] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) u(line)),
    k AS (SELECT doc_id, page, CASE WHEN line % 3 = 0 THEN 'visual' ELSE 'native' END AS backend, len(text) > 40 AS located FROM b WHERE len(text) > 0),
    p AS (SELECT DISTINCT doc_id, page FROM b),
    n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1),
    m AS (SELECT doc_id, count(*) AS blocks, count_if(located) AS located, count(DISTINCT CASE WHEN backend = 'native' THEN page END) AS native, count(DISTINCT CASE WHEN backend = 'visual' THEN page END) AS visual FROM k GROUP BY 1),
    c AS (SELECT doc_id, coalesce(blocks, 0) AS blocks, CAST(coalesce(located, 0) AS BIGINT) AS located, located / blocks AS locator_validity, pages, coalesce(native, 0) / pages AS native_coverage, coalesce(visual, 0) / pages AS visual_coverage FROM n LEFT JOIN m USING (doc_id))
"""


def _parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("page", F.expr("line div 20"))
    blocks = lines.where("length(text) > 0").select("doc_id", "page", F.when(F.col("line") % 3 == 0, "visual").otherwise("native").alias("backend"), (F.length("text") > 40).alias("located"))
    return anchors.parse_metrics(blocks, lines.select("doc_id", "page"), "doc_id")


@query(f"WITH {_BLOCKS} SELECT doc_id, blocks, located, round(locator_validity, 6) AS locator_validity, pages, round(native_coverage, 6) AS native_coverage, round(visual_coverage, 6) AS visual_coverage FROM c")
def parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locator validity and routing coverage of documents' lines, pages of 20"""
    m = _parses(spark, sf_dir)
    return m.select("doc_id", "blocks", "located", "pages", *[F.round(c, 6).alias(c) for c in ("locator_validity", "native_coverage", "visual_coverage")])


@query(f"WITH {_BLOCKS} SELECT metric, count(v) AS measured, count(*) AS total, round(avg(v), 6) AS mean FROM (SELECT unnest(['locator_validity', 'native_coverage', 'visual_coverage']) AS metric, unnest([locator_validity, native_coverage, visual_coverage]) AS v FROM c) GROUP BY metric")
def measured_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the documents that have a value"""
    return anchors.mean_of_measured(_parses(spark, sf_dir), ["locator_validity", "native_coverage", "visual_coverage"]).withColumn("mean", F.round("mean", 6))


def _integration_cases(spark: SparkSession, sf_dir: str) -> tuple[list[benchmarks.Case], dict[str, DataFrame]]:
    left, right = match_queries._left(spark, sf_dir), match_queries._right(spark, sf_dir)
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    parts = table(spark, sf_dir, "part")
    rules = spark.createDataFrame([("cm", "m", "length", "0.01")], "from_unit string, to_unit string, kind string, factor string").withColumn("factor", F.col("factor").cast("decimal(18,11)"))

    @cache
    def matched(again: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Both sides and their edges, which all cases and expectations of one order share."""
        a, b = benchmarks.permuted(left, again), benchmarks.permuted(right, again)
        e = match.edges(a, b, match_queries.STRICT, match_queries.REVIEW).select("left_id", "right_id", "methods", "by_position", "status", "confidence")
        return a, b, Scratch(spark, "benchmark").keep(e, "edges")

    def catalogs(again: bool) -> dict[str, DataFrame]:
        a, b, e = matched(again)
        sizes = parts.select("p_partkey", F.col("p_size").alias("value"), F.when(F.col("p_partkey") % 4 == 0, "parsec").otherwise("cm").alias("unit"), F.lit("m").alias("target_unit"), F.lit("length").alias("quantity_kind"))
        side = lambda d, s: d.select(F.lit(s).alias("side"), F.col("id").cast("string").alias("key"))
        return {
            "rows": side(a, "left").unionByName(side(b, "right")),
            "fields": a.select(F.col("id").cast("string").alias("key"), F.lit("name").alias("field"), F.col("name").alias("value")),
            "pairs": e.where("status = 'accepted'").select(*text("left_id", "right_id")),
            "conflicts": e.where("status = 'conflict'").select(F.lit("identity").alias("code"), *text("left_id", "right_id")),
            "evidence": e.select(F.concat_ws("-", "left_id", "right_id").alias("owner"), (F.size("methods") > 0).alias("resolved")),
            "units": numbers.convert(benchmarks.permuted(sizes, again), rules).select(F.col("p_partkey").cast("string").alias("probe"), F.col("converted").cast("string").alias("value")),
        }

    @cache
    def found(again: bool) -> DataFrame:
        r = match.records(matched(again)[2], kept=True)
        members = F.concat(F.transform("left_ids", lambda x: F.concat(F.lit("l"), x.cast("string"))), F.transform("right_ids", lambda x: F.concat(F.lit("r"), x.cast("string"))))
        return Scratch(spark, "benchmark").keep(r.withColumn("members", members).withColumn("record_key", F.col("component")), "records")

    def repaired(again: bool) -> dict[str, DataFrame]:
        r = found(again)
        after = match.decide(r, r.where("status = 'review_required'").select("record_key", "members", F.lit("accept").alias("decision")))
        return {"repairs": match.repair_outcome(match.repair_defects(r), after).select(F.col("component").alias("defect"), "outcome")}

    def unknown(_: bool) -> dict[str, DataFrame]:
        stray = spark.createDataFrame([("nowhere", ["l1"], "accept")], "record_key string, members array<string>, decision string")
        return {"repairs": match.decide(found(False), stray).select(F.col("component").alias("defect"), F.col("status").alias("outcome"))}

    cases = [
        benchmarks.Case("catalogs", "integration", catalogs), benchmarks.Case("repairs", "repair_probe", repaired),
        benchmarks.Case("too_many", "failure_injection", lambda _: match.catalog_crossmatch(left, right, limits=(1, 1)), match.CapacityExceeded.code),
        benchmarks.Case("unknown_decision", "failure_injection", unknown, "USER_RAISED_EXCEPTION"),
    ]
    named = lambda c, d: d.select(F.lit(c).alias("case_id"), "*")
    truth = left.select(F.col("id").alias("left_id"), "tic_id", F.col("gaia_id").alias("g")).join(right.select(F.col("id").alias("right_id"), "tic_id"), "tic_id")
    k = F.col("c_custkey")
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    name = F.when(k % 7 == 0, "another").otherwise(F.concat(F.lit("customer "), (k % 40).cast("string")))
    expected = {
        "rows": named("catalogs", customers.select(F.lit("left").alias("side"), k.cast("string").alias("key")).unionByName(suppliers.select(F.lit("right").alias("side"), (F.col("s_suppkey") + 1).cast("string").alias("key")))),
        "fields": named("catalogs", customers.select(k.cast("string").alias("key"), F.lit("name").alias("field"), name.alias("value"))),
        "pairs": named("catalogs", truth.select(*text("left_id", "right_id"))),
        "units": named("catalogs", parts.select(F.col("p_partkey").cast("string").alias("probe"), (F.col("p_size") * F.lit("0.01").cast("decimal(18,2)")).cast("decimal(38,10)").cast("string").alias("value"))),
        "conflicts": named("catalogs", truth.select(F.lit("identity").alias("code"), *text("left_id", "right_id"), ((F.col("left_id") + F.col("right_id")) % 2 == 0).alias("detected"))),
        "repairs": named("repairs", match.repair_defects(found(False)).select(F.col("component").alias("defect"), (F.col("defect") == "unconfirmed_match").alias("repairable"))),
    }
    return cases, expected


_WHOLE = f"""
    WITH RECURSIVE {match_queries._PAIRS}, {match_queries._COMPONENTS}, g AS (SELECT component, CASE WHEN bool_or(status = 'conflict') THEN 'conflict' WHEN bool_and(status = 'accepted') THEN 'accepted' ELSE 'review_required' END AS status FROM n JOIN comp ON comp.node = n.a GROUP BY component),
    m(metric, numerator, denominator) AS (
        SELECT 'source_retrieval_completeness', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)), (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
        UNION ALL SELECT 'field_value_correctness', (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0), (SELECT count(*) FROM customer)
        UNION ALL SELECT 'entity_alignment_precision', (SELECT count(*) FROM e WHERE t AND status = 'accepted'), (SELECT count(*) FROM e WHERE status = 'accepted')
        UNION ALL SELECT 'entity_alignment_recall', (SELECT count(*) FROM e WHERE t AND status = 'accepted'), (SELECT count(*) FROM p WHERE t)
        UNION ALL SELECT 'unit_normalization_success', (SELECT count(*) FROM part WHERE p_partkey % 4 <> 0), (SELECT count(*) FROM part)
        UNION ALL SELECT 'conflict_detection', (SELECT count(*) FROM e WHERE t AND (status = 'conflict') = ((left_id + right_id) % 2 = 0)), (SELECT count(*) FROM p WHERE t)
        UNION ALL SELECT 'repair_success', (SELECT count(*) FROM g WHERE status = 'review_required'), (SELECT count(*) FROM g WHERE status = 'review_required')
        UNION ALL SELECT 'false_repair_rate', 0, (SELECT count(*) FROM g WHERE status = 'conflict')
        UNION ALL SELECT 'evidence_coverage', (SELECT count(*) FROM e WHERE t OR g), (SELECT count(*) FROM e)
        UNION ALL SELECT 'reproducibility_hash_stability', 2, 2 UNION ALL SELECT 'failure_recovery', 2, 2
    )
"""


@query(f"{_WHOLE} SELECT metric, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator, round(numerator / nullif(denominator, 0), 6) AS rate FROM m")
def integration_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven metrics over a match of customers and suppliers, its repairs and two failures; a rate over nothing is null"""
    cases, expected = _integration_cases(spark, sf_dir)
    return benchmarks.integration(spark, cases, expected, required=False)[1].withColumn("rate", F.round("rate", 6))


@query("SELECT * FROM (VALUES ('catalogs', 'integration', NULL, NULL, true, true), ('repairs', 'repair_probe', NULL, NULL, true, true), ('too_many', 'failure_injection', 'CROSSMATCH_CAPACITY_EXCEEDED', 'CROSSMATCH_CAPACITY_EXCEEDED', NULL, true), ('unknown_decision', 'failure_injection', 'USER_RAISED_EXCEPTION', 'USER_RAISED_EXCEPTION', NULL, true)) t(case_id, category, error, expected_error, stable, passed)")
def integration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each scenario ended, and whether it gave the same rows on permuted input"""
    cases, expected = _integration_cases(spark, sf_dir)
    return benchmarks.integration(spark, cases, expected)[0]


_GRAPH = """
    k AS (
        SELECT 'u' || user_id AS case_id, ['scientific_graph', 'scientific_graph', 'rejection_case', 'size_boundary', 'data_mapping_fixture'][user_id % 5 + 1] AS kind, CASE WHEN user_id % 5 IN (2, 3) THEN 'failed' ELSE 'passed' END AS expected_status,
            CASE WHEN user_id % 5 = 2 OR user_id % 9 = 0 THEN 'failed' ELSE 'passed' END AS status, user_id % 8 <> 0 AS schema_valid, user_id % 6 <> 0 AS stable_order
        FROM (SELECT DISTINCT user_id FROM events)
    ), i AS (
        SELECT 'u' || user_id AS case_id, ['node', 'edge', 'evidence_use', 'accepted_relation', 'reasoning_trace', 'nonaccepted_relation'][event_id % 6 + 1] AS part, event_type AS key, 1 AS e, CASE WHEN user_id % 3 = 0 OR event_id % 7 <> 0 THEN 1 ELSE 0 END AS a FROM events
        UNION ALL SELECT 'u' || user_id, 'node', event_type || '!', 0, 1 FROM events WHERE event_id % 31 = 0
    ), c AS (SELECT case_id, part, sum(least(e, a)) AS matched, sum(e) AS expected, sum(a) AS actual, sum(a - least(e, a)) AS unexpected FROM (SELECT case_id, part, key, sum(e) AS e, sum(a) AS a FROM i GROUP BY ALL) GROUP BY ALL)
"""


def _graph_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    case = F.concat(F.lit("u"), u.cast("string")).alias("case_id")
    kinds = (benchmarks.SCIENTIFIC, benchmarks.SCIENTIFIC, benchmarks.REJECTION, benchmarks.SIZE, benchmarks.MAPPING)
    failed = lambda c: F.when(c, "failed").otherwise("passed")
    cases = e.select("user_id").distinct().select(
        case, pick(kinds, u % 5).alias("kind"), failed((u % 5).isin(2, 3)).alias("expected_status"), failed((u % 5 == 2) | (u % 9 == 0)).alias("status"), (u % 8 != 0).alias("schema_valid"), (u % 6 != 0).alias("stable_order"),
    )
    part = pick(benchmarks.PARTS, i % 6).alias("part")
    items = e.select(case, part, F.lit("expected").alias("side"), F.col("event_type").alias("key"))
    items = items.unionByName(e.where((u % 3 == 0) | (i % 7 != 0)).select(case, part, F.lit("actual").alias("side"), F.col("event_type").alias("key")))
    items = items.unionByName(e.where(i % 31 == 0).select(case, F.lit("node").alias("part"), F.lit("actual").alias("side"), F.concat("event_type", F.lit("!")).alias("key")))
    return benchmarks.graph_cases(cases, items)


@query(f"""
    WITH {_GRAPH} SELECT k.case_id, coalesce(sum(matched), 0)::BIGINT AS matched, coalesce(sum(expected), 0)::BIGINT AS expected, coalesce(sum(unexpected), 0)::BIGINT AS unexpected, any_value(schema_valid AND status = expected_status) AS as_expected,
        any_value(schema_valid AND status = expected_status) AND coalesce(sum(CASE WHEN part IN ('node', 'edge', 'evidence_use') THEN expected + actual - 2 * matched END), 0) = 0 AS exact
    FROM k LEFT JOIN c USING (case_id) GROUP BY k.case_id
""")
def graph_benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases, their events as expected and found parts of graphs"""
    r = _graph_results(spark, sf_dir)
    total = lambda c: sum((F.col(f"{p}_{c}") for p in benchmarks.PARTS), F.lit(0)).cast("long").alias(c)
    return r.select("case_id", total("matched"), total("expected"), total("unexpected"), "as_expected", "exact")


@query(f"""
    WITH {_GRAPH}, s AS (SELECT part, coalesce(sum(matched), 0) AS m, coalesce(sum(expected), 0) AS e FROM c JOIN k USING (case_id) WHERE kind = 'scientific_graph' GROUP BY part),
    w AS (SELECT case_id, sum(expected + actual - 2 * matched) AS off FROM c WHERE part IN ('node', 'edge', 'evidence_use') GROUP BY 1), r AS (SELECT k.*, schema_valid AND status = expected_status AS ok, coalesce(off, 0) = 0 AS whole FROM k LEFT JOIN w USING (case_id)),
    m(metric, numerator, denominator, scope) AS (
        SELECT 'full_graph_exact_match_rate', count_if(kind = 'scientific_graph' AND ok AND whole), count_if(kind = 'scientific_graph'), 'paper_benchmark_scientific_graph_cases' FROM r
        UNION ALL SELECT 'node_exact_match_rate', m, e, 'paper_benchmark_expected_nodes' FROM s WHERE part = 'node' UNION ALL SELECT 'edge_exact_match_rate', m, e, 'paper_benchmark_expected_edges' FROM s WHERE part = 'edge'
        UNION ALL SELECT 'evidence_coverage_rate', m, e, 'paper_benchmark_edge_evidence_uses' FROM s WHERE part = 'evidence_use' UNION ALL SELECT 'accepted_relation_coverage_rate', m, e, 'paper_benchmark_accepted_relations' FROM s WHERE part = 'accepted_relation'
        UNION ALL SELECT 'reasoning_trace_coverage_rate', m, e, 'paper_benchmark_reasoning_traces' FROM s WHERE part = 'reasoning_trace' UNION ALL SELECT 'nonaccepted_relation_exclusion_rate', e - m, e, 'paper_benchmark_nonaccepted_relations' FROM s WHERE part = 'nonaccepted_relation'
        UNION ALL SELECT 'stable_identity_order_rate', count_if(stable_order), count(*), 'schema_valid_expected_pass_cases' FROM r WHERE schema_valid AND expected_status = 'passed'
        UNION ALL SELECT 'data_mapping_fixture_pass_rate', count_if(ok), count(*), 'data_mapping_fixture_cases' FROM r WHERE kind = 'data_mapping_fixture' UNION ALL SELECT 'rejection_case_pass_rate', count_if(ok), count(*), 'rejection_fixture_cases' FROM r WHERE kind = 'rejection_case'
        UNION ALL SELECT 'size_boundary_pass_rate', count_if(ok), count(*), 'size_boundary_fixture_cases' FROM r WHERE kind = 'size_boundary' UNION ALL SELECT 'schema_pass_rate', count_if(schema_valid), count(*), 'all_cases' FROM r
    ) SELECT metric, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator, round(numerator / nullif(denominator, 0), 6) AS rate, scope FROM m
""")
def graph_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rate with its own numerator, denominator and scope"""
    return benchmarks.graph_rates(_graph_results(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query("""
    SELECT 'customer' AS part, 'changed_cell' AS problem, '=[' || c_custkey || ']' AS key, 'c_acctbal' AS "column" FROM customer WHERE c_custkey % 50 = 5
    UNION ALL SELECT 'customer', 'changed_cell', '=[' || c_custkey || ']', 'c_name' FROM customer WHERE c_custkey % 200 = 5
    UNION ALL SELECT 'orders', 'missing_row', '=[' || o_orderkey || ']', NULL FROM orders WHERE o_orderkey % 300 = 7
    UNION ALL SELECT 'supplier', 'extra_row', '=[' || (s_suppkey + 1000000) || ']', NULL FROM supplier WHERE s_suppkey % 9 = 1
""")
def bundle_readmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables sealed as a bundle, and what differs in altered copies of them"""
    customers, orders, suppliers = (table(spark, sf_dir, n) for n in ("customer", "orders", "supplier"))
    path = new_path(spark, "bundle")
    root = bundles.build(spark, [bundles.Part("customer", customers, ("c_custkey",)), bundles.Part("orders", orders, ("o_orderkey",)), bundles.Part("supplier", suppliers, ("s_suppkey",))], path)
    k = F.col("c_custkey")
    changed = customers.withColumn("c_acctbal", F.when(k % 50 == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    changed = changed.withColumn("c_name", F.when(k % 200 == 5, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name")))
    more = suppliers.unionByName(suppliers.where("s_suppkey % 9 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))
    return bundles.readmit(spark, [bundles.Part("customer", changed, ("c_custkey",)), bundles.Part("orders", orders.where("o_orderkey % 300 != 7"), ("o_orderkey",)), bundles.Part("supplier", more, ("s_suppkey",))], path, root)
