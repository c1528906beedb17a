"""Prices of parts by several suppliers fused to one, and the quality of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import contract_gate, data_quality, fusion
from ..scratch import Scratch, table
from .catalog import query

FIELDS = ["price", "discount", "tax"]
REASONS = ["not_measured", "unresolved_alignment", "unresolved_conflict"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a part are its sources, the supplier their priority; returned lines count as documents."""
    li = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("decimal(18,2)")
    named = F.create_map(F.lit("l_extendedprice"), F.when(F.col("l_quantity") > 10, d("l_extendedprice")), F.lit("l_discount"), F.when(F.col("l_discount") > 0.02, d("l_discount")), F.lit("l_tax"), d("l_tax"))
    payloads = li.select(F.col("l_partkey").alias("row_id"), F.lit("lines").alias("source"), F.when(F.col("l_returnflag") == "R", "document").otherwise("structured").alias("kind"), F.col("l_suppkey").alias("source_priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), (F.col("l_partkey") % 31 != 0).alias("aligned"), named.alias("payload"))
    aliases = spark.createDataFrame([("lines", "l_extendedprice", "price", 1), ("lines", "l_discount", "discount", 1), ("lines", "l_tax", "tax", 1)], "source string, raw_field string, field_id string, alias_priority int")
    return fusion.by_alias(payloads, aliases)


_CELLS = """
    c AS (
        SELECT l_partkey AS row_id, unnest(['price', 'discount', 'tax']) AS field_id, unnest([CASE WHEN l_quantity > 10 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END, CASE WHEN l_discount > 0.02 THEN CAST(l_discount AS DECIMAL(18,2)) END, CAST(l_tax AS DECIMAL(18,2))]) AS value,
            CASE WHEN l_returnflag = 'R' THEN 'document' ELSE 'structured' END AS kind, l_suppkey AS p, l_orderkey * 10 + l_linenumber AS cell_id, l_partkey % 31 <> 0 AS aligned FROM lineitem
    )"""
_SELECTED = f"""{_CELLS}, g AS (
        SELECT row_id, field_id, arg_min(value, (p, cell_id)) FILTER (kind = 'structured' AND value IS NOT NULL) AS sv, min((p, cell_id)) FILTER (kind = 'structured' AND value IS NOT NULL) AS sk,
            min(value) FILTER (kind = 'document') AS dlo, max(value) FILTER (kind = 'document') AS dhi, min(cell_id) FILTER (kind = 'document' AND value IS NOT NULL) AS did, min(value) AS lo, max(value) AS hi, bool_and(aligned) AS aligned, count_if(kind = 'structured') AS fields FROM c GROUP BY ALL
    ), s AS (
        SELECT *, CASE WHEN lo IS NULL AND fields > 0 THEN 'not_measured' WHEN lo IS NULL THEN 'not_in_source' WHEN NOT aligned THEN 'unresolved_alignment' WHEN sk IS NOT NULL THEN 'structured' WHEN dlo = dhi THEN 'document_consensus' ELSE 'unresolved_conflict' END AS outcome FROM g
    ), f AS (SELECT row_id, field_id, outcome, CASE outcome WHEN 'structured' THEN sv WHEN 'document_consensus' THEN dlo END AS value, coalesce(lo <> hi, false) AS in_conflict FROM s)"""


@query(f"WITH {_CELLS}, g AS (SELECT row_id, field_id, count(value) AS n, min(value) AS low, max(value) AS high, min(p) FILTER (value IS NOT NULL) AS a, max(p) FILTER (value IS NOT NULL) AS b FROM c GROUP BY ALL) SELECT row_id, field_id, n, low, high, (high - low)::DOUBLE <= 0 OR (high - low)::DOUBLE / greatest(abs(high)::DOUBLE, abs(low)::DOUBLE, 1e-28) <= 0.05 AS agrees, CASE WHEN a = b THEN 'same_source' ELSE 'cross_source' END AS scope FROM g WHERE n > 1")
def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 J11 M01"""
    return fusion.conflicts(_cells(spark, sf_dir), ["row_id", "field_id"], "value", "source_priority", 0.0, 0.05)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.select_canonical(_cells(spark, sf_dir), ["row_id", "field_id"])


@query(f"WITH {_SELECTED} SELECT row_id, field_id, outcome, value, in_conflict FROM f")
def canonical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 J12 G19"""
    return _selected(spark, sf_dir).drop("cell_id")


@query(f"WITH {_SELECTED} SELECT row_id, max(value) FILTER (field_id = 'price') AS price, max(value) FILTER (field_id = 'discount') AS discount, max(value) FILTER (field_id = 'tax') AS tax FROM f GROUP BY row_id")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S28"""
    return fusion.wide(_selected(spark, sf_dir), FIELDS)


@query(f"WITH {_SELECTED}, v AS (SELECT row_id, field_id, coalesce(CAST(value AS VARCHAR), outcome) AS t FROM f) SELECT row_id, max(t) FILTER (field_id = 'price') AS price, max(t) FILTER (field_id = 'discount') AS discount, max(t) FILTER (field_id = 'tax') AS tax FROM v GROUP BY row_id")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S29 X20"""
    return fusion.csv_rows(_selected(spark, sf_dir), FIELDS)


_COUNTED = f"""{_SELECTED}, k AS (
        SELECT CASE WHEN grouping(field_id) = 0 THEN 'field' WHEN grouping(row_id) = 0 THEN 'row' ELSE 'dataset' END AS scope, coalesce(field_id, CAST(row_id AS VARCHAR), 'all') AS target, count(*) AS cells, count(value) AS mapped, count_if(in_conflict)::BIGINT AS conflicts,
            count_if(value IS NULL AND outcome = 'not_measured')::BIGINT AS not_measured, count_if(value IS NULL AND outcome = 'unresolved_alignment')::BIGINT AS unresolved_alignment, count_if(value IS NULL AND outcome = 'unresolved_conflict')::BIGINT AS unresolved_conflict
        FROM f GROUP BY GROUPING SETS ((field_id), (row_id), ())
    )"""


@query(f"WITH {_COUNTED} SELECT * FROM k")
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26 A41"""
    return fusion.counters(_selected(spark, sf_dir), REASONS)


_METRICS = {"completeness": "mapped", "conflict_rate": "conflicts", "missing_rate": "not_measured"}


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.metrics(fusion.counters(_selected(spark, sf_dir), REASONS), _METRICS, F.lit(False))


_METRIC_SQL = f"{_COUNTED}, m AS (SELECT scope, target, unnest(['completeness', 'conflict_rate', 'missing_rate']) AS metric_id, unnest([mapped, conflicts, not_measured]) AS numerator, cells AS denominator FROM k)"


@query(f"WITH {_METRIC_SQL} SELECT scope, target, metric_id, numerator, denominator, 'determinate' AS status, round(numerator / denominator, 6) AS value FROM m")
def quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27"""
    return _metrics(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


_UNIT_FIELDS = ["price", "tax"]
_OBSERVED = f"""{_SELECTED.replace("l_partkey % 31 <> 0 AS aligned FROM", "l_partkey % 31 <> 0 AS aligned, l_orderkey % 97 <> 0 AS kept, l_orderkey % 89 <> 0 AS retained, l_linenumber <> 5 AS right_unit FROM")}, h AS (
        SELECT row_id, field_id, bool_and(kept) AS kept, bool_and(retained) AS retained, count_if(field_id <> 'discount') AS units, count_if(field_id <> 'discount' AND right_unit) AS right_units, min(p) <> max(p) AS several FROM c WHERE value IS NOT NULL GROUP BY ALL
    ), o AS (
        SELECT row_id, field_id, 1 AS applicable, (value IS NOT NULL)::INT AS mapped, (value IS NULL)::INT AS missing, (value IS NULL AND outcome LIKE 'unresolved%')::INT AS unresolved, (value IS NOT NULL AND kept)::INT AS provenance, (value IS NOT NULL AND kept AND retained)::INT AS evidence,
            CASE WHEN value IS NULL THEN 0 ELSE right_units END AS unit_consistent, CASE WHEN value IS NULL THEN 0 ELSE units END AS unit_applicable, in_conflict::INT AS conflict, coalesce(in_conflict AND NOT several, false)::INT AS same_source, coalesce(in_conflict AND several, false)::INT AS cross_source
        FROM f LEFT JOIN h USING (row_id, field_id)
    ), a AS (SELECT CASE WHEN grouping(field_id) = 0 THEN 'field' WHEN grouping(row_id) = 0 THEN 'row' ELSE 'dataset' END AS scope, coalesce(field_id, CAST(row_id AS VARCHAR), 'dataset') AS target, {", ".join(f"sum({c}) AS {c}" for c in data_quality._COUNTS)} FROM o GROUP BY GROUPING SETS ((field_id), (row_id), ())
    ), rec AS (
        SELECT CAST(p_partkey AS VARCHAR) AS target, CASE p_partkey % 5 WHEN 0 THEN 'unpaired' WHEN 1 THEN 'conflict_group' ELSE 'paired' END AS kind, p_partkey % 3 = 0 AS odd, p_partkey % 11 AS band FROM part
    ), fl AS (
        SELECT target, (kind = 'paired' AND band < 3)::INT AS low_confidence, (kind = 'paired' AND band < 10)::INT AS with_confidence, (kind = 'conflict_group' OR kind = 'paired' AND odd)::INT AS review_required, (kind <> 'unpaired')::INT AS adjudicable, (kind = 'unpaired' AND odd)::INT AS inconclusive, (kind = 'unpaired')::INT AS unpaired, (kind = 'paired')::INT AS paired FROM rec
    ), ra AS (SELECT count(*) AS records, sum(review_required) AS review, sum(adjudicable) AS adj, sum(inconclusive) AS inc, sum(paired) AS pairs FROM fl
    ), e AS (SELECT count(*) AS edges, count_if(o_orderpriority = '5-LOW') AS low_edges, count_if(o_custkey % 7 <> 0) AS edge_evidence FROM orders
    ), l AS (
        SELECT scope, target, unnest(['completeness', 'missingness', 'unresolved_rate', 'provenance_coverage', 'evidence_coverage', 'unit_consistency', 'same_source_conflict_rate', 'cross_source_conflict_rate']) AS m,
            unnest([mapped, missing, unresolved, provenance, evidence + CASE WHEN scope = 'dataset' THEN edge_evidence ELSE 0 END, unit_consistent, same_source, cross_source]) AS n,
            unnest([applicable, applicable, applicable, mapped, mapped + CASE WHEN scope = 'dataset' THEN edges ELSE 0 END, unit_applicable, applicable, applicable]) AS d FROM a, e
    ), u AS (
        SELECT scope, target, scope || '_' || m AS metric_id, n, d FROM l WHERE scope <> 'row' OR m NOT LIKE '%conflict%'
        UNION ALL SELECT scope, target, 'row_conflict_rate', conflict, applicable FROM a WHERE scope = 'row'
        UNION ALL SELECT scope, target, unnest(['row_low_confidence_flag', 'row_review_required_flag', 'row_inconclusive_flag']), unnest([low_confidence, review_required, inconclusive]), unnest([with_confidence, adjudicable, unpaired]) FROM a JOIN fl USING (target) WHERE scope = 'row'
        UNION ALL SELECT 'dataset', 'dataset', unnest(['object_match_coverage', 'low_confidence_edge_rate', 'review_required_record_rate', 'inconclusive_record_rate', 'source_scope_completeness', 'validation_integrity']),
            unnest([pairs, low_edges, review, inc, (SELECT count(*) FROM region), 1]), unnest([records, edges, adj, records, (SELECT count(*) FROM region), 1]) FROM ra, e
    )"""


@query(f"""
    WITH {_OBSERVED}, x AS (SELECT *, metric_id LIKE '%_flag' AND d = 0 OR metric_id = 'field_unit_consistency' AND target = 'discount' AS none FROM u)
    SELECT scope, target, metric_id, CASE WHEN none THEN 0 ELSE n END::BIGINT AS numerator, CASE WHEN none THEN 0 ELSE d END::BIGINT AS denominator,
        CASE WHEN none THEN 'not_applicable' WHEN d = 0 THEN 'empty_denominator' ELSE 'determinate' END AS status, CASE WHEN NOT none AND d > 0 THEN round_even(n / d, 6) END::DOUBLE AS value FROM x
""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 metrics of the fused prices, with parts as match records, orders as edges and regions as sources"""
    return _evaluated(spark, sf_dir, _observed_values(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


def _observed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, line = F.expr("cell_id div 10"), F.col("cell_id") % 10
    return _cells(spark, sf_dir).withColumns({"in_snapshot": order % 97 != 0, "retained": order % 89 != 0, "unit": F.when(line == 5, "other").otherwise("usual"), "target_unit": F.lit("usual")})


def _evaluated(spark: SparkSession, sf_dir: str, values: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "unpaired").when(k % 5 == 1, "conflict_group").otherwise("paired")
    status = F.when(k % 5 == 1, "conflict").when(k % 3 != 0, "accepted").when(k % 5 == 0, "inconclusive").otherwise("review_required")
    band = F.when(k % 11 < 3, "low").when(k % 11 < 6, "medium").when(k % 11 < 10, "high")
    records = table(spark, sf_dir, "part").select(k.alias("row_id"), kind.alias("record_type"), status.alias("status"), band.alias("band"))
    edges = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("high").alias("band"), (F.col("o_custkey") % 7 != 0).alias("with_evidence"))
    sources = table(spark, sf_dir, "region").select(F.lit(True).alias("complete"))
    return data_quality.evaluate(data_quality.observed_cells(values, _UNIT_FIELDS), records, edges, sources, _UNIT_FIELDS)


#: A check of each metric: rates of what is wrong are to be 0, the others at least 0.9; then the conditions.
_CHECKS = [
    contract_gate.Check(f"{m}.limit", m, *(("equals", "0") if m.endswith(("rate", "flag", "missingness")) else ("gte", "0.9")), "insufficient" if m.endswith("flag") else "pass") for m in contract_gate.SCOPES
] + [contract_gate.Check(f"candidate.{c}", condition=c) for c in contract_gate.CONDITIONS]
_LIMITS = ", ".join(f"({i}, '{c.constraint_id}', '{c.metric_id}', '{c.operator}', {c.threshold}, '{c.not_applicable}')" for i, c in enumerate(_CHECKS) if c.metric_id)
_CHECKED = f"""{_OBSERVED}, x AS (SELECT *, metric_id LIKE '%_flag' AND d = 0 OR metric_id = 'field_unit_consistency' AND target = 'discount' AS none FROM u),
    b(place, constraint_id, metric_id, operator, threshold, other) AS (VALUES {_LIMITS}),
    one AS (SELECT b.*, CASE WHEN none THEN other WHEN d = 0 THEN 'insufficient' WHEN CASE operator WHEN 'gte' THEN round_even(n / d, 6) >= threshold ELSE round_even(n / d, 6) = threshold END THEN 'pass' ELSE 'fail' END AS r FROM x JOIN b USING (metric_id)),
    checks AS (
        SELECT place, constraint_id, metric_id, NULL AS condition, count(*) AS targets, count_if(r = 'fail')::BIGINT AS failed, count_if(r = 'insufficient')::BIGINT AS insufficient FROM one GROUP BY place, constraint_id, metric_id
        UNION ALL SELECT 32, 'candidate.unit_policy_canonical', NULL, 'unit_policy_canonical', 1, 0, 0
        UNION ALL SELECT 33, 'candidate.requested_fields_exact', NULL, 'requested_fields_exact', 1, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END, 0 FROM lineitem
        UNION ALL SELECT 34, 'candidate.source_scope_allowed', NULL, 'source_scope_allowed', 1, max((r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA'))::INT), 0 FROM region
        UNION ALL SELECT 35, 'candidate.evidence_locator_present', NULL, 'evidence_locator_present', 1, 1 - max((l_orderkey % 89 <> 0)::INT), 0 FROM lineitem
        UNION ALL SELECT 36, 'candidate.source_snapshot_present', NULL, 'source_snapshot_present', 1, 1 - max((l_orderkey % 97 <> 0)::INT), 0 FROM lineitem
        UNION ALL SELECT 37, 'candidate.document_source_authorized', NULL, 'document_source_authorized', 1, max((l_returnflag = 'R')::INT), 0 FROM lineitem
    ), results AS (SELECT *, CASE WHEN failed > 0 THEN 'fail' WHEN insufficient > 0 THEN 'insufficient' ELSE 'pass' END AS result FROM checks)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _observed_values(spark, sf_dir)
    contract = contract_gate.Contract(tuple(FIELDS), ("AFRICA", "AMERICA", "ASIA"))
    held = contract_gate.conditions(values, table(spark, sf_dir, "region").withColumnRenamed("r_name", "source_id"), contract)
    return contract_gate.checked(_evaluated(spark, sf_dir, values), held, _CHECKS)


@query(f"WITH {_CHECKED} SELECT place, constraint_id, metric_id, condition, targets, failed::BIGINT AS failed, insufficient::BIGINT AS insufficient, result FROM results")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 32 metrics and six conditions against a contract"""
    return _checked(spark, sf_dir)


@query(f"WITH {_CHECKED} SELECT count(*) AS checks, count_if(result = 'fail')::BIGINT AS failed, count_if(result = 'insufficient')::BIGINT AS insufficient, CASE WHEN count_if(result = 'fail') > 0 THEN 'fail' WHEN count_if(result = 'insufficient') > 0 THEN 'insufficient' ELSE 'pass' END AS result FROM results")
def contract_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 A43"""
    return contract_gate.verdict(_checked(spark, sf_dir))


def _rules(spark: SparkSession) -> DataFrame:
    rows = [("dataset", "completeness", "gte", "0.9"), ("field", "completeness", "gte", "0.95"), ("row", "conflict_rate", "equals", "0"), ("dataset", "missing_rate", "equals", "0")]
    return spark.createDataFrame(rows, "scope string, metric_id string, operator string, t string").select("scope", "metric_id", "operator", F.col("t").cast("decimal(18,6)").alias("threshold"))


@query(f"""
    WITH {_METRIC_SQL}, r(scope, metric_id, operator, threshold) AS (VALUES ('dataset', 'completeness', 'gte', 0.9), ('field', 'completeness', 'gte', 0.95), ('row', 'conflict_rate', 'equals', 0), ('dataset', 'missing_rate', 'equals', 0)),
    v AS (SELECT m.scope, CASE WHEN operator = 'gte' THEN round(numerator / denominator, 6) >= threshold ELSE round(numerator / denominator, 6) = threshold END AS ok FROM m JOIN r USING (scope, metric_id))
    SELECT scope, count(*) AS rules, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS verdict FROM v GROUP BY scope
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29 A44"""
    return fusion.overall(fusion.gate(_metrics(spark, sf_dir), _rules(spark)), ["scope"])


@query("SELECT c_custkey, level, field_id FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'host_star' WHEN 1 THEN 'planet_assertion' ELSE 'planet_candidate' END AS level FROM customer) JOIN (VALUES ('host_star', 'star'), ('host_star', 'system'), ('planet_assertion', 'planet'), ('planet_assertion', 'star'), ('planet_assertion', 'system'), ('planet_candidate', 'planet')) f(level, field_id) USING (level)")
def field_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 F10"""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*[F.lit(x) for x in ("host_star", "planet_assertion", "planet_candidate")]), (F.col("c_custkey") % 3).cast("int")).alias("level"))
    manifest = spark.createDataFrame([("host_star", "star"), ("host_star", "system"), ("planet_assertion", "planet"), ("planet_assertion", "star"), ("planet_assertion", "system"), ("planet_candidate", "planet")], "level string, field_id string")
    return fusion.applicable(rows, manifest)


@query("""
    WITH u AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,6)) AS v, ['earth', 'jupiter_radius', 'jupiter_mass'][1 + p_partkey % 3] AS unit FROM part)
    SELECT p_partkey, CASE unit WHEN 'earth' THEN 'identity' ELSE 'converted' END AS conversion, round(CASE unit WHEN 'earth' THEN v::DOUBLE WHEN 'jupiter_radius' THEN v::DOUBLE * 11.20898 ELSE v::DOUBLE * 317.828 END, 4) AS converted FROM u
""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M02"""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("value"), F.get(F.array(*[F.lit(x) for x in ("earth", "jupiter_radius", "jupiter_mass")]), (k % 3).cast("int")).alias("unit"), F.lit("earth").alias("target_unit"), F.lit("ratio").alias("quantity_kind"))
    rules = spark.createDataFrame([("jupiter_radius", "earth", "ratio", "11.20898"), ("jupiter_mass", "earth", "ratio", "317.828")], "from_unit string, to_unit string, kind string, f string").select("from_unit", "to_unit", "kind", F.col("f").cast("decimal(38,20)").alias("factor"))
    return numbers.convert(rows, rules).select("p_partkey", "conversion", F.round(F.col("converted").cast("double"), 4).alias("converted"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(38,10)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS plain, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS whole FROM part".replace("\\\\", "\\"))
def canonical_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M01 M03 M04"""
    p = table(spark, sf_dir, "part")
    whole = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_size") + 0.5)
    return p.select("p_partkey", numbers.plain(numbers.decimal(F.col("p_retailprice"))).alias("plain"), numbers.canonical(whole, F.lit("integer")).alias("whole"))


@query("SELECT l_returnflag, CASE (l_quantity > 10)::INT + (l_discount > 0.02)::INT WHEN 2 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'missing' END AS uncertainty, ['measured', 'lower', 'upper'][1 + l_linenumber % 3] AS \"limit\", count(*) AS n FROM lineitem GROUP BY ALL")
def uncertainty_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M05 M06"""
    plus, minus = F.when(F.col("l_quantity") > 10, 1), F.when(F.col("l_discount") > 0.02, 1)
    flag = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", numbers.uncertainty(plus, minus).alias("uncertainty"), numbers.limit(F.col("l_tax"), flag, {0: "measured", 1: "lower", 2: "upper"}).alias("limit")).agg(F.count(F.lit(1)).alias("n"))


#: The same selection from all sources but the first line of each order.
_WITHOUT_FIRST = _SELECTED.removeprefix(_CELLS).replace("g AS (", "g2 AS (").replace("FROM c GROUP", "FROM c WHERE cell_id % 10 <> 1 GROUP").replace("s AS (", "s2 AS (", 1).replace("FROM g)", "FROM g2)").replace("FROM g\n", "FROM g2\n").replace("f AS (", "f2 AS (").replace("FROM s)", "FROM s2)")


@query(f"WITH {_SELECTED}{_WITHOUT_FIRST}, a AS (SELECT row_id, field_id, CAST(value AS VARCHAR) AS value FROM f), b AS (SELECT row_id, field_id, CAST(value AS VARCHAR) AS value FROM f2) SELECT *, 'first' AS only_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'second' FROM (FROM b EXCEPT ALL FROM a)")
def rebuild_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of the dataset against one that lacks the first line of each order"""
    first = Scratch(spark, "rebuild").keep(_selected(spark, sf_dir), "first")
    again = fusion.select_canonical(_cells(spark, sf_dir).where("cell_id % 10 <> 1"), ["row_id", "field_id"])
    cells = lambda d: d.select("row_id", "field_id", F.col("value").cast("string").alias("value"))
    return fusion.same_rows(cells(first), cells(again))


@query(f"WITH {_SELECTED} SELECT count(*) AS cells, 0::BIGINT AS differing FROM f")
def rebuild_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the dataset from rows in different order don't differ"""
    first = Scratch(spark, "rebuild").keep(_selected(spark, sf_dir), "first")
    again = fusion.select_canonical(_cells(spark, sf_dir).repartition(7, "cell_id"), ["row_id", "field_id"])
    cells = lambda d: d.select("row_id", "field_id", F.col("value").cast("string").alias("value"))
    count = F.count(F.lit(1))
    return first.agg(count.alias("cells")).crossJoin(fusion.same_rows(cells(first), cells(again)).agg(count.alias("differing")))  # one row each
