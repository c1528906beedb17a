"""The whole set of quality metrics: what is counted for each field, row and dataset, and the metrics of the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import fusion

#: For each scope its metrics with the counts that are divided.
METRICS = {
    "field": {
        "field_completeness": ("mapped", "applicable"),
        "field_missingness": ("missing", "applicable"),
        "field_unresolved_rate": ("unresolved", "applicable"),
        "field_provenance_coverage": ("provenance", "mapped"),
        "field_evidence_coverage": ("evidence", "mapped"),
        "field_unit_consistency": ("unit_consistent", "unit_applicable"),
        "field_same_source_conflict_rate": ("same_source", "applicable"),
        "field_cross_source_conflict_rate": ("cross_source", "applicable"),
    },
    "row": {
        "row_completeness": ("mapped", "applicable"),
        "row_missingness": ("missing", "applicable"),
        "row_unresolved_rate": ("unresolved", "applicable"),
        "row_provenance_coverage": ("provenance", "mapped"),
        "row_evidence_coverage": ("evidence", "mapped"),
        "row_unit_consistency": ("unit_consistent", "unit_applicable"),
        "row_conflict_rate": ("conflict", "applicable"),
        "row_low_confidence_flag": ("low_confidence", "with_confidence"),
        "row_review_required_flag": ("review_required", "adjudicable"),
        "row_inconclusive_flag": ("inconclusive", "unpaired"),
    },
    "dataset": {
        "dataset_completeness": ("mapped", "applicable"),
        "dataset_missingness": ("missing", "applicable"),
        "dataset_unresolved_rate": ("unresolved", "applicable"),
        "dataset_provenance_coverage": ("provenance", "mapped"),
        "dataset_evidence_coverage": ("evidence", "evidence_applicable"),
        "dataset_unit_consistency": ("unit_consistent", "unit_applicable"),
        "dataset_cross_source_conflict_rate": ("cross_source", "applicable"),
        "dataset_same_source_conflict_rate": ("same_source", "applicable"),
        "object_match_coverage": ("paired", "records"),
        "low_confidence_edge_rate": ("low_edges", "edges"),
        "review_required_record_rate": ("review_required", "adjudicable"),
        "inconclusive_record_rate": ("inconclusive", "records"),
        "source_scope_completeness": ("complete_sources", "required_sources"),
        "validation_integrity": ("checks_passed", "checks"),
    },
}
FLAGS = ("row_low_confidence_flag", "row_review_required_flag", "row_inconclusive_flag")

_COUNTS = ("applicable", "mapped", "missing", "unresolved", "provenance", "evidence", "unit_consistent", "unit_applicable", "conflict", "same_source", "cross_source")
_RECORD = ("low_confidence", "with_confidence", "review_required", "adjudicable", "inconclusive", "unpaired")


def observed_cells(values: DataFrame, unit_fields: list[str]) -> DataFrame:
    """The canonical selection of each (row_id, field_id) and what the metrics count of it.

    values are the cells of ``fusion.select_canonical`` with unit, target_unit, in_snapshot (the source's snapshot is kept) and retained
    (its evidence is). A mapped cell has provenance if all its values' snapshots are kept, evidence if all evidence is, too.
    """
    has = F.col("value").isNotNull()
    counts_units = has & F.col("field_id").isin(*unit_fields)
    source = F.when(has, F.col("source_priority"))
    more = {
        "in_snapshots": F.bool_and(F.when(has, F.col("in_snapshot"))), "all_retained": F.bool_and(F.when(has, F.col("retained"))), "unit_applicable": F.count_if(counts_units),
        "unit_consistent": F.count_if(counts_units & F.col("unit").eqNullSafe(F.col("target_unit"))), "several": F.min(source) != F.max(source),
    }
    cells = fusion.select_canonical(values, ["row_id", "field_id"], more)
    mapped, provenance = F.col("value").isNotNull(), F.coalesce("in_snapshots", F.lit(False))
    one = {
        "applicable": F.lit(True), "mapped": mapped, "missing": ~mapped, "unresolved": ~mapped & F.col("outcome").startswith("unresolved"), "provenance": mapped & provenance,
        "evidence": mapped & provenance & F.coalesce("all_retained", F.lit(False)), "conflict": F.col("in_conflict"), "same_source": F.col("in_conflict") & ~F.col("several"), "cross_source": F.col("in_conflict") & F.col("several"),
    }
    units = [F.when(mapped, F.col(c)).otherwise(0).alias(c) for c in ("unit_consistent", "unit_applicable")]
    return cells.select("row_id", "field_id", *[c.cast("long").alias(name) for name, c in one.items()], *units)


def cell_counts(cells: DataFrame) -> DataFrame:
    """(scope, target, counts…) for each field, each row and the dataset."""
    by = [[F.col("field_id")], [F.col("row_id")], []]
    g = cells.groupingSets(by, F.col("field_id"), F.col("row_id")).agg(F.grouping("field_id").alias("gf"), F.grouping("row_id").alias("gr"), *[F.sum(c).alias(c) for c in _COUNTS])
    scope = F.when(F.col("gf") == 0, "field").when(F.col("gr") == 0, "row").otherwise("dataset")
    target = F.when(F.col("gf") == 0, F.col("field_id")).when(F.col("gr") == 0, F.col("row_id").cast("string")).otherwise("dataset")
    return g.select(scope.alias("scope"), target.alias("target"), *_COUNTS)


def record_flags(records: DataFrame) -> DataFrame:
    """For match records (row_id, record_type paired, conflict_group or unpaired, status, band) what their rows' flags count, as 0 and 1."""
    kind, status, band = F.col("record_type"), F.col("status"), F.col("band")
    sure = (kind == "paired") & band.isin("high", "medium", "low")
    adjudicable = kind.isin("paired", "conflict_group")
    flags = {
        "low_confidence": sure & (band == "low"), "with_confidence": sure, "review_required": adjudicable & status.isin("review_required", "conflict"), "adjudicable": adjudicable,
        "inconclusive": (kind == "unpaired") & (status == "inconclusive"), "unpaired": kind == "unpaired", "paired": kind == "paired",
    }
    return records.select("row_id", *[F.coalesce(c, F.lit(False)).cast("long").alias(name) for name, c in flags.items()])


def _value(counts: Column) -> Column:
    return F.coalesce(counts, F.lit(0).cast("long"))


def evaluate(cells: DataFrame, records: DataFrame, edges: DataFrame, sources: DataFrame, unit_fields: list[str]) -> DataFrame:
    """(scope, target, metric_id, numerator, denominator, status, value): all 32 metrics of a dataset.

    cells as ``observed_cells`` gives them, records as for ``record_flags`` (none for a plain source table), edges (band, with_evidence)
    and sources (complete). A flag without a record of its kind and the units of a field without units don't apply; with an incomplete source
    no metric is determined. An empty dataset has the dataset's metrics only, with empty denominators.
    """
    # kept, so that the cells are counted once for the three scopes
    counts = Scratch(cells.sparkSession, "quality").keep(cell_counts(cells), "counts")
    flags = record_flags(records)
    count = F.count(F.lit(1))
    # one row each
    of_records = flags.agg(count.alias("records"), *[_value(F.sum(c)).alias(c) for c in (*_RECORD, "paired")])
    of_edges = edges.agg(count.alias("edges"), F.count_if(F.col("band") == "low").alias("low_edges"), F.count_if("with_evidence").alias("edge_evidence"))
    of_sources = sources.agg(count.alias("required_sources"), F.count_if("complete").alias("complete_sources"))
    # grouping sets give no row for an empty table, an aggregate does
    dataset = counts.where("scope = 'dataset'").agg(*[F.sum(c).alias(c) for c in _COUNTS]).withColumns({"scope": F.lit("dataset"), "target": F.lit("dataset")}).crossJoin(of_records).crossJoin(of_edges).crossJoin(of_sources)
    dataset = dataset.withColumn("evidence", _value(F.col("evidence")) + F.col("edge_evidence")).withColumn("evidence_applicable", _value(F.col("mapped")) + F.col("edges"))
    dataset = dataset.withColumn("checks", F.lit(1).cast("long")).withColumn("checks_passed", F.lit(1).cast("long"))
    rows = counts.where("scope = 'row'").join(flags.drop("paired").withColumn("target", F.col("row_id").cast("string")).drop("row_id"), "target", "left")
    known = of_sources.select((F.col("required_sources") != F.col("complete_sources")).alias("incomplete"))
    parts = []
    for scope, counted in (("field", counts.where("scope = 'field'")), ("row", rows), ("dataset", dataset)):
        each = F.array(*[F.struct(F.lit(m).alias("metric_id"), _value(F.col(n)).alias("numerator"), _value(F.col(d)).alias("denominator")) for m, (n, d) in METRICS[scope].items()])
        parts.append(counted.select("scope", "target", F.explode(each).alias("m")).select("scope", "target", "m.*"))
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(F.broadcast(known))
    flag = F.col("metric_id").isin(*FLAGS) & (F.col("denominator") == 0)
    unitless = (F.col("metric_id") == "field_unit_consistency") & ~F.col("target").isin(*unit_fields)
    broken = F.when(F.col("numerator") > F.col("denominator"), F.raise_error(F.concat(F.lit("more counted than there is: "), F.col("metric_id"))).cast("long"))
    long = long.withColumn("numerator", F.coalesce(broken, F.col("numerator")))
    out = long.withColumn("r", fusion.metric(F.col("numerator"), F.col("denominator"), flag | unitless, F.col("incomplete")))
    none = F.col("r.status") == "not_applicable"
    return out.select("scope", "target", "metric_id", *[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("numerator", "denominator")], "r.status", "r.value")
