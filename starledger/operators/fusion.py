"""Fusion of values from several sources: long cells, conflicts, canonical selection, and the way back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_safe


def long_cells(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """(row_id, field_id, value) text cells, null ones too."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_id"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.col(row).alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*")


def resolve(members: DataFrame, raw: DataFrame, key: list[str], check: str) -> DataFrame:
    """Members with their raw records; a missing record, or one whose ``check`` column differs, stops the query."""
    r = raw.withColumnRenamed(check, "__found").withColumn("__known", F.lit(True))
    out = members.join(r, key, "left")
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    ok = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no raw record "), name)).cast("boolean")).when(~F.col("__found").eqNullSafe(F.col(check)), F.raise_error(F.concat(F.lit("another raw record under "), name)).cast("boolean")).otherwise(F.lit(True))
    return out.withColumn("resolved", ok).where("resolved").drop("__found", "__known", "resolved")


def by_alias(payloads: DataFrame, aliases: DataFrame) -> DataFrame:
    """(…, field_id, alias_priority, value) from payload maps and a manifest of field aliases (source, raw_field, field_id, alias_priority) of fixed size."""
    long = payloads.select(*[c for c in payloads.columns if c != "payload"], F.explode("payload").alias("raw_field", "value"))
    return long.join(F.broadcast(aliases), ["source", "raw_field"])


def with_documents(cells: DataFrame, observations: DataFrame) -> DataFrame:
    """Document observations behind structured cells."""
    return cells.withColumn("kind", F.lit("structured")).unionByName(observations.withColumn("kind", F.lit("document")), allowMissingColumns=True)


def applicable(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row, field) cells that an entity level has; the manifest (level, field_id) is of fixed size."""
    return rows.join(F.broadcast(manifest), "level")


def conflicts(cells: DataFrame, group: list[str], value: str, source: str, absolute: float = 0.0, relative: float = 0.0, floor: str = "1e-28") -> DataFrame:
    """Groups with several values, and whether they agree: a span within ``absolute``, or within ``relative`` of the largest magnitude."""
    v = F.col(value)
    g = cells.where(v.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.min(source).alias("__s"), F.max(source).alias("__t"),
    ).where("n > 1")
    span = (F.col("high") - F.col("low")).cast("double")
    scale = F.greatest(F.abs("high").cast("double"), F.abs("low").cast("double"), F.lit(float(floor)))
    agrees = (span <= absolute) | (span / scale <= relative)
    return g.select(*group, "n", "low", "high", agrees.alias("agrees"), F.when(F.col("__s") == F.col("__t"), "same_source").otherwise("cross_source").alias("scope"))


def select_canonical(cells: DataFrame, group: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """One outcome a group from cells (kind, value, source_priority, alias_priority, cell_id, aligned).

    The first structured value by source, alias and id; else the documents' value if they agree on one. Nothing is chosen where the
    alignment is unresolved or documents disagree. Without any value: not_measured if a source has the field, else not_in_source. All of it is one aggregate,
    which also takes the aggregates ``more``.
    """
    more = more or {}
    has = F.col("value").isNotNull()
    structured, document = has & (F.col("kind") == "structured"), has & (F.col("kind") == "document")
    order = F.struct("source_priority", "alias_priority", "cell_id")
    g = cells.groupBy(*group).agg(
        F.min_by(F.when(structured, F.struct("value", "cell_id")), F.when(structured, order)).alias("s"), F.min(F.when(document, F.col("value"))).alias("dlo"), F.max(F.when(document, F.col("value"))).alias("dhi"),
        F.min(F.when(document, F.col("cell_id"))).alias("did"), F.min(F.when(structured, F.col("value"))).alias("slo"), F.max(F.when(structured, F.col("value"))).alias("shi"),
        F.bool_and("aligned").alias("aligned"), F.count_if(F.col("kind") == "structured").alias("fields"),
        *[c.alias(name) for name, c in more.items()],
    )
    any_value = F.col("slo").isNotNull() | F.col("dlo").isNotNull()
    outcome = (
        F.when(~any_value & (F.col("fields") > 0), "not_measured").when(~any_value, "not_in_source").when(~F.col("aligned"), "unresolved_alignment").when(F.col("slo").isNotNull(), "structured")
        .when(F.col("dlo") == F.col("dhi"), "document_consensus").otherwise("unresolved_conflict")
    )
    low, high = F.least("slo", "dlo"), F.greatest("shi", "dhi")
    return g.select(
        *group, outcome.alias("outcome"), F.when(outcome == "structured", F.col("s.value")).when(outcome == "document_consensus", F.col("dlo")).alias("value"),
        F.when(outcome == "structured", F.col("s.cell_id")).when(outcome == "document_consensus", F.col("did")).alias("cell_id"), F.coalesce(low != high, F.lit(False)).alias("in_conflict"), *more,
    )


def wide(cells: DataFrame, fields: list[str], status: str = "outcome", mapped: tuple[str, ...] = ("structured", "document_consensus")) -> DataFrame:
    """One row a row_id again; cells without a value are null. Conditional maxima, so fields are fixed and nothing is listed first."""
    return cells.groupBy("row_id").agg(*[F.max(F.when((F.col("field_id") == f) & F.col(status).isin(*mapped), F.col("value"))).alias(f) for f in fields])


def csv_rows(cells: DataFrame, fields: list[str], status: str = "outcome") -> DataFrame:
    """As ``wide`` for a CSV sink: guarded text, and a cell without a value shows why."""
    shown = F.coalesce(csv_safe(F.col("value")), F.col(status))
    return cells.groupBy("row_id").agg(*[F.max(F.when(F.col("field_id") == f, shown)).alias(f) for f in fields])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one rebuild that the other lacks, as multisets: none if they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


# --- quality --------------------------------------------------------------------------------------------


def counters(cells: DataFrame, reasons: list[str]) -> DataFrame:
    """Counters for each field, each row and all, from one pass with grouping sets."""
    v = F.col("value").isNotNull()
    g = cells.groupingSets([[F.col("field_id")], [F.col("row_id")], []], F.col("field_id"), F.col("row_id")).agg(
        F.grouping("field_id").alias("gf"), F.grouping("row_id").alias("gr"), F.count(F.lit(1)).alias("cells"), F.count_if(v).alias("mapped"), F.count_if("in_conflict").alias("conflicts"),
        *[F.count_if(~v & (F.col("outcome") == r)).alias(r) for r in reasons],
    )
    scope = F.when(F.col("gf") == 0, "field").when(F.col("gr") == 0, "row").otherwise("dataset")
    target = F.when(F.col("gf") == 0, F.col("field_id")).when(F.col("gr") == 0, F.col("row_id").cast("string")).otherwise("all")
    return g.select(scope.alias("scope"), target.alias("target"), "cells", "mapped", "conflicts", *reasons)


def metric(numerator: Column, denominator: Column, structural: Column, incomplete: Column, digits: int = 6) -> Column:
    """struct(status, value): not applicable, then an incomplete source, then an empty denominator, else a ratio, half to even."""
    status = F.when(structural, "not_applicable").when(incomplete, "insufficient_source").when(denominator == 0, "empty_denominator").otherwise("determinate")
    exact = F.try_divide(numerator.cast("decimal(18,0)"), denominator.cast("decimal(18,0)"))
    return F.struct(status.alias("status"), F.when(status == "determinate", F.bround(exact, digits).cast(f"decimal(18,{digits})")).alias("value"))


def metrics(counted: DataFrame, metric_columns: dict[str, str], incomplete: Column) -> DataFrame:
    """(scope, target, metric_id, numerator, denominator, status, value), a row for each metric of each counter row."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(c).alias("numerator"), F.col("cells").alias("denominator")) for m, c in metric_columns.items()])
    long = counted.select("scope", "target", F.explode(rows).alias("m")).select("scope", "target", "m.*")
    return long.withColumn("r", metric(F.col("numerator"), F.col("denominator"), F.lit(False), incomplete)).select("scope", "target", "metric_id", "numerator", "denominator", "r.status", "r.value")


def gate(metric_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope, target, metric_id, verdict): rules (scope, metric_id, operator gte or equals, threshold) of fixed size; what can't be determined is insufficient, what doesn't apply passes."""
    j = metric_rows.join(F.broadcast(rules), ["scope", "metric_id"])
    ok = F.when(F.col("operator") == "gte", F.col("value") >= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    verdict = F.when(F.col("status") == "not_applicable", "pass").when(F.col("status") != "determinate", "insufficient").when(ok, "pass").otherwise("fail")
    return j.select("scope", "target", "metric_id", "value", verdict.alias("verdict"))


def overall(gated: DataFrame, group: list[str]) -> DataFrame:
    """Fail over insufficient over pass."""
    severity = F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "insufficient", 1).otherwise(0)
    return gated.groupBy(*group).agg(F.max(severity).alias("s"), F.count(F.lit(1)).alias("rules")).select(*group, "rules", F.get(F.array(*[F.lit(x) for x in ("pass", "insufficient", "fail")]), F.col("s")).alias("verdict"))
