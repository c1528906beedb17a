"""A contract's gate: thresholds on any of the 32 quality metrics and conditions on the candidate, each a check with a result of its own."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .data_quality import METRICS

SCOPES = {m: scope for scope, of in METRICS.items() for m in of}
#: Conditions on the candidate.
CONDITIONS = ("unit_policy_canonical", "requested_fields_exact", "source_scope_allowed", "evidence_locator_present", "source_snapshot_present", "document_source_authorized")
#: Results by severity.
RESULTS = ("pass", "insufficient", "fail")


@dataclass(frozen=True)
class Check:
    """A metric against a threshold (operator gte or equals), or a condition if no metric is named; ``not_applicable`` is the result where the metric isn't."""

    constraint_id: str
    metric_id: str | None = None
    operator: str = "gte"
    threshold: str | None = None
    not_applicable: str = "pass"
    condition: str | None = None


@dataclass(frozen=True)
class Contract:
    fields: tuple[str, ...]
    sources: tuple[str, ...]
    unit_policy: str = "canonical"
    require_locator: bool = True
    require_snapshot: bool = True
    documents_allowed: bool = False


def _validated(checks: list[Check]) -> None:
    if not checks or len({c.constraint_id for c in checks}) != len(checks):
        raise ValueError("constraints need distinct ids, and there must be one")
    for c in checks:
        if (c.metric_id is None) == (c.condition is None) or c.metric_id not in (*SCOPES, None) or c.condition not in (*CONDITIONS, None):
            raise ValueError(f"{c.constraint_id} has to name one known metric or condition")
        if c.metric_id and (c.operator not in ("gte", "equals") or c.threshold is None or not Decimal(c.threshold).is_finite()):
            raise ValueError(f"{c.constraint_id} has no numeric threshold or an unknown operator")
        if c.not_applicable not in ("pass", "insufficient"):
            raise ValueError(f"{c.constraint_id}: what doesn't apply passes or is insufficient")


def conditions(values: DataFrame, sources: DataFrame, contract: Contract) -> DataFrame:
    """(condition, holds) of values (field_id, kind structured or document, in_snapshot, retained) and sources (source_id); one row for each condition.

    Of a candidate without values, the fields aren't those requested (unless none are) and required locators and snapshots are absent; without sources their scope
    is allowed. Null ids are of no requested field and of no allowed source.
    """
    one = F.lit(1)
    inside = lambda c, known: F.coalesce(F.col(c).isin(*known) if known else F.lit(False), F.lit(False))
    v = values.agg(
        F.count_if(~inside("field_id", contract.fields)).alias("other_fields"), F.count_distinct(F.when(inside("field_id", contract.fields), F.col("field_id"))).alias("fields"),
        F.count_if("retained").alias("located"), F.count_if("in_snapshot").alias("kept"), F.count_if(F.col("kind") == "document").alias("documents"),
    )
    s = sources.agg(F.count(one).alias("n"), F.count_if(~inside("source_id", contract.sources)).alias("other_sources"))
    holds = {
        "unit_policy_canonical": F.lit(contract.unit_policy == "canonical"),
        "requested_fields_exact": (F.col("other_fields") == 0) & (F.col("fields") == len(set(contract.fields))),
        "source_scope_allowed": F.col("other_sources") == 0,
        "evidence_locator_present": F.lit(not contract.require_locator) | (F.col("located") > 0),
        "source_snapshot_present": F.lit(not contract.require_snapshot) | (F.col("kept") > 0),
        "document_source_authorized": F.lit(contract.documents_allowed) | (F.col("documents") == 0),
    }
    # one row each
    return v.crossJoin(s).select(F.inline(F.array(*[F.struct(F.lit(k).alias("condition"), c.alias("holds")) for k, c in holds.items()])))


def no_conditions(spark: SparkSession) -> DataFrame:
    """What holds where only metrics are checked."""
    return spark.createDataFrame([], "condition string, holds boolean")


def checked(metrics: DataFrame, held: DataFrame, checks: list[Check]) -> DataFrame:
    """(place, constraint_id, metric_id, condition, targets, failed, insufficient, result), a row for each check in order.

    metrics are rows of ``data_quality.evaluate``, held those of ``conditions``. A metric of fields or rows is checked for each of them, and its
    result is the worst; a metric without rows (a dataset without rows) is insufficient. ValueError for unknown metrics, conditions or operators.
    """
    _validated(checks)
    spark = metrics.sparkSession
    rows = [(i, c.constraint_id, c.metric_id, c.condition, c.operator, c.threshold, c.not_applicable) for i, c in enumerate(checks)]
    # as many rows as the contract has checks
    bound = spark.createDataFrame(rows, "place int, constraint_id string, metric_id string, condition string, operator string, threshold string, not_applicable string").withColumn("threshold", F.col("threshold").cast("decimal(18,6)"))
    ok = F.when(F.col("operator") == "gte", F.col("value") >= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    one = F.when(F.col("status") == "not_applicable", F.col("not_applicable")).when((F.col("status") != "determinate") | F.col("value").isNull(), "insufficient").when(ok, "pass").otherwise("fail")
    each = metrics.select("metric_id", "status", "value").join(F.broadcast(bound.where("metric_id is not null")), "metric_id").select("place", one.alias("one"))
    found = each.groupBy("place").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("one") == "fail").alias("failed"), F.count_if(F.col("one") == "insufficient").alias("insufficient"))
    of_conditions = held.join(F.broadcast(bound), "condition").select("place", F.lit(1).cast("long").alias("targets"), (~F.col("holds")).cast("long").alias("failed"), F.lit(0).cast("long").alias("insufficient"))
    out = bound.join(found.unionByName(of_conditions), "place", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("targets", "failed", "insufficient")]
    result = F.when(F.col("failed") > 0, "fail").when((F.col("insufficient") > 0) | (F.col("targets") == 0), "insufficient").otherwise("pass")
    return out.select("place", "constraint_id", "metric_id", "condition", *counts).withColumn("result", result)


def verdict(check_rows: DataFrame) -> DataFrame:
    """One row (checks, failed, insufficient, result): fail over insufficient over pass."""
    n = lambda r: F.count_if(F.col("result") == r)
    result = F.when(F.col("failed") > 0, "fail").when((F.col("insufficient") > 0) | (F.col("checks") == 0), "insufficient").otherwise("pass")
    return check_rows.agg(F.count(F.lit(1)).alias("checks"), n("fail").alias("failed"), n("insufficient").alias("insufficient")).withColumn("result", result)
