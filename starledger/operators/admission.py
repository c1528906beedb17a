"""Admission of a source table and of a match's input: what is wrong with them by named reasons, and the cells of an admitted table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion

RA, DEC = "ra", "dec"


@dataclass(frozen=True)
class Field:
    """A column that a source may deliver: its field, whether null is allowed, the units and the factor between them (none for text)."""

    raw: str
    field_id: str
    nullable: bool = True
    unit: str | None = None
    canonical_unit: str | None = None
    factor: str | None = None


def projection(selected: list[str], manifest: list[Field]) -> list[Field]:
    """The manifest's entries for the selected columns; ValueError unless they are the key and other approved columns, each once, coordinates as a pair."""
    known = {f.raw: f for f in manifest}
    if not selected or selected[0] != manifest[0].raw:
        raise ValueError(f"the first column has to be the key {manifest[0].raw}")
    if len(set(selected)) != len(selected) or not set(selected) <= set(known):
        raise ValueError("columns repeat or aren't approved")
    if (RA in selected) != (DEC in selected):
        raise ValueError("coordinates are selected as a pair or not at all")
    return [known[c] for c in selected]


def identity(key: Column) -> Column:
    """The key without outer and repeated white space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(key.cast("string"), r"\s+", " ")))


def rejections(table: DataFrame, fields: list[Field], status: str) -> DataFrame:
    """(reason, rows): why the table isn't admitted; no row if it is.

    status is what the source says of its answer (complete, empty or truncated). Reasons: status_disagrees (once), null_key, null_value (a
    field that may not be null), duplicate_identity (rows that share one), half_coordinate, coordinate_out_of_range. Identities are counted
    before they are compared, so one that repeats in a third of all rows is one row of the shuffle for each task.
    """
    if status not in ("complete", "empty", "truncated"):
        raise ValueError(f"unknown status {status}")
    key, names = F.col(fields[0].raw), [f.raw for f in fields]
    count = lambda c: F.count_if(c)
    checks = {"null_key": key.isNull() | (identity(key) == ""), "null_value": F.lit(False)}
    for f in fields[1:]:
        if not f.nullable:
            checks["null_value"] = checks["null_value"] | F.col(f.raw).isNull()
    if RA in names:
        ra, dec = F.col(RA).cast("double"), F.col(DEC).cast("double")
        checks["half_coordinate"] = ra.isNull() != dec.isNull()
        # NaN is above every number
        checks["coordinate_out_of_range"] = F.coalesce(~((ra >= 0) & (ra < 360)) | ~((dec >= -90) & (dec <= 90)), F.lit(False))
    found = table.agg(F.count(F.lit(1)).alias("n"), *[count(c).alias(r) for r, c in checks.items()])
    wrong = F.when(F.lit(status == "empty") != (F.col("n") == 0), 1).otherwise(0).cast("long")
    each = F.array(F.struct(F.lit("status_disagrees").alias("reason"), wrong.alias("rows")), *[F.struct(F.lit(r).alias("reason"), F.col(r).alias("rows")) for r in checks])
    by_row = found.select(F.inline(each))
    same = table.where(key.isNotNull()).groupBy(identity(key).alias("i")).agg(F.count(F.lit(1)).alias("n")).where("i != '' and n > 1")
    twice = same.agg(F.lit("duplicate_identity").alias("reason"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"))
    return by_row.unionByName(twice).where("rows > 0")


def admitted(table: DataFrame, source: str, fields: list[Field]) -> DataFrame:
    """(row_id, field_id, value, unit, locator) of each cell: the value in its canonical unit as text, the locator source/identity/column."""
    row = identity(F.col(fields[0].raw))
    cells = []
    for f in fields:
        raw = F.col(f.raw)
        value = raw.cast("string") if f.factor is None else (raw.cast("decimal(20,6)") * F.lit(f.factor).cast("decimal(12,6)")).cast("decimal(32,6)").cast("string")
        cells.append(F.struct(F.lit(f.field_id).alias("field_id"), value.alias("value"), F.lit(f.canonical_unit).cast("string").alias("unit"), F.concat(F.lit(f"{source}/"), row, F.lit(f"/{f.raw}")).alias("locator")))
    return table.select(row.alias("row_id"), F.explode(F.array(*cells)).alias("c")).select("row_id", "c.*")


def table_metrics(cells: DataFrame, status: str) -> DataFrame:
    """The three metrics of an admitted table's cells, as rows of ``data_quality.evaluate`` for ``contract_gate.checked``.

    Scope is complete if the source says so and there are rows; units are consistent by admission, counted where a value has one; every cell
    has its locator as evidence. An incomplete answer leaves all three undetermined, a table without such cells its ratio empty.
    """
    if status not in ("complete", "empty", "truncated"):
        raise ValueError(f"unknown status {status}")
    long = lambda c: c.cast("long")
    n = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNotNull() & F.col("unit").isNotNull()).alias("units"), F.count_if(F.col("locator").isNotNull()).alias("located"))
    whole = long(F.lit(status == "complete") & (F.col("cells") > 0))
    each = {"source_scope_completeness": (whole, long(F.lit(1))), "dataset_unit_consistency": (F.col("units"), F.col("units")), "dataset_evidence_coverage": (F.col("located"), F.col("cells"))}
    rows = n.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric_id"), a.alias("numerator"), b.alias("denominator")) for m, (a, b) in each.items()])))
    out = rows.withColumn("r", fusion.metric(F.col("numerator"), F.col("denominator"), F.lit(False), F.lit(status != "complete")))
    return out.select(F.lit("dataset").alias("scope"), F.lit("dataset").alias("target"), "metric_id", "numerator", "denominator", "r.status", "r.value")


def capacity(left: DataFrame, right: DataFrame, kind: str, pairs: list[tuple[str, str]], most_rows: int, most_pairs: int) -> DataFrame:
    """One row (left_rows, right_rows, eligible_pairs, verdict) on a match's input; verdict is accepted or capacity_exceeded.

    ``pairs`` names the kinds of rows, left and right, that may be compared with each other; a limit itself is accepted. Only the
    check knows limits: the joins here have none.
    """
    kinds = lambda d, names: d.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(kind) == k).alias(f"k{i}") for i, k in enumerate(names)])
    a = kinds(left, [x for x, _ in pairs]).withColumnsRenamed({f"k{i}": f"a{i}" for i in range(len(pairs))} | {"rows": "left_rows"})
    b = kinds(right, [y for _, y in pairs]).withColumnsRenamed({f"k{i}": f"b{i}" for i in range(len(pairs))} | {"rows": "right_rows"})
    eligible = sum((F.col(f"a{i}").cast("decimal(19,0)") * F.col(f"b{i}").cast("decimal(19,0)") for i in range(len(pairs))), F.lit(0).cast("decimal(38,0)"))
    full = (F.greatest("left_rows", "right_rows") > most_rows) | (F.col("eligible_pairs") > most_pairs)
    return a.crossJoin(b).select("left_rows", "right_rows", eligible.cast("decimal(38,0)").alias("eligible_pairs")).withColumn("verdict", F.when(full, "capacity_exceeded").otherwise("accepted"))  # one row each
