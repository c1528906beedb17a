"""Public views of published artifacts: labelled facts and tables without internal ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label

#: Fields of internal use.
INTERNAL = ("row_id", "cell_id", "run_id", "version_id", "content_hash")


def facts(df: DataFrame, key: str, units: dict[str, str] | None = None) -> DataFrame:
    """(key, place, label, value, unit) of an artifact's fields in order; internal fields and nulls are left out."""
    names = [c for c in df.columns if c != key and c not in INTERNAL]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label(c)).alias("label"), F.col(f"`{c}`").cast("string").alias("value"), F.lit((units or {}).get(c)).cast("string").alias("unit")) for i, c in enumerate(names)])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.*").where("value is not null")


def with_evidence(fact_rows: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The number of evidence items beside each fact; 0 for none."""
    n = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("evidence"))
    return fact_rows.join(n, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)).cast("long"))
