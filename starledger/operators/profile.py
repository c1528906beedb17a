"""Data profile, descriptive statistics, outlier fences and correlations.

All start from one table of value frequencies, (field, value, n): equal values are counted before any shuffle, and
medians, quartiles, ranks and top values follow from running totals over it, so no task holds a whole column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..scratch import Scratch
from .ordering import counted, middle, order_statistics, running_totals


def kind(t: T.DataType) -> str:
    """Boolean, number, string, array or object."""
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    return t.typeName()


def fields_of(df: DataFrame, wanted: str | None = None) -> list[str]:
    return [f.name for f in df.schema if wanted is None or kind(f.dataType) == wanted]


def long_numbers(df: DataFrame, fields: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., field, value double) for every finite number."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.field", "c.value").where(finite(F.col("value")))


def long_texts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value string) for every value that isn't null; nested values as JSON."""
    def text(f: str) -> Column:
        t = df.schema[f].dataType
        return F.to_json(f) if kind(t) in ("array", "object") else F.col(f).cast("string")

    cells = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("value")) for f in fields])
    return df.select(F.explode(cells).alias("c")).select("c.field", "c.value").where("value is not null")


def data_profile(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A row for each field: present, absent, non_null, null, distinct, kind, and for numbers count, min, max, mean, median.

    Columns of a table are always present, so absent is 0. An empty table gives a row of zeros for each field.
    """
    fields = fields or df.columns
    spark = df.sparkSession
    scratch = Scratch(spark, "profile")
    freq = counted(long_texts(df, fields), ["field"], "value")
    per = freq.groupBy("field").agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_count"))
    numeric = [f for f in fields if kind(df.schema[f].dataType) == "number"]
    named = spark.createDataFrame([(f, kind(df.schema[f].dataType)) for f in fields], "field string, value_kind string")
    rows = df.agg(F.count(F.lit(1)).alias("present"))
    out = named.join(per, "field", "left").crossJoin(F.broadcast(rows))  # one row
    if numeric:
        numbers = long_numbers(df, numeric)
        summary = numbers.groupBy("field").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
        medians = order_statistics(numbers, ["field"], "value", {"median": middle(F.lit(0), F.col("total"))}, scratch)
        out = out.join(summary, "field", "left").join(medians.select("field", "median"), "field", "left")
    else:
        out = out.selectExpr("*", "cast(null as bigint) as count", *[f"cast(null as double) as {c}" for c in ("min", "max", "mean", "median")])
    non_null = F.coalesce("non_null", F.lit(0)).cast("long")
    return out.select(
        "field", "value_kind", "present", F.lit(0).cast("long").alias("absent"), non_null.alias("non_null"), (F.col("present") - non_null).alias("null_count"),
        F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"), "count", "min", "max", "mean", "median",
    )


def categorical_summary(df: DataFrame, fields: list[str], order: str | None = None, most: int = 5, least_distinct: int = 2, most_distinct: int = 50) -> DataFrame:
    """Top values of fields with 2 to 50 distinct ones; ties by first appearance in ``order``, or else by value."""
    first = F.min(order) if order else F.lit(None).cast("long")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = df.select(*([order] if order else []), F.explode(cells).alias("c")).select("c.*", *([order] if order else [])).where("value is not null")
    freq = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    # fields with more values leave before anything is ranked
    sizes = freq.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("total")).where(F.col("distinct_count").between(least_distinct, most_distinct))
    ranked = freq.join(F.broadcast(sizes), "field").withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first", "value")))
    return ranked.where(F.col("rank") <= most).select("field", "rank", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "distinct_count")


def outlier_fences(df: DataFrame, fields: list[str]) -> DataFrame:
    """Quartiles as medians of halves (the middle value left out of both when the count is odd), fences at 1.5 times their distance, values strictly outside counted."""
    scratch = Scratch(df.sparkSession, "fences")
    numbers = long_numbers(df, fields)
    freq = scratch.keep(counted(numbers, ["field"], "value"), "values")
    n, half = F.col("total"), F.floor(F.col("total") / 2)
    lower = F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(middle(F.lit(0), half))
    upper = F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(middle(F.ceil(n / 2), half))
    cumulated = running_totals(freq, ["field"], ["value"], "n", scratch)
    aggs = []
    for name, places in (("q1", lower), ("q3", upper)):
        hits = F.size(F.filter(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))))
        aggs.append((F.sum(F.col("value") * hits) / F.sum(hits)).alias(name))
    q = cumulated.groupBy("field").agg(F.first("total").alias("count"), *aggs)
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("low", F.col("q1") - 1.5 * F.col("iqr")).withColumn("high", F.col("q3") + 1.5 * F.col("iqr"))
    outside = freq.join(F.broadcast(q), "field").where("value < low or value > high").groupBy("field").agg(F.sum("n").alias("outliers"))  # a row for each field
    return q.join(outside, "field", "left").select("field", "count", "q1", "q3", "iqr", "low", "high", F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers"))


def descriptive(df: DataFrame, fields: list[str]) -> DataFrame:
    """Count, min, max, mean, median, population standard deviation; a field without a number is an error."""
    scratch = Scratch(df.sparkSession, "descriptive")
    numbers = long_numbers(df, fields)
    named = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    base = numbers.groupBy("field").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"))
    out = named.join(base, "field", "left").join(order_statistics(numbers, ["field"], "value", {"median": middle(F.lit(0), F.col("total"))}, scratch).select("field", "median"), "field", "left")
    return out.withColumn("count", F.when(F.col("count") > 0, F.col("count")).otherwise(F.raise_error(F.concat(F.lit("no number in field "), "field")).cast("long")))


def _pearson(x: Column, y: Column, weight: Column | None = None) -> dict[str, Column]:
    """Shifted sums would be steadier; covariances of Spark's own aggregates are already so."""
    return {"n": F.count(x), "cov": F.covar_pop(x, y), "sx": F.stddev_pop(x), "sy": F.stddev_pop(y)}


def _coefficient() -> Column:
    flat = (F.col("sx") == 0) | (F.col("sy") == 0)
    raw = F.col("cov") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))
    return F.when(flat, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def pearson(df: DataFrame, fields: list[str]) -> DataFrame:
    """(left_field, right_field, n, coefficient) for each pair with two rows or more finite in both; 0 where one doesn't vary. One pass for all pairs."""
    pairs = list(combinations(fields, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = finite(F.col(a)) & finite(F.col(b))
        x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
        aggs.append(F.struct(F.lit(a).alias("left_field"), F.lit(b).alias("right_field"), *[c.alias(k) for k, c in _pearson(x, y).items()]).alias(f"p{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*").where("n >= 2").select("left_field", "right_field", "n", _coefficient().alias("coefficient"))


def spearman(df: DataFrame, fields: list[str]) -> DataFrame:
    """As A07 over average ranks, ranked anew for each pair among the rows finite in both."""
    scratch = Scratch(df.sparkSession, "spearman")
    pairs = list(combinations(fields, 2))
    cells = F.array(*[
        F.when(finite(F.col(a)) & finite(F.col(b)), F.struct(F.lit(a).alias("left_field"), F.lit(b).alias("right_field"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")))
        for a, b in pairs
    ])
    both = df.select(F.explode(F.array_compact(cells)).alias("p")).select("p.*").groupBy("left_field", "right_field", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    both = scratch.keep(both, "pairs")
    key = ["left_field", "right_field"]
    for v in ("x", "y"):
        freq = both.groupBy(*key, v).agg(F.sum("m").alias("n"))
        ranks = running_totals(freq, key, [v], "n", scratch).select(*key, v, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{v}"))
        both = both.join(ranks, [*key, v])
    m = F.col("m")
    w = F.sum(m)
    sums = both.groupBy(*key).agg(w.alias("n"), *[F.sum(m * e).alias(k) for k, e in {"a": F.col("rx"), "b": F.col("ry"), "aa": F.col("rx") ** 2, "bb": F.col("ry") ** 2, "ab": F.col("rx") * F.col("ry")}.items()])
    n = F.col("n")
    made = sums.select(*key, "n", (F.col("ab") / n - F.col("a") * F.col("b") / n / n).alias("cov"), F.sqrt(F.greatest(F.lit(0.0), F.col("aa") / n - (F.col("a") / n) ** 2)).alias("sx"), F.sqrt(F.greatest(F.lit(0.0), F.col("bb") / n - (F.col("b") / n) ** 2)).alias("sy"))
    return made.where("n >= 2").select(*key, "n", _coefficient().alias("coefficient"))


def chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of the rows that have both; a value must be a finite number or a string that isn't blank, else an error."""
    def ok(c: str) -> Column:
        return finite(F.col(c)) if kind(df.schema[c].dataType) == "number" else F.trim(F.col(c).cast("string")) != ""

    def value(c: str) -> Column:
        shown = F.col(c).cast("double") if kind(df.schema[c].dataType) == "number" else F.trim(F.col(c).cast("string"))
        return F.when(ok(c), shown).otherwise(F.raise_error(F.lit(f"{c} has a value that can't be drawn")).cast(shown_type(df, c))).alias(c)

    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(value(x), value(y))


def shown_type(df: DataFrame, c: str) -> str:
    return "double" if kind(df.schema[c].dataType) == "number" else "string"
