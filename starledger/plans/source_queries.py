"""Scans, sinks and streams over the test tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe
from ..operators import fusion, presentation
from ..scratch import new_path, table
from ..sources import catalogs, fits, images, sinks, tabular
from ..streaming import event_log
from .catalog import query
from .skills import as_metrics, run


@query("SELECT event_id, round(sep, 3) AS separation FROM (SELECT event_id, degrees(2 * asin(sqrt(least(1.0, sin(radians(d - 10) / 2) ** 2 + cos(radians(10)) * cos(radians(d)) * sin(radians(r - 120) / 2) ** 2)))) * 3600 AS sep FROM (SELECT event_id, (event_id::DOUBLE * 137.508::DOUBLE) % 360::DOUBLE AS r, (event_id::DOUBLE * 61.803::DOUBLE) % 180::DOUBLE - 90 AS d FROM events)) WHERE sep <= 5 * 3600 ORDER BY event_id LIMIT 50")
def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 S12"""
    i = F.col("event_id").cast("double")
    sky = table(spark, sf_dir, "events").select("event_id", ((i * 137.508) % 360.0).alias("ra"), ((i * 61.803) % 180.0 - 90.0).alias("dec"))
    return catalogs.cone(sky, 120.0, 10.0, 5.0, "event_id", 50).select("event_id", F.round("separation", 3).alias("separation"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV and read with their types"""
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, private=True)
    return tabular.read_csv(spark, path).withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT n_nationkey AS key, coalesce(n_name, '') AS name FROM nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S02 S30"""
    path = new_path(spark, "json")
    sinks.write_json(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_name"])
    return spark.read.schema("n_nationkey int, n_name string").json(path).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS o_orderdate FROM orders")
def parquet_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 D03"""
    return tabular.read_parquet(spark, f"{sf_dir}/orders.parquet", iso=True).select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '''=' WHEN c_custkey % 4 = 1 THEN '''@' ELSE '' END || c_name AS name FROM customer")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20 S29"""
    k = F.col("c_custkey") % 4
    return table(spark, sf_dir, "customer").select("c_custkey", csv_safe(F.concat(F.when(k == 0, "=").when(k == 1, "@").otherwise(""), "c_name")).alias("name"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS last_sequence, count(*) AS updates FROM events GROUP BY user_id")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log followed as a stream and folded"""
    source, out = new_path(spark, "log"), new_path(spark, "folded")
    events = table(spark, sf_dir, "events")
    events.repartitionByRange(4, "event_id").write.parquet(source)
    s = event_log.follow(spark, source, events.schema, 1)
    event_log.drain_latest(event_log.fold(s, "user_id", "event_id", ["event_type", "value"]), "user_id", out, new_path(spark, "offsets"))
    return event_log.current(spark, out, "user_id")


@query("SELECT event_id, user_id FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, kept once"""
    source, out = new_path(spark, "twice"), new_path(spark, "once")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.union(e).write.parquet(source)
    event_log.drain(event_log.once(event_log.follow(spark, source, e.schema), ["event_id"], "ts", "40 days"), out, new_path(spark, "offsets"))
    return spark.read.parquet(out).select("event_id", "user_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows, in batch by the same function"""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = event_log.windows(e, "ts", "value", "1 day", "1 hour", by=["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT 'correlation_analysis' AS skill, m AS metric, v AS value FROM (SELECT count(*)::DOUBLE AS n, round(corr(l_quantity, l_tax), 6) AS coefficient FROM lineitem) UNPIVOT (v FOR m IN (n, coefficient))")
def skill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y01 Y02 Y03 Y05"""
    out = run("correlation_analysis", table(spark, sf_dir, "lineitem"), {"fields": ["l_quantity", "l_tax"]})
    return as_metrics(out, "correlation_analysis").withColumn("value", F.round("value", 6))


@query("""
    WITH f AS (
        SELECT p_partkey, 0 AS place, 'P Name' AS label, p_name AS value, NULL AS unit FROM part UNION ALL SELECT p_partkey, 1, 'P Size', CAST(p_size AS VARCHAR), 'cm' FROM part
        UNION ALL SELECT p_partkey, 2, 'P Brand', p_brand, NULL FROM part
    ) SELECT f.*, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS evidence FROM f
""")
def public_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G21 F13"""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", F.lit("x").alias("content_hash"))
    return presentation.with_evidence(presentation.facts(p, "p_partkey", {"p_size": "cm"}), table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")


@query("SELECT o_orderkey, o_orderstatus AS status, unnest(['o_totalprice', 'o_custkey']) AS field_id, unnest([CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), CAST(o_custkey AS VARCHAR)]) AS value FROM orders")
def admitted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approved projection as one cell a row and field"""
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    cells = fusion.long_cells(o, "o_orderkey", ["o_totalprice", "o_custkey"])
    return cells.join(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status")), "row_id").select(F.col("row_id").alias("o_orderkey"), "status", "field_id", "value")


@query("SELECT event_id, value, 1 + event_id % 7 / 8 AS uncertainty FROM events WHERE event_id % 4 <> 0 AND event_id % 7 <> 0")
def light_curve_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a FITS table with flags, read back by ranges of rows; unflagged samples with a positive error"""
    path = new_path(spark, "light-curve")
    i = F.col("event_id")
    error = F.when(i % 7 == 0, 0.0).otherwise(1 + i % 7 / 8)
    fits.write_table(table(spark, sf_dir, "events").select(
        i.cast("double").alias("time"), i.cast("int").alias("cadenceno"), F.col("value").alias("pdcsap_flux"), error.alias("pdcsap_flux_err"), F.when(i % 4 == 0, 8).otherwise(0).alias("quality"),
    ), path)
    raw = fits.read_table(spark, path, "time double, pdcsap_flux double, pdcsap_flux_err double, quality int", split=1 << 20, push=True)
    return catalogs.light_curve_rows(raw).select(F.col("time").cast("long").alias("event_id"), "value", "uncertainty")


@query("SELECT event_id, round(10 ** (3.5 + event_id / 1048576), 6) AS wavelength, CAST(CAST(value AS FLOAT) AS DOUBLE) AS flux, round(1 / sqrt(event_id % 5), 9) AS uncertainty FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def spectrum_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a spectrum's FITS table; unmasked samples of positive weight"""
    path = new_path(spark, "spectrum")
    i = F.col("event_id")
    fits.write_table(table(spark, sf_dir, "events").select(
        F.col("value").cast("float").alias("flux"), (F.lit(3.5) + i / 1048576).alias("loglam"), (i % 5).cast("float").alias("ivar"), F.when(i % 3 == 0, 16).otherwise(0).alias("and_mask"), i.alias("event_id"),
    ), path)
    raw = fits.read_table(spark, path, "flux float, loglam double, ivar float, and_mask int, event_id bigint", split=1 << 20, push=True)
    got = catalogs.spectrum_rows(raw)
    return got.select("event_id", F.round("wavelength", 6).alias("wavelength"), F.col("flux").cast("double").alias("flux"), F.round("uncertainty", 9).alias("uncertainty"))


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _workbook(rows: pd.DataFrame) -> pd.DataFrame:
    """One workbook of parts: numbers as values, texts inline, nothing for a blank cell."""
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    lines = ['<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABC", ("key", "name", "size"), strict=True)) + "</row>"]
    for i, r in enumerate(rows.itertuples(), 2):
        size = f'<c r="C{i}"><v>{r.size}</v></c>' if r.size % 5 else ""
        lines.append(f'<row r="{i}"><c r="A{i}"><v>{r.key}</v></c><c r="B{i}" t="inlineStr"><is><t>{escaped(r.name)}</t></is></c>{size}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return pd.DataFrame({"name": [f"parts-{rows.book.iloc[0]}.xlsx"], "content": [out.getvalue()]})


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 5 <> 0 THEN p_size END AS p_size, CAST(p_partkey // 500 AS BIGINT) AS book FROM part")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in workbooks of 500, read row by row; blank cells are absent"""
    path = new_path(spark, "workbooks")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.expr("p_partkey div 500").alias("book"))
    # a workbook has 500 rows at most
    sinks.write_files(parts.groupBy("book").applyInPandas(_workbook, "name string, content binary"), path)
    c, book = F.col("cells"), F.regexp_extract("path", r"parts-(\d+)\.xlsx$", 1)
    return tabular.read_xlsx(spark, path).select(c["key"].cast("long").alias("p_partkey"), c["name"].alias("p_name"), c["size"].cast("int").alias("p_size"), book.cast("long").alias("book"))


def _archive(rows: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for r in rows.itertuples():
            z.writestr(f"{r.label}/{r.vec_id}.rgb", bytes(r.pixels.tolist()))
    return pd.DataFrame({"name": [f"images-{rows.pack.iloc[0]}.zip"], "content": [out.getvalue()]})


@query("""
    WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 4) * 32))) AS BIGINT)) AS p FROM embeddings)
    SELECT label || '/' || vec_id || '.rgb' AS name, CAST(label AS VARCHAR) AS label, CAST(75 AS INTEGER) AS cells, CAST(list_sum(p) AS BIGINT) AS light, CAST(list_max(p) AS BIGINT) AS brightest FROM p
""")
def archive_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 5 x 5 pixels in archives of 200, read by ranges of entries"""
    path = new_path(spark, "archives")
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") + 4) * 32).cast("double"))).cast("int"))
    images_ = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(level, F.array_repeat(F.lit(0), 75 - 64)).alias("pixels"), F.expr("vec_id div 200").alias("pack"))
    # an archive has 200 images at most
    sinks.write_files(images_.groupBy("pack").applyInPandas(_archive, "name string, content binary"), path)
    got = images.read_image_archives(spark, path, side=5)
    shade = F.transform("pixels", lambda x: F.round(x * 255).cast("long"))
    return got.select("name", "label", F.size("pixels").alias("cells"), F.aggregate(shade, F.lit(0).cast("long"), lambda a, x: a + x).alias("light"), F.array_max(shade).alias("brightest"))
