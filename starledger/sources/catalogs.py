"""Sky catalogs and measurements: table services' CSV and XML, cone searches, schema drift, FITS tables, recorded pages, search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite, separation, within
from . import fits


def type_category(token: str) -> str | None:
    """String, integer or number for a service's type name."""
    t = token.strip().lower().split("(")[0]
    if t in ("char", "varchar", "unicodechar", "string", "text", "clob", "date", "timestamp"):
        return "string"
    if t in ("short", "int", "integer", "long", "bigint", "smallint", "unsignedbyte"):
        return "integer"
    return "number" if t in ("float", "double", "real", "numeric", "decimal", "number") else None


def drift(df: DataFrame, pinned: dict[str, str]) -> list[str]:
    """How a table's columns differ from a pinned contract of names and categories; nothing if they agree."""
    kinds = {f.name: type_category(f.dataType.simpleString()) for f in df.schema}
    return [f"missing {c}" for c in pinned if c not in kinds] + [f"unexpected {c}" for c in kinds if c not in pinned] + [f"{c} is {kinds[c]}, not {k}" for c, k in pinned.items() if c in kinds and kinds[c] != k]


def typed_cell(cell: Column, kind: str, name: str) -> Column:
    """Identifier (1 to 32 ASCII digits, as text), text (ASCII, up to 128, no control characters) or number (finite); blank is null, anything else stops the query."""
    t = F.trim(cell)
    blank = cell.isNull() | (t == "")
    ok = {"identifier": t.rlike(r"^[0-9]{1,32}$"), "text": t.rlike(r"^[\x20-\x7e]{1,128}$"), "number": finite(t.try_cast("double"))}[kind]
    out = t.try_cast("double") if kind == "number" else t
    bad = F.raise_error(F.concat(F.lit(f"{name} has a cell that is no {kind}: "), F.coalesce(cell, F.lit("")))).cast("double" if kind == "number" else "string")
    return F.when(~blank & ok, out).when(~blank, bad).alias(name)


def read_tap_csv(spark: SparkSession, path: str, columns: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """CSV of a table service; the header must name the columns in order, and more rows than ``max_rows`` are an error, not cut off."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    if raw.columns != list(columns):
        raise ValueError(f"the columns are {raw.columns}, not {list(columns)}")
    return _bounded(raw.select(*[typed_cell(F.col(c), k, c) for c, k in columns.items()]), max_rows)


def read_votable(spark: SparkSession, path: str, columns: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """The same for XML tables: a TR a row, its TDs in the order of ``columns``."""
    schema = T.StructType([T.StructField("TD", T.ArrayType(T.StringType()))])
    rows = spark.read.format("xml").option("rowTag", "TR").option("nullValue", "").schema(schema).load(path)
    cells = [typed_cell(F.get("TD", F.lit(i)), k, c) for i, (c, k) in enumerate(columns.items())]
    sound = F.when(F.size("TD") == len(columns), True).otherwise(F.raise_error(F.lit(f"a row has not {len(columns)} cells")).cast("boolean"))
    return _bounded(rows.where(sound).select(*cells), max_rows)


def _bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df


def cone(df: DataFrame, ra: float, dec: float, degrees: float, key: str, limit: int | None = None, ra_column: str = "ra", dec_column: str = "dec") -> DataFrame:
    """Rows within a radius of a position, nearest key first; the declination band reaches the scan as a pushed filter."""
    d = F.col(dec_column)
    near = df.where(d.between(dec - degrees - 1e-9, dec + degrees + 1e-9))
    arcsec = separation(F.lit(float(ra)), F.lit(float(dec)), F.col(ra_column), d)
    out = near.withColumn("separation", arcsec).where(within(F.col("separation"), degrees * 3600))
    return out.orderBy(key).limit(limit) if limit else out


def renamed(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Physical columns under their public names; others are left out."""
    return df.select(*[F.col(p).alias(a) for a, p in aliases.items()])


def find_object(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows of one object name, spaces and case ignored."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return df.where(norm(F.col(name)) == norm(F.lit(value)))


# --- FITS -----------------------------------------------------------------------------------------------


def read_fits(spark: SparkSession, path: str, columns: list[str], hdu: int = 1, split: int = 16 << 20) -> DataFrame:
    """(path, columns… double) of binary tables, read by ranges of rows; a missing column is an error."""
    kinds = {f.name: f.dataType.simpleString() for f in fits.read_table(spark, path, hdu=hdu).schema}
    missing = [c for c in columns if c not in kinds]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    asked = ", ".join(["path string", *[f"`{c}` {kinds[c]}" for c in columns]])
    return fits.read_table(spark, path, asked, hdu, split).select("path", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])


def spectrum_rows(raw: DataFrame, *, flux: str = "flux", log_wave: str = "loglam", weight: str = "ivar", mask: str = "and_mask") -> DataFrame:
    """Unmasked samples of positive weight: wavelength, flux, uncertainty."""
    ok = (F.col(mask) == 0) & finite(F.col(flux)) & finite(F.col(log_wave)) & finite(F.col(weight)) & (F.col(weight) > 0)
    other = [c for c in raw.columns if c not in (flux, log_wave, weight, mask)]
    return raw.where(ok).select(*other, F.pow(F.lit(10.0), F.col(log_wave)).alias("wavelength"), F.col(flux).alias("flux"), (1 / F.sqrt(weight)).alias("uncertainty"))


def light_curve_rows(raw: DataFrame, *, time: str = "time", value: str = "pdcsap_flux", error: str = "pdcsap_flux_err", quality: str = "quality") -> DataFrame:
    """Samples of quality 0 with finite values and a positive error."""
    ok = (F.col(quality) == 0) & finite(F.col(time)) & finite(F.col(value)) & finite(F.col(error)) & (F.col(error) > 0)
    other = [c for c in raw.columns if c not in (time, value, error, quality)]
    return raw.where(ok).select(*other, F.col(time).alias("time"), F.col(value).alias("value"), F.col(error).alias("uncertainty"))


# --- recorded pages and search results ------------------------------------------------------------------


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, row_no, row map) of recorded pages, JSON lines {"page_no", "sha256", "rows"}; rows whose hash differs stop the query."""
    raw = spark.read.schema("page_no int, sha256 string, rows string").json(path)
    ok = F.when(F.sha2("rows", 256) == F.col("sha256"), True).otherwise(F.raise_error(F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" is not what was recorded"))).cast("boolean"))
    return raw.where(ok).select("page_no", F.posexplode(F.from_json("rows", "array<map<string,string>>")).alias("row_no", "row"))


_ITEM = "struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,DOI:string,URL:string,abstract:string>"


def search_items(pages: DataFrame, body: str) -> DataFrame:
    """Papers of bibliographic search pages: tags are stripped from titles and abstracts, which stay whole."""
    items = F.from_json(F.get_json_object(body, "$.message.items"), f"array<{_ITEM}>")
    clean = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    i = pages.select(F.explode(items).alias("i"))
    authors = F.transform(F.coalesce("i.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.concat_ws(" ", a["given"], a["family"]))
    year = F.get(F.get(F.col("i.issued")["date-parts"], F.lit(0)), F.lit(0))
    return i.select(clean(F.get("i.title", F.lit(0))).alias("title"), authors.alias("authors"), year.alias("year"), F.col("i.DOI").alias("doi"), F.col("i.URL").alias("url"), clean(F.col("i.abstract")).alias("abstract"))
