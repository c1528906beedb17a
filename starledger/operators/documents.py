"""Documents: page routing, locators, HTML tables, labels, observations."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import ratio
from .papers import first_failure


def route(chars: Column, graphics: Column, minimum: int = 80, ceiling: int = 256) -> Column:
    """Native text, unless a page has too little of it, or graphics and not much; ValueError for a ceiling below the minimum."""
    if not 1 <= minimum <= ceiling:
        raise ValueError("the ceiling must not be below the minimum, which is 1 at least")
    return F.when((chars < minimum) | (graphics & (chars < ceiling)), "visual").otherwise("native")


def inversions(blocks: DataFrame, page: list[str], order: str, value: str) -> DataFrame:
    """One row: adjacent pairs on a page whose value falls, all pairs, and the rate (null for none). Windows hold one page."""
    w = Window.partitionBy(*page).orderBy(order)
    steps = blocks.withColumn("__b", F.lag(value).over(w)).where("__b is not null")
    n = F.count(F.lit(1))
    return steps.agg(F.count_if(F.col(value) < F.col("__b")).alias("inversions"), n.alias("pairs"), ratio(F.count_if(F.col(value) < F.col("__b")), n).alias("rate"))


def check_locators(locators: DataFrame, blocks: DataFrame) -> DataFrame:
    """(locator_id, reason): unknown block, box outside its page, text range out of bounds; null reason if sound."""
    b = blocks.select("block_id", F.length("text").alias("chars"), "width", "height", F.lit(True).alias("known"))
    j = locators.join(b, "block_id", "left")
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("width")) & (F.col("y1") <= F.col("height")) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    reason = first_failure(("unknown_block", F.col("known").isNull()), ("box_outside_page", ~inside), ("range_out_of_bounds", (F.col("start") < 0) | (F.col("end") > F.col("chars")) | (F.col("start") >= F.col("end"))))
    return j.select("locator_id", reason.alias("reason"))


class _Cells(HTMLParser):
    """Cells of a page's tables in a grid with spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, int, int, str]] = []
        self.table, self.row, self.taken, self.cell, self.span = -1, -1, set(), None, (1, 1)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self._close()
            self.table, self.row, self.taken = self.table + 1, -1, set()
        elif tag == "tr" and self.table >= 0:
            self._close()
            self.row += 1
        elif tag in ("td", "th") and self.row >= 0:
            self._close()
            a = dict(attrs)
            size = [int(a[k]) if (a.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.cell, self.span = [], (min(max(1, size[0]), 1000), min(max(1, size[1]), 1000))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is None:
            return
        col = 0
        while (self.row, col) in self.taken:
            col += 1
        value = " ".join("".join(self.cell).split())
        for r in range(self.row, self.row + self.span[0]):
            for c in range(col, col + self.span[1]):
                self.taken.add((r, c))
                self.out.append((self.table, r, c, value))
        self.cell = None


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, col_no, value) of every table of every page; spans repeat their value; pages in Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for k, h in zip(p[key], p[html], strict=True):
                parser = _Cells()
                parser.feed(h or "")
                parser.close()
                parser._close()
                rows += [(k, *c) for c in parser.out]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "col_no", "value"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table_no int, row_no int, col_no int, value string")


def labelled_columns(cells: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """First-row cells of tables matched with registered labels (label, field_id) of fixed size: exactly, else without a bracketed suffix."""
    head = cells.where("row_no = 0").withColumn("whole", text.name_key(F.col("value"))).withColumn("bare", text.name_key(text.header_unit(F.col("value"))["label"]))
    a = F.broadcast(aliases.select(F.lower("label").alias("l"), "field_id"))
    one = head.join(a.toDF("whole", "f1"), "whole", "left").join(a.toDF("bare", "f2"), "bare", "left")
    return one.select(key, "table_no", "col_no", F.coalesce("f1", "f2").alias("field_id"), F.when(F.col("f1").isNotNull(), "exact").when(F.col("f2").isNotNull(), "without_unit").alias("how"), text.header_unit(F.col("value"))["unit"].alias("unit")).where("field_id is not null")


def lookup(tokens: DataFrame, forms: DataFrame, token: str) -> DataFrame:
    """(token, status, key): matched by one key, ambiguous by several, unresolved by none; forms (form, key)."""
    j = tokens.select(token).distinct().join(forms.withColumnRenamed("form", token), token, "left").groupBy(token).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    status = F.when(F.col("lo").isNull(), "unresolved").when(F.col("lo") == F.col("hi"), "matched").otherwise("ambiguous")
    return j.select(token, status.alias("status"), F.when(status == "matched", F.col("lo")).alias("key"))


def admit_observations(observations: DataFrame, fields: DataFrame, entities: DataFrame, authorized: DataFrame) -> DataFrame:
    """(id, code): the first rung an observation misses: authorization, field, entity, value, unit; null if it passes.

    ``observations`` (id, document, field, entity, value text, unit), ``fields`` (field, field_id, units array), ``entities`` (form, key), ``authorized`` (document).
    """
    f = lookup(observations, fields.select(F.col("field").alias("form"), F.col("field_id").alias("key")), "field").toDF("field", "f_status", "field_id")
    e = lookup(observations, entities, "entity").toDF("entity", "e_status", "entity_key")
    units = fields.groupBy("field_id").agg(F.array_distinct(F.flatten(F.collect_set("units"))).alias("units"))
    j = observations.join(authorized.distinct().withColumn("ok", F.lit(True)), "document", "left").join(f, "field", "left").join(e, "entity", "left").join(F.broadcast(units), "field_id", "left")
    code = first_failure(
        ("not_authorized", F.col("ok").isNull()), ("field_unresolved", F.coalesce("f_status", F.lit("unresolved")) == "unresolved"), ("field_ambiguous", F.col("f_status") == "ambiguous"),
        ("entity_unresolved", F.coalesce("e_status", F.lit("unresolved")) == "unresolved"), ("entity_ambiguous", F.col("e_status") == "ambiguous"),
        ("bad_value", F.col("value").try_cast("double").isNull()), ("unknown_unit", ~F.array_contains("units", F.coalesce("unit", F.lit("")))),
    )
    return j.select("id", code.alias("code"))
