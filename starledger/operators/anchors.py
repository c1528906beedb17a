"""Which anchors a text holds, by one automaton of all anchors, and how much of what was expected a parse recovers.

Texts and anchors are compared without case and with white space folded. The automaton (Aho–Corasick) reads each whole text once,
however many anchors there are; anchors that are part of others are found too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..scratch import Scratch

#: Characters of anchors in one automaton; more are searched for in passes of their own.
PART = 4_000_000
#: Texts read at once.
_ROWS = 256


def folded(text: str | None) -> str:
    return " ".join((text or "").casefold().split())


def _folded_column(values: pd.Series) -> pd.Series:
    return values.map(folded)


def _automaton(anchors: list[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for i, a in enumerate(anchors):
        made.add_word(a, i)
    if not anchors:
        return None
    made.make_automaton()
    return made


def _pass(texts: DataFrame, key: str, text: str, anchors: list[str]) -> DataFrame:
    # anchors of one part
    sent = texts.sparkSession.sparkContext.broadcast(anchors)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        automaton = _automaton(known)
        for b in it:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                own, held = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    found = {a for _, a in automaton.iter(folded(t))} if automaton and t else ()
                    own += [i] * len(found)
                    held += sorted(found)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(own, pa.int64())), pa.array([known[a] for a in held], pa.string())], [key, "anchor"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, anchor string")


def held_anchors(texts: DataFrame, key: str, text: str, anchors: DataFrame, anchor: str = "anchor", part: int = PART) -> DataFrame:
    """(key, anchor): the distinct anchors, folded, that each text holds somewhere. Null and blank anchors are in no text; rows that share a key each have their own."""
    wanted = anchors.select(F.col(anchor).alias("a")).where("trim(a) != ''").distinct()
    total = wanted.agg(F.sum(F.length("a"))).first()[0] or 0
    parts = 1 if total <= part else math.ceil(2 * total / part)
    out = None
    for p in range(parts):
        rows = (wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == p)).collect()
        one = _pass(texts, key, text, sorted({f for r in rows if (f := folded(r["a"]))}))
        out = one if out is None else out.unionByName(one)
    return out if parts == 1 else out.distinct()


def recovery(texts: DataFrame, key: str, text: str, expected: DataFrame, part: int = PART) -> DataFrame:
    """(key, kind, recovered, expected, rate) of expected (key, kind, anchor) in the texts of their keys; no row where nothing is expected.

    An anchor that is expected twice counts twice. Blank anchors are held by every text that exists, as an empty string is.
    """
    fold = F.pandas_udf(_folded_column, "string")
    want = expected.where("anchor is not null").select(key, "kind", fold("anchor").alias("anchor"))
    held = Scratch(texts.sparkSession, "anchors").keep(held_anchors(texts, key, text, want, part=part).distinct(), "held")
    found = held.withColumn("found", F.lit(1))
    there = texts.select(key).distinct().withColumn("there", F.lit(1))
    j = want.join(found, [key, "anchor"], "left").join(there, key, "left")
    ok = F.col("found").isNotNull() | ((F.col("anchor") == "") & F.col("there").isNotNull())
    g = j.groupBy(key, "kind").agg(F.count_if(ok).alias("recovered"), F.count(F.lit(1)).alias("expected"))
    return g.withColumn("rate", ratio(F.col("recovered"), F.col("expected")))


def parse_metrics(blocks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, blocks, located, locator_validity, pages, native_coverage, visual_coverage) of blocks (key, page, backend, located) and pages (key, page).

    A rate without anything to measure is null, except coverage, which is 0 without pages.
    """
    b = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if("located").alias("located"))
    touched = blocks.groupBy(key).agg(*[F.countDistinct(F.when(F.col("backend") == n, F.col("page"))).alias(n) for n in ("native", "visual")])
    p = pages.groupBy(key).agg(F.countDistinct("page").alias("pages"))
    j = p.join(b, key, "full").join(touched, key, "left").fillna(0, ["pages", "blocks", "located", "native", "visual"])
    cover = lambda c: F.coalesce(ratio(F.col(c), F.col("pages")), F.lit(0.0)).alias(f"{c}_coverage")
    return j.select(key, "blocks", "located", ratio(F.col("located"), F.col("blocks")).alias("locator_validity"), "pages", cover("native"), cover("visual"))


def mean_of_measured(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, measured, total, mean): cases without a value don't count as zero; the mean over none is null."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return cases.select(F.inline(each)).groupBy("metric").agg(F.count("value").alias("measured"), F.count(F.lit(1)).alias("total"), F.avg("value").alias("mean"))
