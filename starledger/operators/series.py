"""Time series and spectra: neighbours in order, clipping, folding, periodograms, continua and lines, for objects of any length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import doppler, finite
from ..scratch import Scratch
from .ordering import median, neighbours, positions
from .periodogram import on_grid

#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826022185056018


def lag_features(df: DataFrame, group: list[str], order: str, value: str, lags: int) -> DataFrame:
    """(group, order, label, lag_1 … lag_n) of rows with all lags."""
    made = {f"lag_{k}": (lambda w, k=k: F.lag(value, k).over(w)) for k in range(1, lags + 1)}
    out = neighbours(df.select(*group, order, value), group, [order], made, before=lags)
    return out.where(F.col(f"lag_{lags}").isNotNull()).select(*group, order, F.col(value).alias("label"), *made)


def cadence(df: DataFrame, group: list[str], time: str) -> DataFrame:
    """(group, n, duration, cadence): the median of steps between neighbours; null for one row."""
    steps = neighbours(df.select(*group, time), group, [time], {"step": lambda w: F.col(time) - F.lag(time).over(w)}, before=1)
    mid = median(steps.where("step is not null").withColumn("step", F.round("step", 9)), group, "step").select(*group, F.col("median").alias("cadence"))
    return df.groupBy(*group).agg(F.count(time).alias("n"), (F.max(time) - F.min(time)).alias("duration")).join(mid, group, "left")


def extrema(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Interior rows at least as large as the one before and larger than the one behind, in magnitude."""
    made = {"__b": lambda w: F.abs(F.lag(value).over(w)), "__a": lambda w: F.abs(F.lead(value).over(w))}
    out = neighbours(df, group, [order], made, before=1, after=1)
    return out.where((F.abs(value) >= F.col("__b")) & (F.abs(value) > F.col("__a"))).drop("__a", "__b", "position", "group_size")


def line_width(df: DataFrame, group: list[str], order: str, flux: str, reach: int = 2) -> DataFrame:
    """``equivalent_width``, the integral of 1 - flux by trapezoids over ``reach`` rows to both sides, cut at the ends."""
    def area(w) -> Column:
        total = F.lit(0.0)
        for k in range(-reach, reach):
            here = [(F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)) for c in (order, flux)]
            nxt = [(F.lag(c, -k - 1).over(w) if k + 1 < 0 else F.lead(c, k + 1).over(w)) for c in (order, flux)]
            total = total + F.coalesce((nxt[0] - here[0]) * ((1 - here[1]) + (1 - nxt[1])) / 2, F.lit(0.0))
        return total

    return neighbours(df, group, [order], {"equivalent_width": area}, before=reach, after=reach).drop("position", "group_size")


def occurrences(df: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """``occurrence``, from 0, among rows of one fingerprint; a fingerprint may hold any number of rows."""
    return positions(df, fingerprint, order).withColumnRenamed("position", "occurrence").drop("group_size")


def even_sample(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows at floor(i (n - 1) / (limit - 1)) for i below ``limit``, each once; all rows if there are no more."""
    placed = positions(df, group, order)
    n, p = F.col("group_size"), F.col("position")
    # row p is taken if some i has p (limit-1) <= i (n-1) < (p+1)(limit-1)
    first = F.ceil(p * (limit - 1) / F.greatest(n - 1, F.lit(1)))
    hit = (first * (n - 1) < (p + 1) * (limit - 1)) & (first < limit)
    return placed.where((n <= limit) | hit).drop("position", "group_size")


def time_split(df: DataFrame, group: list[str], time: str, key: str, share: float) -> DataFrame:
    """``part`` train or test: the last ``share`` of rows test; rows of one time aren't parted but go to test together."""
    placed = positions(df, group, [time, key])
    cut = F.floor(F.col("group_size") * (1 - share)).cast("long")
    first = placed.where(F.col("position") == cut).select(*group, F.col(time).alias("__cut"))
    out = placed.join(first, group, "left")
    return out.withColumn("part", F.when(F.col(time) >= F.col("__cut"), "test").otherwise("train")).drop("__cut", "position", "group_size")


def robust_scale(df: DataFrame, group: list[str], value: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, center, mad): the median and the scaled median absolute deviation, exact."""
    center = median(df, group, value, scratch).select(*group, F.col("median").alias("center"))
    away = df.join(center, group).withColumn("__d", F.abs(F.col(value) - F.col("center")))
    mad = median(away, group, "__d", scratch).select(*group, (F.col("median") * MAD_SCALE).alias("mad"))
    return center.join(mad, group)


def light_curve(df: DataFrame, group: list[str], time: str, value: str, sigma: float = 5.0, period: float = 1.0, least: int = 8, magnitude: bool = False) -> DataFrame:
    """Accepted samples: (group, time, normalized, phase). Values are divided by their median (or it is subtracted from magnitudes), clipped at
    ``sigma`` scaled deviations, and folded from the first time; objects with fewer than ``least`` samples, or repeated times, stop the query."""
    if not 2 <= sigma <= 20:
        raise ValueError("sigma must be from 2 to 20")
    scratch = Scratch(df.sparkSession, "curve")
    rows = df.select(*group, time, value).where(finite(F.col(value)))
    size = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(time).alias("times"), F.min(time).alias("t0"))
    bad = F.when(F.col("n") < least, "too few samples").when(F.col("times") < F.col("n"), "repeated times")
    size = size.withColumn("t0", F.when(bad.isNotNull(), F.raise_error(bad).cast("double")).otherwise(F.col("t0").cast("double")))
    scale = robust_scale(rows, group, value, scratch)
    j = rows.join(scale, group).join(size.select(*group, "t0"), group)
    v, c = F.col(value), F.col("center")
    kept = j.where((F.col("mad") == 0) | (F.abs(v - c) <= sigma * F.col("mad")))
    return kept.select(*group, time, (v - c if magnitude else F.try_divide(v, c)).alias("normalized"), F.pmod((F.col(time) - F.col("t0")) / period, F.lit(1.0)).alias("phase"))


def frequency_grid(low: float, high: float, duration: float, per_peak: int = 5) -> np.ndarray:
    """Frequencies from 1 / high to 1 / low periods."""
    step = 1 / (per_peak * duration)
    return 1 / high + step * np.arange(max(2, math.ceil((1 / low - 1 / high) / step) + 1))


def periodogram(df: DataFrame, group: str, time: str, value: str, frequencies: np.ndarray) -> DataFrame:
    """(group, frequency, power), Lomb–Scargle in standard normalization about the mean."""
    return on_grid(df, group, time, value, frequencies)


def peaks(power: DataFrame, group: str, k: int = 10) -> DataFrame:
    """The k strongest local maxima of each object, and its strongest frequency in any case."""
    from pyspark.sql import Window

    best = power.groupBy(group).agg(F.max_by(F.struct("frequency", "power"), F.struct("power", -F.col("frequency"))).alias("b")).select(group, "b.*")
    all_ = extrema(power, [group], "frequency", "power").unionByName(best).distinct()
    w = Window.partitionBy(group).orderBy(F.desc("power"), "frequency")  # cut to ranks before the shuffle
    return all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def continuum(df: DataFrame, group: str, wave: str, flux: str, rounds: int = 4, reject: float = 3.0) -> DataFrame:
    """``continuum`` beside each sample: a cubic in the scaled wavelength, refitted without what lies beyond ``reject`` scaled deviations.

    The fit solves normal equations from power sums, which are aggregates; only one row an object reaches Python.
    """
    scratch = Scratch(df.sparkSession, "continuum")
    span = df.groupBy(group).agg(F.min(wave).alias("lo"), F.max(wave).alias("hi"))
    x = (2 * F.col(wave) - F.col("lo") - F.col("hi")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    rows = scratch.keep(df.join(span, group).withColumn("x", x).withColumn("use", F.lit(True)).drop("lo", "hi"), "rows")
    kind = df.schema[group].dataType.simpleString()

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            a = np.array([[[r[f"x{i + j}"] for j in range(4)] for i in range(4)] for _, r in p.iterrows()]).reshape(-1, 4, 4)
            b = p[[f"y{i}" for i in range(4)]].to_numpy()
            out = [np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(a, b, strict=True)]
            yield pd.DataFrame({group: p[group], **{f"c{i}": [o[i] for o in out] for i in range(4)}})

    for i in range(rounds):
        used = rows.where("use")
        sums = used.groupBy(group).agg(*[F.sum(F.pow("x", F.lit(float(k)))).alias(f"x{k}") for k in range(7)], *[F.sum(F.col(flux) * F.pow("x", F.lit(float(k)))).alias(f"y{k}") for k in range(4)])
        fit = scratch.keep(sums.mapInPandas(solve, f"{group} {kind}, c0 double, c1 double, c2 double, c3 double"), f"fit{i}")
        model = F.col("c0") + F.col("x") * (F.col("c1") + F.col("x") * (F.col("c2") + F.col("x") * F.col("c3")))
        rows = rows.drop("continuum").join(fit, group).withColumn("continuum", model).drop("c0", "c1", "c2", "c3")
        if i < rounds - 1:
            away = rows.where("use").withColumn("away", F.abs(F.col(flux) - F.col("continuum")))
            mad = median(away, [group], "away", scratch).select(group, (F.col("median") * MAD_SCALE).alias("mad"))
            rows = rows.join(mad, group).withColumn("use", F.col("use") & ((F.col("mad") == 0) | (F.abs(F.col(flux) - F.col("continuum")) <= reject * F.col("mad")))).drop("mad")
            rows = scratch.keep(rows, f"rows{i}")
    return rows.drop("x", "use")


def spectrum(df: DataFrame, group: str, wave: str, flux: str, rest: float, strongest: int = 32) -> DataFrame:
    """Lines: extrema of flux over continuum beyond three times the noise, with depth, width, signal to noise and velocity."""
    from pyspark.sql import Window

    flat = continuum(df, group, wave, flux).withColumn("ratio", F.try_divide(F.col(flux), F.col("continuum"))).where("ratio is not null")
    flat = Scratch(df.sparkSession, "spectrum").keep(flat, "flat")
    steps = neighbours(flat, [group], [wave], {"step": lambda w: F.col("ratio") - F.lag("ratio").over(w)}, before=1)
    noise = robust_scale(steps.where("step is not null"), [group], "step").select(group, (F.col("mad") / math.sqrt(2)).alias("noise"))
    wide = line_width(flat.withColumn("depth", 1 - F.col("ratio")), [group], wave, "ratio")
    lines = extrema(wide, [group], wave, "depth").join(noise, group).where(F.abs("depth") > 3 * F.col("noise"))
    w = Window.partitionBy(group).orderBy(F.desc(F.abs("depth")), wave)
    out = lines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= strongest)
    snr = F.least(F.lit(1e12), F.coalesce(F.try_divide(F.lit(1.0), F.col("noise")), F.lit(1e12)))
    return out.select(group, "rank", wave, "depth", "equivalent_width", snr.alias("snr"), doppler(F.col(wave), F.lit(rest)).alias("velocity"))


def regression_metrics(df: DataFrame, group: list[str], actual: str, predicted: str) -> DataFrame:
    """Mae, rmse and r2 (null where the actual values don't vary)."""
    e = F.col(actual) - F.col(predicted)
    g = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("v"))
    return g.select(*group, "n", "mae", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"))


def naive_forecast(df: DataFrame, group: list[str], order: str, value: str, key: str, share: float = 0.2) -> DataFrame:
    """How well the last value forecasts the next, over the test part."""
    lagged = neighbours(df.select(*group, order, key, value), group, [order, key], {"last": lambda w: F.lag(value).over(w)}, before=1).drop("position", "group_size")
    parts = time_split(lagged, group, order, key, share)
    return regression_metrics(parts.where("part = 'test' and last is not null"), group, value, "last")


def chunks(blocks_: DataFrame, document: str, order: str, text: str, section: str, budget: int = 2000, most: int = 20) -> DataFrame:
    """Greedy chunks of a document's blocks: a chunk ends before its characters (two between blocks) pass the budget or its blocks ``most``.

    (document, chunk, blocks array, chars, section): the section is the last one named so far. A document's block lengths, not
    their texts, are folded in the JVM.
    """
    size = F.length(text)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.alias("s"), F.col(section).alias("h"))))
    g = blocks_.groupBy(document).agg(parts.alias("p"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("h"), F.array().cast("array<struct<chunk:int,o:bigint,s:int,h:string>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        flush = (acc["n"] > 0) & ((acc["chars"] + 2 + b["s"] > budget) | (acc["n"] >= most))
        chunk = acc["chunk"] + flush.cast("int")
        h = F.coalesce(b["h"], acc["h"])
        row = F.struct(chunk.alias("chunk"), b["o"].cast("bigint").alias("o"), b["s"].alias("s"), h.alias("h"))
        chars = F.when(flush | (acc["n"] == 0), b["s"]).otherwise(acc["chars"] + 2 + b["s"])
        return F.struct(chunk.alias("chunk"), chars.alias("chars"), F.when(flush, 1).otherwise(acc["n"] + 1).alias("n"), h.alias("h"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = g.select(document, F.explode(F.aggregate("p", start, step)["out"]).alias("r")).select(document, "r.*")
    return rows.groupBy(document, "chunk").agg(
        F.array_sort(F.collect_list("o")).alias("blocks"), (F.sum("s") + 2 * (F.count(F.lit(1)) - 1)).alias("chars"), F.max_by("h", "o").alias("section"),
    )
