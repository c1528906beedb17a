"""Hypothesis tests: moments and rank sums as aggregates over all rows, the p-value of the one row that is left in an Arrow batch."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_tail, p_of, p_value
from ..functions.numbers import finite
from ..scratch import Scratch
from .ordering import running_totals
from .profile import long_numbers

_ENVELOPE = ("test", "n", "statistic", "p_value", "effect_name", "effect")


def _envelope(df: DataFrame, test: str, n: Column, statistic: Column, p: Column, effect_name: str, effect: Column) -> DataFrame:
    return df.select(F.lit(test).alias("test"), n.cast("long").alias("n"), statistic.alias("statistic"), p.alias("p_value"), F.lit(effect_name).alias("effect_name"), effect.alias("effect"))


def decided(tests: list[DataFrame], alpha: float = 0.05) -> DataFrame:
    """Up to 32 tests, numbered; reject_null where p is below alpha; a statistic or p that isn't finite is an error."""
    if not 0 < alpha < 1 or not 1 <= len(tests) <= 32:
        raise ValueError("alpha must lie between 0 and 1, and there must be 1 to 32 tests")
    out = None
    for i, t in enumerate(tests, 1):
        row = t.select(F.lit(f"hypothesis.{i}").alias("test_id"), *_ENVELOPE)
        out = row if out is None else out.unionByName(row)
    bad = ~finite(F.col("statistic")) | ~finite(F.col("p_value"))
    p = F.when(bad, F.raise_error(F.concat(F.col("test_id"), F.lit(" has no finite result"))).cast("double")).otherwise(F.col("p_value"))
    return out.withColumn("p_value", p).withColumn("reject_null", F.col("p_value") < alpha)


def t_one(df: DataFrame, field: str, mean: float) -> DataFrame:
    """One-sample t and Cohen's d (0 where the values don't vary)."""
    m = long_numbers(df, [field]).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    n, diff, sd = F.col("n"), F.col("m") - mean, F.col("sd")
    t = F.try_divide(diff, sd / F.sqrt("n"))
    return _envelope(m, "one_sample_t", n, t, p_of("t", t, n - 1), "cohens_d", F.coalesce(F.try_divide(diff, sd), F.lit(0.0)))


def t_paired(df: DataFrame, left: str, right: str) -> DataFrame:
    """One-sample t of the differences of complete pairs."""
    pairs = df.where(finite(F.col(left)) & finite(F.col(right))).select((F.col(left).cast("double") - F.col(right).cast("double")).alias("difference"))
    return t_one(pairs, "difference", 0.0).withColumn("test", F.lit("paired_t"))


def _two(df: DataFrame, left: str, right: str) -> DataFrame:
    x, y = F.when(finite(F.col(left)), F.col(left).cast("double")), F.when(finite(F.col(right)), F.col(right).cast("double"))
    return df.agg(*[f(c).alias(f"{name}{i}") for i, c in ((1, x), (2, y)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])


def t_welch(df: DataFrame, left: str, right: str) -> DataFrame:
    """A10: two samples of unequal variance; Cohen's d with the pooled deviation."""
    m = _two(df, left, right)
    n1, n2, v1, v2, diff = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2"), F.col("m1") - F.col("m2")
    e1, e2 = v1 / n1, v2 / n2
    t = F.try_divide(diff, F.sqrt(e1 + e2))
    dof = F.try_divide((e1 + e2) ** 2, e1**2 / (n1 - 1) + e2**2 / (n2 - 1))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return _envelope(m, "welch_t", n1 + n2, t, p_of("t", t, dof), "cohens_d", F.coalesce(F.try_divide(diff, pooled), F.lit(0.0)))


def anova(df: DataFrame, fields: list[str]) -> DataFrame:
    """2 to 32 fields as groups; eta squared."""
    if not 2 <= len(fields) <= 32:
        raise ValueError("analysis of variance takes 2 to 32 fields")
    groups = long_numbers(df, fields).groupBy("field").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n = F.col("n")
    s = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(n * F.col("m")).alias("s"), F.sum(n * F.col("m") ** 2).alias("ss"), F.sum(n * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") ** 2 / F.col("n")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(between / d1, F.col("within") / d2)
    return _envelope(s, "one_way_anova", F.col("n"), f, p_of("f", f, d1, d2), "eta_squared", F.coalesce(F.try_divide(between, between + F.col("within")), F.lit(0.0)))


def chi_square(df: DataFrame, left: str, right: str) -> DataFrame:
    """Independence of two categories of 2 to 64 values; 2 by 2 with Yates' correction; Cramer's V; cells expected below 5 are flagged."""
    cells = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    # marginals of at most 64 categories each are checked before their product is formed
    size = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n")).crossJoin(cols.agg(F.count(F.lit(1)).alias("c")))
    ok = F.col("r").between(2, 64) & F.col("c").between(2, 64)
    size = size.withColumn("r", F.when(ok, F.col("r")).otherwise(F.raise_error(F.lit("each side must have 2 to 64 categories")).cast("long")))
    # one more than allowed, so that no task ever lists a column of many values
    few, fewer = rows.limit(65), cols.limit(65)
    listed = size.crossJoin(few.agg(F.collect_list(F.struct("a", "ra")).alias("rows"))).crossJoin(fewer.agg(F.collect_list(F.struct("b", "cb")).alias("cols")))
    grid = listed.where("r between 2 and 64").select("r", "c", "n", F.explode("rows").alias("x"), "cols").select("r", "c", "n", "x.*", F.explode("cols").alias("y")).select("r", "c", "n", "a", "ra", "y.*")
    full = grid.join(cells, ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0))).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    gap = F.abs(F.col("o") - F.col("e"))
    yates = F.when((F.col("r") == 2) & (F.col("c") == 2), F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))).otherwise(gap)
    s = full.groupBy("r", "c", "n").agg(F.sum(yates**2 / F.col("e")).alias("chi2"), F.sum((F.col("e") < 5).cast("long")).alias("low_expected"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    v = F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1)))
    return s.select(
        F.lit("chi_square").alias("test"), "n", F.col("chi2").alias("statistic"), p_of("chi2", F.col("chi2"), dof).alias("p_value"), F.lit("cramers_v").alias("effect_name"), v.alias("effect"),
        dof.cast("long").alias("dof"), (F.col("low_expected") > 0).alias("low_expected_cells"),
    )


def mann_whitney(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two-sided U, rank-biserial r = 1 - 2 U / (n1 n2); exact where the smaller side has at most 8 values, the larger 100,000 (all that the reference takes), and none tie, else normal with corrections for ties and continuity."""
    scratch = Scratch(df.sparkSession, "ranks")
    freq = long_numbers(df, [left, right]).groupBy("value").agg(F.sum((F.col("field") == left).cast("long")).alias("k1"), F.count(F.lit(1)).alias("n"))
    ranked = running_totals(freq.withColumn("all", F.lit(0)), ["all"], ["value"], "n", scratch)
    rank, n = F.col("before") + (F.col("n") + 1) / 2, F.col("n").cast("double")
    s = ranked.agg(F.sum("k1").alias("n1"), F.sum("n").alias("both"), F.sum(F.col("k1") * rank).alias("r1"), F.sum(n**3 - n).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), (F.col("both") - F.col("n1")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    total = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    exact = (F.least(n1, n2) <= 8) & (F.greatest(n1, n2) <= 100_000) & (F.col("ties") == 0)
    kind = F.when(exact, "u").otherwise("upper_z")
    raw = p_value(kind, F.when(exact, u).otherwise(z), n1, n2)
    p = F.least(F.lit(1.0), F.when(exact, raw).otherwise(2 * raw))
    return _envelope(s, "mann_whitney_u", F.col("both"), u, p, "rank_biserial", 1 - 2 * u / (n1 * n2))


#: Coefficients of Royston's 1995 approximation (algorithm AS R94).
_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p of 3 to 5000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        mm, u = m @ m, 1 / math.sqrt(n)
        last = _poly(_C1, u) + m[-1] / math.sqrt(mm)
        a = np.empty(n)
        if n > 5:
            second = _poly(_C2, u) + m[-2] / math.sqrt(mm)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    spread = ((x - x.mean()) ** 2).sum()
    if spread == 0:
        return 1.0, 1.0
    w = min(1.0, float((a @ x) ** 2 / spread))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = 0.459 * n - 2.273
        y, mu, sd = -math.log(g - math.log1p(-w)), _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_SD, n))
    else:
        y, mu, sd = math.log1p(-w) if w < 1 else -50.0, _poly(_LARGE_MEAN, math.log(n)), math.exp(_poly(_LARGE_SD, math.log(n)))
    return w, normal_tail((y - mu) / sd)


def shapiro_wilk(df: DataFrame, field: str) -> DataFrame:
    """Normality of 3 to 5000 values; other numbers are an error, checked before the values meet in one task."""
    values = long_numbers(df, [field])
    n = values.count()
    if not 3 <= n <= 5000:
        raise ValueError("Shapiro-Wilk takes 3 to 5000 values")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        w, pv = shapiro(p["value"].to_numpy())
        return pd.DataFrame({"n": [len(p)], "w": [w], "p": [pv]})

    s = values.groupBy("field").applyInPandas(run, "n long, w double, p double")
    return _envelope(s, "shapiro_wilk", F.col("n"), F.col("w"), F.col("p"), "w", F.col("w"))
