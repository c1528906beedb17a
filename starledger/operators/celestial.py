"""Events of sampled positions: the moments at which a series enters another state, found between samples.

Samples are rows (group, time, value); a series may be of any length, neighbours are found in blocks. Between two samples a value moves evenly; where
it passes several limits at once, each is an event of its own. A moment that falls on a sample belongs to the step that ends there.
Samples without a finite time or value are left out; of samples at one time the one with the largest value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..scratch import Scratch
from .ordering import neighbours

#: The altitude at which the Sun's rim touches the horizon, limits of twilight, and names of states.
HORIZON = -0.8333
TWILIGHT_LIMITS = (-18.0, -12.0, -6.0, HORIZON)
TWILIGHTS = ("Night", "Astronomical twilight", "Nautical twilight", "Civil twilight", "Day")
MOON_PHASES = ("New Moon", "First Quarter", "Full Moon", "Last Quarter")
SEASONS = ("Vernal Equinox", "Summer Solstice", "Autumnal Equinox", "Winter Solstice")
ALIGNMENTS = ("conjunction", "opposition")


def _steps(samples: DataFrame, group: str, time: str, value: str, after: bool = False) -> DataFrame:
    """(group, t, v, t0, v0[, t1, v1]): each sample with the one before (and after) it."""
    t, v = F.col(time).cast("double"), F.col(value).cast("double")
    rows = samples.select(group, t.alias("t"), v.alias("v")).where(finite(t) & finite(v)).groupBy(group, "t").agg(F.max("v").alias("v"))
    made = {"t0": lambda w: F.lag("t").over(w), "v0": lambda w: F.lag("v").over(w)}
    if after:
        made |= {"t1": lambda w: F.lead("t").over(w), "v1": lambda w: F.lead("v").over(w)}
    return neighbours(rows, [group], ["t"], made, before=1, after=int(after))


def _between(level: Column, first: Column, last: Column) -> Column:
    """When a value that moves evenly reaches a level."""
    return F.col("t0") + (level - first) / (last - first) * (F.col("t") - F.col("t0"))


def crossings(samples: DataFrame, group: str, time: str, value: str, limits: tuple[float, ...], states: tuple[str, ...]) -> DataFrame:
    """(group, t, state, rising): each passage of one of the ascending limits, with the state that it leads to; a value on a limit is above it."""
    steps = _steps(samples, group, time, value).where("v0 is not null")
    names = F.array(*[F.lit(s) for s in states])
    passed = F.array(*[F.struct(F.lit(float(x)).alias("level"), F.lit(i).alias("i")) for i, x in enumerate(limits)])
    up, down = (F.col("v0") < F.col("l.level")) & (F.col("v") >= F.col("l.level")), (F.col("v0") >= F.col("l.level")) & (F.col("v") < F.col("l.level"))
    each = steps.withColumn("l", F.explode(passed)).where(up | down)
    return each.select(group, _between(F.col("l.level"), F.col("v0"), F.col("v")).alias("t"), F.get(names, F.when(up, F.col("l.i") + 1).otherwise(F.col("l.i"))).alias("state"), up.alias("rising"))


def rises_and_sets(samples: DataFrame, group: str, time: str, altitude: str, horizon: float = HORIZON) -> DataFrame:
    """(group, t, state): rise and set."""
    return crossings(samples, group, time, altitude, (horizon,), ("set", "rise")).drop("rising")


def twilights(samples: DataFrame, group: str, time: str, sun: str) -> DataFrame:
    """(group, t, state): the twilight that begins."""
    return crossings(samples, group, time, sun, TWILIGHT_LIMITS, TWILIGHTS).drop("rising")


def turns(samples: DataFrame, group: str, time: str, angle: str, states: tuple[str, ...]) -> DataFrame:
    """(group, t, state): moments at which an angle in degrees passes a multiple of 360 / len(states), forwards or backwards; a step is the shorter way round."""
    n = len(states)
    width = 360 / n
    steps = _steps(samples, group, time, angle).where("v0 is not null")
    first = F.pmod(F.col("v0"), F.lit(360.0))
    last = first + F.pmod(F.col("v") - F.col("v0") + 180, F.lit(360.0)) - 180
    steps = steps.withColumn("a", first).withColumn("b", last)
    low, high = F.floor(F.least("a", "b") / width) + 1, F.floor(F.greatest("a", "b") / width)
    # going back, the multiple that the step ends on is passed and the one it starts on isn't
    back = F.col("b") < F.col("a")
    low = F.when(back, F.ceil(F.col("b") / width)).otherwise(low)
    high = F.when(back, F.ceil(F.col("a") / width) - 1).otherwise(high)
    steps = steps.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high")
    each = steps.withColumn("m", F.explode(F.sequence("low", "high")))
    names = F.array(*[F.lit(s) for s in states])
    return each.select(group, _between(F.col("m") * width, F.col("a"), F.col("b")).alias("t"), F.get(names, F.pmod(F.col("m"), F.lit(n)).cast("int")).alias("state"))


def summits(samples: DataFrame, group: str, time: str, value: str, state: str, least: float | None = None) -> DataFrame:
    """(group, t, state, height): greatest values by the parabola through a sample and its neighbours, such as transits and greatest elongations.

    A sample counts that isn't below the one before and is above the one after; ``least`` leaves out lower summits.
    """
    rows = _steps(samples, group, time, value, after=True).where("v0 is not null and v1 is not null and v >= v0 and v > v1")
    # divided differences
    d0, d1 = (F.col("v") - F.col("v0")) / (F.col("t") - F.col("t0")), (F.col("v1") - F.col("v")) / (F.col("t1") - F.col("t"))
    curve = (d1 - d0) / (F.col("t1") - F.col("t0"))
    at = (F.col("t0") + F.col("t")) / 2 - d0 / (2 * curve)
    height = F.col("v0") + d0 * (at - F.col("t0")) + curve * (at - F.col("t0")) * (at - F.col("t"))
    out = rows.select(group, at.alias("t"), F.lit(state).alias("state"), height.alias("height"))
    return out if least is None else out.where(F.col("height") >= least)


def merged(events: dict[str, DataFrame], group: str) -> DataFrame:
    """(group, t, event, state) of all kinds of events."""
    out = None
    for kind, e in events.items():
        one = e.select(group, "t", F.lit(kind).alias("event"), "state")
        out = one if out is None else out.unionByName(one)
    return out


def earliest(events: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` events in order, and whether there are more (truncated)."""
    few = Scratch(events.sparkSession, "events").keep(events.orderBy(*order).limit(most + 1), "first")
    more = few.count() > most
    return few.orderBy(*order).limit(most).withColumn("truncated", F.lit(more))
