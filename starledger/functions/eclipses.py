"""Solar eclipses from positions: the Moon's shadow cones against the Earth's ellipsoid. Lengths are in kilometres from the Earth's centre.

Lines meet the ellipsoid in a space in which it is the unit sphere. A cone's edge is sampled by rays around its axis, as array expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Radii of the Sun and the Moon, and the WGS-84 ellipsoid.
SUN_RADIUS, MOON_RADIUS = 695_700.0, 1737.4
EQUATORIAL, POLAR = 6378.137, 6378.137 * (1 - 1 / 298.257223563)
KINDS = ("none", "partial", "annular", "total", "hybrid")
#: Shadow radii below this are nothing.
_LEAST = 1e-6


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _along(start: Column, step: Column, times: Column | float) -> Column:
    t = times if isinstance(times, Column) else F.lit(times)
    return vector(*[start[k] + step[k] * t for k in "xyz"])


def _unit_space(v: Column) -> Column:
    return vector(v["x"] / EQUATORIAL, v["y"] / EQUATORIAL, v["z"] / POLAR)


def first_meeting(origin: Column, direction: Column) -> Column:
    """How many steps of ``direction`` from ``origin`` on a line meets the Earth first, never backwards; null if it misses."""
    o, d = _unit_space(origin), _unit_space(direction)
    a, b, c = _dot(d, d), _dot(o, d), _dot(o, o) - 1
    root = F.sqrt(b * b - a * c)
    near, far = (-b - root) / a, (-b + root) / a
    return F.when(b * b - a * c >= 0, F.when(near >= 0, near).when(far >= 0, far))


def latitude(p: Column) -> Column:
    """Geodetic latitude in degrees of a point on the ellipsoid."""
    return F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"]) * ((POLAR / EQUATORIAL) ** 2)))


def longitude(p: Column) -> Column:
    return F.degrees(F.atan2(p["y"], p["x"]))


def _edge(samples: int, slope: Column, last: Column | None) -> Column:
    """Array of the points (latitude, longitude, distance, radius) where the rays of a cone's edge meet the Earth, ray by ray; rays that miss are absent."""

    def ray(i: Column) -> Column:
        angle = i * (2 * math.pi / samples)
        across = vector(*[F.col("across")[k] * F.cos(angle) + F.col("up")[k] * F.sin(angle) for k in "xyz"])
        origin, direction = _along(F.col("moon"), across, MOON_RADIUS), _along(F.col("axis"), across, slope)
        return F.struct(origin.alias("o"), direction.alias("d"))

    rays = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), ray)
    met = F.transform(rays, lambda r: F.struct(r["o"].alias("o"), r["d"].alias("d"), first_meeting(r["o"], r["d"]).alias("t")))
    ok = lambda r: r["t"].isNotNull() & (F.lit(MOON_RADIUS) + slope * r["t"] > _LEAST) & (F.lit(True) if last is None else r["t"] <= last)

    def point(r: Column) -> Column:
        p = _along(r["o"], r["d"], r["t"])
        return F.struct(latitude(p).alias("latitude"), longitude(p).alias("longitude"), r["t"].alias("distance"), (F.lit(MOON_RADIUS) + slope * r["t"]).alias("radius"))

    return F.transform(F.filter(met, ok), point)


def eclipses(positions: DataFrame, sun: str = "sun", moon: str = "moon", samples: int = 72) -> DataFrame:
    """Add kind, latitude, longitude, penumbra, umbra, apex_inside, penumbra_edge and umbra_edge to rows of positions (x, y, z).

    The axis runs from the Sun through the Moon. Where it meets the Earth the radii are those of the cones there (a negative umbra is beyond its
    apex): total with an umbra, annular without, hybrid if the umbra's apex lies inside the Earth. Where it misses, an eclipse is
    partial if a ray of the penumbra's edge meets the Earth, and latitude, longitude and radii are null. Null positions give nulls.
    """
    kept = [c for c in positions.columns if c not in (sun, moon)]
    d = positions.select(*kept, F.col(sun).alias("sun"), F.col(moon).alias("moon"))
    d = d.withColumn("apart", vector(*[F.col("moon")[k] - F.col("sun")[k] for k in "xyz"])).withColumn("distance", F.sqrt(_dot(F.col("apart"), F.col("apart"))))
    d = d.withColumn("axis", vector(*[F.col("apart")[k] / F.col("distance") for k in "xyz"]))
    d = d.withColumn("wide", F.lit(SUN_RADIUS + MOON_RADIUS) / F.col("distance")).withColumn("narrow", F.lit(MOON_RADIUS - SUN_RADIUS) / F.col("distance")).withColumn("apex", F.col("distance") * (MOON_RADIUS / (SUN_RADIUS - MOON_RADIUS)))
    # two directions across the axis; along the pole any will do
    a, flat = F.col("axis"), F.hypot(F.col("axis")["x"], F.col("axis")["y"])
    d = d.withColumn("across", F.when(flat > 1e-12, vector(a["y"] / flat, -a["x"] / flat, F.lit(0.0))).otherwise(vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    c = F.col("across")
    d = d.withColumn("up", vector(a["y"] * c["z"] - a["z"] * c["y"], a["z"] * c["x"] - a["x"] * c["z"], a["x"] * c["y"] - a["y"] * c["x"]))
    d = d.withColumn("t", first_meeting(F.col("moon"), a)).withColumn("point", F.when(F.col("t").isNotNull(), _along(F.col("moon"), a, F.col("t"))))
    tip = _unit_space(_along(F.col("moon"), a, F.col("apex")))
    d = d.withColumn("apex_inside", _dot(tip, tip) < 1).withColumn("penumbra_edge", _edge(samples, F.col("wide"), None)).withColumn("umbra_edge", _edge(samples, F.col("narrow"), F.col("apex")))
    penumbra, umbra = F.lit(MOON_RADIUS) + F.col("wide") * F.col("t"), F.lit(MOON_RADIUS) + F.col("narrow") * F.col("t")
    central = F.when(penumbra <= _LEAST, "none").when(F.col("apex_inside"), "hybrid").when(umbra > _LEAST, "total").otherwise("annular")
    kind = F.when(F.col("distance").isNull(), None).when(F.col("t").isNotNull(), central).when(F.size("penumbra_edge") > 0, "partial").otherwise("none")
    return d.select(
        *kept, kind.alias("kind"), latitude(F.col("point")).alias("latitude"), longitude(F.col("point")).alias("longitude"), penumbra.alias("penumbra"), umbra.alias("umbra"), "apex_inside", "penumbra_edge", "umbra_edge",
    )
