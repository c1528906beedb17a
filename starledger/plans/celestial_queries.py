"""Users' events as samples of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import eclipses
from ..operators import celestial
from ..scratch import table
from .catalog import query

_S = "s AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value % 40 - 20 AS altitude, value % 60 - 35 AS sun, (event_id * 37 + value) % 360 AS angle FROM events)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "CAST(event_id AS DOUBLE) AS t", "value % 40 - 20 AS altitude", "value % 60 - 35 AS sun", "(event_id * 37 + value) % 360 AS angle")


_EVENTS = f"""
    {_S}, p AS (SELECT *, lag(t) OVER w AS t0, lag(altitude) OVER w AS a0, lag(sun) OVER w AS s0, lag(angle) OVER w AS g0, lead(t) OVER w AS t1, lead(altitude) OVER w AS a1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    lim(i, level) AS (VALUES (0, -18.0::DOUBLE), (1, -12.0::DOUBLE), (2, -6.0::DOUBLE), (3, -0.8333::DOUBLE)),
    g AS (SELECT user_id, t0, t, g0 AS a, g0 + ((angle - g0 + 180) % 360 + CASE WHEN (angle - g0 + 180) % 360 < 0 THEN 360 ELSE 0 END) - 180 AS b FROM p WHERE g0 IS NOT NULL),
    m AS (SELECT *, unnest(range(CAST(CASE WHEN b < a THEN ceil(b / 90) ELSE floor(a / 90) + 1 END AS BIGINT), CAST(CASE WHEN b < a THEN ceil(a / 90) - 1 ELSE floor(b / 90) END AS BIGINT) + 1)) AS m FROM g),
    ev AS (
        SELECT user_id, t0 + (-0.8333::DOUBLE - a0) / (altitude - a0) * (t - t0) AS t, 'rise_set' AS event, CASE WHEN altitude >= a0 THEN 'rise' ELSE 'set' END AS state FROM p WHERE (a0 < -0.8333::DOUBLE) <> (altitude < -0.8333::DOUBLE) AND a0 IS NOT NULL
        UNION ALL SELECT user_id, t0 + (level - s0) / (sun - s0) * (t - t0), 'twilight', ['Night', 'Astronomical twilight', 'Nautical twilight', 'Civil twilight', 'Day'][i + CASE WHEN sun >= s0 THEN 2 ELSE 1 END] FROM p, lim WHERE (s0 < level) <> (sun < level) AND s0 IS NOT NULL
        UNION ALL SELECT user_id, t0 + (m * 90 - a) / (b - a) * (t - t0), 'phase', ['New Moon', 'First Quarter', 'Full Moon', 'Last Quarter'][(m % 4 + 4) % 4 + 1] FROM m
        UNION ALL SELECT user_id, (t0 + t) / 2 - (altitude - a0) / (t - t0) / (2 * ((a1 - altitude) / (t1 - t) - (altitude - a0) / (t - t0)) / (t1 - t0)), 'transit', 'transit' FROM p WHERE altitude >= a0 AND altitude > a1
    )
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    by = ("user_id", "t")
    return celestial.merged({
        "rise_set": celestial.rises_and_sets(s, *by, "altitude"), "twilight": celestial.twilights(s, *by, "sun"), "phase": celestial.turns(s, *by, "angle", celestial.MOON_PHASES), "transit": celestial.summits(s, *by, "altitude", "transit"),
    }, "user_id")


@query(f"WITH {_EVENTS} SELECT user_id, t, event, state FROM ev")
def celestial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risings, settings, twilights, phases and transits, between samples"""
    return _events(spark, sf_dir)


@query(f"WITH {_EVENTS} SELECT user_id, t, event, state, (SELECT count(*) > 100 FROM ev) AS truncated FROM (SELECT * FROM ev ORDER BY ev.t, user_id, event, state LIMIT 100)")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of all kinds, and whether there are more"""
    return celestial.earliest(_events(spark, sf_dir), ["t", "user_id", "event", "state"], 100)


_ECLIPSES = """
    k AS (SELECT c_custkey, 357000::DOUBLE + c_custkey % 50 * 1000 AS mx, (c_custkey % 37 - 18)::DOUBLE * 800 AS my, (c_custkey % 41 - 20)::DOUBLE * 700 AS mz, 149600000::DOUBLE AS sx, 695700::DOUBLE AS rs, 1737.4::DOUBLE AS rm, 6378.137::DOUBLE AS a, 6378.137::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS b FROM customer),
    n AS (SELECT *, sqrt((mx - sx) ** 2 + my ** 2 + mz ** 2) AS dist FROM k),
    x AS (SELECT *, (mx - sx) / dist AS ax, my / dist AS ay, mz / dist AS az, (rs + rm) / dist AS wide, (rm - rs) / dist AS narrow, dist * rm / (rs - rm) AS apex FROM n),
    c AS (SELECT *, (mx * mx + my * my) / (a * a) + mz * mz / (b * b) - 1 AS q0, (mx * ax + my * ay) / (a * a) + mz * az / (b * b) AS q1, (ax * ax + ay * ay) / (a * a) + az * az / (b * b) AS q2 FROM x),
    t AS (SELECT *, CASE WHEN q1 * q1 >= q2 * q0 THEN (-q1 - sqrt(greatest(q1 * q1 - q2 * q0, 0))) / q2 END AS t FROM c),
    r AS (
        SELECT c_custkey, a, b, rm, wide, narrow, apex, mx + rm * ux AS ox, my + rm * uy AS oy, mz + rm * uz AS oz, ax + wide * ux AS px, ay + wide * uy AS py, az + wide * uz AS pz, ax + narrow * ux AS nx, ay + narrow * uy AS ny, az + narrow * uz AS nz FROM (
            SELECT *, ay / f * cos(g) + az * ax / f * sin(g) AS ux, -ax / f * cos(g) + az * ay / f * sin(g) AS uy, (-ax * ax / f - ay * ay / f) * sin(g) AS uz FROM (SELECT *, sqrt(ax * ax + ay * ay) AS f, i * (2 * pi() / 72) AS g FROM x, (SELECT unnest(range(72)) AS i)))
    ), q AS (
        SELECT *, (ox * ox + oy * oy) / (a * a) + oz * oz / (b * b) - 1 AS q0, (ox * px + oy * py) / (a * a) + oz * pz / (b * b) AS p1, (px * px + py * py) / (a * a) + pz * pz / (b * b) AS p2, (ox * nx + oy * ny) / (a * a) + oz * nz / (b * b) AS n1, (nx * nx + ny * ny) / (a * a) + nz * nz / (b * b) AS n2 FROM r
    ), e AS (
        SELECT c_custkey, count_if(p1 * p1 >= p2 * q0) AS penumbra_points, count_if(n1 * n1 >= n2 * q0 AND (-n1 - sqrt(greatest(n1 * n1 - n2 * q0, 0))) / n2 <= apex AND rm + narrow * (-n1 - sqrt(greatest(n1 * n1 - n2 * q0, 0))) / n2 > 0.000001) AS umbra_points FROM q GROUP BY 1
    ), o AS (
        SELECT c_custkey, t, rm + wide * t AS penumbra, rm + narrow * t AS umbra, mx + ax * t AS x, my + ay * t AS y, mz + az * t AS z, a, b, ((mx + ax * apex) ** 2 + (my + ay * apex) ** 2) / (a * a) + (mz + az * apex) ** 2 / (b * b) < 1 AS inside FROM t
    )
"""


@query(f"""
    WITH {_ECLIPSES} SELECT c_custkey, CASE WHEN t IS NULL THEN CASE WHEN penumbra_points > 0 THEN 'partial' ELSE 'none' END WHEN inside THEN 'hybrid' WHEN umbra > 0.000001 THEN 'total' ELSE 'annular' END AS kind,
        round(degrees(atan2(z, sqrt(x * x + y * y) * (b / a) ** 2)), 6) AS latitude, round(degrees(atan2(y, x)), 6) AS longitude, round(penumbra, 4) AS penumbra, round(umbra, 4) AS umbra, CAST(penumbra_points AS INTEGER) AS penumbra_points, CAST(umbra_points AS INTEGER) AS umbra_points
    FROM o JOIN e USING (c_custkey)
""")
def eclipse_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as positions of the Moon: every kind of eclipse occurs"""
    k = F.col("c_custkey")
    where = table(spark, sf_dir, "customer").select(
        k, eclipses.vector(F.lit(149_600_000.0), F.lit(0.0), F.lit(0.0)).alias("sun"), eclipses.vector(k % 50 * 1000 + 357_000.0, (k % 37 - 18) * 800.0, (k % 41 - 20) * 700.0).alias("moon"),
    )
    got = eclipses.eclipses(where)
    return got.select(k, "kind", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude")], *[F.round(c, 4).alias(c) for c in ("penumbra", "umbra")], F.size("penumbra_edge").alias("penumbra_points"), F.size("umbra_edge").alias("umbra_points"))
