"""Images of pairs of stars, one pair for each event, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import photometry
from ..scratch import Scratch, table
from ..sources import images
from .catalog import query

_FWHM = 2.5
_SIGMA = _FWHM * photometry.PER_FWHM
#: Places of the two stars in an event's stamp of 10 x 10 pixels.
_A, _B = (4.2, 4.1), (6.4, 5.3)


def _light(star: tuple[float, float], x: str = "i", y: str = "j") -> str:
    s = f"CAST({2 * _SIGMA * _SIGMA!r} AS DOUBLE)"
    return f"exp(-(({x} - CAST({star[0]} AS DOUBLE)) * ({x} - CAST({star[0]} AS DOUBLE)) + ({y} - CAST({star[1]} AS DOUBLE)) * ({y} - CAST({star[1]} AS DOUBLE))) / {s}) / (pi() * {s})"


#: A pixel's light over a level of 10, with noise that repeats.
_VALUE = f"10 + ((i * 7 + j * 13 + event_id) % 11 - 5) / CAST(10 AS DOUBLE) + (100 + value) * {_light(_A)} + (80 + value / 2) * {_light(_B)}"
_P = f"""
    s AS (SELECT event_id, value, event_id // 400 AS image, event_id % 400 % 20 * 10 AS ox, event_id % 400 // 20 * 10 AS oy FROM events),
    p AS (SELECT event_id, image, i, j, ox + i AS x, oy + j AS y, {_VALUE} AS v FROM s, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(10)) AS j))
"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value", "event_id div 400 AS image", "event_id % 400 % 20 * 10 AS ox", "event_id % 400 div 20 * 10 AS oy")
    cells = e.selectExpr("*", "explode(sequence(0, 9)) AS i").selectExpr("*", "explode(sequence(0, 9)) AS j")
    return cells.selectExpr("image", "ox + i AS x", "oy + j AS y", f"{_VALUE} AS v")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id div 400 AS image", "event_id % 400 % 20 * 10 AS ox", "event_id % 400 div 20 * 10 AS oy")
    pair = ", ".join(f"struct(2 * event_id + {k} AS star, ox + CAST({s[0]} AS DOUBLE) AS cx, oy + CAST({s[1]} AS DOUBLE) AS cy)" for k, s in enumerate((_A, _B)))
    return e.selectExpr("image", f"inline(array({pair}))")


def _in_box(star: tuple[float, float]) -> str:
    return f"i BETWEEN {round(star[0]) - 2} AND {round(star[0]) + 2} AND j BETWEEN {round(star[1]) - 2} AND {round(star[1]) + 2}"


@query(f"""
    WITH {_P}, w AS (SELECT *, v - 10 AS u, CASE WHEN {_in_box(_A)} THEN {_light(_A)} ELSE 0 END AS a, CASE WHEN {_in_box(_B)} THEN {_light(_B)} ELSE 0 END AS b FROM p),
    n AS (SELECT image, event_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * u) AS au, sum(b * u) AS bu FROM w GROUP BY ALL),
    f AS (SELECT image, event_id, (au * bb - bu * ab) / (aa * bb - ab * ab) AS fa, (bu * aa - au * ab) / (aa * bb - ab * ab) AS fb FROM n),
    r AS (SELECT image, event_id, fa, fb, sqrt(sum(CASE WHEN a > 0 THEN (u - fa * a - fb * b) ** 2 END) / 25) AS ra, sqrt(sum(CASE WHEN b > 0 THEN (u - fa * a - fb * b) ** 2 END) / 25) AS rb FROM w JOIN f USING (image, event_id) GROUP BY ALL)
    SELECT image, 2 * event_id AS star, round(fa, 5) AS flux, round(ra, 5) AS residual, CAST(25 AS BIGINT) AS pixels FROM r UNION ALL SELECT image, 2 * event_id + 1, round(fb, 5), round(rb, 5), 25 FROM r
""")
def star_fluxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping stars at known places, fitted together"""
    got = photometry.fit(_pixels(spark, sf_dir), _stars(spark, sf_dir), "image", _FWHM, 10.0, moves=0, integrated=False, wings=0)
    return got.select("image", "star", F.round("flux", 5).alias("flux"), F.round("residual", 5).alias("residual"), "pixels")


_S2 = f"CAST({2 * _SIGMA * _SIGMA!r} AS DOUBLE)"


@query(f"""
    WITH {_P}, o AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / {_S2}) AS g FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx * dx + dy * dy <= 4),
    t AS (SELECT count(*) AS n, sum(g) AS s, sum(g * g) AS q, sum((2 * dx / {_S2} * g) ** 2) AS d FROM o),
    k AS (SELECT dx, dy, g, (g - s / n) / (q - s * s / n) AS w, d FROM o, t),
    h AS (
        SELECT p.image, p.x - dx AS x, p.y - dy AS y, sum(w * (v - 10)) AS height, sum(CASE WHEN dx = 0 AND dy = 0 THEN v - 10 END) AS mid, sum(CASE WHEN dx <> 0 OR dy <> 0 THEN v - 10 ELSE 0 END) / 12 AS around,
            sum(2 * dx / {_S2} * g * (v - 10)) / any_value(d) AS mx, sum(2 * dy / {_S2} * g * (v - 10)) / any_value(d) AS my
        FROM p, k GROUP BY ALL
    ), bright AS (SELECT * FROM h WHERE height > 3),
    lower AS (SELECT DISTINCT b.image, b.x, b.y FROM bright b, o JOIN bright c ON c.image = b.image AND c.x = b.x + dx AND c.y = b.y + dy WHERE (dx <> 0 OR dy <> 0) AND (c.height > b.height OR (c.height = b.height AND (dy < 0 OR dy = 0 AND dx < 0))))
    SELECT image, x, y, round(height, 6) AS height, round((mid - around) / height, 6) AS sharpness, round(x + greatest(-0.5, least(0.5, mx / height)), 6) AS cx, round(y + greatest(-0.5, least(0.5, my / height)), 6) AS cy
    FROM bright ANTI JOIN lower USING (image, x, y) WHERE (mid - around) / height BETWEEN 0.2 AND 1
""")
def star_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars found by the matched filter, whatever tile they lie in"""
    got = photometry.detect(_pixels(spark, sf_dir), "image", _FWHM, 3.0, 10.0)
    return got.select("image", "x", "y", *[F.round(c, 6).alias(c) for c in ("height", "sharpness", "cx", "cy")])


_CLIP = "p AS (SELECT image, v FROM p0)" + "".join(f"""
    , m{i} AS (SELECT image, median(v) AS center FROM {'p' if i == 0 else f'p{i}k'} GROUP BY image), d{i} AS (SELECT image, any_value(center) AS center, median(abs(v - center)) * 1.4826022185056018::DOUBLE AS scale FROM {'p' if i == 0 else f'p{i}k'} JOIN m{i} USING (image) GROUP BY image)
    , p{i + 1}k AS (SELECT image, v FROM {'p' if i == 0 else f'p{i}k'} JOIN d{i} USING (image) WHERE scale = 0 OR abs(v - center) <= 3 * scale)""" for i in range(3))
_BACKGROUND = _P.replace("    p AS (", "    p0 AS (") + ", " + _CLIP


@query(f"WITH {_BACKGROUND} SELECT image, round(center, 6) AS center, round(scale, 6) AS scale FROM d2")
def star_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and noise of images, clipped three times"""
    got = images.background(_pixels(spark, sf_dir), "image")
    return got.select("image", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


@query(f"WITH {_P} SELECT image, round(sum(greatest(v - 10, 0) * x) / sum(greatest(v - 10, 0)), 6) AS cx, round(sum(greatest(v - 10, 0) * y) / sum(greatest(v - 10, 0)), 6) AS cy, round(sum(greatest(v - 10, 0)), 4) AS light FROM p GROUP BY image")
def star_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T22"""
    got = images.centroid(_pixels(spark, sf_dir).withColumn("v", F.col("v") - 10), "image")
    return got.select("image", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("light", 4).alias("light"))


@query(f"""
    WITH {_P}, t AS (SELECT image, 2 * event_id AS star, ox + CAST({_A[0]} AS DOUBLE) AS cx, oy + CAST({_A[1]} AS DOUBLE) AS cy FROM s UNION ALL SELECT image, 2 * event_id + 1, ox + CAST({_B[0]} AS DOUBLE), oy + CAST({_B[1]} AS DOUBLE) FROM s),
    n AS (SELECT t.*, CAST(floor(cx) AS BIGINT) + dx AS x, CAST(floor(cy) AS BIGINT) + dy AS y FROM t, (SELECT unnest(range(-5, 7)) AS dx), (SELECT unnest(range(-5, 7)) AS dy)),
    r AS (SELECT star, n.image, v, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM n JOIN p USING (image, x, y))
    SELECT image, star, round(sum(CASE WHEN r <= 3 THEN v END) - count_if(r <= 3) * avg(CASE WHEN r BETWEEN 4 AND 5 THEN v END), 5) AS flux, CAST(count_if(r <= 3) AS BIGINT) AS n FROM r GROUP BY ALL
""")
def star_apertures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light in circles less the mean of rings"""
    stars = _stars(spark, sf_dir).withColumnRenamed("star", "source")
    got = images.aperture(_pixels(spark, sf_dir), stars, "image", 3.0, 4.0, 5.0)
    return got.select("image", F.col("source").alias("star"), F.round("flux", 5).alias("flux"), "n")


@query(f"""
    WITH {_BACKGROUND}, lit AS (SELECT image, event_id, v - center AS net FROM p0 JOIN d2 USING (image) WHERE v > center + 5 * scale)
    SELECT image, CAST(count(*) AS BIGINT) AS pixels, round(sum(net), 4) AS flux, count(DISTINCT event_id) AS stamps FROM lit GROUP BY image
""")
def star_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected bright pixels, summed for each image; no segment crosses a stamp"""
    scratch = Scratch(spark, "star-segments")
    got = scratch.keep(images.segments(_pixels(spark, sf_dir), "image", 5.0, least=1), "found")
    stamp = F.struct(F.floor(F.col("cx") / 10), F.floor(F.col("cy") / 10))
    return got.groupBy("image").agg(F.sum("pixels").alias("pixels"), F.round(F.sum("flux"), 4).alias("flux"), F.countDistinct(stamp).alias("stamps"))
