"""Predicates and arithmetic on numbers, decimals, units and sky positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """a number that is neither null, NaN nor infinite."""
    x = c.cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def missing(c: Column) -> Column:
    """null or blank; 0 and false are present."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"^\s+$", "") == "", F.lit(True))


def complete(columns: list[str]) -> Column:
    """every feature is finite."""
    return reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])


def strict(columns: list[str], row: str) -> list[Column]:
    """the columns as doubles; the first row with a feature that isn't finite stops the query and is named."""
    def one(c: str) -> Column:
        return F.when(finite(F.col(c)), F.col(c).cast("double")).otherwise(
            F.raise_error(F.concat(F.lit(f"feature {c} is not a finite number in row "), F.coalesce(F.col(row).cast("string"), F.lit("null")))).cast("double")
        ).alias(c)

    return [one(c) for c in columns]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


# --- decimals and units ---------------------------------------------------------------------------------

#: Text of a decimal: bounds on its length, digits and exponent.
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,4})?$"


def decimal(c: Column, scale: int = 10) -> Column:
    """Text or number to decimal(38, scale); null where it isn't one or has no room. -0 is 0."""
    text = F.trim(c.cast("string"))
    d = F.when(F.length(text) <= 128, F.when(text.rlike(_DECIMAL), text)).try_cast(f"decimal(38,{scale})")
    return F.when(d == 0, F.lit(0).cast(f"decimal(38,{scale})")).otherwise(d)


def plain(d: Column) -> Column:
    """No exponent, no trailing zeros, 0 for zero."""
    text = d.cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(d == 0, F.lit("0")).when(text.contains("."), short).otherwise(text)


def convert(rows: DataFrame, rules: DataFrame, value: str = "value", unit: str = "unit", target: str = "target_unit", kind: str = "quantity_kind", digits: int = 10) -> DataFrame:
    """Multiply by the catalog's factor where units and quantity kind agree with a rule.

    ``rules`` (from_unit, to_unit, kind, factor decimal) is a catalog of a fixed, small number of rows. Adds
    ``converted`` (decimal, half to even) and ``conversion``: identity, converted or no_rule.
    """
    r = F.broadcast(rules.select(F.col("from_unit").alias(unit), F.col("to_unit").alias(target), F.col("kind").alias(kind), "factor"))
    out = rows.join(r, [unit, target, kind], "left")
    v = F.col(value).cast("decimal(18,6)")
    same = F.col(unit) == F.col(target)
    return out.withColumn("converted", F.when(same, v.cast(f"decimal(38,{digits})")).otherwise(F.bround(v * F.col("factor").cast("decimal(18,11)"), digits).cast(f"decimal(38,{digits})"))).withColumn(
        "conversion", F.when(same, "identity").when(F.col("factor").isNotNull(), "converted").otherwise("no_rule")
    ).drop("factor")


def canonical(c: Column, data_type: Column, scale: int = 10) -> Column:
    """Text of a value by its declared type: trimmed string, plain number, or an integer without a fraction; null if it isn't one."""
    d = decimal(c, scale)
    return F.when(data_type == "string", F.nullif(F.trim(c.cast("string")), F.lit(""))).when(data_type == "number", plain(d)).when((data_type == "integer") & (d == F.floor(d)), plain(d))


def uncertainty(plus: Column, minus: Column) -> Column:
    """How much of a value's uncertainty is given."""
    n = plus.isNotNull().cast("int") + minus.isNotNull().cast("int")
    return F.when(n == 2, "complete").when(n == 1, "partial").otherwise("missing")


def limit(value: Column, flag: Column, codes: dict[int, str]) -> Column:
    """Measured, lower or upper by the manifest's codes; a flag without a value, or the reverse, is an error."""
    named = reduce(lambda w, kv: w.when(flag == kv[0], kv[1]), codes.items(), F.when(F.lit(False), ""))
    return F.when(value.isNull() & flag.isNull(), F.lit(None).cast("string")).when(
        value.isNull() | flag.isNull(), F.raise_error(F.lit("a limit flag and its value must come together")).cast("string")
    ).otherwise(F.coalesce(named, F.raise_error(F.concat(F.lit("unknown limit code "), flag.cast("string"))).cast("string")))


# --- sky positions --------------------------------------------------------------------------------------

#: Tolerances of an inclusive separation threshold.
REL_TOL, ABS_TOL = 1e-12, 1e-7


def right_ascension(ra: Column) -> Column:
    """[0, 360] degrees, 360 becoming 0; anything else is an error."""
    return F.when((ra < 0) | (ra > 360), F.raise_error(F.lit("right ascension is outside 0 to 360")).cast("double")).when(ra == 360, 0.0).otherwise(ra)


def declination(dec: Column) -> Column:
    return F.when((dec < -90) | (dec > 90), F.raise_error(F.lit("declination is outside -90 to 90")).cast("double")).otherwise(dec)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in arc seconds by the haversine."""
    d_ra, d_dec = F.radians(ra2 - ra1), F.radians(dec2 - dec1)
    h = F.pow(F.sin(d_dec / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(d_ra / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))) * 3600


def within(distance: Column, threshold: float) -> Column:
    """Inclusive, with a tolerance for rounding."""
    slack = F.greatest(F.lit(ABS_TOL), F.lit(REL_TOL) * F.greatest(F.abs(distance), F.lit(abs(threshold))))
    return (distance <= threshold) | (F.abs(distance - threshold) <= slack)


def band(confidence: Column, conflict: Column) -> Column:
    """Name of a confidence."""
    return F.when(conflict, "not_applicable").when(confidence >= 0.95, "high").when(confidence >= 0.70, "medium").otherwise("low")


SPEED_OF_LIGHT_KM_S = 299792.458


def doppler(observed: Column, rest: Column) -> Column:
    """Velocity in km/s."""
    return SPEED_OF_LIGHT_KM_S * (observed / rest - 1)


def apparent_radius(radius: Column, distance: Column) -> Column:
    """Degrees; null where the body would enclose the observer."""
    return F.when((distance > 0) & (radius <= distance), F.degrees(F.asin(radius / distance)))


def page_box(box: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """A pixel box (x0, y0, x1, y1, from the top) in page coordinates (from the bottom)."""
    sx, sy = page_width / width, page_height / height
    return F.struct((box["x0"] * sx).alias("x0"), (page_height - box["y1"] * sy).alias("y0"), (box["x1"] * sx).alias("x1"), (page_height - box["y0"] * sy).alias("y1"))


# --- shadows --------------------------------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def shadow(sun: Column, moon: Column, sun_radius: float, moon_radius: float) -> Column:
    """Axis and half angles of umbra and penumbra for positions (x, y, z) in km from the Earth's centre."""
    d = F.struct(*[(moon[k] - sun[k]).alias(k) for k in "xyz"])
    length = F.sqrt(_dot(d, d))
    axis = F.struct(*[((moon[k] - sun[k]) / length).alias(k) for k in "xyz"])
    return F.struct(
        axis.alias("axis"), length.alias("distance"), F.asin((F.lit(sun_radius) - moon_radius) / length).alias("umbra"), F.asin((F.lit(sun_radius) + moon_radius) / length).alias("penumbra"),
    )


def on_ellipsoid(origin: Column, axis: Column, equatorial: float = 6378.137, flattening: float = 1 / 298.257223563) -> Column:
    """Where a line first meets the Earth: (latitude, longitude) in degrees, geodetic; null if it misses."""
    squash = 1 - flattening
    o = F.struct((origin["x"] / equatorial).alias("x"), (origin["y"] / equatorial).alias("y"), (origin["z"] / (equatorial * squash)).alias("z"))
    a = F.struct((axis["x"] / equatorial).alias("x"), (axis["y"] / equatorial).alias("y"), (axis["z"] / (equatorial * squash)).alias("z"))
    qa, qb, qc = _dot(a, a), _dot(o, a), _dot(o, o) - 1
    disc = qb * qb - qa * qc
    t = (-qb - F.sqrt(disc)) / qa
    x, y, z = (origin[k] + t * axis[k] for k in "xyz")
    lat = F.degrees(F.atan2(z, F.sqrt(x * x + y * y) * squash * squash))
    return F.when((disc >= 0) & (t >= 0), F.struct(lat.alias("latitude"), F.degrees(F.atan2(y, x)).alias("longitude")))
