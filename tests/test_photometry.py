"""Stars found and measured on small images, whatever tiles they lie in, against dense least squares and the light that was put in."""

import math

import numpy as np
import pytest

from starledger.operators import photometry as P

SIGMA = 3.0 * P.PER_FWHM


def collected(x, y, cx, cy, flux):
    one = lambda d: (math.erf((d + 0.5) / (SIGMA * math.sqrt(2))) - math.erf((d - 0.5) / (SIGMA * math.sqrt(2)))) / 2
    return flux * one(x - cx) * one(y - cy)


STARS = [("a", 10.3, 12.2, 500.0), ("b", 14.3, 12.9, 300.0), ("c", 31.6, 30.4, 800.0), ("d", 32.0, 5.0, 200.0), ("e", 47.7, 40.0, 350.0)]


def image(noise=0.0, level=20.0, n=56):
    rng = np.random.default_rng(1)
    rows = []
    for y in range(n):
        for x in range(n):
            v = level + noise * rng.normal() + sum(collected(x, y, cx, cy, f) for _, cx, cy, f in STARS)
            rows.append(("i", x, y, float(v)))
    return rows + [("i", n + 3, n + 3, None), ("i", n + 4, n + 4, float("nan"))]


KIND = "image string, x int, y int, v double"


def test_filter_gives_heights_on_any_level():
    kernel, mask = P.matched_filter(3.0)
    r = kernel.shape[0] // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    star = 7 * np.exp(-(x * x + y * y) / (2 * SIGMA**2)) + 100
    assert abs((kernel * star).sum() - 7) < 1e-9 and abs(kernel.sum()) < 1e-12 and mask.sum() == (kernel != 0).sum()


def test_detection_does_not_depend_on_tiles(spark):
    df = spark.createDataFrame(image(0.3), KIND)
    found = [sorted((r["x"], r["y"], round(r["height"], 9), round(r["cx"], 9)) for r in P.detect(df, "image", 3.0, 8.0, 20.0, side=side).collect()) for side in (7, 16, 128)]
    assert found[0] == found[1] == found[2]
    assert {f[:2] for f in found[0]} == {(10, 12), (14, 13), (32, 30), (32, 5), (48, 40)}
    spike = [r if (r[1], r[2]) != (20, 40) else ("i", 20, 40, 300.0) for r in image(0.3)]
    assert len(P.detect(spark.createDataFrame(spike, KIND), "image", 3.0, 8.0, 20.0).collect()) == 5
    flat = spark.createDataFrame([("f", x, y, 5.0) for x in range(9) for y in range(9)], KIND)
    assert P.detect(flat, "image", 3.0, 1.0, 5.0).count() == 0 and P.detect(df.limit(0), "image", 3.0, 1.0).count() == 0


def test_fluxes_of_known_places_equal_dense_least_squares(spark):
    rows = image(0.5)
    stars = spark.createDataFrame([("i", s, cx, cy) for s, cx, cy, _ in STARS] + [("i", "out", 500.0, 500.0)], "image string, star string, cx double, cy double")
    got = {r["star"]: r for r in P.fit(spark.createDataFrame(rows, KIND), stars, "image", 3.0, 20.0, moves=0, wings=0).collect()}
    assert set(got) == {s for s, *_ in STARS}
    pixels = [r for r in rows if r[3] is not None and not math.isnan(r[3])]
    a = np.array([[collected(x, y, cx, cy, 1.0) if abs(x - round(cx)) <= 2 and abs(y - round(cy)) <= 2 else 0.0 for _, cx, cy, _ in STARS] for _, x, y, _ in pixels])
    want = np.linalg.lstsq(a, np.array([r[3] - 20 for r in pixels]), rcond=None)[0]
    assert np.allclose([got[s]["flux"] for s, *_ in STARS], want, rtol=1e-9)
    assert all(got[s]["pixels"] == 25 for s in got)
    wide = {r["star"]: r["flux"] for r in P.fit(spark.createDataFrame(rows, KIND), stars, "image", 3.0, 20.0, moves=0).collect()}
    in_box = (a > 0).any(axis=1)
    light = np.array([[collected(x, y, cx, cy, 1.0) if abs(x - round(cx)) <= 5 and abs(y - round(cy)) <= 5 else 0.0 for _, cx, cy, _ in STARS] for _, x, y, _ in pixels])
    want = np.linalg.lstsq(light[in_box], np.array([r[3] - 20 for r in pixels])[in_box], rcond=None)[0]
    assert np.allclose([wide[s] for s, *_ in STARS], want, rtol=1e-9)


def test_places_and_fluxes_are_found(spark):
    rows = image(0.05)
    got = P.measure(spark.createDataFrame(rows, KIND), "image", 3.0, 8.0).collect()
    assert len(got) == 5
    for _, cx, cy, f in STARS:
        near = min(got, key=lambda r: (r["cx"] - cx) ** 2 + (r["cy"] - cy) ** 2)
        assert abs(near["cx"] - cx) < 0.02 and abs(near["cy"] - cy) < 0.02 and abs(near["flux"] / f - 1) < 0.02


def test_crowds_are_solved_alike_by_gradients(monkeypatch):
    rng = np.random.default_rng(2)
    row, col, a = rng.integers(0, 400, 900), rng.integers(0, 60, 900), rng.normal(size=900)
    b = rng.normal(size=400)
    direct = P._solved(row, col, a, b, 60)
    monkeypatch.setattr(P, "_DIRECT", 1)
    assert np.allclose(P._solved(row, col, a, b, 60), direct, atol=1e-8)


def test_names_must_differ(spark):
    stars = spark.createDataFrame([("i", "a", 10.0, 10.0), ("i", "a", 30.0, 30.0)], "image string, star string, cx double, cy double")
    with pytest.raises(Exception, match="one name"):
        P.fit(spark.createDataFrame(image(), KIND), stars, "image", 3.0, 20.0).collect()


def test_fits_do_not_depend_on_tiles(spark):
    """A chain of stars over several tiles is fitted as one crowd."""
    chain = [(f"s{k}", 6.3 + 3.9 * k, 20.2 + 0.7 * k, 100.0 + 10 * k) for k in range(11)]
    rows = [("i", x, y, sum(collected(x, y, cx, cy, f) for _, cx, cy, f in chain)) for x in range(56) for y in range(12, 40)]
    stars = spark.createDataFrame([("i", s, cx + 0.2, cy - 0.1) for s, cx, cy, _ in chain], "image string, star string, cx double, cy double")
    found = [{r["star"]: (r["cx"], r["cy"], r["flux"], r["pixels"]) for r in P.fit(spark.createDataFrame(rows, KIND), stars, "image", 3.0, side=side).collect()} for side in (16, 128)]
    assert set(found[0]) == {s for s, *_ in chain} and all(np.allclose(found[0][s], found[1][s], rtol=1e-8) for s in found[0])
    assert all(np.allclose(found[0][s][:3], (cx, cy, f), atol=0.05) for s, cx, cy, f in chain)
    many = stars.limit(0).unionByName(spark.range(400).selectExpr("'i' AS image", "cast(id AS string) AS star", "id * 30.0 AS cx", "10.0D AS cy"))
    level = spark.range(400).selectExpr("'i' AS image", "cast(id * 30 AS int) AS x", "10 AS y", "cast(id + 1 AS double) AS v")
    alone = P.fit(level, many, "image", 3.0, moves=0, wings=0).collect()
    assert len(alone) == 400 and all(abs(r["flux"] * collected(0, 0, 0, 0, 1.0) - int(r["star"]) - 1) < 1e-6 and r["pixels"] == 1 for r in alone)
