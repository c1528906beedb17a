"""Levels, apertures and segments of images, however an image is cut among tasks."""

import numpy as np

from starledger.operators.tiles import groups
from starledger.sources import images

KIND = "image string, x int, y int, v double"


def rows(seed=4, n=40):
    r = np.random.default_rng(seed)
    return [(i, x - 5, y, float(r.normal(10, 1) + 60 * (r.random() < 0.3))) for i in ("a", "b") for x in range(n) for y in range(n)]


def test_large_images_have_the_same_level(spark):
    df = spark.createDataFrame(rows() + [("a", 99, 99, float("nan")), ("c", 0, 0, 7.0)], KIND)
    one, many = ({r["image"]: (r["center"], r["scale"]) for r in images.background(df, "image", whole=w).collect()} for w in (5000, 1000))
    assert set(one) == {"a", "b", "c"} and one["c"] == (7.0, 0.0) and one == many


def test_apertures_meet_pixels_without_a_broadcast(spark, capsys):
    pixels = spark.createDataFrame([*rows(), ("a", 3, 4, None)], KIND)
    where = [("a", "p", 1.2, 7.9), ("b", "q", 15.5, 16.0), ("a", "r", 33.9, 39.0), ("b", "far", 90.0, 90.0)]
    got = images.aperture(pixels, spark.createDataFrame(where, "image string, source string, cx double, cy double"), "image", 3.0, 4.0, 5.0, side=16)
    found = {r["source"]: r for r in got.collect()}
    assert set(found) == {"p", "q", "r"}
    for i, name, cx, cy in where[:3]:
        near = [(((x - cx) ** 2 + (y - cy) ** 2) ** 0.5, v) for j, x, y, v in [*rows(), ("a", 3, 4, None)] if i == j]
        ring = [v for r, v in near if 4 <= r <= 5 and v is not None]
        inside = [v for r, v in near if r <= 3]
        assert found[name]["n"] == len(inside) and abs(found[name]["flux"] - (sum(v or 0 for v in inside) - len(inside) * sum(ring) / len(ring))) < 1e-8
    got.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_segments_do_not_depend_on_tiles(spark):
    df = spark.createDataFrame(rows(), KIND)
    found = [sorted((r["image"], r["pixels"], round(r["cx"], 6), round(r["cy"], 6), round(r["flux"], 6)) for r in images.segments(df, "image", least=1, side=side).collect()) for side in (4, 16, 512)]
    assert found[0] == found[1] == found[2] and 1 < len(found[0])


def test_groups_of_places():
    r = np.random.default_rng(6)
    x, y = r.integers(-20, 20, 150), r.integers(-20, 20, 150)
    for reach in (1, 3):
        label = np.arange(150)
        near = (np.abs(x[:, None] - x) <= reach) & (np.abs(y[:, None] - y) <= reach)
        for _ in range(150):
            label = np.where(near, label, 999).min(axis=1)
        got = groups(x, y, reach)
        assert len(set(zip(label.tolist(), got.tolist(), strict=True))) == len(set(label.tolist())) == len(set(got.tolist()))
