"""Moments of events of sampled series against functions whose roots are known."""

import math

import pytest
from pyspark.sql import functions as F

from starledger.operators import celestial as C

KIND = "o string, t double, v double"


def moments(df):
    return [(round(r["t"], 6), r["state"]) for r in df.orderBy("t").collect()]


def test_crossings_of_a_sine(spark):
    rows = [("a", float(t), 30 * math.sin(2 * math.pi * t / 240)) for t in range(481)]
    df = spark.createDataFrame(rows + [("a", 3.5, None), ("a", None, 1.0), ("a", 4.5, float("nan")), ("a", 0.0, -5.0)], KIND)
    got = moments(C.rises_and_sets(df, "o", "t", "v", horizon=0.0))
    assert [s for _, s in got] == ["set", "rise", "set"] and [t for t, _ in got] == pytest.approx([120, 240, 360], abs=1e-6)
    got = moments(C.twilights(df, "o", "t", "v"))
    names = [s for _, s in got]
    assert names[:8] == ["Civil twilight", "Nautical twilight", "Astronomical twilight", "Night", "Astronomical twilight", "Nautical twilight", "Civil twilight", "Day"]
    want = 120 + 240 / (2 * math.pi) * math.asin(6 / 30)
    assert got[1][0] == pytest.approx(want, abs=0.01)


def test_several_limits_in_one_step_and_values_on_a_limit(spark):
    df = spark.createDataFrame([("a", 0.0, -20.0), ("a", 10.0, 0.0), ("a", 20.0, -12.0), ("a", 30.0, -12.0), ("b", 0.0, 5.0)], KIND)
    assert moments(C.twilights(df, "o", "t", "v")) == [
        (1.0, "Astronomical twilight"), (4.0, "Nautical twilight"), (7.0, "Civil twilight"), (round(10 * (20 - 0.8333) / 20, 6), "Day"), (round(10 + 10 * 0.8333 / 12, 6), "Civil twilight"), (15.0, "Nautical twilight"),
    ]


def test_turns_go_the_shorter_way_round(spark):
    df = spark.createDataFrame([("a", 0.0, 350.0), ("a", 1.0, 10.0), ("a", 2.0, 100.0), ("a", 3.0, 80.0), ("a", 4.0, 0.0), ("a", 5.0, 350.0), ("a", 6.0, 270.0), ("a", 7.0, 260.0)], KIND)
    assert moments(C.turns(df, "o", "t", "v", C.MOON_PHASES)) == [
        (0.5, "New Moon"), (round(1 + 80 / 90, 6), "First Quarter"), (2.5, "First Quarter"), (4.0, "New Moon"), (6.0, "Last Quarter"),
    ]
    assert moments(C.turns(df, "o", "t", "v", C.ALIGNMENTS)) == [(0.5, "conjunction"), (4.0, "conjunction")]


def test_summits_of_a_parabola(spark):
    rows = [("a", t, 40 - (t - 7.3) ** 2) for t in (0.0, 2.0, 5.0, 6.0, 9.0, 11.0)]
    r = C.summits(spark.createDataFrame(rows, KIND), "o", "t", "v", "transit").collect()
    assert len(r) == 1 and r[0]["t"] == pytest.approx(7.3) and r[0]["height"] == pytest.approx(40)
    assert C.summits(spark.createDataFrame(rows, KIND), "o", "t", "v", "transit", least=41).count() == 0


def test_merged_sorted_and_cut(spark):
    df = spark.createDataFrame([("a", float(t), float((-1) ** t)) for t in range(12)], KIND)
    every = C.merged({"rise_set": C.rises_and_sets(df, "o", "t", "v", 0.0), "again": C.rises_and_sets(df, "o", "t", "v", 0.0)}, "o")
    assert every.count() == 22
    few = C.earliest(every, ["t", "event"], 3).collect()
    assert [(r["t"], r["event"], r["truncated"]) for r in few] == [(0.5, "again", True), (0.5, "rise_set", True), (1.5, "again", True)]
    assert not any(r["truncated"] for r in C.earliest(every, ["t", "event"], 22).collect())
    assert C.earliest(every.where(F.lit(False)), ["t"], 3).count() == 0


def positions(spark, rows):
    from starledger.functions import eclipses

    df = spark.createDataFrame(rows, "name string, s array<double>, m array<double>")
    at = lambda c: eclipses.vector(*[F.get(c, F.lit(i)) for i in range(3)])
    return eclipses.eclipses(df.select("name", at("s").alias("sun"), at("m").alias("moon")))


def test_kinds_of_eclipses(spark):
    sun = [149_600_000.0, 0.0, 0.0]
    rows = [("total", sun, [360_000.0, 0.0, 0.0]), ("annular", sun, [400_000.0, 0.0, 0.0]), ("hybrid", sun, [374_000.0, 0.0, 0.0]), ("partial", sun, [360_000.0, 8000.0, 0.0]), ("none", sun, [360_000.0, 12_000.0, 0.0]), ("away", sun, [-360_000.0, 0.0, 0.0]), (None, None, None)]
    got = {r["name"]: r for r in positions(spark, rows).collect()}
    assert {n: r["kind"] for n, r in got.items()} == {"total": "total", "annular": "annular", "hybrid": "hybrid", "partial": "partial", "none": "none", "away": "none", None: None}
    t = got["total"]
    distance, apart = 360_000 - 6378.137, 149_600_000 - 360_000
    assert t["umbra"] == pytest.approx(1737.4 - (695_700 - 1737.4) / apart * distance) and t["penumbra"] == pytest.approx(1737.4 + (695_700 + 1737.4) / apart * distance)
    assert (t["latitude"], t["longitude"]) == (0, 0) and got["annular"]["umbra"] < 0 and got["partial"]["umbra"] is None
    assert len(t["penumbra_edge"]) == len(t["umbra_edge"]) == 72 and 0 < len(got["partial"]["penumbra_edge"]) < 72 and not got["none"]["penumbra_edge"]
    assert max(abs(p["latitude"]) for p in t["umbra_edge"]) == pytest.approx(math.degrees(t["umbra"] / 6378.137), rel=0.02)
    # every point of the edge lies on the cone
    for p in got["partial"]["penumbra_edge"]:
        lat, lon, e2 = math.radians(p["latitude"]), math.radians(p["longitude"]), 1 - (6356.752314 / 6378.137) ** 2
        n = 6378.137 / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        x, y, z = n * math.cos(lat) * math.cos(lon), n * math.cos(lat) * math.sin(lon), n * (1 - e2) * math.sin(lat)
        axis = [360_000 - sun[0], 8000.0, 0.0]
        length = math.hypot(*axis)
        axis = [v / length for v in axis]
        rel = [x - 360_000, y - 8000, z]
        along = sum(a * b for a, b in zip(axis, rel, strict=True))
        off = math.sqrt(sum(v * v for v in rel) - along * along)
        assert off == pytest.approx(p["radius"], rel=1e-4)


def test_every_kind_occurs(spark):

    from starledger.plans.queries import QUERIES

    kinds = {r["kind"] for r in QUERIES["eclipse_kinds"](spark, "/root/testdata/sf0.01").select("kind").distinct().collect()}
    assert kinds == {"none", "partial", "annular", "total", "hybrid"}
