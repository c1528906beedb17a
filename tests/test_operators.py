"""Operators against values worked out by hand, in any order of rows."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from starledger.functions import distributions as d
from starledger.functions import hashing, numbers, text
from starledger.operators import admission, data_quality, documents, fusion, graph, hypothesis, learning, match, ordering, paging, papers, profile, series
from starledger.plans import skills
from starledger.session import session
from starledger.sources import catalogs, images


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("got", "want"), [
    (lambda: d.t_two_sided(2.228, 10), 0.05), (lambda: d.t_two_sided(0, 5), 1.0), (lambda: d.f_tail(3.885, 2, 12), 0.05), (lambda: d.chi2_tail(3.841, 1), 0.05), (lambda: d.chi2_tail(18.307, 10), 0.05),
    (lambda: d.normal_two_sided(1.96), 0.05), (lambda: d.mann_whitney_exact(2, 4, 5), 8 / 126), (lambda: d.mann_whitney_exact(0, 3, 3), 0.1),
])
def test_tails(got, want):
    assert abs(got() - want) < 2e-4


def test_shapiro_of_known_sample():
    w, p = hypothesis.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert abs(w - 0.79) < 0.01 and abs(p - 0.0067) < 0.001


def test_effects(spark):
    rows = spark.createDataFrame([(10.0, 1.0), (11.0, 2.0), (12.0, 3.0), (13.0, 4.0), (14.0, 5.0)], "left double, right double")
    r = hypothesis.t_welch(rows, "left", "right").first()
    assert abs(r["effect"] - 9 / math.sqrt(2.5)) < 1e-9
    table = spark.createDataFrame([("A", "X")] * 19 + [("A", "Y")] + [("B", "Y")] * 19 + [("B", "X")], "g string, o string")
    r = hypothesis.chi_square(table, "g", "o").first()
    assert abs(r["statistic"] - 28.9) < 1e-9 and r["dof"] == 1  # with Yates' correction
    with pytest.raises(ValueError):
        hypothesis.decided([hypothesis.t_one(rows, "left", 0.0)], alpha=1.5)


def test_quartiles_leave_the_middle_out(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 50)], "v double")
    r = profile.outlier_fences(rows, ["v"]).first()
    assert (r["q1"], r["q3"], r["outliers"]) == (3.0, 8.0, 1)
    r = profile.outlier_fences(rows.limit(1), ["v"]).first()
    assert (r["q1"], r["q3"], r["outliers"]) == (1.0, 1.0, 0)


def test_profile_of_empty_and_null(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert {r["present"] for r in profile.data_profile(empty).collect()} == {0}
    rows = spark.createDataFrame([(None, "x"), (float("nan"), None), (2.0, "x")], "a double, b string")
    r = {x["field"]: x for x in profile.data_profile(rows).collect()}
    assert (r["a"]["count"], r["a"]["median"], r["a"]["non_null"], r["b"]["distinct_count"]) == (1, 2.0, 2, 1)


@pytest.mark.parametrize("size", [2, 3, 50_000])
def test_neighbours_in_blocks_equal_one_window(spark, size):
    rows = spark.createDataFrame([(g, i, (i * 37 + g) % 11) for g in (0, 1) for i in range(23)], "g int, t int, v int").repartition(5)
    got = ordering.neighbours(rows, ["g"], ["t"], {"a": lambda w: F.lag("v", 2).over(w), "b": lambda w: F.lead("v").over(w)}, before=2, after=1, size=size)
    v = lambda g, i: (i * 37 + g) % 11 if 0 <= i < 23 else None
    assert sorted((r["g"], r["t"], r["a"], r["b"]) for r in got.collect()) == [(g, i, v(g, i - 2), v(g, i + 1)) for g in (0, 1) for i in range(23)]


def test_positions_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    assert ordering.positions(rows.repartition(7), ["g"], ["k"]).where("position != k or group_size != 5000").isEmpty()


def test_text(spark):
    L = F.lit
    assert one(spark, text.title_key(L("  Ｔhe ＂Große＂ \t Star—Map ™"))) == "the grosse star map tm"
    assert one(spark, text.doi(L("https://doi.org/10.1234/AB%2Fc).,"))) == "10.1234/ab/c"
    assert one(spark, text.doi(L("none"))) is None
    assert one(spark, text.arxiv(L("arXiv:2101.00001v3"))) == "2101.00001" and one(spark, text.arxiv(L("https://arxiv.org/pdf/math.GT/0309136v1.pdf"))) == "math.gt/0309136"
    assert one(spark, text.url(L("HTTP://Ex.org/a/?b=2&utm_x=1&a=1#f"))) == "http://ex.org/a?a=1&b=2"
    assert one(spark, text.url(L("ftp://ex.org"))) is None and one(spark, text.url(L("http://u@ex.org/"))) is None
    assert one(spark, text.catalog_id(L("tic 00042"), "tic", "TIC")) == "TIC 42" and one(spark, text.catalog_id(L("0"), "tic", "TIC")) is None
    assert one(spark, text.toi(L("TOI-700.1"))) == "700.01" and one(spark, text.toi(L("700.123"))) == "700.123"
    m = one(spark, text.measured(L("3.5 +0.2/-0.1 km")))
    assert (m["value"], m["plus"], m["minus"], m["limit"], m["unit"], m["null_reason"]) == ("3.5", "0.2", "0.1", "measured", "km", None)
    assert one(spark, text.measured(L("abc")))["null_reason"] == "unparsed"
    assert one(spark, text.unsafe_unit(L("m or km"))) and one(spark, text.negation_lost(L("is not hot"), L("hot")))
    assert one(spark, text.csv_safe(L(" =1+1"))) == "' =1+1"
    assert text.label("sky_dist") == "Sky Dist"


def test_numbers(spark):
    L = F.lit
    assert one(spark, numbers.plain(numbers.decimal(L("-0.500")))) == "-0.5" and one(spark, numbers.plain(numbers.decimal(L("-0")))) == "0" and one(spark, numbers.plain(numbers.decimal(L("100")))) == "100"
    assert one(spark, numbers.decimal(L("nan"))) is None and one(spark, numbers.canonical(L("2.5"), L("integer"))) is None
    assert abs(one(spark, numbers.separation(L(10.0), L(0.0), L(10.0), L(1 / 3600))) - 1) < 1e-9
    assert one(spark, numbers.within(L(2.00000005), 2.0)) and not one(spark, numbers.within(L(2.001), 2.0))
    assert one(spark, numbers.band(L(0.7), L(False))) == "medium"
    sun, moon = (F.struct(*[L(v).alias(k) for k, v in zip("xyz", p, strict=True)]) for p in ((1.5e8, 0.0, 0.0), (3.8e5, 0.0, 0.0)))
    s = one(spark, numbers.on_ellipsoid(moon, numbers.shadow(sun, moon, 696_000.0, 1737.4)["axis"]))
    assert abs(s["latitude"]) < 1e-9 and abs(s["longitude"]) < 1e-9


def test_seal_ignores_order(spark):
    rows = spark.createDataFrame([(i % 3, i, str(i)) for i in range(50)] + [(0, 0, "0")], "g int, a int, b string")
    x, y = (dict((r["g"], r["seal"]) for r in hashing.seal(df, ["g"], ["a", "b"]).collect()) for df in (rows, rows.orderBy(F.desc("a")).repartition(6)))
    z = dict((r["g"], r["seal"]) for r in hashing.seal(rows.distinct(), ["g"], ["a", "b"]).collect())
    assert x == y and x[0] != z[0] and x[1] == z[1]
    assert one(spark, hashing.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})) == '{"a":null,"b":1}'


def _candidates(spark, rows):
    return spark.createDataFrame(rows, "id long, tic_id long, gaia_id long, ra double, dec double").selectExpr("*", "'h' as level", "'s' as source", "true as complete", "'n' as name")


def test_match_decisions(spark):
    left = _candidates(spark, [(1, 10, None, 0.0001, 0.0), (2, 20, 5, 50.0, 10.0), (3, None, None, 100.0, 89.9999), (4, 40, None, None, None)])
    right = _candidates(spark, [(1, 10, None, 359.9999, 0.0), (2, 20, 6, 50.0, 10.0), (3, None, 7, 280.0, 89.9999), (4, 41, None, 0.0, 0.0)])
    got = {(r["left_id"], r["right_id"]): (r["status"], r["confidence"]) for r in match.edges(left, right).collect()}
    assert got == {(1, 1): ("accepted", 1.0), (2, 2): ("conflict", 0.0), (3, 3): ("review_required", 0.7), (1, 4): ("conflict", 0.0)}
    assert got == {(r["left_id"], r["right_id"]): (r["status"], r["confidence"]) for r in match.edges(left.orderBy(F.desc("id")), right.orderBy(F.desc("id"))).collect()}


def test_manual_decisions_must_fit(spark):
    records = spark.createDataFrame([("a", ["x"], "review_required"), ("b", ["y"], "accepted")], "record_key string, members array<string>, status string")
    good = spark.createDataFrame([("a", ["x"], "accept")], "record_key string, members array<string>, decision string")
    assert {r["record_key"]: r["status"] for r in match.decide(records, good).collect()} == {"a": "accepted", "b": "accepted"}
    for bad in (("b", ["y"], "accept"), ("a", ["z"], "accept"), ("c", ["x"], "accept")):
        with pytest.raises(Exception, match="review|members|record"):
            match.decide(records, spark.createDataFrame([bad], good.schema)).collect()


def test_selection_rules(spark):
    cells = spark.createDataFrame([
        ("r", "a", "structured", "2", 2, 1, 1, True), ("r", "a", "structured", "1", 1, 1, 2, True), ("r", "a", "document", "9", 3, 1, 3, True), ("r", "b", "document", "5", 1, 1, 4, True), ("r", "b", "document", "6", 1, 1, 5, True),
        ("r", "c", "structured", None, 1, 1, 6, True), ("r", "d", "structured", "1", 1, 1, 7, False), ("r", "e", "document", "7", 1, 1, 8, True), ("r", "e", "document", "7", 2, 1, 9, True),
    ], "row_id string, field_id string, kind string, value string, source_priority int, alias_priority int, cell_id int, aligned boolean")
    got = {r["field_id"]: (r["outcome"], r["value"], r["in_conflict"]) for r in fusion.select_canonical(cells, ["row_id", "field_id"]).collect()}
    assert got == {"a": ("structured", "1", True), "b": ("unresolved_conflict", None, True), "c": ("not_measured", None, False), "d": ("unresolved_alignment", None, False), "e": ("document_consensus", "7", False)}


def test_metric_precedence(spark):
    m = lambda *a: one(spark, numbers_metric(*a))
    numbers_metric = lambda n, d, s, i: fusion.metric(F.lit(n), F.lit(d), F.lit(s), F.lit(i))
    assert [m(1, 0, True, True)["status"], m(1, 0, False, True)["status"], m(1, 0, False, False)["status"], str(m(1, 3, False, False)["value"])] == ["not_applicable", "insufficient_source", "empty_denominator", "0.333333"]


def test_cursor():
    c = paging.sign_cursor(b"k", {"version": 1, "at": [3, "x"]})
    assert paging.open_cursor(b"k", c, {"version": 1})["at"] == [3, "x"]
    for key, cursor, bound in ((b"other", c, {}), (b"k", c[:-4] + "AAAA", {}), (b"k", c, {"version": 2})):
        with pytest.raises(ValueError):
            paging.open_cursor(key, cursor, bound)


def test_top_pairs_falls_back_to_any_pairs(spark):
    claims = spark.createDataFrame([(i, "accepted", ["e"], [f"o{i}"], f"m{i}", None, f"t{i}") for i in range(4)], "id long, status string, evidence array<string>, objects array<string>, metric string, unit string, type string")
    assert [(r["source_id"], r["target_id"]) for r in papers.top_pairs(claims, 5).collect()] == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2)]


def test_chunks(spark):
    rows = spark.createDataFrame([("d", i, "x" * n, h) for i, (n, h) in enumerate([(5, "A"), (5, None), (20, None), (1, "B")])], "d string, i int, t string, h string")
    got = [(r["chunk"], r["blocks"], r["chars"], r["section"]) for r in series.chunks(rows, "d", "i", "t", "h", budget=12).orderBy("chunk").collect()]
    assert got == [(0, [0, 1], 12, "A"), (1, [2], 20, "A"), (2, [3], 1, "B")]


def test_periodogram_finds_the_period(spark):
    rows = spark.createDataFrame([("s", float(t), 5 + math.sin(2 * math.pi * t / 7.3)) for t in range(200)], "o string, t double, y double")
    best = series.peaks(series.periodogram(rows, "o", "t", "y", series.frequency_grid(3.0, 50.0, 200.0)), "o").where("rank = 1").first()
    assert abs(1 / best["frequency"] - 7.3) < 0.15 and best["power"] > 0.9


def test_spectrum_finds_the_line(spark):
    rows = spark.createDataFrame([("s", 5000.0 + i, 10 + 0.01 * i + 0.01 * ((i * 7919) % 13 - 6) - 6 * math.exp(-(((i - 120) / 1.5) ** 2))) for i in range(300)], "o string, w double, f double")
    r = series.spectrum(rows, "o", "w", "f", 5120.0).where("rank = 1").first()
    assert r["w"] == 5120.0 and r["depth"] > 0.4 and abs(r["velocity"]) < 1e-6


def test_dbscan_and_forest(spark):
    points = [(i, float(i % 5), 0.0) for i in range(10)] + [(100 + i, 50.0 + i % 3, 50.0) for i in range(9)] + [(999, 500.0, 500.0)]
    rows = spark.createDataFrame(points, "k long, x double, y double")
    got = {r["k"]: r["label"] for r in learning.dbscan(rows, "k", ["x", "y"], 1.0, 4).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[100 + i] for i in range(9)} == {100} and got[999] is None
    top = learning.isolation_forest(rows, "k", ["x", "y"], 0.06).orderBy(F.desc("score")).first()
    assert top["k"] == 999 and top["anomaly"]


def test_html_cells(spark):
    html = "<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2<td>3</tr><tr><td>4 <b>5</b></td></tr></table><table><tr><td>x</td></tr></table>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<p>no table")], "k long, h string")
    got = [tuple(r) for r in documents.html_cells(rows, "k", "h").collect()]
    assert got == [(1, 0, 0, 0, "A"), (1, 0, 0, 1, "A"), (1, 0, 0, 2, "B"), (1, 0, 1, 0, "1"), (1, 0, 2, 0, "1"), (1, 0, 1, 1, "2"), (1, 0, 1, 2, "3"), (1, 0, 2, 1, "4 5"), (1, 1, 0, 0, "x")]


def test_difference_meets_by_identity(spark):
    kind = "category string, key string, value string, semantic string, match_group string"
    a = spark.createDataFrame([("c", "1", "x", "s1", None), ("c", "2", "y", "s2", None), ("c", "3", "z", None, "g"), ("c", "4", "w", None, None)], kind)
    b = spark.createDataFrame([("c", "1", "x2", "s1", None), ("c", "9", "y", "s2", None), ("c", "8", "zz", None, "g"), ("c", "7", "n", None, None)], kind)
    assert sorted(tuple(r)[1:] for r in graph.difference(a, b).collect()) == [("1", "changed"), ("4", "removed"), ("7", "added"), ("8", "changed"), ("9", "unchanged")]


def test_segments_and_aperture(spark):
    pixels = [("i", x, y, float((x * 7 + y * 13) % 5) + (100.0 if (x - 10) ** 2 + (y - 12) ** 2 <= 4 else 0.0)) for x in range(30) for y in range(30)]
    rows = spark.createDataFrame(pixels, "image string, x long, y long, v double")
    s = images.segments(rows, "image").collect()
    assert len(s) == 1 and abs(s[0]["cx"] - 10) < 0.1 and abs(s[0]["cy"] - 12) < 0.1 and s[0]["pixels"] == 13
    src = spark.createDataFrame([("i", "a", 10.0, 12.0)], "image string, source string, cx double, cy double")
    assert abs(images.aperture(rows, src, "image", 3.0, 5.0, 8.0).first()["flux"] - 1300) < 60


def test_learning_queries_use_whole_vectors_and_forests(spark, monkeypatch):
    from starledger.plans.queries import QUERIES

    seen = []
    forest, means, clusters, axes = learning.fit, learning.KMeans, learning.kmeans, learning.pca
    monkeypatch.setattr(learning, "fit", lambda *a, **b: [m := forest(*a, **b), seen.append((len(a[1]), getattr(m.stages[-1], "getNumTrees", None)))][0])
    monkeypatch.setattr(learning, "KMeans", lambda **b: [means(**b), seen.append("start")][0])
    monkeypatch.setattr(learning, "kmeans", lambda df, key, fields, *a: [clusters(df, key, fields, *a), seen.append(len(fields))][0])
    monkeypatch.setattr(learning, "pca", lambda df, key, fields: [axes(df, key, fields), seen.append(len(fields))][0])
    few = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("label < 2").limit(60)
    monkeypatch.setattr("starledger.plans.learning_queries.table", lambda s, d, name: few if name == "embeddings" else s.read.parquet(f"{d}/{name}.parquet"))
    want = {"kmeans_clusters": ["start"] * 10 + [64], "pca_axes": [64], "feature_importance": [(64, 200)], "tabular_model": [(64, 200)], "cross_validation": [(64, None)] * 3, "forecast": [(3, 200)]}
    for name, made in want.items():
        seen.clear()
        QUERIES[name](spark, SMALL)
        assert seen == made, name


def test_skills_reach_their_algorithms(spark):
    rows = spark.createDataFrame([(i, float(i % 5), 1000.0 * (i % 5), 0.0, float(i // 20), float(i // 20), 3.0 * (i % 5)) for i in range(40)], "k long, a double, b double, c double, d double, y double, z double")
    four = {"key": "k", "fields": ["a", "b", "c", "d"]}
    got = {r["k"]: r["label"] for r in skills.run("clustering_analysis", rows, four | {"algorithm": "dbscan", "eps": 1.1, "min_samples": 4}).collect()}
    assert {got[i] for i in range(20)} == {0} and {got[20 + i] for i in range(20)} == {20}  # apart in the fourth field only
    top = skills.run("anomaly_detection", rows.unionByName(rows.limit(1).selectExpr("999L as k", "90d as a", "b", "c", "d", "y", "z")), {"key": "k", "fields": ["a", "b"], "contamination": 0.02})
    assert top.first()["k"] == 999
    m = {r["metric"]: (r["value"], r["baseline"]) for r in skills.run("tabular_machine_learning", rows, {"key": "k", "fields": ["a", "d"], "label": "y"}).collect()}
    assert m["accuracy"] == (1.0, 0.5)
    m = {r["metric"]: r["value"] for r in skills.run("tabular_machine_learning", rows, {"key": "k", "fields": ["a", "d"], "label": "z", "task": "regression", "model": "linear"}).collect()}
    assert m["mae"] < 1e-6 and m["r2"] > 0.999
    with pytest.raises(ValueError):
        skills.run("clustering_analysis", rows, four | {"algorithm": "other"})


def test_mann_whitney_is_exact_beside_many(spark):
    rows = spark.createDataFrame([(float(i), i + 0.5 if i < 2 else None) for i in range(300)], "a double, b double")
    got = hypothesis.mann_whitney(rows, "a", "b").first()
    assert abs(got["p_value"] - d.mann_whitney_exact(597, 300, 2)) < 1e-12


def test_skill_parameters(spark):
    rows = spark.createDataFrame([(1, 2.0)], "k long, a double")
    for name, given in (("nothing", {}), ("data_profile", {"code": "x"}), ("correlation_analysis", {}), ("clustering_analysis", {"key": "k", "fields": ["a"], "k": 1}), ("clustering_analysis", {"key": "k", "fields": ["a"], "k": True})):
        with pytest.raises(ValueError):
            skills.run(name, rows, given)
    assert len(skills.SKILLS) == 24


def test_cone_filter_is_pushed(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) as ra", "cast(id as double) as dec").write.parquet(str(tmp_path / "s"))
    plan = catalogs.cone(spark.read.parquet(str(tmp_path / "s")), 1.0, 1.0, 2.0, "id")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(dec" in plan


def test_session_settings(spark):
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_quality_metrics_of_incomplete_and_empty_sources(spark):
    cell = "row_id string, field_id string, kind string, value string, source_priority int, alias_priority int, cell_id int, aligned boolean, unit string, target_unit string, in_snapshot boolean, retained boolean"
    values = [("r", "a", "structured", "2", 1, 1, 1, True, "m", "m", True, True), ("r", "a", "structured", "3", 1, 1, 2, True, None, "m", True, False), ("r", "b", "document", "5", 1, 1, 3, True, "m", "m", False, True), ("s", "a", "structured", None, 1, 1, 4, True, "m", "m", True, True)]
    records, edges = spark.createDataFrame([("r", "paired", "review_required", "low"), ("s", "unpaired", None, None)], "row_id string, record_type string, status string, band string"), spark.createDataFrame([("low", True), (None, False)], "band string, with_evidence boolean")

    def run(rows, complete):
        cells = data_quality.observed_cells(spark.createDataFrame(rows, cell), ["a"])
        out = data_quality.evaluate(cells, records, edges, spark.createDataFrame([(x,) for x in complete], "complete boolean"), ["a"])
        return {(r["target"], r["metric_id"]): (r["numerator"], r["denominator"], r["status"]) for r in out.collect()}

    got = run(values, [True, True])
    assert len(got) == 2 * 8 + 2 * 10 + 14 and len({m for _, m in got}) == 32
    assert got["a", "field_unit_consistency"] == (1, 2, "determinate") and got["b", "field_unit_consistency"] == (0, 0, "not_applicable")
    assert got["a", "field_evidence_coverage"] == (0, 1, "determinate") and got["b", "field_provenance_coverage"] == (0, 1, "determinate")
    assert got["a", "field_same_source_conflict_rate"] == (1, 2, "determinate") and got["s", "row_provenance_coverage"] == (0, 0, "empty_denominator")
    assert got["r", "row_low_confidence_flag"] == (1, 1, "determinate") and got["s", "row_low_confidence_flag"] == (0, 0, "not_applicable") and got["s", "row_inconclusive_flag"] == (0, 1, "determinate")
    assert got["dataset", "dataset_evidence_coverage"] == (1, 4, "determinate") and got["dataset", "object_match_coverage"] == (1, 2, "determinate")
    part = run(values, [True, False])
    assert part["dataset", "source_scope_completeness"] == (1, 2, "insufficient_source") and part["dataset", "validation_integrity"] == (1, 1, "insufficient_source") and part["a", "field_completeness"] == (1, 2, "insufficient_source") and part["b", "field_unit_consistency"][2] == "not_applicable"
    empty = run([], [True])
    assert len(empty) == 14 and empty["dataset", "dataset_completeness"] == (0, 0, "empty_denominator")


def test_metrics_of_an_admitted_table(spark):
    cells = spark.createDataFrame([("a", "x", "1", "m", "s/a/x"), ("a", "y", None, "m", "s/a/y"), ("a", "z", "t", None, "s/a/z")], "row_id string, field_id string, value string, unit string, locator string")
    run = lambda d, status: {r["metric_id"]: (r["numerator"], r["denominator"], r["status"]) for r in admission.table_metrics(d, status).collect()}
    assert run(cells, "complete") == {"source_scope_completeness": (1, 1, "determinate"), "dataset_unit_consistency": (1, 1, "determinate"), "dataset_evidence_coverage": (3, 3, "determinate")}
    assert {s for _, _, s in run(cells, "truncated").values()} == {s for _, _, s in run(cells.limit(0), "empty").values()} == {"insufficient_source"}
    assert run(cells.limit(0), "complete") == {"source_scope_completeness": (0, 1, "determinate"), "dataset_unit_consistency": (0, 0, "empty_denominator"), "dataset_evidence_coverage": (0, 0, "empty_denominator")}
    with pytest.raises(ValueError):
        run(cells, "partial")


def test_admission_of_tables(spark):
    manifest = [admission.Field("k", "id", nullable=False), admission.Field("v", "v", nullable=False), admission.Field("ra", "ra"), admission.Field("dec", "dec")]
    for bad in ([], ["v", "k"], ["k", "v", "v"], ["k", "w"], ["k", "ra"]):
        with pytest.raises(ValueError):
            admission.projection(bad, manifest)
    fields = admission.projection(["k", "v", "ra", "dec"], manifest)
    schema = "k string, v int, ra double, dec double"
    run = lambda rows, status: {r["reason"]: r["rows"] for r in admission.rejections(spark.createDataFrame(rows, schema), fields, status).collect()}
    assert run([("a", 1, 0.0, 90.0), ("b", 2, None, None)], "complete") == {} and run([], "empty") == {} and run([], "complete") == {"status_disagrees": 1}
    assert run([("A  b", 1, 360.0, 0.0), (" a B", None, 1.0, None), (None, 1, float("nan"), 0.0)], "truncated") == {"null_key": 1, "null_value": 1, "duplicate_identity": 2, "half_coordinate": 1, "coordinate_out_of_range": 2}
    with pytest.raises(ValueError, match="status"):
        run([], "other")


def test_capacity_at_its_limit(spark):
    a, b = spark.createDataFrame([("h",), ("h",), ("p",)], "kind string"), spark.createDataFrame([("h",), ("q",), ("q",)], "kind string")
    verdict = lambda rows, pairs: admission.capacity(a, b, "kind", [("h", "h"), ("p", "q")], rows, pairs).first()
    assert verdict(3, 4)["verdict"] == "accepted" and verdict(3, 4)["eligible_pairs"] == 4
    assert verdict(2, 4)["verdict"] == verdict(3, 3)["verdict"] == "capacity_exceeded"


def test_routing_thresholds(spark):
    from starledger.operators.documents import route

    rows = [(79, False), (80, False), (80, True), (255, True), (256, True), (255, False)]
    got = spark.createDataFrame(rows, "chars int, graphics boolean").select(route(F.col("chars"), F.col("graphics")).alias("r")).collect()
    assert [r["r"] for r in got] == ["visual", "native", "visual", "visual", "native", "native"]
    with pytest.raises(ValueError):
        route(F.col("chars"), F.col("graphics"), 100, 99)


def test_crossmatch_rejects_what_exceeds_its_capacity(spark):

    kind = "id string, level string, source string, complete boolean, tic_id string, gaia_id string, name string, ra double, dec double"
    c = spark.createDataFrame([(f"s{i}", "host_star", "a", True, str(i), None, None, None, None) for i in range(3)], kind)
    other = c.withColumn("source", F.lit("b"))
    assert match.catalog_crossmatch(c, other, limits=(3, 9))["edges"].count() == 3
    for limits in ((2, 9), (3, 8)):
        with pytest.raises(match.CapacityExceeded, match="CROSSMATCH_CAPACITY_EXCEEDED"):
            match.catalog_crossmatch(c, other, limits=limits)
    assert skills.run("catalog_crossmatch", c, right=other).count() == 3
    with pytest.raises(match.CapacityExceeded):
        skills.run("catalog_crossmatch", c, {"most_pairs": 8}, right=other)
