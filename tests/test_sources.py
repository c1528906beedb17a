"""Readers and writers on small files."""

import io
import json
import struct
import zipfile

import pytest

from starledger.sources import catalogs, fits, images, sinks, tabular


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id , mass,name\n1,2.5,"x, ""y"""\n2, ,  z \n', encoding="utf-8")
    got = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("id", "bigint"), ("mass", "double"), ("name", "string")]
    assert [tuple(r) for r in got.collect()] == [(1, 2.5, 'x, "y"'), (2, None, "z")]
    kinds = tabular.cell_kinds(tabular.read_csv(spark, str(tmp_path / "a.csv"), typed=False), "id").collect()
    assert {(r["id"], r["field"]): r["kind"] for r in kinds} == {("1", "mass"): "number", ("1", "name"): "string", ("2", "mass"): None, ("2", "name"): "string"}
    for header in ([], ["a", "A"], ["a", " "], [f"c{i}" for i in range(257)]):
        with pytest.raises(ValueError):
            tabular.checked_header(header)


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": null}, {"a": "x"}]')
    (tmp_path / "b.json").write_text('{"rows": [{"b": {"c": 2}}]}')
    got = tabular.read_json(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((r["a"] or "", r["b"] or "", tuple(r["present"])) for r in got) == [("", '{"c":2}', ("b",)), ("1", "", ("a", "b")), ("x", "", ("a",))]


def _xlsx(rows, sheets=1):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>name</t></si></sst>')
        body = "".join(f"<row>{r}</row>" for r in rows)
        for i in range(sheets):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    rows = ['<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>', '<c r="A2"><v>7</v></c>', '<c r="A3"/>', '<c r="B4" t="inlineStr"><is><t>x</t></is></c>']
    (tmp_path / "a.xlsx").write_bytes(_xlsx(rows))
    assert [r["cells"] for r in tabular.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [{"id": "7"}, {"name": "x"}]
    with pytest.raises(ValueError):
        list(tabular.sheet_rows(io.BytesIO(_xlsx(rows, 2))))


def test_table_service_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_id,ra,note\n123,1.5,ok\n124,,\n")
    kinds = {"source_id": "identifier", "ra": "number", "note": "text"}
    assert [tuple(r) for r in catalogs.read_tap_csv(spark, str(tmp_path / "a.csv"), kinds).collect()] == [("123", 1.5, "ok"), ("124", None, None)]
    with pytest.raises(ValueError):
        catalogs.read_tap_csv(spark, str(tmp_path / "a.csv"), kinds, max_rows=1)
    with pytest.raises(ValueError):
        catalogs.read_tap_csv(spark, str(tmp_path / "a.csv"), {"ra": "number", "source_id": "identifier", "note": "text"})
    with pytest.raises(Exception, match="no identifier"):
        catalogs.read_tap_csv(spark, str(tmp_path / "a.csv"), {**kinds, "ra": "identifier"}).collect()
    (tmp_path / "v.xml").write_text("<VOTABLE><TABLEDATA><TR><TD>5</TD><TD>2.5</TD></TR><TR><TD>6</TD><TD></TD></TR></TABLEDATA></VOTABLE>")
    assert sorted(tuple(r) for r in catalogs.read_votable(spark, str(tmp_path / "v.xml"), {"id": "identifier", "ra": "number"}).collect()) == [("5", 2.5), ("6", None)]


def test_drift_and_types(spark):
    assert [catalogs.type_category(t) for t in ("varchar(20)", "BIGINT", "double", "geometry")] == ["string", "integer", "number", None]
    df = spark.createDataFrame([], "a long, b string")
    assert catalogs.drift(df, {"a": "integer", "b": "string"}) == []
    assert catalogs.drift(df, {"a": "number", "c": "string"}) == ["missing c", "unexpected b", "a is integer, not number"]


def _fits(columns, rows):
    def head(cards):
        text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    size = sum(struct.calcsize(f) for _, _, f in columns)
    body = b"".join(struct.pack(">" + "".join(f for _, _, f in columns), *r) for r in rows)
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", size), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (n, t, _) in enumerate(columns, 1):
        cards += [(f"TTYPE{i}", f"'{n}'"), (f"TFORM{i}", f"'{t}'")]
    return head([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + head(cards) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits(spark, tmp_path):
    columns = [("FLUX", "E", "f"), ("LOGLAM", "D", "d"), ("IVAR", "E", "f"), ("AND_MASK", "J", "i")]
    (tmp_path / "s.fits").write_bytes(_fits(columns, [(1.5, 3.0, 4.0, 0), (2.0, 3.1, 0.0, 0), (3.0, 3.2, 1.0, 8), (float("nan"), 3.3, 1.0, 0)]))
    raw = catalogs.read_fits(spark, str(tmp_path / "s.fits"), ["flux", "loglam", "ivar", "and_mask"])
    got = [(r["wavelength"], r["flux"], r["uncertainty"]) for r in catalogs.spectrum_rows(raw).collect()]
    assert raw.count() == 4 and got == [(1000.0, 1.5, 0.5)]
    with pytest.raises(Exception, match="lacks"):
        catalogs.read_fits(spark, str(tmp_path / "s.fits"), ["nope"]).collect()


def test_fits_in_ranges_with_filters(spark, tmp_path):
    columns = [("N", "J", "i"), ("BIG", "K", "q"), ("X", "D", "d"), ("NAME", "5A", "5s"), ("FLAG", "L", "c"), ("V", "2E", "2f"), ("B", "B", "B"), ("SKIP", "1P", "8s")]
    rows = [(i - 500, i << 40, i / 3, b"n%d" % (i % 7), (b"T", b"F", b"\0")[i % 3], i, -i, i % 256, b"") for i in range(1000)]
    raw = _fits(columns, rows)
    (tmp_path / "a.fits").write_bytes(raw)
    (tmp_path / "_ignored.fits").write_bytes(b"x")
    df = fits.read_table(spark, str(tmp_path), split=5000)
    assert df.dtypes == [("n", "int"), ("big", "bigint"), ("x", "double"), ("name", "string"), ("flag", "boolean"), ("v", "array<float>"), ("b", "smallint")]
    assert df.rdd.getNumPartitions() > 5
    want = [(i - 500, i << 40, i / 3, f"n{i % 7}", (True, False, None)[i % 3], [float(i), float(-i)], i % 256) for i in range(1000)]
    assert sorted(tuple(r) for r in df.collect()) == want
    for condition, keep in (("n = 3", lambda r: r[0] == 3), ("n in (1, 2) and x > 167.1", lambda r: r[0] in (1, 2) and r[2] > 167.1), ("not (b <= 100) and n is not null", lambda r: r[6] > 100), ("b >= 10 and b < 12", lambda r: 10 <= r[6] < 12), ("n <> 5", lambda r: r[0] != 5), ("n > 100 or b = 3", lambda r: r[0] > 100 or r[6] == 3)):
        assert sorted(tuple(r) for r in df.where(condition).collect()) == [r for r in want if keep(r)], condition
        pushed = fits.read_table(spark, str(tmp_path), split=5000, push=True).where(condition)
        assert sorted(tuple(r) for r in pushed.collect()) == [r for r in want if keep(r)], condition
    assert df.count() == 1000
    few = fits.read_table(spark, str(tmp_path), "x double, n int, path string", push=True).where("n = 3 and x > 0")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "(x#" in plan and "(n#" not in plan and "big" not in plan
    assert [(r["x"], r["n"], r["path"].endswith("a.fits")) for r in few.collect()] == [(503 / 3, 3, True)]
    with pytest.raises(Exception, match="lacks"):
        fits.read_table(spark, str(tmp_path), "nope int").collect()
    with pytest.raises(Exception, match="not bigint"):
        fits.read_table(spark, str(tmp_path), "n bigint").collect()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.fits").write_bytes(raw[:-20_000])
    with pytest.raises(Exception, match="ends before row"):
        fits.read_table(spark, str(tmp_path / "cut")).collect()


def test_fits_scaled_columns_and_missing_cells():
    head = {"XTENSION": "BINTABLE", "NAXIS": "2", "NAXIS1": "6", "NAXIS2": "3", "TFIELDS": "2", "TTYPE1": "U", "TFORM1": "I", "TZERO1": "32768", "TTYPE2": "K", "TFORM2": "J", "TNULL2": "-1"}
    text = fits.header([("SIMPLE", "T"), ("NAXIS", 0)]) + fits.header([(k, v if k in ("XTENSION", "TTYPE1", "TTYPE2", "TFORM1", "TFORM2") else int(v)) for k, v in head.items()])
    layout = fits.Layout.of(lambda at, n: text[at : at + n], 1)
    u, k = layout.columns
    assert (layout.rows, layout.width, u.kind.simpleString(), k.kind.simpleString()) == (3, 6, "double", "int")
    import numpy as np

    assert u.decode(np.array([-32768, 0, 32767], ">i2")).to_pylist() == [0.0, 32768.0, 65535.0]
    assert k.decode(np.array([5, -1, 0], ">i4")).to_pylist() == [5, None, 0]
    with pytest.raises(ValueError, match="ends early"):
        fits.Layout.of(lambda at, n: text[:3000][at : at + n], 1)
    with pytest.raises(ValueError, match="no binary table"):
        fits.Layout.of(lambda at, n: text[at : at + n], 0)


def test_fits_written(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as int) a", "id b", "id / 7 c", "id % 2 = 0 d", "cast(id as float) e", "cast(id as smallint) f")
    fits.write_table(df.repartition(3), str(tmp_path / "t"))
    back = fits.read_table(spark, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert all(p.name.startswith("part-") for p in (tmp_path / "t").iterdir())
    with pytest.raises(Exception, match="no nulls"):
        fits.write_table(spark.sql("select cast(null as int) a"), str(tmp_path / "u"))
    assert not (tmp_path / "u").exists() or not list((tmp_path / "u").glob("[!.]*"))
    with pytest.raises(Exception, match="can't be a column"):
        fits.write_table(spark.sql("select 'x' a"), str(tmp_path / "v"))


def test_recorded_pages_and_items(spark, tmp_path):
    import hashlib

    rows = json.dumps([{"a": "1"}, {"a": "2"}])
    (tmp_path / "p.json").write_text(json.dumps({"page_no": 1, "sha256": hashlib.sha256(rows.encode()).hexdigest(), "rows": rows}))
    assert [r["row"]["a"] for r in catalogs.recorded(spark, str(tmp_path / "p.json")).collect()] == ["1", "2"]
    body = json.dumps({"message": {"items": [{"title": ["<i>A</i> b"], "author": [{"given": "X", "family": "Y"}], "issued": {"date-parts": [[2020, 1]]}, "DOI": "10.1/x"}]}})
    r = catalogs.search_items(spark.createDataFrame([(body,)], "body string"), "body").first()
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"]) == ("A b", ["X Y"], 2020, "10.1/x", None)


def test_image_archive(spark, tmp_path):
    def archive(names, size=12):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, bytes(range(size)))
        return out.getvalue()

    (tmp_path / "a.zip").write_bytes(archive(["cat/1.rgb", "cat/2.rgb", "dog/1.rgb"]))
    got = images.read_image_archives(spark, str(tmp_path / "a.zip"), 2)
    assert {(r["label"], len(r["pixels"])) for r in got.collect()} == {("cat", 12), ("dog", 12)}
    assert images.balanced(got) == ["two images a class"]
    for names, size in ((["../x"], 12), (["a/b/c"], 12), (["a/x", "a/X"], 12), (["a/x"], 11)):
        with pytest.raises(ValueError):
            images.entries(zipfile.ZipFile(io.BytesIO(archive(names, size))), 2)
    (tmp_path / "b.zip").write_bytes(archive([f"l{i % 3}/{i}.rgb" for i in range(50)]))
    shared = images.read_image_archives(spark, str(tmp_path / "b.zip"), 2, split=1000)
    assert shared.rdd.getNumPartitions() > 3 and sorted(r["name"] for r in shared.collect()) == sorted(f"l{i % 3}/{i}.rgb" for i in range(50))
    assert images.read_image_archives(spark, str(tmp_path / "b.zip"), 2, pixels=False).columns == ["archive", "name", "label"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x", None), (2, "y", 3.0)], "row_id long, b string, a double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {("'=x", None), ("y", "3.0")}
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":3.0,"b":"y","row_id":2}', '{"a":null,"b":"=x","row_id":1}']
