"""Image archives, and measures over pixels as rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numbers import finite
from ..operators.components import components
from ..operators.series import MAD_SCALE, robust_scale
from ..operators.tiles import groups, links, packed, unpacked
from ..scratch import Scratch
from . import files

#: Pixels of an image that one task sorts.
WHOLE = 1 << 22


def entries(z: zipfile.ZipFile, side: int) -> list[tuple[zipfile.ZipInfo, str]]:
    """(entry, label) of raw ``side`` x ``side`` RGB files in a folder for each label; ValueError for unsafe or repeated paths and other sizes."""
    out, seen = [], set()
    for i in z.infolist():
        if i.is_dir():
            continue
        parts = i.filename.split("/")
        if len(parts) != 2 or any(p in ("", ".", "..") for p in parts) or i.filename.lower() in seen:
            raise ValueError(f"{i.filename}: an image lies once in a label's folder")
        seen.add(i.filename.lower())
        if i.file_size != side * side * 3:
            raise ValueError(f"{i.filename}: not {side} x {side} RGB")
        out.append((i, parts[0]))
    return out


class ImageReader(DataSourceReader):
    def __init__(self, path: str, side: int, split: int, columns: list[str]):
        self.path, self.side, self.split, self.columns = path, side, split, columns

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p) for p in files.shares(files.visible_files(self.path), self.split)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = files.opened(self.path)
        for path, share, of in partition.value:
            file = files.RangeFile(system, path)
            with zipfile.ZipFile(file) as z:
                # every share checks the whole directory and reads the bytes of its own entries
                all_ = entries(z, self.side)
                for i, label in all_[len(all_) * share // of : len(all_) * (share + 1) // of]:
                    row = {"archive": path, "name": i.filename, "label": label}
                    if "pixels" in self.columns:
                        row["pixels"] = (np.frombuffer(z.read(i), np.uint8) / 255).tolist()
                    yield tuple(row[c] for c in self.columns)
            file.close()


class ImageSource(DataSource):
    """Options: path (an archive or folder of them), side (32), split (bytes of an archive for each task, 16 MB)."""

    @classmethod
    def name(cls) -> str:
        return "image_archive"

    def schema(self) -> str:
        return "archive string, name string, label string, pixels array<double>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ImageReader(self.options["path"], int(self.options.get("side", 32)), int(self.options.get("split", 16 << 20)), schema.names)


def read_image_archives(spark: SparkSession, path: str, side: int = 32, split: int = 16 << 20, pixels: bool = True) -> DataFrame:
    """(archive, name, label, pixels array<double> from 0 to 1); large archives are shared out by entries. Without ``pixels`` no entry is read."""
    columns = "archive string, name string, label string" + ", pixels array<double>" * pixels
    return files.load(spark, ImageSource, path, columns, side=side, split=split)


def balanced(images: DataFrame, least: int = 2, most_classes: int = 32, ratio: float = 100.0) -> list[str]:
    """Why a labelled set can't be learned from; nothing if it can."""
    g = images.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    checks = {"2 to 32 classes": 2 <= g["k"] <= most_classes, "two images a class": (g["lo"] or 0) >= least, "classes of like size": (g["hi"] or 0) <= ratio * max(1, g["lo"] or 0)}
    return [k for k, ok in checks.items() if not ok]


def background(pixels: DataFrame, image: str, rounds: int = 3, sigma: float = 3.0, whole: int = WHOLE) -> DataFrame:
    """(image, center, scale) of pixel values (x, y, v), clipped ``rounds`` times.

    The values of an image of up to ``whole`` pixels are clipped by one task, those of a larger one in ranges of many tasks.
    """
    rows = pixels.where(finite(F.col("v")) & F.col(image).isNotNull()).select(image, F.col("v").cast("double").alias("v"))
    large = pixels.groupBy(image).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(image)
    kind = pixels.schema[image].dataType.simpleString()

    def clip(t: pa.Table) -> pa.Table:
        v = unpacked(t, "v")
        for _ in range(rounds):
            center = float(np.median(v))
            scale = float(np.median(np.abs(v - center))) * MAD_SCALE
            if scale > 0:
                v = v[np.abs(v - center) <= sigma * scale]
        return pa.table([t.column(image).slice(0, 1), pa.array([center]), pa.array([scale])], [image, "center", "scale"])

    def clipped(some: DataFrame) -> DataFrame:
        return packed(some, [image], ["v"]).groupBy(image).applyInArrow(clip, f"`{image}` {kind}, center double, scale double")

    if large.isEmpty():
        return clipped(rows)
    large = Scratch(pixels.sparkSession, "background").keep(large, "large")
    return clipped(rows.join(large, image, "left_anti")).unionByName(_spread_background(rows.join(large, image, "left_semi"), image, rounds, sigma))


def _spread_background(rows: DataFrame, image: str, rounds: int, sigma: float) -> DataFrame:
    for i in range(rounds):
        s = Scratch(rows.sparkSession, f"background{i}")
        scale = s.keep(robust_scale(rows, [image], "v", s), "scale")
        rows = rows.join(scale, image).where((F.col("mad") == 0) | (F.abs(F.col("v") - F.col("center")) <= sigma * F.col("mad"))).select(image, "v")
    return scale.withColumnRenamed("mad", "scale")


def centroid(pixels: DataFrame, image: str) -> DataFrame:
    """Centre of light (null without any)."""
    v = F.greatest(F.col("v"), F.lit(0.0))
    return pixels.groupBy(image).agg(F.try_divide(F.sum(v * F.col("x")), F.sum(v)).alias("cx"), F.try_divide(F.sum(v * F.col("y")), F.sum(v)).alias("cy"), F.sum(v).alias("light"))


def aperture(pixels: DataFrame, sources: DataFrame, image: str, radius: float, inner: float, outer: float, side: int = 128) -> DataFrame:
    """Light in a circle around each source (image, source, cx, cy) less the mean of a ring.

    Sources go to the tiles that they reach into; in a tile they meet pixels by cells as wide as the ring, and what tiles find is summed.
    """
    w = float(max(outer, radius))
    kind, named = pixels.schema[image].dataType.simpleString(), sources.schema["source"].dataType.simpleString()
    tile = lambda c: F.floor(c / side)
    p = pixels.where(F.col(image).isNotNull()).select(image, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v"), F.col("v").isNull().cast("double").alias("gap"))
    p = packed(p.withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y"))).where("tx is not null and ty is not null"), [image, "tx", "ty"], ["x", "y", "v", "gap"])
    s = sources.select(image, "source", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    for t, c in (("tx", "cx"), ("ty", "cy")):
        s = s.withColumn(t, F.explode(F.sequence(tile(F.col(c) - 2 * w), tile(F.col(c) + 2 * w))))

    names = [image, "source", "total", "lit", "n", "ring", "rings"]

    def light(src: pa.Table, pix: pa.Table) -> pa.Table:
        cx, cy = src.column("cx").to_numpy(), src.column("cy").to_numpy()
        x, y, v, gap = (unpacked(pix, c) for c in ("x", "y", "v", "gap"))
        cell = lambda a, b: np.floor(b / w).astype(np.int64) * (1 << 32) + np.floor(a / w).astype(np.int64)
        key = cell(x, y)
        order = np.argsort(key, kind="stable")
        key, x, y, v, known = key[order], x[order], y[order], v[order], gap[order] == 0
        middle = cell(cx, cy)
        rows = [middle + d * (1 << 32) for d in (-1, 0, 1)]
        low = np.concatenate([np.searchsorted(key, r - 1) for r in rows])
        many = np.concatenate([np.searchsorted(key, r + 1, "right") for r in rows]) - low
        of = np.tile(np.arange(len(cx)), 3)
        got, met = np.zeros((5, len(cx))), np.zeros(len(cx), bool)
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // (1 << 20), prepend=-1))  # about a million pairs at a time
        for a, z in zip(cuts, [*cuts[1:], len(many)], strict=False):
            n = many[a:z]
            i = np.repeat(of[a:z], n)
            at = np.arange(len(i)) + np.repeat(low[a:z] - np.cumsum(n) + n, n)
            r = np.sqrt((x[at] - cx[i]) ** 2 + (y[at] - cy[i]) ** 2)
            inside, ring = r <= radius, (r >= inner) & (r <= outer) & known[at]
            sure = inside & known[at]
            met[i] = True
            got += [np.bincount(i[k], weights, len(cx)) for k, weights in ((sure, v[at[sure]]), (sure, None), (inside, None), (ring, v[at[ring]]), (ring, None))]
        some = pa.array(np.flatnonzero(met))
        total, lit, n, light_, rings = got[:, met]
        columns = [src.column(image).take(some), src.column("source").take(some), pa.array(total), pa.array(lit.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(light_), pa.array(rings.astype(np.int64))]
        return pa.table(columns, names)

    part = s.groupBy(image, "tx", "ty").cogroup(p.groupBy(image, "tx", "ty")).applyInArrow(light, f"`{image}` {kind}, source {named}, total double, lit long, n long, ring double, rings long")
    g = part.groupBy(image, "source").agg(*[F.sum(c).alias(c) for c in names[2:]])
    g = g.withColumn("total", F.when(F.col("lit") > 0, F.col("total"))).withColumn("ring", F.try_divide(F.col("ring"), F.col("rings")))
    return g.select(image, "source", (F.col("total") - F.col("n") * F.coalesce("ring", F.lit(0.0))).alias("flux"), "n", "ring")


def segments(pixels: DataFrame, image: str, sigma: float = 5.0, least: int = 5, side: int = 512) -> DataFrame:
    """(image, source, pixels, cx, cy, flux): connected pixels above the background by ``sigma`` scales.

    Pixels are connected within tiles first; what lies at tiles' borders then connects what the tiles found.
    """
    scratch = Scratch(pixels.sparkSession, "segments")
    level = scratch.keep(background(pixels, image), "background")
    kind = pixels.schema[image].dataType.simpleString()
    p = pixels.where(finite(F.col("v"))).select(image, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    p = p.withColumn("tx", F.floor(F.col("x") / side)).withColumn("ty", F.floor(F.col("y") / side)).where("tx is not null and ty is not null")
    # joined when many pixels are one row
    tiles = packed(p, [image, "tx", "ty"], ["x", "y", "v"]).join(level, image)

    def connect(t: pa.Table) -> pa.Table:
        x, y, v = (unpacked(t, c) for c in ("x", "y", "v"))
        net = v - t.column("center")[0].as_py()
        lit = v > t.column("center")[0].as_py() + sigma * t.column("scale")[0].as_py()
        x, y, net = x[lit].astype(np.int64), y[lit].astype(np.int64), net[lit]
        first, of = np.unique(groups(x, y, 1), return_inverse=True)
        n = len(first)
        edge = np.flatnonzero((x % side == 0) | (x % side == side - 1) | (y % side == 0) | (y % side == side - 1))
        edge = edge[np.argsort(of[edge], kind="stable")]
        places = pa.StructArray.from_arrays([pa.array(x[edge]), pa.array(y[edge])], ["x", "y"])
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(of[edge], minlength=n))).astype(np.int32))
        columns = [t.column(image).take(pa.array(np.zeros(n, np.int64))), pa.array(x[first]), pa.array(y[first]), pa.array(np.bincount(of, minlength=n)), *(pa.array(np.bincount(of, m, n).astype(float)) for m in (net * x, net * y, net)), pa.ListArray.from_arrays(offsets, places)]
        return pa.table(columns, [image, "x", "y", "pixels", "sx", "sy", "flux", "edge"])

    found = tiles.groupBy(image, "tx", "ty").applyInArrow(connect, f"`{image}` {kind}, x long, y long, pixels long, sx double, sy double, flux double, edge array<struct<x:long,y:long>>")
    digits = lambda c: F.when(F.length(c.cast("string")) < 6, F.lpad(c.cast("string"), 6, "0")).otherwise(c.cast("string"))
    found = scratch.keep(found.withColumn("p", F.concat_ws(":", F.col(image).cast("string"), digits(F.col("y")), digits(F.col("x")))).drop("x", "y"), "found")
    comp = components(links(found.select(image, "p", F.inline("edge")), image, "p", 1), scratch, "pixels")
    named = found.join(comp.toDF("p", "source"), "p", "left").withColumn("source", F.coalesce("source", "p"))
    g = named.groupBy(image, "source").agg(F.sum("pixels").alias("pixels"), (F.sum("sx") / F.sum("flux")).alias("cx"), (F.sum("sy") / F.sum("flux")).alias("cy"), F.sum("flux").alias("flux"))
    return g.where(F.col("pixels") >= least)
