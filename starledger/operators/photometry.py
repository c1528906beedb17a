"""Stars of images of pixel rows (image, x, y, v): found by a matched filter in tiles, measured by joint least squares.

Images may be of any size: pixels go to tiles of a fixed side together with a halo as wide as the filter, so a tile is bounded and
peaks don't depend on how an image is cut. Stars whose boxes share pixels are fitted together, all others on their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..scratch import Scratch
from .components import components
from .tiles import groups, links, packed, starts, unpacked

SIDE = 128
#: Standard deviation of a Gaussian of full width 1 at half its height.
PER_FWHM = 1 / (2 * math.sqrt(2 * math.log(2)))
#: Stars that one task measures at a time, about.
_TOGETHER = 2000
#: Stars fitted together up to which the equations are solved directly, beyond by conjugate gradients.
_DIRECT = 150


def matched_filter(fwhm: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights that give the height of a star on a level background at each pixel by least squares, and the pixels that they reach.

    The star is a Gaussian over the pixels within 1.5 standard deviations (2 pixels at least) of the middle; weights sum to 0.
    """
    sigma = fwhm * PER_FWHM
    reach = max(2.0, 1.5 * sigma)
    r = int(reach)
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    mask = x * x + y * y <= reach * reach
    g = np.where(mask, np.exp(-(x * x + y * y) / (2 * sigma * sigma)), 0.0)
    n = mask.sum()
    return np.where(mask, g - g.sum() / n, 0.0) / ((g * g).sum() - g.sum() ** 2 / n), mask


def _tiles(pixels: DataFrame, image: str, halo: int, side: int) -> DataFrame:
    """Pixels in the tiles (tx, ty) that they lie in or border on."""
    at = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    return pixels.withColumn("tx", F.explode(at("x"))).withColumn("ty", F.explode(at("y")))


def detect(pixels: DataFrame, image: str, fwhm: float, threshold: float | str, level: float | str = 0.0, sharp: tuple[float, float] = (0.2, 1.0), side: int = SIDE) -> DataFrame:
    """(image, x, y, height, sharpness, cx, cy): pixels where the matched filter gives more than ``threshold`` and most of all within its reach.

    ``level`` and ``threshold`` are numbers or names of columns that hold one value an image. Of equal neighbours the first by y and x counts.
    Sharpness is how far a pixel stands out of its neighbours' mean, by its height; stars outside of ``sharp`` are spikes or wide things and left
    out. (cx, cy) is the centre by one step of least squares. Pixels that are absent, null or not finite count as level.
    """
    kernel, mask = matched_filter(fwhm)
    sigma = fwhm * PER_FWHM
    r = kernel.shape[0] // 2
    halo = 2 * r
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if mask[dy + r, dx + r]]
    of = lambda c: F.col(c) if isinstance(c, str) else F.lit(float(c))
    rows = pixels.select(F.col(image), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.col("v").cast("double") - of(level)).alias("v"), of(threshold).alias("least"))
    rows = _tiles(rows.where(finite(F.col("v"))), image, halo, side)
    slope = {o: o[1] * math.exp(-(o[0] ** 2 + o[1] ** 2) / (2 * sigma**2)) / sigma**2 for o in offsets}
    slopes = sum(s * s for s in slope.values())

    def find(t: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(t["tx"].iloc[0]), int(t["ty"].iloc[0])
        wide = side + 2 * halo
        a = np.zeros((wide, wide))
        a[t["y"].to_numpy() - ty * side + halo, t["x"].to_numpy() - tx * side + halo] = t["v"]
        n = wide - 2 * r
        shifted = lambda m, o, k: m[r + o[0] : r + o[0] + k, r + o[1] : r + o[1] + k]
        height = sum(kernel[o[0] + r, o[1] + r] * shifted(a, o, n) for o in offsets)
        here = height[r : r + side, r : r + side]
        top = here > t["least"].iloc[0]
        for o in offsets:
            if o != (0, 0):
                other = shifted(height, o, side)
                top &= here > other if o < (0, 0) else here >= other
        y, x = np.nonzero(top)
        h = here[y, x]
        v = lambda o: a[y + halo + o[0], x + halo + o[1]]
        around = sum((v(o) for o in offsets if o != (0, 0)), np.zeros(len(y))) / (len(offsets) - 1)
        sharpness = (v((0, 0)) - around) / h
        step = lambda turn: np.clip(sum((slope[o] * v(turn(o)) for o in offsets), np.zeros(len(y))) / (h * slopes), -0.5, 0.5)
        out = pd.DataFrame({image: t[image].iloc[0], "x": x + tx * side, "y": y + ty * side, "height": h, "sharpness": sharpness})
        out["cx"], out["cy"] = out["x"] + step(lambda o: o), out["y"] + step(lambda o: (o[1], o[0]))
        return out[(sharpness >= sharp[0]) & (sharpness <= sharp[1])]

    kind = pixels.schema[image].dataType.simpleString()
    return rows.groupBy(image, "tx", "ty").applyInPandas(find, f"{image} {kind}, x long, y long, height double, sharpness double, cx double, cy double")


def _profile(d: np.ndarray, sigma: float, integrated: bool) -> np.ndarray:
    """Light of a star of flux 1 along one axis at a distance of d: over the pixel, or at its middle."""
    if not integrated:
        return np.exp(-d * d / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
    s = sigma * math.sqrt(2)
    return np.array([(math.erf((x + 0.5) / s) - math.erf((x - 0.5) / s)) / 2 for x in d])


def _slope(d: np.ndarray, sigma: float, integrated: bool) -> np.ndarray:
    """Change of the profile as the star moves."""
    g = lambda x: np.exp(-x * x / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
    return g(d - 0.5) - g(d + 0.5) if integrated else d / (sigma * sigma) * g(d)


def _solved(row: np.ndarray, col: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least squares of a sparse system given by its cells; ``b`` by row."""
    if n <= 3 * _DIRECT:
        dense = np.zeros((len(b), n))
        np.add.at(dense, (row, col), a)
        return np.linalg.lstsq(dense, b, rcond=None)[0]
    times = lambda x: np.bincount(row, a * x[col], len(b))
    back = lambda y: np.bincount(col, a * y[row], n)
    scale = 1 / np.sqrt(np.maximum(np.bincount(col, a * a, n), 1e-300))
    x, left = np.zeros(n), b.copy()
    s = scale * back(left)
    p, gamma = s.copy(), float(s @ s)
    first = gamma
    for _ in range(10 * n):
        if gamma <= 1e-24 * first:
            break
        q = times(scale * p)
        step = gamma / float(q @ q)
        x += step * p
        left -= step * q
        s = scale * back(left)
        gamma, old = float(s @ s), gamma
        p = s + gamma / old * p
    return scale * x


def _solved_crowds(crowd: np.ndarray, rows: np.ndarray, stars: np.ndarray, pix: np.ndarray, at: np.ndarray, parts: list[np.ndarray], light: np.ndarray) -> np.ndarray:
    """``_solved`` for each crowd with unknowns for each part of a star: [part, star].

    Stars and pixels are numbered crowd by crowd; ``crowd`` is by star, ``rows`` and ``stars`` are a crowd's numbers of pixels and stars. Small crowds of one size are solved together.
    """
    n, first_pix, first_star = len(parts), np.cumsum(rows) - rows, np.cumsum(stars) - stars
    of = crowd[at]
    out = np.zeros((n, len(crowd)))
    cells = np.cumsum(np.bincount(of, minlength=len(rows)))
    by_size = np.lexsort((rows, stars))
    begin = starts(stars[by_size], rows[by_size])
    for a, z in zip(begin, np.append(begin[1:], len(by_size)), strict=True):
        m, k = int(rows[by_size[a]]), int(stars[by_size[a]])
        together = max(1, (1 << 21) // (m * k * n)) if k <= _DIRECT // 8 else 1
        for low in range(a, z, together):
            some = np.sort(by_size[low : min(z, low + together)])
            e = np.concatenate([np.arange(cells[c - 1] if c else 0, cells[c]) for c in some])
            where = np.searchsorted(some, of[e])
            row, col = pix[e] - first_pix[of[e]], at[e] - first_star[of[e]]
            b = light[first_pix[some][:, None] + np.arange(m)]
            mine = first_star[some][:, None] + np.arange(k)
            if len(some) == 1:
                got = _solved(np.tile(row, n), np.concatenate([col + i * k for i in range(n)]), np.concatenate([p[e] for p in parts]), b[0], n * k)[None]
            else:
                dense = np.zeros((len(some), m, n * k))
                for i, p in enumerate(parts):
                    dense[where, row, col + i * k] = p[e]
                got = (np.linalg.pinv(dense, rcond=np.finfo(float).eps * max(m, n * k)) @ b[:, :, None])[:, :, 0]
            for i in range(n):
                out[i, mine] = got[:, i * k : (i + 1) * k]
    return out


def fit(pixels: DataFrame, stars: DataFrame, image: str, fwhm: float, level: float | str = 0.0, box: int = 5, moves: int = 3, integrated: bool = True, wings: int = 3, side: int = SIDE) -> DataFrame:
    """(image, star, cx, cy, flux, residual, pixels): the light of stars (image, star, cx, cy), fitted together where their boxes overlap.

    A star is a round Gaussian, by default as a pixel collects it. The fit is to a box of ``box`` x ``box`` pixels around each star's middle; ``wings``
    pixels beyond its own box a star still lights the boxes of others. With ``moves`` each
    step fits flux and position at once (Gauss–Newton, at most half a pixel a step), a last one the fluxes alone; with 0 positions stay. The
    residual is the root of the mean square over the star's pixels. Stars without a pixel have no row; two of one name and image are an error;
    stars at exactly one place share its light. Crowds are found in tiles and then across their borders, and a star gets its pixels from the tiles that
    it lights; stars that overlap one after the other are one task's.
    """
    scratch = Scratch(pixels.sparkSession, "photometry")
    kind, named = pixels.schema[image].dataType.simpleString(), stars.schema["star"].dataType.simpleString()
    of = F.col(level) if isinstance(level, str) else F.lit(float(level))
    half, wide = box // 2, box + 2 * wings
    span = box - 1 + wings  # farther apart, stars share no pixel
    tile = lambda c: F.floor(c / side)
    s = stars.select(image, "star", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).withColumn("name", F.concat_ws(":", F.col(image).cast("string"), F.col("star").cast("string")))
    s = s.withColumn("x", F.round("cx").cast("long")).withColumn("y", F.round("cy").cast("long")).where(F.col(image).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())

    def near(t: pa.Table) -> pa.Table:
        """A tile's stars with the name of the crowd that they form in it, and whether it may go on beyond."""
        x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
        order = pa.array(np.argsort(t.column("name").to_numpy(zero_copy_only=False).astype(str), kind="stable"))
        t, x, y = t.take(order), x[order], y[order]
        crowd = np.unique(groups(x, y, span), return_inverse=True)[1]
        first = np.full(len(x), len(x))
        np.minimum.at(first, crowd, np.arange(len(x)))
        rim = np.minimum.reduce([x % side, side - 1 - x % side, y % side, side - 1 - y % side]) < span
        return t.append_column("crowd", t.column("name").take(pa.array(first[crowd]))).append_column("rim", pa.array(rim))

    s = s.withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y")))
    shape = f"`{image}` {kind}, star {named}, cx double, cy double, name string, x long, y long, tx long, ty long"
    s = scratch.keep(s.groupBy(image, "tx", "ty").applyInArrow(near, f"{shape}, crowd string, rim boolean"), "stars")
    if not s.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("two stars of an image have one name")
    joined = components(links(s.where("rim").select(image, "x", "y", "crowd"), image, "crowd", span), scratch, "stars").toDF("crowd", "whole")
    s = s.join(joined, "crowd", "left").withColumn("crowd", F.coalesce("whole", "crowd")).select(image, "star", "name", "crowd", "cx", "cy", "x", "y")
    for t, c in (("tx", "x"), ("ty", "y")):
        s = s.withColumn(t, F.explode(F.sequence(tile(F.col(c) - half - wings), tile(F.col(c) + box - 1 - half + wings))))
    p = pixels.select(image, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.col("v").cast("double") - of).alias("v")).where(finite(F.col("v")))
    p = packed(p.withColumn("tx", tile(F.col("x"))).withColumn("ty", tile(F.col("y"))), [image, "tx", "ty"], ["x", "y", "v"])
    sigma = fwhm * PER_FWHM
    step_y, step_x = (g.ravel() - half - wings for g in np.mgrid[:wide, :wide])
    in_box = (step_x >= -half) & (step_x <= box - 1 - half) & (step_y >= -half) & (step_y <= box - 1 - half)

    def cut(src: pa.Table, pix: pa.Table) -> pa.Table:
        """Of each star the pixels of a tile in the square that it lights, row by row, NaN where there is none or no star's box is."""
        x, y, v = (unpacked(pix, c) for c in ("x", "y", "v"))
        place = (y.astype(np.int64) % side) * side + x.astype(np.int64) % side
        light = np.full(side * side + 1, np.nan)
        light[place] = v
        tx, ty = (src.column(c)[0].as_py() * side if src.num_rows else 0 for c in ("tx", "ty"))
        px = src.column("x").to_numpy()[:, None] - tx + step_x
        py = src.column("y").to_numpy()[:, None] - ty + step_y
        at = np.where((px >= 0) & (px < side) & (py >= 0) & (py < side), py * side + px, side * side)
        boxed = np.zeros(side * side + 1, bool)
        boxed[at[:, in_box]] = True
        if (boxed[:-1] & (np.bincount(place, minlength=side * side) > 1)).any():
            raise ValueError("two pixels of an image have one place")
        light[~boxed] = np.nan
        light[-1] = np.nan
        got = light[at]
        some = np.flatnonzero(~np.isnan(got).all(axis=1))
        out = src.select([image, "star", "name", "crowd", "cx", "cy", "x", "y"]).take(pa.array(some))
        return out.append_column("light", pa.array([r.tobytes() for r in got[some]], pa.binary()))

    cells = s.groupBy(image, "tx", "ty").cogroup(p.groupBy(image, "tx", "ty")).applyInArrow(cut, f"`{image}` {kind}, star {named}, name string, crowd string, cx double, cy double, x long, y long, light binary")

    def one(f, d: np.ndarray) -> np.ndarray:
        return f(d, sigma, integrated)

    def solve(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("crowd", "ascending"), ("name", "ascending")]))
        got = np.frombuffer(b"".join(t.column("light").to_pylist())).reshape(t.num_rows, wide * wide)
        name = t.column("name").combine_chunks().dictionary_encode().indices.to_numpy()
        heads = starts(name)
        # a star has a row for each tile that it lights
        got = np.fmax.reduceat(got, heads)
        t = t.take(pa.array(heads))
        n = t.num_rows
        crowd = t.column("crowd").combine_chunks().dictionary_encode().indices.to_numpy()
        cx, cy, x0, y0 = (t.column(c).to_numpy() for c in ("cx", "cy", "x", "y"))
        at, step = np.nonzero(~np.isnan(got))
        mine, v = in_box[step], got[at, step]
        x, y = x0[at] + step_x[step], y0[at] + step_y[step]
        order = np.lexsort((x, y, crowd[at]))
        at, mine, v, x, y = at[order], mine[order], v[order], x[order], y[order]
        begin = starts(crowd[at], y, x)
        pix = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
        light = v[begin]
        sizes = (np.bincount(crowd[at[begin]]), np.bincount(crowd))
        flux = None
        for k in range(moves + 1):
            px, py = one(_profile, x - cx[at]), one(_profile, y - cy[at])
            if flux is None or k == moves:
                flux = _solved_crowds(crowd, *sizes, pix, at, [px * py], light)[0]
            if k < moves:
                sx, sy = flux[at] * one(_slope, x - cx[at]) * py, flux[at] * px * one(_slope, y - cy[at])
                flux, dx, dy = _solved_crowds(crowd, *sizes, pix, at, [px * py, sx, sy], light)
                cx, cy = cx + np.clip(dx, -0.5, 0.5), cy + np.clip(dy, -0.5, 0.5)
        left = (light - np.bincount(pix, flux[at] * px * py, len(light)))[pix]
        count = np.bincount(at[mine], minlength=n)
        residual = np.sqrt(np.bincount(at[mine], (left * left)[mine], n) / np.maximum(count, 1))
        out = pa.table([t.column(image), t.column("star"), pa.array(cx), pa.array(cy), pa.array(flux), pa.array(residual), pa.array(count)], [image, "star", "cx", "cy", "flux", "residual", "pixels"])
        return out.filter(pa.array(count > 0))

    # many small crowds to a task
    packs = max(1, math.ceil(s.count() / _TOGETHER))
    cells = cells.withColumn("pack", F.pmod(F.xxhash64("crowd"), F.lit(packs)))
    return cells.groupBy("pack").applyInArrow(solve, f"`{image}` {kind}, star {named}, cx double, cy double, flux double, residual double, pixels long")


def measure(pixels: DataFrame, image: str, fwhm: float = 3.0, sigmas: float = 5.0, background: DataFrame | None = None, box: int = 5) -> DataFrame:
    """Stars that stand out of the background (image, center, scale) by ``sigmas`` of its scale, named by y and x, with their fitted light."""
    if background is None:
        from ..sources.images import background as clipped

        background = clipped(pixels, image)
    kernel, mask = matched_filter(fwhm)
    # the scale of the filter's result on noise of scale 1
    error = float(np.sqrt((kernel * kernel).sum()))
    b = background.select(image, F.col("center").alias("__level"), (F.col("scale") * error * sigmas).alias("__least"))
    p = Scratch(pixels.sparkSession, "stars").keep(pixels.select(image, "x", "y", "v").join(b, image), "pixels")
    found = detect(p, image, fwhm, "__least", "__level")
    name: Column = F.concat_ws("-", F.col("y").cast("string"), F.col("x").cast("string"))
    return fit(p, found.withColumn("star", name), image, fwhm, "__level", box)
