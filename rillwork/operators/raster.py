"""Map algebra on elevation cells, line sampling, profile and accuracy checks.

Cells are rows: ``cells(grid_id, row, col, value)``; a grid's header is one row of
``grids(grid_id, origin_x, origin_y, pixel_w, pixel_h, crs, nodata, width, height)``.
Neighbour access is an equi-join on (grid, row, col) after shifting the indices,
so a grid of any size is spread evenly over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.session import checkpointed


def is_nodata(value: Column, nodata: Column) -> Column:
    return value.isNull() | F.isnan(value) | (nodata.isNotNull() & (value == nodata))


# --- mosaics, windows, pyramids -------------------------------------------------------

def misaligned(grids: DataFrame) -> DataFrame:
    """Grids that cannot be merged with the first: other CRS or pixel size."""
    first = grids.agg(F.min_by(F.struct("pixel_w", "pixel_h", "crs"), "grid_pos")).scalar()
    base = grids.withColumn("_f", first)
    off = lambda a: F.abs(F.col(a) - F.col(f"_f.{a}")) > 1e-6 * F.greatest(F.abs(F.col(a)), F.abs(F.col(f"_f.{a}")))
    return base.where(off("pixel_w") | off("pixel_h") | (F.col("crs") != F.col("_f.crs"))).select("grid_id")


def mosaic(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Aligned grids merged on common rows and columns; where they overlap the later wins.

    Returns the covered cells ``(row, col, value)``; cells no grid covers are absent,
    which is what nodata means in this layout.
    """
    frame = grids.agg(F.struct(F.min("origin_x").alias("x"), F.max("origin_y").alias("y"),
                               F.min_by("pixel_w", "grid_pos").alias("w"),
                               F.min_by("pixel_h", "grid_pos").alias("h"))).scalar()
    g = grids.withColumn("_f", frame).select(
        "grid_id", "grid_pos",
        F.rint((F.col("_f.y") - F.col("origin_y")) / F.col("_f.h")).cast("bigint").alias("_r"),
        F.rint((F.col("origin_x") - F.col("_f.x")) / F.col("_f.w")).cast("bigint").alias("_c"))
    placed = cells.join(g, "grid_id")
    return placed.groupBy((F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col")).agg(
        F.max_by("value", "grid_pos").alias("value"))


def clip_window(cells: DataFrame, grid: dict, bounds: tuple[float, float, float, float]) -> tuple[DataFrame, dict]:
    """Whole pixels covering the bounds, with the shifted header."""
    min_x, min_y, max_x, max_y = bounds
    c0 = max(0, math.floor((min_x - grid["origin_x"]) / grid["pixel_w"]))
    c1 = min(grid["width"], math.ceil((max_x - grid["origin_x"]) / grid["pixel_w"]))
    r0 = max(0, math.floor((grid["origin_y"] - max_y) / grid["pixel_h"]))
    r1 = min(grid["height"], math.ceil((grid["origin_y"] - min_y) / grid["pixel_h"]))
    if c0 >= c1 or r0 >= r1:
        raise ValueError("clip bounds do not meet the grid")
    window = cells.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    moved = window.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)
    header = dict(grid, origin_x=grid["origin_x"] + c0 * grid["pixel_w"],
                  origin_y=grid["origin_y"] - r0 * grid["pixel_h"], width=c1 - c0, height=r1 - r0)
    return moved, header


def halved(cells: DataFrame, width: int, height: int) -> DataFrame:
    """2x2 block means over valid cells; an odd last row or column is trimmed."""
    kept = cells.where((F.col("row") < height // 2 * 2) & (F.col("col") < width // 2 * 2))
    return kept.groupBy((F.col("row") / 2).cast("bigint").alias("row"), (F.col("col") / 2).cast("bigint").alias("col")).agg(
        F.avg("value").alias("value"))


def pyramid(cells: DataFrame, width: int, height: int, levels: int) -> DataFrame:
    """All coarser levels as ``(level, row, col, value)``, until a side would vanish."""
    out = cells.select(F.lit(0).alias("level"), "row", "col", "value")
    current = cells
    for level in range(1, levels + 1):
        if width < 2 or height < 2:
            break
        current = checkpointed(halved(current, width, height))
        width, height = width // 2, height // 2
        out = out.unionByName(current.select(F.lit(level).alias("level"), "row", "col", "value"))
    return out


# --- sampling ----------------------------------------------------------------------------

def bilinear(points: DataFrame, cells: DataFrame, grid: dict, key: str = "point_id") -> DataFrame:
    """``(key, value, covered, nodata)`` per point; four neighbours met by an equi-join.

    ``points(key, x, y)``. Outside the extent is not covered; a missing neighbour is
    nodata and never replaced; indices are held inside the grid at its edge.
    """
    w, h = grid["width"], grid["height"]
    x0, y0, pw, ph = grid["origin_x"], grid["origin_y"], grid["pixel_w"], grid["pixel_h"]
    inside = F.col("x").between(x0, x0 + w * pw) & F.col("y").between(y0 - h * ph, y0)
    fc = (F.col("x") - x0) / pw - 0.5
    fr = (F.lit(float(y0)) - F.col("y")) / ph - 0.5
    at = points.select(key, inside.alias("covered"), F.floor(fc).alias("_c"), F.floor(fr).alias("_r"),
                       (fc - F.floor(fc)).alias("_tx"), (fr - F.floor(fr)).alias("_ty"))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("bigint")
    corner = lambda dr, dc, wt: F.struct(clamp(F.col("_r") + dr, h).alias("row"), clamp(F.col("_c") + dc, w).alias("col"), wt.alias("wt"))
    tx, ty = F.col("_tx"), F.col("_ty")
    corners = F.array(corner(0, 0, (1 - tx) * (1 - ty)), corner(0, 1, tx * (1 - ty)),
                      corner(1, 0, (1 - tx) * ty), corner(1, 1, tx * ty))
    # points outside ask for no cell and stay as one row; exploded rows look small to the planner, so they meet no join but one
    asked = at.select(key, F.explode_outer(F.when(F.col("covered"), corners)).alias("k")).select(key, "k.*")
    met = asked.join(cells.select("row", "col", "value"), ["row", "col"], "left")
    out = met.groupBy(key).agg(F.sum(F.col("wt") * F.col("value")).alias("_v"),
                               F.bool_or(F.when(F.col("wt").isNotNull(), F.col("value").isNull())).alias("_n"))
    return out.select(key, F.when(~F.col("_n"), F.col("_v")).alias("value"), F.col("_n").isNotNull().alias("covered"),
                      F.coalesce("_n", F.lit(False)).alias("nodata"))


def densified(points: Column, spacing: float) -> Column:
    """Line vertices with every gap cut into equal parts no longer than the spacing."""
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    def cut(p: Column) -> Column:
        a, b = p["a"], p["b"]
        steps = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / spacing).cast("int"))
        return F.transform(F.sequence(F.lit(1), steps), lambda i: F.when(i == steps, b).otherwise(F.struct(
            (a["x"] + (b["x"] - a["x"]) * i / steps).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / steps).alias("y"))))
    return F.concat(F.slice(points, 1, 1), F.flatten(F.transform(pairs, cut)))


def sampled_lines(lines: DataFrame, cells: DataFrame, grid: dict, spacing: float, dem_id: str) -> DataFrame:
    """Elevated vertices ``(line_id, pos, x, y, z)`` along densified lines; nodata is null z."""
    vertices = lines.select("line_id", F.posexplode(densified(F.col("pts"), spacing)).alias("pos", "p")).select(
        "line_id", "pos", "p.x", "p.y")
    # a vertex takes its place along, so that no join has to bring it back
    z = bilinear(vertices.withColumn("vertex", F.struct("line_id", "pos", "x", "y")), cells, grid, "vertex")
    return z.select("vertex.line_id", "vertex.pos", F.col("value").alias("z"), F.lit(dem_id).alias("dem_id"), "vertex.x", "vertex.y")


# --- relief --------------------------------------------------------------------------------

def hillshade(cells: DataFrame, grid: dict, azimuth: float = 315.0, altitude: float = 45.0,
              z_factor: float = 1.0, nodata: float = -1.0, tile: int = 256) -> DataFrame:
    """Lambertian relief 0..255 per cell.

    Cells go to square tiles with a one-cell rim from the neighbours (at most four
    copies of a rim cell), and each tile is shaded as one NumPy block, so a task
    handles a bounded block whatever the size of the grid. Edges are replicated; a
    cell touching nodata is nodata.
    """
    if not 0.0 <= azimuth < 360.0:
        raise ValueError("azimuth must be within [0, 360)")
    if not 0.0 < altitude <= 90.0:
        raise ValueError("altitude must be within (0, 90]")
    if z_factor <= 0:
        raise ValueError("z_factor must be positive")
    near = lambda c: F.array_distinct(F.array(F.floor((c - 1) / tile), F.floor(c / tile), F.floor((c + 1) / tile)))
    spread = cells.select("row", "col", "value", F.explode(near(F.col("row"))).alias("tr"), F.col("col").alias("_c"))
    spread = spread.select("row", "col", "value", "tr", F.explode(near(F.col("_c"))).alias("tc"))
    spread = spread.where(F.col("tr").between(0, (grid["height"] - 1) // tile) & F.col("tc").between(0, (grid["width"] - 1) // tile))

    height, width, pw, ph = grid["height"], grid["width"], float(grid["pixel_w"]), float(grid["pixel_h"])

    def shade_tile(key, pdf):
        tr, tc = int(key[0]), int(key[1])
        r0, c0 = tr * tile, tc * tile
        nr, nc = min(tile, height - r0), min(tile, width - c0)
        block = np.full((nr + 2, nc + 2), np.nan)
        block[pdf["row"].to_numpy() - r0 + 1, pdf["col"].to_numpy() - c0 + 1] = pdf["value"].to_numpy(dtype=float)
        return shaded_block(block, r0, c0, (r0 == 0, r0 + nr == height, c0 == 0, c0 + nc == width),
                            pw, ph, azimuth, altitude, z_factor, nodata)

    return spread.groupBy("tr", "tc").applyInPandas(shade_tile, "row bigint, col bigint, value double")


def shaded_block(block: np.ndarray, r0: int, c0: int, rim: tuple[bool, bool, bool, bool], pw: float, ph: float,
                 azimuth: float, altitude: float, z_factor: float, nodata: float) -> pd.DataFrame:
    """Shade of the inner cells of a block carrying a one-cell rim (NaN is nodata)."""
    gone = np.isnan(block)
    gone_inner = gone.copy()
    top, bottom, left, right = rim
    if top:
        block[0], gone_inner[0] = block[1], False
    if bottom:
        block[-1], gone_inner[-1] = block[-2], False
    if left:
        block[:, 0], gone_inner[:, 0] = block[:, 1], False
    if right:
        block[:, -1], gone_inner[:, -1] = block[:, -2], False
    view = lambda a, i, j: a[i:a.shape[0] - 2 + i, j:a.shape[1] - 2 + j]
    east = view(block, 0, 2) + 2 * view(block, 1, 2) + view(block, 2, 2)
    west = view(block, 0, 0) + 2 * view(block, 1, 0) + view(block, 2, 0)
    south = view(block, 2, 0) + 2 * view(block, 2, 1) + view(block, 2, 2)
    north = view(block, 0, 0) + 2 * view(block, 0, 1) + view(block, 0, 2)
    dx, dy = (east - west) / (8 * pw), (south - north) / (8 * ph)
    slope, facing = np.arctan(z_factor * np.hypot(dx, dy)), np.arctan2(dy, -dx)
    facing = np.where(facing < 0, facing + 2 * np.pi, facing)
    zenith, sun = np.radians(90 - altitude), np.radians((450 - azimuth) % 360)
    light = np.clip(255 * (np.cos(zenith) * np.cos(slope) + np.sin(zenith) * np.sin(slope) * np.cos(sun - facing)), 0, 255)
    touched = np.zeros(light.shape, dtype=bool)
    for i in range(3):
        for j in range(3):
            touched |= view(gone_inner, i, j)
    own = view(gone, 1, 1)
    light = np.where(touched | own, nodata, light)
    rows, cols = np.indices(light.shape)
    return pd.DataFrame({"row": (rows + r0).ravel(), "col": (cols + c0).ravel(), "value": light.ravel()})


def relief_layer(shade: DataFrame, nodata: float = -1.0, tint: tuple[int, int, int] | None = None,
                 opacity: float = 1.0) -> DataFrame:
    """Shade as straight-alpha RGBA; nodata is transparent."""
    if not 0.0 <= opacity <= 1.0:
        raise ValueError("opacity must be within [0, 1]")
    if tint is not None and (len(tint) != 3 or not all(0 <= int(c) <= 255 for c in tint)):
        raise ValueError("tint must be three ints within 0..255")
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("value")))
    rgb = [F.rint(v)] * 3 if tint is None else [F.rint(v / 255 * c) for c in tint]
    alpha = F.when(F.col("value") == nodata, F.lit(0)).otherwise(F.rint(F.lit(255.0 * opacity)).cast("int"))
    return shade.select("row", "col", *[c.cast("int").alias(n) for c, n in zip(rgb, "rgb")], alpha.alias("a"))


def composite(base: DataFrame, layers: Sequence[DataFrame]) -> DataFrame:
    """Layers laid over the base in order, rounding half to even after each."""
    out = base
    for layer in layers:
        over = layer.select("row", "col", *[F.col(c).alias(f"_{c}") for c in "rgba"])
        both = out.join(over, ["row", "col"])
        ab, ao = F.col("a") / 255, F.col("_a") / 255
        alpha = ao + ab * (1 - ao)
        mix = lambda c: F.when(alpha > 0, F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(
            (F.col(f"_{c}") * ao + F.col(c) * ab * (1 - ao)) / alpha)))).otherwise(F.lit(0.0)).cast("int").alias(c)
        out = both.select("row", "col", *[mix(c) for c in "rgb"], F.rint(alpha * 255).cast("int").alias("a"))
    return out


def elevation_range(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    valid = cells.where(~is_nodata(F.col("value"), F.lit(nodata).cast("double")))
    return valid.agg(F.min("value").alias("z_min"), F.max("value").alias("z_max"))


def normalized_dem(cells: DataFrame, grids: DataFrame, target: dict, inverse, levels: int) -> DataFrame:
    """Mosaic once, warp once onto the target grid, then build the pyramid.

    ``inverse(x, y)`` gives the source coordinates of a target position as columns;
    target cells sample the mosaic bilinearly, so each source cell is read once.
    """
    problems = misaligned(grids).limit(3).collect()
    if problems:
        raise ValueError(f"grids cannot be merged: {[r[0] for r in problems]}")
    merged = checkpointed(mosaic(cells, grids))
    frame = grids.agg(F.min("origin_x"), F.max("origin_y"), F.min_by("pixel_w", "grid_pos"), F.min_by("pixel_h", "grid_pos"),
                      F.max(F.col("origin_x") + F.col("width") * F.col("pixel_w")),
                      F.min(F.col("origin_y") - F.col("height") * F.col("pixel_h"))).first()
    x0, y0, pw, ph, x1, y1 = frame
    source = dict(origin_x=x0, origin_y=y0, pixel_w=pw, pixel_h=ph, width=round((x1 - x0) / pw), height=round((y0 - y1) / ph))
    spark = cells.sparkSession
    total = target["width"] * target["height"]
    grid = spark.range(total).select((F.col("id") / target["width"]).cast("bigint").alias("row"), (F.col("id") % target["width"]).alias("col"))
    x = target["origin_x"] + (F.col("col") + 0.5) * target["pixel_w"]
    y = target["origin_y"] - (F.col("row") + 0.5) * target["pixel_h"]
    sx, sy = inverse(x, y)
    points = grid.select(F.struct("row", "col").alias("cell"), sx.alias("x"), sy.alias("y"))
    warped = bilinear(points, merged, source, "cell").where("value IS NOT NULL").select("cell.row", "cell.col", "value")
    return pyramid(checkpointed(warped), target["width"], target["height"], levels)


# --- elevated lines as arrays ---------------------------------------------------------------

def profile_qa(z: Column, tolerance: float = 0.0) -> Column:
    """struct(vertices, nodata, inversions, max_rise) of a downstream profile array.

    A vertex is an inversion when it tops the last valid vertex before it by more
    than the tolerance; missing vertices neither cause nor hide one.
    """
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(0).alias("inv"), F.lit(0.0).alias("rise"))
    def step(s: Column, v: Column) -> Column:
        up = v.isNotNull() & s["prev"].isNotNull() & (v > s["prev"] + tolerance)
        return F.struct(F.coalesce(v, s["prev"]).alias("prev"), (s["inv"] + F.coalesce(up, F.lit(False)).cast("int")).alias("inv"),
                        F.when(up, F.greatest(s["rise"], v - s["prev"])).otherwise(s["rise"]).alias("rise"))
    folded = F.aggregate(z, start, step)
    return F.struct(F.size(z).alias("vertices"), F.size(F.filter(z, lambda v: v.isNull())).alias("nodata"),
                    folded["inv"].alias("inversions"), folded["rise"].alias("max_rise"))


def monotonic_surface(z: Column, tolerance: float = 0.0, enabled: bool = True) -> Column:
    """Water surface that never climbs: a rise beyond the tolerance is held at the last value."""
    if not enabled:
        return z
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<double>").alias("out"))
    def step(s: Column, v: Column) -> Column:
        held = F.when(v.isNotNull() & s["prev"].isNotNull() & (v > s["prev"] + tolerance), s["prev"]).otherwise(v)
        return F.struct(F.coalesce(held, s["prev"]).alias("prev"), F.array_append(s["out"], held).alias("out"))
    return F.aggregate(z, start, step, lambda s: s["out"])


def qa_rollup(lines: DataFrame, qa: str = "qa") -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.sum(f"{qa}.vertices").alias("vertices"), F.sum(f"{qa}.nodata").alias("nodata"),
                     F.sum(f"{qa}.inversions").alias("inversions"), F.max(f"{qa}.max_rise").alias("max_rise"))


# --- accuracy ---------------------------------------------------------------------------------

def error_metrics(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vertical error over points where truth and sample are both present; the rest are skipped."""
    e = F.col("value") - F.col("expected")
    return samples.groupBy(*keys).agg(
        F.count(e).alias("n_compared"), F.count_if(e.isNull()).alias("n_skipped"), F.max(F.abs(e)).alias("max_abs"),
        F.avg(F.abs(e)).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rmse"))


def coverage(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ok = F.count_if(F.col("covered") & ~F.col("nodata"))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_total"), ok.alias("n_covered"), F.count_if(F.col("covered") & F.col("nodata")).alias("n_nodata"),
        F.count_if(~F.col("covered")).alias("n_uncovered"),
        F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("fraction"))


def accuracy_verdict(metrics: DataFrame, tolerance: float) -> DataFrame:
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    return metrics.withColumn("within_tolerance", (F.col("n_compared") > 0) & F.coalesce(F.col("max_abs") <= tolerance, F.lit(False)))


# --- tile planning ----------------------------------------------------------------------------

def dem_cells(boxes: DataFrame) -> DataFrame:
    """One-degree cell names covering each lon/lat box ``(box_id, min_lon, min_lat, max_lon, max_lat)``."""
    ok = (F.col("min_lon") <= F.col("max_lon")) & (F.col("min_lat") <= F.col("max_lat"))
    checked = boxes.where(F.assert_true(ok, F.lit("box with min above max")).isNull())
    span = lambda lo, hi: F.when(F.ceil(hi) > F.floor(lo), F.sequence(F.floor(lo), F.ceil(hi) - 1)).otherwise(F.array().cast("array<bigint>"))
    west = checked.withColumn("_w", F.explode(span(F.col("min_lon"), F.col("max_lon"))))
    both = west.withColumn("_s", F.explode(span(F.col("min_lat"), F.col("max_lat"))))
    return both.select("box_id", F.format_string("n%02dw%03d", F.col("_s") + 1, F.abs("_w")).alias("tile"))


def within_tile_budget(tiles: DataFrame, budget: int) -> int:
    """Number of distinct tiles; more than the budget is an error before any work starts."""
    n = tiles.select("tile").distinct().count()
    if budget and n > budget:
        raise ValueError(f"{n} tiles exceed the budget of {budget}")
    return n
