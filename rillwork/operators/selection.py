"""Repair, clip and selection of classified features; every candidate ends in one bucket.

Features carry ``pos`` (source order), ``source_id, class, geom_type, parts, crs``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import fixed_values as X
from rillwork.functions import geometry as G
from rillwork.operators import overlay as O
from rillwork.operators import spatial as S
from rillwork.operators.classify import lookup
from rillwork.session import checkpointed

INTERNAL_CRS = "EPSG:5070"


# --- repair ---------------------------------------------------------------------------

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PATH = T.ArrayType(POINT)
GEOMETRY = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
CHECK = T.StructType([T.StructField("invalid", T.BooleanType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(POINT))))])


def meets_itself(parts) -> bool:
    """Whether outlines cross, run along each other, or a ring touches itself.

    Edges are sorted by their left end, so an edge is compared only with those that begin
    before it stops. Rings may touch other rings in points.
    """
    rings = [ring for part in parts for ring in part]
    if any(len({(p["x"], p["y"]) for p in ring[1:]}) < len(ring) - 1 for ring in rings):
        return True
    e = np.array([(a["x"], a["y"], b["x"], b["y"]) for ring in rings for a, b in zip(ring[:-1], ring[1:])], dtype=float).reshape(-1, 4)
    ring = np.repeat(np.arange(len(rings)), [max(len(r) - 1, 0) for r in rings])
    lo, hi = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    order = np.argsort(lo, kind="stable")
    e, ring, lo, hi = e[order], ring[order], lo[order], hi[order]
    stops = np.searchsorted(lo, hi, side="right")
    near = 1e-12
    for i in range(len(e)):
        o, same = e[i + 1:stops[i]], ring[i + 1:stops[i]] == ring[i]
        x0, y0, x1, y1 = e[i]
        dx, dy = x1 - x0, y1 - y0
        ex, ey, wx, wy = o[:, 2] - o[:, 0], o[:, 3] - o[:, 1], o[:, 0] - x0, o[:, 1] - y0
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (wx * ey - wy * ex) / den, (wx * dy - wy * dx) / den
        t_in, u_in = (t > near) & (t < 1 - near), (u > near) & (u < 1 - near)
        t_on, u_on = (t >= -near) & (t <= 1 + near), (u >= -near) & (u <= 1 + near)
        size = dx * dx + dy * dy
        if ((den != 0) & ((t_in & u_in) | (same & (t_in & u_on | u_in & t_on)))).any():
            return True
        line = (den == 0) & (np.abs(dx * wy - dy * wx) <= near * size) if size else np.zeros(len(o), dtype=bool)
        if line.any():
            p, q = (wx * dx + wy * dy)[line], ((wx + ex) * dx + (wy + ey) * dy)[line]
            if (np.minimum(np.maximum(p, q), size) - np.maximum(np.minimum(p, q), 0) > near * size).any():
                return True
    return False


def meet_themselves(e: np.ndarray, ring: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``meets_itself`` by outline for many outlines of few edges; edges carry ring and outline, sorted, the latter from 0."""
    found = np.zeros(group[-1] + 1, dtype=bool)
    # a ring's vertices are the ends of its edges
    order = np.lexsort((e[:, 3], e[:, 2], ring))
    again = (ring[order[1:]] == ring[order[:-1]]) & (e[order[1:], 2:] == e[order[:-1], 2:]).all(axis=1)
    found[group[order[1:][again]]] = True
    lo, hi = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    order = np.lexsort((lo, group))
    e, ring, lo, hi = e[order], ring[order], lo[order], hi[order]
    i, j = O.grouped_pairs(group)
    near_by = lo[j] <= hi[i]
    i, j = i[near_by], j[near_by]
    near, same = 1e-12, ring[i] == ring[j]
    dx, dy, ex, ey = e[i, 2] - e[i, 0], e[i, 3] - e[i, 1], e[j, 2] - e[j, 0], e[j, 3] - e[j, 1]
    wx, wy = e[j, 0] - e[i, 0], e[j, 1] - e[i, 1]
    den = dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (wx * ey - wy * ex) / den, (wx * dy - wy * dx) / den
    t_in, u_in = (t > near) & (t < 1 - near), (u > near) & (u < 1 - near)
    t_on, u_on = (t >= -near) & (t <= 1 + near), (u >= -near) & (u <= 1 + near)
    crossed = (den != 0) & ((t_in & u_in) | (same & (t_in & u_on | u_in & t_on)))
    size = dx * dx + dy * dy
    p, q = wx * dx + wy * dy, (wx + ex) * dx + (wy + ey) * dy
    shared = np.minimum(np.maximum(p, q), size) - np.maximum(np.minimum(p, q), 0)
    run = (size != 0) & (den == 0) & (np.abs(dx * wy - dy * wx) <= near * size) & (shared > near * size)
    found[group[i[crossed | run]]] = True
    return found


@F.arrow_udf(CHECK)
def outline_check(parts: pa.Array) -> pa.Array:
    """Whether outlines meet themselves, and their valid parts if so; outlines of few edges go together."""
    def opened(lists: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return lists.flatten(), np.repeat(owner, sizes)

    sub, outline = opened(parts, np.arange(len(parts)))
    rings, outline = opened(sub, outline)
    points, ring = opened(rings, np.arange(len(rings)))
    xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype(float)
    on = np.flatnonzero(ring[1:] == ring[:-1])
    e, ring = np.hstack([xy[on], xy[on + 1]]), ring[on]
    owner = outline[ring]
    sizes = np.bincount(owner, minlength=len(parts))
    invalid, valid = np.zeros(len(parts), dtype=bool), [None] * len(parts)
    for k in np.flatnonzero(sizes > O.TOGETHER).tolist():
        geom = parts[k].as_py()
        invalid[k] = meets_itself(geom)
        valid[k] = O.as_rows(O.valid_parts(geom)) if invalid[k] else None
    few = np.flatnonzero((sizes > 0) & (sizes <= O.TOGETHER))
    share = np.cumsum(sizes[few] ** 2) // O.PAIRS
    for own in np.split(few, np.flatnonzero(np.diff(share)) + 1):
        if not len(own):
            continue
        mine = np.isin(owner, own)
        at = np.searchsorted(own, owner[mine])
        bad = meet_themselves(e[mine], ring[mine], at)
        invalid[own] = bad
        if bad.any():
            open_ = bad[at]
            made = O.valid_parts_many(e[mine][open_], (np.cumsum(bad) - 1)[at[open_]])
            for k, geom in zip(own[bad].tolist(), made):
                valid[k] = O.as_rows(geom)
    return pa.StructArray.from_arrays([pa.array(invalid), pa.array(valid, GEOMETRY)], ["invalid", "parts"])


def repaired(features: DataFrame) -> DataFrame:
    """Adds repair flags and ``area_m2``/``length_m``; ``dropped`` is empty or collapsed.

    Repeated vertices go; outlines that meet themselves become valid parts of the same
    even-odd ground (a figure of eight becomes two parts); singleton multiparts are unwrapped.
    """
    kind = F.lower("geom_type")
    before = F.size(G.vertices(F.col("parts")))
    # outlines cost far more than their bytes: a file of few splits is dealt to all tasks
    spread = features.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pos")
    out = spread.withColumn("_parts", G.without_repeats(F.col("parts"))).withColumn("_before", before)
    out = out.withColumn("duplicates_removed", F.col("_before") - F.size(G.vertices(F.col("_parts"))))
    polygon = kind.contains("polygon")
    out = out.withColumn("_check", F.when(polygon, outline_check(F.col("_parts"))))
    out = out.withColumn("invalid_fixed", F.coalesce(F.col("_check.invalid"), F.lit(False)))
    out = out.withColumn("_parts", F.when(F.col("invalid_fixed"), F.col("_check.parts")).otherwise(F.col("_parts")))
    single = kind.startswith("multi") & (F.size("_parts") == 1)
    out = out.withColumn("multipart_normalized", F.coalesce(single, F.lit(False)))
    out = out.withColumn("geom_type", F.when(single, F.regexp_replace("geom_type", "(?i)^multi", "")).when(
        F.col("invalid_fixed") & (F.size("_parts") > 1), "MultiPolygon").otherwise(F.col("geom_type")))
    polygon = F.lower("geom_type").contains("polygon")
    out = out.withColumn("area_m2", F.when(polygon, G.area(F.col("_parts"))))
    out = out.withColumn("length_m", F.when(F.lower("geom_type").contains("line"), G.length(F.col("_parts"))))
    empty = F.col("parts").isNull() | (F.col("_before") <= 0)
    flat = (polygon & (F.col("area_m2") == 0)) | (F.col("length_m") == 0)
    out = out.withColumn("dropped", F.when(empty, "empty").when(F.coalesce(flat, F.lit(False)), "collapsed"))
    return out.withColumn("parts", F.col("_parts")).drop("_parts", "_before", "_check")


def repair_stats(fixed: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0))
    return fixed.agg(
        F.count("*").alias("total_in"), F.count_if(F.col("dropped").isNull()).alias("total_out"),
        yes("invalid_fixed").alias("invalid_fixed"), yes("invalid_fixed").alias("self_intersections_fixed"),
        F.count_if(F.col("dropped") == "empty").alias("empties_dropped"),
        F.count_if(F.col("dropped") == "collapsed").alias("collapsed_dropped"),
        F.coalesce(F.sum("duplicates_removed"), F.lit(0)).alias("duplicate_vertices_removed"),
        yes("multipart_normalized").alias("multipart_normalized"))


# --- place in the region -----------------------------------------------------------------

def region_boundary(areas: DataFrame) -> DataFrame | None:
    """Boundary parts; what several of them hold counts once wherever they are used. None when there are none."""
    return None if areas.isEmpty() else areas


def county_boundary(counties: DataFrame, state_fp: str, name: str) -> DataFrame:
    """The parts of one county, by state code and name in any case; refuses a county that is not there."""
    found = counties.where((F.col("statefp") == state_fp) & (F.lower(F.trim("name")) == name.strip().lower()))
    if found.isEmpty():
        raise ValueError(f"no county {name!r} in state {state_fp!r}")
    return found


def _located(features: DataFrame, boundary: DataFrame | None, cell: float) -> DataFrame:
    """Adds ``inside`` (any part in the region), ``clipped`` and the measures of what is inside.

    Polygons and lines are cut to the union of the boundary parts.
    """
    if boundary is None:
        return features.withColumn("inside", F.lit(True)).withColumn("clipped", F.lit(False))
    features = checkpointed(features)
    kind = F.lower("geom_type")
    region = checkpointed(O.union_tiles(boundary.select("poly_pos", "parts"), cell))
    polys = O.clip_polygons(features.where(kind.contains("polygon")).select("pos", "parts"), region, cell)
    lines = S.clip_lines(features.where(kind.contains("line")).select("pos", "parts"), boundary, cell).drop("kept_length")
    cut = polys.unionByName(lines).select("pos", "outcome", F.col("parts").alias("_cut"))
    spots = features.where(kind.contains("point")).select("pos", F.element_at(G.vertices(F.col("parts")), 1).alias("p")).select("pos", "p.x", "p.y")
    inside = S.clip_points(spots, boundary, cell).select("pos", F.col("inside").alias("_in"))
    out = features.join(cut, "pos", "left").join(inside, "pos", "left")
    out = out.withColumn("inside", F.coalesce(F.col("outcome") != "dropped", F.col("_in"), F.lit(False)))
    out = out.withColumn("clipped", F.coalesce(F.col("outcome") == "partial", F.lit(False)))
    polygon, line = F.col("clipped") & kind.contains("polygon"), F.col("clipped") & kind.contains("line")
    return (out.withColumn("parts", F.when(F.col("clipped"), F.col("_cut")).otherwise(F.col("parts")))
            .withColumn("area_m2", F.when(polygon, G.area(F.col("_cut"))).otherwise(F.col("area_m2")))
            .withColumn("length_m", F.when(line, G.length(F.col("_cut"))).otherwise(F.col("length_m")))
            .withColumn("geom_type", F.when(polygon, F.when(F.size("_cut") > 1, "MultiPolygon").otherwise("Polygon")).otherwise(F.col("geom_type")))
            .drop("outcome", "_cut", "_in"))


def _prepared(features: DataFrame, boundary: DataFrame | None, cell: float, target: str = INTERNAL_CRS,
              transforms=None) -> DataFrame:
    moved = features.withColumn("parts", F.when(F.col("class") == "excluded", F.col("parts")).otherwise(
        G.reprojected(F.col("parts"), F.col("crs"), target, transforms)))
    return _located(repaired(moved), boundary, cell)


def _with_duplicates(rows: DataFrame, passes: Column) -> DataFrame:
    """Adds ``dup_of``: the source id of the first passing feature with the same geometry, if it is another."""
    keyed = rows.withColumn("_pass", passes).withColumn("_hash", F.when(F.col("_pass"), F.sha2(
        G.canonical(F.col("parts"), F.col("geom_type")), 256)))
    keyed = checkpointed(keyed)
    first = keyed.where("_pass").groupBy("_hash").agg(F.min(F.struct("pos", "source_id")).alias("_first"))
    out = S.skew_join(keyed, first, ["_hash"], "left")
    other = F.col("_pass") & (F.col("_first.pos") < F.col("pos"))
    return out.withColumn("dup_of", F.when(other, F.col("_first.source_id"))).drop("_hash", "_first", "_pass")


def _m2(v: Column) -> Column:
    return F.concat(F.format_string("%.1f", v), F.lit(" m²"))


def _common_reason() -> Column:
    return (F.when(F.col("class") == "excluded", F.col("inclusion_reason"))
            .when(F.col("dropped") == "empty", "excluded: no geometry")
            .when(F.col("dropped").isNotNull(), F.concat(F.lit("excluded: geometry dropped in repair ("), "dropped", F.lit(")")))
            .when(~F.col("inside"), "excluded: outside region boundary"))


def _bucketed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    bucket = F.when(F.col("_why").isNull(), "selected").otherwise("excluded")
    return rows.select(*columns, bucket.alias("bucket"), F.coalesce("_why", "_kept").alias("reason"))


_OUT = ("pos", "source_id", "class", "area_m2", "clipped")


def select_waterbodies(features: DataFrame, boundary: DataFrame | None = None, cell: float = 1000.0, *,
                       pond_max: float = 0.0, min_inland: float = 0.0, min_coastal: float = 0.0,
                       coastal_mode: str = "conservative", transforms=None) -> DataFrame:
    rows = _prepared(features, boundary, cell, transforms=transforms)
    # only what lies inside is measured, so only that can turn out to be a pond
    small = F.col("inside") & F.col("dropped").isNull() & (F.col("area_m2") < pond_max)
    rows = rows.withColumn("class", F.when((F.col("class") == "lake") & small, "pond").otherwise(F.col("class")))
    coastal = F.col("class").isin(*X.COASTAL_CLASSES)
    limit = F.when(coastal, F.lit(float(min_coastal))).otherwise(F.lit(float(min_inland)))
    fragment = coastal & F.col("clipped") if coastal_mode == "conservative" else F.lit(False)
    why = (_common_reason().when(fragment, "excluded: coastal clip-boundary fragment (conservative coast policy)")
           .when(F.col("area_m2") < limit, F.concat(F.lit("excluded: area "), _m2(F.col("area_m2")), F.lit(" below min "), _m2(limit))))
    rows = _with_duplicates(rows.withColumn("_why", why), F.col("_why").isNull())
    rows = rows.withColumn("_why", F.coalesce("_why", F.concat(F.lit("excluded: duplicate geometry of '"), "dup_of", F.lit("'"))))
    rows = rows.withColumn("_kept", F.concat(F.lit("selected as "), "class", F.lit(": area "), _m2(F.col("area_m2"))))
    return _bucketed(rows, [*_OUT, "geom_type", "parts"])


def flag_shared_edges(selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selection with ``shared_edge`` per selected polygon, and the pairs themselves."""
    chosen = selection.where("bucket = 'selected'").select("pos", "parts")
    pairs = checkpointed(S.shared_edges(chosen))
    touched = pairs.select(F.explode(F.array("a", "b")).alias("pos")).distinct().withColumn("shared_edge", F.lit(True))
    return selection.join(touched, "pos", "left").withColumn("shared_edge", F.coalesce("shared_edge", F.lit(False))), pairs


def select_areal(features: DataFrame, boundary: DataFrame | None = None, cell: float = 1000.0, *,
                 min_area: dict[str, float] | None = None, default_min: float = 0.0, transforms=None) -> DataFrame:
    rows = _prepared(features, boundary, cell, transforms=transforms)
    limit = F.lit(float(default_min)) if not min_area else F.coalesce(lookup(min_area, F.col("class")), F.lit(float(default_min)))
    why = _common_reason().when(F.col("area_m2") < limit, F.concat(
        F.lit("excluded: area "), _m2(F.col("area_m2")), F.lit(" below min "), _m2(limit)))
    rows = _with_duplicates(rows.withColumn("_why", why), F.col("_why").isNull())
    rows = rows.withColumn("_why", F.coalesce("_why", F.concat(F.lit("excluded: duplicate geometry of '"), "dup_of", F.lit("'"))))
    rows = rows.withColumn("_kept", F.concat(F.lit("selected as "), "class", F.lit(": area "), _m2(F.col("area_m2"))))
    return _bucketed(rows, _OUT)


def _thinned(rows: DataFrame, spacing: Column) -> DataFrame:
    """Adds accepted / duplicate-of for point rows that passed so far (``_why`` null)."""
    at = F.element_at(G.vertices(F.col("parts")), 1)
    open_ = checkpointed(rows.where("_why IS NULL").select("pos", "source_id", F.col("class").alias("family"), spacing.alias("spacing"), at.alias("p")).select(
        "pos", "source_id", "family", "spacing", "p.x", "p.y"))
    thin = checkpointed(S.thin_points(open_))
    # at most one point per spot is accepted, so the first accepted one is the only one
    owner = thin.where("accepted").groupBy("x", "y").agg(F.min(F.struct("pos", "source_id")).alias("o"))
    marked = S.skew_join(thin, owner, ["x", "y"], "left")
    twin = F.when(~F.col("accepted") & (F.col("o.pos") < F.col("pos")), F.col("o.source_id"))
    return rows.join(marked.select("pos", "accepted", "spacing", twin.alias("twin_of")), "pos", "left")


def select_points(features: DataFrame, boundary: DataFrame | None = None, cell: float = 1000.0, *,
                  min_spacing: dict[str, float] | None = None, default_spacing: float = 0.0, transforms=None) -> DataFrame:
    rows = _prepared(features, boundary, cell, transforms=transforms).withColumn("_why", _common_reason())
    spacing = F.lit(float(default_spacing)) if not min_spacing else F.coalesce(lookup(min_spacing, F.col("class")), F.lit(float(default_spacing)))
    rows = _thinned(checkpointed(rows), spacing)
    close = F.concat(F.lit("excluded: within "), F.format_string("%.1f", "spacing"), F.lit(" m of a denser-priority "), "class", F.lit(" point (density cap)"))
    why = F.coalesce("_why", F.when(F.col("twin_of").isNotNull(), F.concat(F.lit("excluded: duplicate point of '"), "twin_of", F.lit("'"))).when(~F.col("accepted"), close))
    return _bucketed(rows.withColumn("_why", why).withColumn("_kept", F.concat(F.lit("selected as "), "class")), _OUT)


def select_structures(features: DataFrame, boundary: DataFrame | None = None, cell: float = 1000.0, *,
                      min_area: dict[str, float] | None = None, default_area: float = 0.0,
                      min_spacing: dict[str, float] | None = None, default_spacing: float = 0.0, transforms=None) -> DataFrame:
    """By geometry kind: polygons by area, points by spacing, lines kept once clipped."""
    rows = _prepared(features, boundary, cell, transforms=transforms)
    kind = F.when(F.lower("geom_type").contains("polygon"), "polygon").when(F.lower("geom_type").contains("line"), "line").otherwise("point")
    rows = rows.withColumn("kind", kind)
    limit = F.lit(float(default_area)) if not min_area else F.coalesce(lookup(min_area, F.col("class")), F.lit(float(default_area)))
    spacing = F.lit(float(default_spacing)) if not min_spacing else F.coalesce(lookup(min_spacing, F.col("class")), F.lit(float(default_spacing)))
    why = _common_reason().when((F.col("kind") == "polygon") & (F.col("area_m2") < limit), F.concat(
        F.lit("excluded: area "), _m2(F.col("area_m2")), F.lit(" below min "), _m2(limit)))
    rows = checkpointed(rows.withColumn("_why", why))
    shapes = _with_duplicates(rows.where("kind <> 'point'"), F.col("_why").isNull()).withColumn("_why", F.coalesce(
        "_why", F.concat(F.lit("excluded: duplicate geometry of '"), "dup_of", F.lit("'")))).drop("dup_of")
    dots = _thinned(rows.where("kind = 'point'"), spacing)
    close = F.concat(F.lit("excluded: within "), F.format_string("%.1f", "spacing"), F.lit(" m of a denser-priority "), "class", F.lit(" structure (density cap)"))
    dots = dots.withColumn("_why", F.coalesce("_why", F.when(F.col("twin_of").isNotNull(), F.concat(
        F.lit("excluded: duplicate geometry of '"), "twin_of", F.lit("'"))).when(~F.col("accepted"), close))).drop("accepted", "spacing", "twin_of")
    both = shapes.select(*rows.columns).unionByName(dots.select(*rows.columns))
    kept = F.concat(F.lit("selected as "), "class", F.lit(" ("), "kind", F.lit(")"))
    return _bucketed(both.withColumn("_kept", kept), [*_OUT, "kind"])


def selection_counts(selection: DataFrame) -> DataFrame:
    """Candidates, selected and excluded, and the selected by class, in one pass of grouping sets."""
    cls = F.when(F.col("bucket") == "selected", F.col("class"))
    sets = selection.select("bucket", cls.alias("class")).cube("bucket", "class").agg(
        F.count("*").alias("n"), F.grouping_id("bucket", "class").alias("g"))
    name = F.when(F.col("g") == 3, "candidates").when(F.col("g") == 1, F.col("bucket")).when(
        (F.col("g") == 0) & F.col("class").isNotNull(), F.concat(F.lit("class:"), "class"))
    return sets.select(name.alias("item"), "n").where("item IS NOT NULL")


def exclusion_histogram(selection: DataFrame) -> DataFrame:
    """Excluded features by reason, cut at the figures and names, plus how many lack a source id."""
    said = F.trim(F.split(F.col("reason"), ":")[1])
    short = F.trim(F.regexp_replace(said, r"(area|duplicate geometry of|duplicate point of|within|FType|geometry dropped in repair).*", "$1"))
    return selection.where("bucket = 'excluded'").groupBy(short.alias("reason")).agg(
        F.count("*").alias("n"), F.count_if(F.col("source_id") == "").alias("untraceable"))


def hole_census(polygons: DataFrame) -> DataFrame:
    n = G.holes(F.col("parts"))
    return polygons.agg(F.sum(n).alias("holes"), F.count_if(n > 0).alias("with_holes"), F.count_if(F.size("parts") > 1).alias("multipolygons"))


def global_bounds(features: DataFrame) -> DataFrame:
    b = features.select(G.bounds(F.col("parts")).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return b.agg(zero(F.min("b.min_x")).alias("min_x"), zero(F.min("b.min_y")).alias("min_y"),
                 zero(F.max("b.max_x")).alias("max_x"), zero(F.max("b.max_y")).alias("max_y"))


def placed_markers(points: DataFrame, bounds: DataFrame, width: int, height: int, radius: float) -> DataFrame:
    """Pixel position of points in projected units; those within the canvas and a marker's reach stay."""
    framed = points.withColumn("_b", bounds.select(F.struct("*")).scalar())
    px = (F.col("x") - F.col("_b.min_x")) * (width / (F.col("_b.max_x") - F.col("_b.min_x")))
    py = (F.col("_b.max_y") - F.col("y")) * (height / (F.col("_b.max_y") - F.col("_b.min_y")))
    return framed.withColumn("px", px).withColumn("py", py).drop("_b").where(
        F.col("px").between(-radius, width + radius) & F.col("py").between(-radius, height + radius))


# --- simplification ------------------------------------------------------------------------

def thinned_paths(xy: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices Douglas-Peucker keeps: farther than the tolerance from the chord.

    The paths lie one after another in ``xy``; each round splits the open chords of all of them.
    """
    keep = np.zeros(len(xy), dtype=bool)
    stop = np.cumsum(sizes)
    i, j = (stop - sizes)[sizes > 0], stop[sizes > 0] - 1
    keep[i] = keep[j] = True
    while True:
        wide = j - i > 1
        i, j = i[wide], j[wide]
        if not len(i):
            return keep
        n = j - i - 1
        first = np.cumsum(n) - n
        chord = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(chord)) + (i + 1 - first)[chord]
        d = (xy[j] - xy[i])[chord]
        w = xy[at] - xy[i][chord]
        size = (d * d).sum(axis=1)
        t = np.clip(np.divide((w * d).sum(axis=1), size, out=np.zeros(len(size)), where=size != 0), 0, 1)
        gap = np.hypot(*(w - t[:, None] * d).T)
        top = np.maximum.reduceat(gap, first)
        best = np.flatnonzero(gap == top[chord])[::-1]
        split = np.full(len(i), -1)
        split[chord[best]] = at[best]  # the first of equals is written last
        far = top > tolerance
        keep[split[far]] = True
        i, j = np.concatenate([i[far], split[far]]), np.concatenate([split[far], j[far]])


def thinned_path(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """``thinned_paths`` of one path."""
    return thinned_paths(xy, np.array([len(xy)]), tolerance)


def simplified(paths: DataFrame, tolerance: float, pts: str = "pts") -> DataFrame:
    """Each path simplified and rounded to whole units; paths left with one point go."""
    @F.arrow_udf(PATH)
    def run(series: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(series), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        points = series.flatten()
        xy = np.column_stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype(float)
        keep = thinned_paths(xy, sizes, tolerance)
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets = before[np.concatenate([[0], np.cumsum(sizes)])]
        x, y = np.rint(xy[keep]).T
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([x, y], ["x", "y"]))
    return paths.withColumn(pts, run(F.col(pts))).where(F.size(pts) >= 2)


def widest_paths(paths: DataFrame, width_floor: float, limit: int, tolerance: float) -> DataFrame:
    """The widest ``limit`` paths above a width, simplified; ties in source order."""
    top = paths.where((F.col("width") >= width_floor) & (F.size("pts") >= 2)).orderBy(F.col("width").desc(), "pos").limit(limit)
    return simplified(top, tolerance)


# --- structure quality report ------------------------------------------------------------------

def structure_report(structures: DataFrame, lines: DataFrame, naturals: DataFrame, *, tolerance: float = 250.0,
                     duplicate_tolerance: float = 150.0, cell: float = 1000.0) -> DataFrame:
    """One row: placement, number of duplicate groups, coincidences with natural water."""
    spots = structures.select("pos", "class", "layer", F.element_at(G.vertices(F.col("parts")), 1).alias("p")).select("pos", "class", "layer", "p.x", "p.y")
    summary, _off = S.network_placement(spots.select("pos", "x", "y"), lines, tolerance)
    groups = S.duplicate_groups(spots, duplicate_tolerance).agg(F.count_distinct("root")).scalar()
    clash = S.coincidences(structures, naturals, cell).agg(F.count("*")).scalar()
    return summary.withColumn("duplicate_groups", groups).withColumn("overlaps", clash).withColumn("separation_ok", F.col("overlaps") == 0)


def write_paths(features: DataFrame, path: str, places: int = 2, closed: bool = False) -> None:
    """Drawing text per feature, ordered by basin across and inside the files."""
    path_table(features, places, closed).repartitionByRange("huc", "pos").sortWithinPartitions("huc", "pos").select(
        F.concat_ws("\t", "huc", F.col("pos").cast("string"), "d").alias("value")).write.mode("overwrite").text(path)


def path_table(features: DataFrame, places: int = 2, closed: bool = False) -> DataFrame:
    frame = global_bounds(features).select(F.struct("*")).scalar()
    return features.withColumn("_b", frame).select(
        "huc", "pos", G.path_text(F.col("parts"), F.col("_b.min_x"), F.col("_b.max_y"), places, closed).alias("d"))
