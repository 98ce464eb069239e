"""Column functions over nested-array geometry.

A geometry is ``parts``: array of parts, each an array of rings, each an array of
``struct<x double, y double>``. A line part has one ring (its path), a point part
one ring of one point. Polygon rings are closed; the first ring is the shell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def path(*points: Column) -> Column:
    return F.array(F.array(F.array(*points)))


def box(x0, y0, x1, y1) -> Column:
    """Closed axis-aligned rectangle as a one-part polygon."""
    return path(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _gaps(ring: Column, fn) -> Column:
    """fn(a, b) for each pair of neighbouring points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), fn)


def ring_area(ring: Column) -> Column:
    """Signed area, positive when counter-clockwise; taken about the first point."""
    o = F.element_at(ring, 1)
    return _total(_gaps(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2


def area(parts: Column) -> Column:
    one = lambda part: 2 * F.abs(ring_area(F.element_at(part, 1))) - _total(F.transform(part, lambda r: F.abs(ring_area(r))))
    return _total(F.transform(parts, one))


def length(parts: Column) -> Column:
    one = lambda part: _total(F.transform(part, lambda r: _total(_gaps(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))))
    return _total(F.transform(parts, one))


def vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def bounds(parts: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y); null fields for an empty geometry."""
    xs, ys = F.transform(vertices(parts), lambda p: p["x"]), F.transform(vertices(parts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                    F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def holes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.size(p) - 1)


def without_repeats(parts: Column) -> Column:
    """Consecutive equal vertices collapsed to one."""
    ring = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    return F.transform(parts, lambda part: F.transform(part, ring))


def canonical(parts: Column, geom_type: Column) -> Column:
    """Text that is equal for equal geometries whatever their start vertex or direction."""
    def turned(r: Column) -> Column:
        body = F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))
        first = F.array_position(body, F.array_min(body)).cast("int")
        spun = F.concat(F.slice(body, first, F.size(body)), F.slice(body, F.lit(1), first - 1))
        back = F.concat(F.slice(spun, 1, 1), F.reverse(F.slice(spun, F.lit(2), F.size(spun))))
        return F.when(ring_area(r) >= 0, spun).otherwise(back)
    forward = lambda r: F.when(F.element_at(r, 1) <= F.element_at(r, -1), r).otherwise(F.reverse(r))
    poly = F.array_sort(F.transform(parts, lambda part: F.array_sort(F.transform(part, turned))))
    line = F.array_sort(F.transform(parts, lambda part: F.transform(part, forward)))
    return F.concat(F.lower(geom_type), F.lit(":"), F.when(F.lower(geom_type).contains("polygon"), poly).otherwise(line).cast("string"))


def moved(parts: Column, fn) -> Column:
    """Every vertex through ``fn(x, y) -> (x, y)``; any column-to-column transform fits."""
    def one(p: Column) -> Column:
        x, y = fn(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    return F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, one)))


# --- projections, closed forms on the GRS80 / WGS84 ellipsoids -----------------------------

_A, _F = 6378137.0, 1 / 298.257222101
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)
_LAT1, _LAT2, _LAT0, _LON0 = (math.radians(v) for v in (29.5, 45.5, 23.0, -96.0))


def _q(sin):
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m(lat):
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


_N = (_m(_LAT1) ** 2 - _m(_LAT2) ** 2) / (_q(math.sin(_LAT2)) - _q(math.sin(_LAT1)))
_C = _m(_LAT1) ** 2 + _N * _q(math.sin(_LAT1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.sin(_LAT0))) / _N


def to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to the conterminous-US equal-area grid (NAD83 and WGS84 taken as one)."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(_C - _N * q) / _N
    theta = _N * (F.radians(lon) - _LON0)
    return rho * F.sin(theta), _RHO0 - rho * F.cos(theta)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _A, F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * _A


TRANSFORMS = {
    ("EPSG:4326", "EPSG:5070"): to_albers, ("EPSG:4269", "EPSG:5070"): to_albers,
    ("EPSG:4326", "EPSG:3857"): to_mercator, ("EPSG:4269", "EPSG:3857"): to_mercator,
    ("EPSG:4269", "EPSG:4326"): lambda x, y: (x, y), ("EPSG:4326", "EPSG:4269"): lambda x, y: (x, y),
}


def reprojected(parts: Column, crs: Column, target: str, transforms=None) -> Column:
    """Vertex-wise reprojection by the row's own CRS; a missing or unknown CRS raises."""
    table = TRANSFORMS if transforms is None else transforms
    out = F.when(crs == target, parts)
    for (src, dst), fn in table.items():
        if dst == target:
            out = out.when(crs == src, moved(parts, fn))
    return out.otherwise(F.raise_error(F.concat(F.lit("no transform from "), F.coalesce(crs, F.lit("an unknown CRS")))).cast(GEOMETRY))


# --- text of paths ------------------------------------------------------------------------------

def path_text(parts: Column, min_x: Column, max_y: Column, places: int, closed: bool = False) -> Column:
    """Drawing commands of a geometry: origin at the top left, y down, short numbers.

    Lines give ``M x,y L x,y``; closed rings drop the repeated end point for a ``Z``.
    """
    from rillwork.functions.styling import number_text
    spot = lambda p: F.concat(number_text(p["x"] - min_x, places), F.lit(","), number_text(max_y - p["y"], places))
    spots = F.transform(F.flatten(parts), lambda r: F.transform(r, spot))
    if closed:
        n = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.size(r) - 1).otherwise(F.size(r))
        spots = F.filter(F.transform(spots, lambda r: F.slice(r, F.lit(1), n(r))), lambda r: F.size(r) >= 2)
    ring = lambda r: F.concat(F.lit("M "), F.array_join(r, " L "), F.lit(" Z" if closed else ""))
    return F.array_join(F.transform(F.filter(spots, lambda r: F.size(r) > 0), ring), " ")
