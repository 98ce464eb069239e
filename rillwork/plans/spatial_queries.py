"""Geometry jobs over shapes derived from the given tables (boxes keep the SQL answers exact)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.functions import geometry as G
from rillwork.operators import overlay as O
from rillwork.operators import selection as Z
from rillwork.operators import spatial as S
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import R
from rillwork.session import checkpointed

# nations tile a 1000 x 1000 square, five by five
_NATIONS = """nb AS (SELECT n_nationkey AS poly_pos, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, n_name AS name, (n_nationkey % 5) * 200.0 AS x0, (n_nationkey // 5) * 200.0 AS y0 FROM nation)"""
_POINTS = "pt AS (SELECT c_custkey AS pos, (c_custkey * 37 % 1100) + 0.5 AS x, (c_custkey * 91 % 1100) + 0.25 AS y FROM customer)"
# one box per part, drifting over the square
_BOXES = """bx AS (SELECT p_partkey AS pos, (p_partkey * 53 % 1040) * 1.0 AS x0, (p_partkey * 29 % 1040) * 1.0 AS y0, (p_partkey * 53 % 1040) + 4.0 + p_size AS x1, (p_partkey * 29 % 1040) + 3.0 + p_size % 17 AS y1, p_size, p_brand FROM part)"""
CELL = 64.0


def _nations(spark, sf):
    k = F.col("n_nationkey")
    x, y = k % 5 * 200.0, F.floor(k / 5) * 200.0
    return T.table(spark, sf, "nation").select(k.cast("bigint").alias("poly_pos"), F.lpad(k.cast("string"), 4, "0").alias("code"), F.col("n_name").alias("name"),
                                               G.box(x, y, x + 200, y + 200).alias("parts"))


def _points(spark, sf):
    k = F.col("c_custkey")
    return T.table(spark, sf, "customer").select(k.alias("pos"), (k * 37 % 1100 + 0.5).alias("x"), (k * 91 % 1100 + 0.25).alias("y"))


def _boxes(spark, sf):
    k = F.col("p_partkey")
    x0, y0 = k * 53 % 1040 * 1.0, k * 29 % 1040 * 1.0
    return T.table(spark, sf, "part").select(
        k.alias("pos"), G.box(x0, y0, x0 + 4.0 + F.col("p_size"), y0 + 3.0 + F.col("p_size") % 17).alias("parts"), "p_size", "p_brand")


@query("point_in_polygon", "JN-03", "FAC-09", sql=f"""WITH {_NATIONS}, {_POINTS}, h AS (SELECT p.pos, min(n.poly_pos) AS k FROM pt p JOIN nb n ON p.x >= n.x0 AND p.x < n.x0 + 200 AND p.y >= n.y0 AND p.y < n.y0 + 200 GROUP BY 1)
SELECT p.pos, coalesce(n.code, '0000') AS code, n.name FROM pt p LEFT JOIN h ON h.pos = p.pos LEFT JOIN nb n ON n.poly_pos = h.k""")
def _(spark, sf):
    return S.assign_watersheds(_points(spark, sf), _nations(spark, sf), 4, CELL).select("pos", "code", "name")


_INTER = "greatest(0, least(b.x1, n.x0 + 200) - greatest(b.x0, n.x0)) * greatest(0, least(b.y1, n.y0 + 200) - greatest(b.y0, n.y0))"


@query("overlap_fraction", "JN-04", sql=f"""WITH {_NATIONS}, bx AS (SELECT n_nationkey AS pos, n_nationkey * 41.5 AS x0, n_nationkey * 33.25 AS y0, n_nationkey * 41.5 + 70 + n_nationkey AS x1, n_nationkey * 33.25 + 60 AS y1 FROM nation),
 s AS (SELECT b.pos, sum({_INTER}) / any_value((b.x1 - b.x0) * (b.y1 - b.y0)) AS f FROM bx b JOIN nb n ON n.poly_pos % 2 = 0 GROUP BY 1)
SELECT lpad(CAST(pos AS VARCHAR), 4, '0') AS huc4, round(f, 6) AS fraction FROM s WHERE f >= 0.2""")
def _(spark, sf):
    k = F.col("n_nationkey")
    x, y = k * 41.5, k * 33.25
    basins = T.table(spark, sf, "nation").select(k.cast("bigint").alias("pos"), k.cast("string").alias("huc4"), G.box(x, y, x + 70 + k, y + 60).alias("parts"))
    return S.overlap_fraction(basins, _nations(spark, sf).where("poly_pos % 2 = 0"), CELL, 0.2).withColumn("fraction", R(F.col("fraction")))


@query("shared_area", "JN-07", sql=f"WITH {_NATIONS}, {_BOXES} SELECT b.pos, n.poly_pos, round({_INTER}, 5) AS shared FROM bx b JOIN nb n ON b.x1 > n.x0 AND b.x0 < n.x0 + 200 AND b.y1 > n.y0 AND b.y0 < n.y0 + 200")
def _(spark, sf):
    out = S.overlap_area(_boxes(spark, sf).select("pos", "parts"), _nations(spark, sf).select("poly_pos", "parts"), "pos", "poly_pos", CELL)
    return out.withColumn("shared", R(F.col("shared"), 5))


@query("canal_separation", "JN-07", sql=f"""WITH {_NATIONS}, {_BOXES}, f AS (SELECT b.pos, n.poly_pos, {_INTER} / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS f FROM bx b JOIN nb n ON n.poly_pos % 3 = 0 AND b.pos % 3 = 0
  AND b.x1 > n.x0 AND b.x0 < n.x0 + 200 AND b.y1 > n.y0 AND b.y0 < n.y0 + 200),
 l AS (SELECT b.pos, n.poly_pos, greatest(0, least(b.x1, n.x0 + 200) - greatest(b.x0, n.x0)) / (b.x1 - b.x0) AS f FROM bx b JOIN nb n ON n.poly_pos % 3 = 0 AND b.pos % 3 = 1 AND b.y0 + 0.5 > n.y0 AND b.y0 + 0.5 < n.y0 + 200 AND b.x1 > n.x0 AND b.x0 < n.x0 + 200),
 p AS (SELECT b.pos, n.poly_pos, 1.0 AS f FROM bx b JOIN nb n ON n.poly_pos % 3 = 0 AND b.pos % 3 = 2 AND b.x0 + 0.5 > n.x0 AND b.x0 + 0.5 < n.x0 + 200 AND b.y0 + 0.5 > n.y0 AND b.y0 + 0.5 < n.y0 + 200)
SELECT pos, poly_pos, round(f, 5) AS fraction FROM (SELECT * FROM f UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p) WHERE f >= 0.5""")
def _(spark, sf):
    b = _boxes(spark, sf).withColumn("b", G.bounds(F.col("parts")))
    k = F.col("pos") % 3
    line = G.path(G.point(F.col("b.min_x"), F.col("b.min_y") + 0.5), G.point(F.col("b.max_x"), F.col("b.min_y") + 0.5))
    dot = G.path(G.point(F.col("b.min_x") + 0.5, F.col("b.min_y") + 0.5))
    shapes = b.select("pos", F.when(k == 0, "Polygon").when(k == 1, "LineString").otherwise("Point").alias("geom_type"),
                      F.when(k == 0, F.col("parts")).when(k == 1, line).otherwise(dot).alias("parts"))
    return S.coincidences(shapes, _nations(spark, sf).where("poly_pos % 3 = 0"), CELL).withColumn("fraction", R(F.col("fraction"), 5))


@query("clip_lines", "GEO-04", "GEO-03", sql=f"""WITH {_BOXES}, l AS (SELECT pos, x0, x1, y0 + 0.5 AS y, greatest(0, least(x1, 800) - greatest(x0, 200)) AS k FROM bx), m AS (SELECT *, CASE WHEN y > 200 AND y < 800 THEN k ELSE 0 END AS kept FROM l)
SELECT pos, CASE WHEN kept = 0 THEN 'dropped' WHEN kept = x1 - x0 THEN 'covered' ELSE 'partial' END AS outcome, round(kept, 5) AS kept_length,
 CASE WHEN kept = 0 THEN NULL WHEN kept = x1 - x0 THEN x0 ELSE greatest(x0, 200) END AS start_x FROM m""")
def _(spark, sf):
    b = _boxes(spark, sf).select("pos", G.bounds(F.col("parts")).alias("b"))
    lines = b.select("pos", G.path(G.point(F.col("b.min_x"), F.col("b.min_y") + 0.5), G.point(F.col("b.max_x"), F.col("b.min_y") + 0.5)).alias("parts"))
    region = _nations(spark, sf).where("poly_pos % 5 BETWEEN 1 AND 3 AND poly_pos BETWEEN 5 AND 19")
    out = S.clip_lines(lines, Z.region_boundary(region), CELL)
    return out.select("pos", "outcome", R(F.col("kept_length"), 5).alias("kept_length"), R(G.bounds(F.col("parts"))["min_x"], 5).alias("start_x"))


@query("area_length_bounds", "GEO-05", "GEO-11", sql=f"WITH {_BOXES} SELECT pos, round((x1 - x0) * (y1 - y0), 5) AS area, round(2 * (x1 - x0) + 2 * (y1 - y0), 5) AS length, x0 AS min_x, y1 AS max_y FROM bx")
def _(spark, sf):
    g = G.bounds(F.col("parts"))
    return _boxes(spark, sf).select("pos", R(G.area(F.col("parts")), 5).alias("area"), R(G.length(F.col("parts")), 5).alias("length"), g["min_x"].alias("min_x"), g["max_y"].alias("max_y"))


@query("global_bounds", "GEO-11", sql=f"WITH {_BOXES} SELECT min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM bx")
def _(spark, sf):
    return Z.global_bounds(_boxes(spark, sf))


@query("hole_census", "GEO-12", sql="SELECT CAST(sum(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS holes, count(*) FILTER (p_size % 3 = 0) AS with_holes, count(*) FILTER (p_size % 5 = 0) AS multipolygons FROM part")
def _(spark, sf):
    b = _boxes(spark, sf)
    ring = F.element_at(F.element_at("parts", 1), 1)
    shell = F.when(F.col("p_size") % 3 == 0, F.array(ring, ring)).otherwise(F.array(ring))
    return Z.hole_census(b.select(F.when(F.col("p_size") % 5 == 0, F.array(shell, F.array(ring))).otherwise(F.array(shell)).alias("parts")))


@query("reprojection", "GEO-02", "UDF-02", sql="""WITH p AS (SELECT c_custkey AS pos, -124.0::DOUBLE + (c_custkey % 570) / 10.0::DOUBLE AS lon, 25.0::DOUBLE + (c_custkey % 240) / 10.0::DOUBLE AS lat FROM customer),
 k AS (SELECT 6378137.0::DOUBLE AS a, 2 * (1 / 298.257222101::DOUBLE) - (1 / 298.257222101::DOUBLE) ** 2 AS e2),
 q AS (SELECT k.*, sqrt(e2) AS e FROM k),
 c AS (SELECT q.*, (1 - e2) * (sin(radians(29.5)) / (1 - e2 * sin(radians(29.5)) ** 2) - ln((1 - e * sin(radians(29.5))) / (1 + e * sin(radians(29.5)))) / (2 * e)) AS q1,
  (1 - e2) * (sin(radians(45.5)) / (1 - e2 * sin(radians(45.5)) ** 2) - ln((1 - e * sin(radians(45.5))) / (1 + e * sin(radians(45.5)))) / (2 * e)) AS q2,
  (1 - e2) * (sin(radians(23.0)) / (1 - e2 * sin(radians(23.0)) ** 2) - ln((1 - e * sin(radians(23.0))) / (1 + e * sin(radians(23.0)))) / (2 * e)) AS q0,
  cos(radians(29.5)) / sqrt(1 - e2 * sin(radians(29.5)) ** 2) AS m1, cos(radians(45.5)) / sqrt(1 - e2 * sin(radians(45.5)) ** 2) AS m2 FROM q),
 n AS (SELECT c.*, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM c), z AS (SELECT n.*, m1 * m1 + n * q1 AS cc FROM n),
 r AS (SELECT p.*, z.*, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS ql FROM p, z)
SELECT pos, round(a * sqrt(cc - n * ql) / n * sin(n * (radians(lon) - radians(-96.0))), 3) AS x, round(a * sqrt(cc - n * q0) / n - a * sqrt(cc - n * ql) / n * cos(n * (radians(lon) - radians(-96.0))), 3) AS y FROM r""")
def _(spark, sf):
    k = F.col("c_custkey")
    geo = T.table(spark, sf, "customer").select(k.alias("pos"), G.path(G.point(-124.0 + k % 570 / 10.0, 25.0 + k % 240 / 10.0)).alias("parts"), F.lit("EPSG:4269").alias("crs"))
    out = geo.select("pos", F.element_at(G.vertices(G.reprojected(F.col("parts"), F.col("crs"), "EPSG:5070")), 1).alias("p"))
    return out.select("pos", R(F.col("p.x"), 3).alias("x"), R(F.col("p.y"), 3).alias("y"))


@query("repair_statistics", "GEO-01", sql="""SELECT count(*) AS total_in, count(*) FILTER (p_size % 11 <> 0 AND p_size % 7 <> 0) AS total_out, count(*) FILTER (p_size % 11 <> 0 AND (p_size % 7 = 0 OR p_size % 5 = 0)) AS invalid_fixed,
 count(*) FILTER (p_size % 11 <> 0 AND (p_size % 7 = 0 OR p_size % 5 = 0)) AS self_intersections_fixed, count(*) FILTER (p_size % 11 = 0) AS empties_dropped, count(*) FILTER (p_size % 11 <> 0 AND p_size % 7 = 0) AS collapsed_dropped,
 CAST(coalesce(sum(CASE WHEN p_size % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0 AND p_size % 2 = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS duplicate_vertices_removed,
 count(*) FILTER (p_size % 3 = 0 AND p_size % 11 <> 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0) AS multipart_normalized FROM part""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = k % 100 * 1.0, k % 77 * 1.0
    p = lambda dx, dy: G.point(x + dx, y + dy)
    flat = G.path(p(0, 0), p(2, 0), p(4, 0), p(0, 0))
    bow = G.path(p(0, 0), p(4, 4), p(4, 0), p(0, 4), p(0, 0))
    twice = G.path(p(0, 0), p(4, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0))
    plain = G.path(p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0))
    shape = F.when(s % 11 == 0, F.lit(None)).when(s % 7 == 0, flat).when(s % 5 == 0, bow).when(s % 2 == 0, twice).otherwise(plain)
    feats = T.table(spark, sf, "part").select(k.alias("pos"), F.when(s % 3 == 0, "MultiPolygon").otherwise("Polygon").alias("geom_type"), shape.alias("parts"))
    return Z.repair_stats(Z.repaired(feats))


@query("repaired_outlines", "GEO-01", sql="""SELECT p_partkey AS pos, p_size % 4 < 3 AS invalid, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END AS n_parts,
 CASE p_size % 4 WHEN 0 THEN 8 WHEN 1 THEN 8 WHEN 2 THEN 20 ELSE 10 END AS n_points, CASE p_size % 4 WHEN 0 THEN 8.0 WHEN 1 THEN 2.0 WHEN 2 THEN 22.0 ELSE 20.0 END AS area FROM part""")
def _(spark, sf):
    # a bow-tie, two triangles that meet in a point, two crossing rings (four arms are left), a box with a hole
    k, s = F.col("p_partkey"), F.col("p_size") % 4
    x, y = k % 1000 * 1.0, k % 770 * 1.0
    p = lambda dx, dy: G.point(x + dx, y + dy)
    bow = G.path(p(0, 0), p(4, 4), p(4, 0), p(0, 4), p(0, 0))
    eight = G.path(p(0, 0), p(1, 1), p(0, 2), p(2, 2), p(1, 1), p(2, 0), p(0, 0))
    cross = F.array(F.array(F.array(p(0, 2), p(6, 2), p(6, 4), p(0, 4), p(0, 2)), F.array(p(2, 0), p(4, 0), p(4, 9), p(2, 9), p(2, 0))))
    holed = F.array(F.array(F.array(p(0, 0), p(6, 0), p(6, 4), p(0, 4), p(0, 0)), F.array(p(1, 1), p(3, 1), p(3, 3), p(1, 3), p(1, 1))))
    shape = F.when(s == 0, bow).when(s == 1, eight).when(s == 2, cross).otherwise(holed)
    out = Z.repaired(T.table(spark, sf, "part").select(k.alias("pos"), F.lit("Polygon").alias("geom_type"), shape.alias("parts")))
    return out.select("pos", F.col("invalid_fixed").alias("invalid"), F.size("parts").alias("n_parts"),
                      F.size(G.vertices(F.col("parts"))).alias("n_points"), R(F.col("area_m2"), 5).alias("area"))


# overlapping boxes, one per supplier, whose union is a ragged region
_AREAS = "ar AS (SELECT s_suppkey AS poly_pos, s_suppkey * 37 % 960 AS x0, s_suppkey * 91 % 950 AS y0, s_suppkey * 37 % 960 + 40 + s_suppkey % 31 AS x1, s_suppkey * 91 % 950 + 30 + s_suppkey % 23 AS y1 FROM supplier)"
_GROUND = f"{_AREAS}, xs AS (SELECT *, unnest(range(x0, x1)) AS x FROM ar), gr AS (SELECT DISTINCT x, y FROM (SELECT x, unnest(range(y0, y1)) AS y FROM xs))"


def _areas(spark, sf):
    k = F.col("s_suppkey")
    x, y = k * 37 % 960, k * 91 % 950
    return T.table(spark, sf, "supplier").select(k.alias("poly_pos"), G.box(x, y, x + 40 + k % 31, y + 30 + k % 23).alias("parts"))


@query("cut_polygons", "GEO-04", sql=f"""WITH {_BOXES}, {_GROUND}, bc AS (SELECT pos, x, unnest(range(y0::BIGINT, y1::BIGINT)) AS y FROM (SELECT *, unnest(range(x0::BIGINT, x1::BIGINT)) AS x FROM bx)),
 held AS (SELECT bc.* FROM bc JOIN gr USING (x, y)), n AS (SELECT pos, count(*) AS c FROM held GROUP BY 1),
 r AS (SELECT a.pos, count(*) AS k FROM held a JOIN held b ON a.pos = b.pos AND a.y = b.y AND b.x = a.x + 1 GROUP BY 1), u AS (SELECT a.pos, count(*) AS k FROM held a JOIN held b ON a.pos = b.pos AND a.x = b.x AND b.y = a.y + 1 GROUP BY 1)
SELECT bx.pos, CASE WHEN c IS NULL THEN 'dropped' WHEN c = (x1 - x0) * (y1 - y0) THEN 'covered' ELSE 'partial' END AS outcome, c::DOUBLE AS area,
 (4 * c - 2 * coalesce(r.k, 0) - 2 * coalesce(u.k, 0))::DOUBLE AS length FROM bx LEFT JOIN n USING (pos) LEFT JOIN r USING (pos) LEFT JOIN u USING (pos)""")
def _(spark, sf):
    out = O.clip_polygons(_boxes(spark, sf).select("pos", "parts"), O.union_tiles(_areas(spark, sf), CELL), CELL)
    return out.select("pos", "outcome", R(G.area(F.col("parts")), 4).alias("area"), R(G.length(F.col("parts")), 4).alias("length"))


@query("dissolved_region", "GEO-03", sql=f"""WITH RECURSIVE {_AREAS}, e AS (SELECT a.poly_pos AS a, b.poly_pos AS b FROM ar a JOIN ar b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
 reach AS (SELECT a AS pos, b AS root FROM e UNION SELECT e.a, reach.root FROM reach JOIN e ON e.b = reach.pos), root AS (SELECT pos, min(root) AS region FROM reach GROUP BY 1),
 xs AS (SELECT *, unnest(range(x0, x1)) AS x FROM ar JOIN root ON pos = poly_pos), g AS (SELECT DISTINCT region, x, y FROM (SELECT region, x, unnest(range(y0, y1)) AS y FROM xs)),
 n AS (SELECT region, count(*) AS c FROM g GROUP BY 1), r AS (SELECT a.region, count(*) AS k FROM g a JOIN g b ON a.region = b.region AND a.y = b.y AND b.x = a.x + 1 GROUP BY 1),
 u AS (SELECT a.region, count(*) AS k FROM g a JOIN g b ON a.region = b.region AND a.x = b.x AND b.y = a.y + 1 GROUP BY 1)
SELECT region, c::DOUBLE AS area, (4 * c - 2 * r.k - 2 * u.k)::DOUBLE AS length FROM n JOIN r USING (region) JOIN u USING (region)""")
def _(spark, sf):
    out = O.dissolved(_areas(spark, sf), CELL)
    return out.select("region", R(G.area(F.col("parts")), 4).alias("area"), R(G.length(F.col("parts")), 4).alias("length"))


@query("county_scope", "GEO-03", "GEO-04", sql=f"""WITH {_BOXES}, {_AREAS}, c AS (SELECT ar.* FROM ar JOIN supplier ON s_suppkey = poly_pos ORDER BY poly_pos LIMIT 1),
 h AS (SELECT bx.pos, greatest(0, least(bx.x1, c.x1) - greatest(bx.x0, c.x0)) * greatest(0, least(bx.y1, c.y1) - greatest(bx.y0, c.y0)) AS area, (bx.x1 - bx.x0) * (bx.y1 - bx.y0) AS own FROM bx, c)
SELECT pos, CASE WHEN area = own THEN 'covered' ELSE 'partial' END AS outcome, area FROM h WHERE area > 0""")
def _(spark, sf):
    named = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("poly_pos"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("statefp"), F.col("s_name").alias("name"))
    chosen = named.orderBy("poly_pos").first()
    county = Z.county_boundary(_areas(spark, sf).join(named, "poly_pos"), chosen["statefp"], chosen["name"].upper())
    out = O.clip_polygons(_boxes(spark, sf).select("pos", "parts"), O.union_tiles(county, CELL), CELL)
    return out.where("outcome <> 'dropped'").select("pos", "outcome", R(G.area(F.col("parts")), 4).alias("area"))


_WB = f"""{_BOXES}, w AS (SELECT b.*, CASE b.p_size % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'lake' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'bay' WHEN 4 THEN 'coastal' WHEN 5 THEN 'lake' ELSE 'inlet' END AS cls FROM bx b),
 g AS (SELECT *, greatest(0, least(x1, 800) - greatest(x0, 200)) * greatest(0, least(y1, 800) - greatest(y0, 200)) AS shared, (x1 - x0) * (y1 - y0) AS own FROM w),
 h AS (SELECT *, shared < own AND shared > 0 AS clipped, CASE WHEN cls = 'lake' AND shared > 0 AND shared < 300 THEN 'pond' ELSE cls END AS class, cls IN ('bay', 'inlet', 'coastal') AS coast FROM g),
 i AS (SELECT *, cls <> 'excluded' AND shared > 0 AND NOT (coast AND clipped) AND shared >= CASE WHEN coast THEN 200 ELSE 120 END AS ok FROM h),
 j AS (SELECT *, row_number() OVER (PARTITION BY ok, greatest(x0, 200), greatest(y0, 200), least(x1, 800), least(y1, 800) ORDER BY pos) AS k FROM i)"""


def _waterbodies(spark, sf):
    cls = F.expr("CASE p_size % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'lake' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'bay' WHEN 4 THEN 'coastal' WHEN 5 THEN 'lake' ELSE 'inlet' END")
    return _boxes(spark, sf).select("pos", F.concat(F.lit("s"), "pos").alias("source_id"), cls.alias("class"), F.lit("Polygon").alias("geom_type"), "parts",
                                    F.lit("EPSG:5070").alias("crs"), F.lit("excluded: by code").alias("inclusion_reason"))


def _region(spark, sf):
    return _nations(spark, sf).where("poly_pos % 5 BETWEEN 1 AND 3 AND poly_pos BETWEEN 5 AND 19")


def _selected(spark, sf):
    return Z.select_waterbodies(_waterbodies(spark, sf), _region(spark, sf), CELL, pond_max=300, min_inland=120, min_coastal=200)


@query("waterbody_selection", "GEO-06", sql=f"""WITH {_WB} SELECT pos, CASE WHEN cls = 'excluded' THEN cls ELSE class END AS class, CASE WHEN ok AND k = 1 THEN 'selected' ELSE 'excluded' END AS bucket,
 CASE WHEN cls = 'excluded' THEN 'by code' WHEN shared = 0 THEN 'outside' WHEN coast AND clipped THEN 'fragment' WHEN NOT ok THEN 'area' WHEN k > 1 THEN 'duplicate' ELSE 'kept' END AS why FROM j""")
def _(spark, sf):
    r = F.col("reason")
    why = (F.when(r.contains("by code"), "by code").when(r.contains("outside"), "outside").when(r.contains("fragment"), "fragment")
           .when(r.startswith("excluded: area"), "area").when(r.contains("duplicate"), "duplicate").otherwise("kept"))
    return _selected(spark, sf).select("pos", "class", "bucket", why.alias("why"))


@query("selected_shared_edges", "JN-08", "GEO-06", sql=f"""WITH {_WB}, c AS (SELECT pos, greatest(x0, 200) AS x0, greatest(y0, 200) AS y0, least(x1, 800) AS x1, least(y1, 800) AS y1 FROM j WHERE ok AND k = 1)
SELECT a.pos AS a, b.pos AS b FROM c a JOIN c b ON a.pos < b.pos AND (((a.x0 IN (b.x0, b.x1) OR a.x1 IN (b.x0, b.x1)) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))
 OR ((a.y0 IN (b.y0, b.y1) OR a.y1 IN (b.y0, b.y1)) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)))""")
def _(spark, sf):
    return Z.flag_shared_edges(checkpointed(_selected(spark, sf)))[1]


@query("selection_counts", "AGG-36", sql=f"""WITH {_WB}, s AS (SELECT class, ok AND k = 1 AS sel FROM j) SELECT 'candidates' AS item, count(*) AS n FROM s UNION ALL SELECT CASE WHEN sel THEN 'selected' ELSE 'excluded' END, count(*) FROM s GROUP BY sel
UNION ALL SELECT concat('class:', class), count(*) FROM s WHERE sel GROUP BY class""")
def _(spark, sf):
    return Z.selection_counts(_selected(spark, sf))


@query("exclusion_reasons", "AGG-37", sql=f"""WITH {_WB}, r AS (SELECT CASE WHEN cls = 'excluded' THEN 'by code' WHEN shared = 0 THEN 'outside region boundary' WHEN coast AND clipped THEN 'coastal clip-boundary fragment (conservative coast policy)' WHEN NOT ok THEN 'area' WHEN k > 1 THEN 'duplicate geometry of' END AS reason FROM j)
SELECT reason, count(*) AS n, 0 AS untraceable FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return Z.exclusion_histogram(_selected(spark, sf))


@query("areal_selection", "GEO-07", sql=f"""WITH {_BOXES}, a AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'wetland' WHEN 1 THEN 'playa' ELSE 'perennial_ice' END AS class, (x1 - x0) * (y1 - y0) AS own FROM bx),
 o AS (SELECT *, own >= CASE class WHEN 'wetland' THEN 250 ELSE 90 END AS ok FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY ok, x0, y0, x1, y1 ORDER BY pos) AS k FROM o)
SELECT pos, class, CASE WHEN ok AND k = 1 THEN 'selected' ELSE 'excluded' END AS bucket FROM k""")
def _(spark, sf):
    cls = F.expr("CASE p_size % 3 WHEN 0 THEN 'wetland' WHEN 1 THEN 'playa' ELSE 'perennial_ice' END")
    feats = _boxes(spark, sf).select("pos", F.concat(F.lit("s"), "pos").alias("source_id"), cls.alias("class"), F.lit("Polygon").alias("geom_type"), "parts",
                                     F.lit("EPSG:5070").alias("crs"), F.lit("").alias("inclusion_reason"))
    return Z.select_areal(feats, min_area={"wetland": 250.0}, default_min=90.0).select("pos", "class", "bucket")


@query("areal_selection_cut", "GEO-07", "SET-02", sql=f"""WITH {_BOXES}, a AS (SELECT pos, CASE p_size % 3 WHEN 0 THEN 'wetland' WHEN 1 THEN 'playa' ELSE 'perennial_ice' END AS class,
  greatest(x0, 200) AS x0, greatest(y0, 200) AS y0, least(x1, 800) AS x1, least(y1, 800) AS y1, x0 < 200 OR y0 < 200 OR x1 > 800 OR y1 > 800 AS cut FROM bx),
 o AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END AS area FROM a), q AS (SELECT *, area > 0 AND area >= CASE class WHEN 'wetland' THEN 250 ELSE 90 END AS ok FROM o),
 k AS (SELECT *, row_number() OVER (PARTITION BY ok, x0, y0, x1, y1 ORDER BY pos) AS k FROM q)
SELECT pos, class, CASE WHEN ok AND k = 1 THEN 'selected' ELSE 'excluded' END AS bucket, cut AND area > 0 AS clipped FROM k""")
def _(spark, sf):
    cls = F.expr("CASE p_size % 3 WHEN 0 THEN 'wetland' WHEN 1 THEN 'playa' ELSE 'perennial_ice' END")
    feats = _boxes(spark, sf).select("pos", F.concat(F.lit("s"), "pos").alias("source_id"), cls.alias("class"), F.lit("Polygon").alias("geom_type"), "parts",
                                     F.lit("EPSG:5070").alias("crs"), F.lit("").alias("inclusion_reason"))
    out = Z.select_areal(feats, _region(spark, sf), CELL, min_area={"wetland": 250.0}, default_min=90.0)
    return out.select("pos", "class", "bucket", "clipped")


def _spot_features(spark, sf):
    k = F.col("c_custkey")
    cls = F.expr("CASE c_nationkey % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'spring' WHEN 2 THEN 'waterfall' ELSE 'rapids' END")
    return T.table(spark, sf, "customer").select(
        k.alias("pos"), F.concat(F.lit("s"), k).alias("source_id"), cls.alias("class"), F.lit("Point").alias("geom_type"),
        G.path(G.point(k * 37 % 1000, k * 91 % 500)).alias("parts"), F.lit("EPSG:5070").alias("crs"), F.lit("excluded: by code").alias("inclusion_reason"))


# spots taken one by one in source order: a spot is skipped if one was taken there, or one of its class within its spacing
_THIN = """ f AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM open),
 r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(pos BIGINT, cls VARCHAR, x BIGINT, y BIGINT)[]) AS kept UNION ALL
  SELECT f.k, CASE WHEN len(list_filter(kept, lambda a: (a.x = f.x AND a.y = f.y) OR (f.spacing > 0 AND a.cls = f.cls AND sqrt((a.x - f.x) ** 2 + (a.y - f.y) ** 2) < f.spacing))) > 0
   THEN kept ELSE list_append(kept, {'pos': f.pos, 'cls': f.cls, 'x': f.x, 'y': f.y}) END FROM r JOIN f ON f.k = r.k + 1),
 won AS (SELECT w.* FROM (SELECT unnest(kept) AS w FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1))),
 thin AS (SELECT f.*, w.pos IS NOT NULL AS taken, o.pos AS owner FROM f LEFT JOIN won w ON w.pos = f.pos LEFT JOIN won o ON o.x = f.x AND o.y = f.y AND o.pos < f.pos)"""
_SPOTS = "sp AS (SELECT c_custkey AS pos, CASE c_nationkey % 4 WHEN 0 THEN 'excluded' WHEN 1 THEN 'spring' WHEN 2 THEN 'waterfall' ELSE 'rapids' END AS cls, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 500 AS y FROM customer)"


@query("point_selection", "GEO-08", sql=f"""WITH RECURSIVE {_SPOTS}, open AS (SELECT *, CASE cls WHEN 'spring' THEN 30 WHEN 'waterfall' THEN 18 ELSE 0 END AS spacing FROM sp WHERE cls <> 'excluded'),
{_THIN}
SELECT pos, cls AS class, CASE WHEN taken THEN 'selected' ELSE 'excluded' END AS bucket, CASE WHEN taken THEN concat('selected as ', cls) WHEN owner IS NOT NULL THEN concat('excluded: duplicate point of ''s', owner, '''')
 ELSE printf('excluded: within %.1f m of a denser-priority %s point (density cap)', spacing::DOUBLE, cls) END AS reason FROM thin
UNION ALL SELECT pos, cls, 'excluded', 'excluded: by code' FROM sp WHERE cls = 'excluded'""")
def _(spark, sf):
    return Z.select_points(_spot_features(spark, sf), min_spacing={"spring": 30.0, "waterfall": 18.0}, default_spacing=0.0).select("pos", "class", "bucket", "reason")


@query("structure_selection", "GEO-09", sql=f"""WITH RECURSIVE {_SPOTS}, {_BOXES}, open AS (SELECT pos, 'gate' AS cls, x, y, 25 AS spacing FROM sp WHERE cls <> 'excluded'),
{_THIN},
 own AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM bx), g AS (SELECT *, row_number() OVER w AS n, first_value(pos) OVER w AS first FROM own WINDOW w AS (PARTITION BY area >= 100, x0, y0, x1, y1 ORDER BY pos))
SELECT pos, cls AS class, 'point' AS kind, CASE WHEN taken THEN 'selected' ELSE 'excluded' END AS bucket, CASE WHEN taken THEN 'selected as gate (point)' WHEN owner IS NOT NULL THEN concat('excluded: duplicate geometry of ''s', owner, '''')
 ELSE 'excluded: within 25.0 m of a denser-priority gate structure (density cap)' END AS reason FROM thin
UNION ALL SELECT pos + 1000000000, 'canal_ditch', 'polygon', CASE WHEN area >= 100 AND n = 1 THEN 'selected' ELSE 'excluded' END, CASE WHEN area < 100 THEN printf('excluded: area %.1f m² below min 100.0 m²', area::DOUBLE)
 WHEN n > 1 THEN concat('excluded: duplicate geometry of ''b', first, '''') ELSE 'selected as canal_ditch (polygon)' END FROM g""")
def _(spark, sf):
    dots = _spot_features(spark, sf).where("class <> 'excluded'").withColumn("class", F.lit("gate"))
    boxes = _boxes(spark, sf).select((F.col("pos") + 1_000_000_000).alias("pos"), F.concat(F.lit("b"), "pos").alias("source_id"), F.lit("canal_ditch").alias("class"),
                                     F.lit("Polygon").alias("geom_type"), "parts", F.lit("EPSG:5070").alias("crs"), F.lit("").alias("inclusion_reason"))
    out = Z.select_structures(dots.unionByName(boxes), min_area={"canal_ditch": 100.0}, min_spacing={"gate": 25.0})
    return out.select("pos", "class", "kind", "bucket", "reason")


@query("duplicate_geometry", "SET-02", sql="""WITH d AS (SELECT *, row_number() OVER w AS k, first_value(p_partkey) OVER w AS f FROM part WINDOW w AS (PARTITION BY p_size, p_brand ORDER BY p_partkey))
SELECT p_partkey AS pos, CASE WHEN k > 1 THEN concat('s', f) END AS dup_of FROM d""")
def _(spark, sf):
    # boxes by size and brand, half of them drawn from another corner in the other direction
    b, s, k = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"), F.col("p_size"), F.col("p_partkey")
    one = G.path(G.point(b, s), G.point(b + 1, s), G.point(b + 1, s + 2), G.point(b, s + 2), G.point(b, s))
    two = G.path(G.point(b + 1, s + 2), G.point(b + 1, s), G.point(b, s), G.point(b, s + 2), G.point(b + 1, s + 2))
    feats = T.table(spark, sf, "part").select(k.alias("pos"), F.concat(F.lit("s"), k).alias("source_id"), F.lit("Polygon").alias("geom_type"), F.when(k % 2 == 0, one).otherwise(two).alias("parts"))
    return Z._with_duplicates(feats, F.lit(True)).select("pos", "dup_of")


@query("shared_edges", "JN-08", sql="""WITH g AS (SELECT c_custkey AS pos, c_custkey % 40 AS gx, c_custkey // 40 AS gy, 1.0 + (c_custkey % 3) * 0.5 AS h FROM customer),
 v AS (SELECT a.pos AS a, b.pos AS b FROM g a JOIN g b ON b.gx = a.gx + 1 AND b.gy = a.gy), w AS (SELECT a.pos AS a, b.pos AS b FROM g a JOIN g b ON b.gx = a.gx AND b.gy = a.gy + 1 AND a.h = 2)
SELECT least(a, b) AS a, greatest(a, b) AS b FROM v UNION SELECT least(a, b), greatest(a, b) FROM w""")
def _(spark, sf):
    k = F.col("c_custkey")
    x, y, h = k % 40 * 1.0, F.floor(k / 40) * 2.0, 1.0 + k % 3 * 0.5
    cells = T.table(spark, sf, "customer").select(k.alias("pos"), G.box(x, y, x + 1, y + h).alias("parts"))
    return S.shared_edges(cells)


def _lines(spark, sf):
    # supplier lines: short horizontal reaches
    k = F.col("s_suppkey")
    x, y = k * 37 % 1000, k * 91 % 1000
    return T.table(spark, sf, "supplier").select(k.alias("line_pos"), G.path(G.point(x, y), G.point(x + 20, y)).alias("parts"))


_NEAR = f"""{_POINTS}, ln AS (SELECT s_suppkey AS line_pos, s_suppkey * 37 % 1000 AS x0, s_suppkey * 91 % 1000 AS y0 FROM supplier),
 d AS (SELECT p.pos, l.line_pos, sqrt((p.x - greatest(x0, least(x0 + 20, p.x))) ** 2 + (p.y - y0) ** 2) AS d FROM pt p, ln l),
 nr AS (SELECT pos, arg_min(line_pos, (d, line_pos)) AS line_pos, min(d) AS distance FROM d GROUP BY 1)"""


@query("nearest_reach", "JN-05", sql=f"WITH {_NEAR} SELECT pos, line_pos, round(distance, 6) AS distance FROM nr")
def _(spark, sf):
    return S.nearest_line(_points(spark, sf), _lines(spark, sf)).withColumn("distance", R(F.col("distance")))


@query("network_placement", "JN-06", sql=f"WITH {_NEAR} SELECT count(*) AS count, count(*) FILTER (distance <= 25) AS on_network, round(max(distance), 6) AS max_distance, round(median(distance), 6) AS median_distance FROM nr")
def _(spark, sf):
    summary, _off = S.network_placement(_points(spark, sf), _lines(spark, sf), 25.0)
    return summary.select("count", "on_network", R(F.col("max_distance")).alias("max_distance"), R(F.col("median_distance")).alias("median_distance"))


def _layered(spark, sf):
    k = F.col("c_custkey")
    return T.table(spark, sf, "customer").select(k.alias("pos"), F.when(F.col("c_nationkey") % 2 == 0, "gate").otherwise("dam_weir").alias("class"),
                                                 F.element_at(F.array(F.lit("NHDLine"), F.lit("NHDPoint"), F.lit("NHDArea")), (k % 3 + 1).cast("int")).alias("layer"),
                                                 (k * 37 % 1000 * 1.0).alias("x"), (k * 91 % 1000 * 1.0).alias("y"))


@query("duplicate_groups", "SET-04", sql="""WITH RECURSIVE s AS (SELECT c_custkey AS pos, c_nationkey % 2 AS cl, c_custkey % 3 AS ly, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y FROM customer),
 e AS (SELECT a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.cl = b.cl AND a.ly <> b.ly AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 9),
 r AS (SELECT a AS pos, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.pos)
SELECT pos, min(root) AS root FROM r GROUP BY 1""")
def _(spark, sf):
    return S.duplicate_groups(_layered(spark, sf), 9.0)


@query("structure_report", "AGG-45")
def _(spark, sf):
    pts = _layered(spark, sf).select("pos", "class", "layer", F.lit("Point").alias("geom_type"), G.path(G.point(F.col("x"), F.col("y"))).alias("parts"))
    return Z.structure_report(pts, _lines(spark, sf), _nations(spark, sf).where("poly_pos % 2 = 0"), tolerance=25.0, duplicate_tolerance=9.0, cell=CELL)


@query("marker_placement", "GEO-15", sql=f"""WITH {_POINTS}, p AS (SELECT pos % 4 AS category, (x - 100) * (800 / 700.0) AS px, (900 - y) * (600 / 650.0) AS py FROM pt)
SELECT category, count(*) AS n, round(sum(px), 4) AS px, round(sum(py), 4) AS py FROM p WHERE px BETWEEN -7 AND 807 AND py BETWEEN -7 AND 607 GROUP BY 1""")
def _(spark, sf):
    frame = T.table(spark, sf, "region").agg(F.lit(100.0).alias("min_x"), F.lit(250.0).alias("min_y"), F.lit(800.0).alias("max_x"), F.lit(900.0).alias("max_y"))
    out = Z.placed_markers(_points(spark, sf), frame, 800, 600, 7.0)
    return out.groupBy((F.col("pos") % 4).alias("category")).agg(F.count("*").alias("n"), R(F.sum("px"), 4).alias("px"), R(F.sum("py"), 4).alias("py"))


@query("path_text", "SRC-18", sql=f"""WITH {_BOXES}, m AS (SELECT min(x0) AS mx, max(y1) AS my FROM bx) SELECT p_brand AS huc, pos, concat('M ', CAST(x0 - mx AS BIGINT), ',', CAST(my - y0 AS BIGINT), ' L ', CAST(x1 - mx AS BIGINT), ',', CAST(my - y0 AS BIGINT),
 ' L ', CAST(x1 - mx AS BIGINT), ',', CAST(my - y1 AS BIGINT), ' L ', CAST(x0 - mx AS BIGINT), ',', CAST(my - y1 AS BIGINT), ' Z') AS d FROM bx, m""")
def _(spark, sf):
    return Z.path_table(_boxes(spark, sf).withColumnRenamed("p_brand", "huc"), 2, closed=True)


# an order's lines, in line order, make one path
def _paths(spark, sf):
    v = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").alias("y")).alias("p"))
    li = T.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(v)), lambda s: s["p"]).alias("pts"), F.max("l_extendedprice").alias("width"))


@query("simplified_paths", "GEO-14")
def _(spark, sf):
    return Z.simplified(_paths(spark, sf), 5.0).select("pos", F.size("pts").alias("points"))


@query("widest_paths", "SRT-03", sql="""WITH p AS (SELECT l_orderkey AS pos, max(l_extendedprice) AS width, count(*) AS n FROM lineitem GROUP BY 1) SELECT pos, width FROM p WHERE width >= 1000 AND n >= 2 ORDER BY width DESC, pos LIMIT 25""")
def _(spark, sf):
    return Z.widest_paths(_paths(spark, sf), 1000.0, 25, 5.0).select("pos", "width")
