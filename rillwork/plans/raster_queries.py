"""Raster jobs over cells derived from the lineitem table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.operators import raster as A
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import R

# a grid whose side grows with the data: suppliers across, part ids folded to 64 rows
_GRID_SQL = """dims AS (SELECT CAST(count(*) AS BIGINT) AS w FROM supplier), cells AS (SELECT l_partkey % 64 AS row, l_suppkey AS col, round(avg(l_quantity), 4) AS value FROM lineitem WHERE (l_partkey + l_suppkey) % 41 <> 0 GROUP BY 1, 2)"""


def _cells(spark, sf):
    li = T.table(spark, sf, "lineitem").where((F.col("l_partkey") + F.col("l_suppkey")) % 41 != 0)
    return li.groupBy((F.col("l_partkey") % 64).alias("row"), F.col("l_suppkey").alias("col")).agg(F.round(F.avg("l_quantity"), 4).alias("value"))


def _grid(spark, sf):
    width = T.table(spark, sf, "supplier").count()
    return dict(origin_x=0.0, origin_y=640.0, pixel_w=10.0, pixel_h=10.0, width=width, height=64)


@query("mosaic", "RAS-01", sql="""WITH g AS (SELECT s_suppkey AS grid_id, s_suppkey AS pos, (s_suppkey % 10) * 4 AS c0, (s_suppkey // 10 % 10) * 3 AS r0 FROM supplier),
 c AS (SELECT l_suppkey AS grid_id, l_partkey % 8 AS row, l_partkey // 8 % 8 AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)
SELECT c.row + g.r0 - (SELECT min(r0) FROM g) AS row, c.col + g.c0 - (SELECT min(c0) FROM g) AS col, arg_max(value, pos) AS value FROM c JOIN g ON g.grid_id = c.grid_id GROUP BY 1, 2""")
def _(spark, sf):
    k = F.col("s_suppkey")
    grids = T.table(spark, sf, "supplier").select(
        k.alias("grid_id"), k.alias("grid_pos"), (k % 10 * 40 + 5.0).alias("origin_x"), (1000.0 - F.floor(k / 10) % 10 * 30).alias("origin_y"),
        F.lit(10.0).alias("pixel_w"), F.lit(10.0).alias("pixel_h"), F.lit("EPSG:5070").alias("crs"))
    cells = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grid_id"), (F.col("l_partkey") % 8).alias("row"),
                                                   (F.floor(F.col("l_partkey") / 8) % 8).alias("col")).agg(F.max("l_quantity").alias("value"))
    return A.mosaic(cells, grids)


@query("clip_window", "RAS-02", sql=f"WITH {_GRID_SQL} SELECT row - 10 AS row, col - 5 AS col, value FROM cells WHERE row BETWEEN 10 AND 40 AND col BETWEEN 5 AND 61")
def _(spark, sf):
    window, _header = A.clip_window(_cells(spark, sf), _grid(spark, sf), (55.0, 235.0, 612.0, 533.0))
    return window


@query("pyramid", "RAS-03", sql=f"""WITH {_GRID_SQL}, l1 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM cells, dims WHERE col < w // 2 * 2 GROUP BY 1, 2),
 l2 AS (SELECT row // 2 AS row, col // 2 AS col, avg(value) AS value FROM l1, dims WHERE col < (w // 2) // 2 * 2 GROUP BY 1, 2)
SELECT 0 AS level, row, col, round(value, 9) AS value FROM cells UNION ALL SELECT 1, row, col, round(value, 9) FROM l1 UNION ALL SELECT 2, row, col, round(value, 9) FROM l2""")
def _(spark, sf):
    g = _grid(spark, sf)
    return A.pyramid(_cells(spark, sf), g["width"], g["height"], 2).withColumn("value", R(F.col("value"), 9))


_PTS = "pts AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 1040) - 20.0 AS x, (c_custkey * 91 % 680) - 20.5 AS y FROM customer)"
_BIL = _GRID_SQL + ", " + _PTS + """, f AS (SELECT *, (x / 10 - 0.5) - floor(x / 10 - 0.5) AS tx, ((640 - y) / 10 - 0.5) - floor((640 - y) / 10 - 0.5) AS ty,
  CAST(floor(x / 10 - 0.5) AS BIGINT) AS c, CAST(floor((640 - y) / 10 - 0.5) AS BIGINT) AS r, x BETWEEN 0 AND w * 10 AND y BETWEEN 0 AND 640 AS covered FROM pts, dims),
 q AS (SELECT point_id, greatest(0, least(63, r + dr)) AS row, greatest(0, least(w - 1, c + dc)) AS col, CASE WHEN dc = 1 THEN tx ELSE 1 - tx END * CASE WHEN dr = 1 THEN ty ELSE 1 - ty END AS wt
  FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc) WHERE covered),
 s AS (SELECT q.point_id, sum(wt * value) AS v, count(*) <> count(value) AS nd FROM q LEFT JOIN cells ON cells.row = q.row AND cells.col = q.col GROUP BY 1),
 samples AS (SELECT f.point_id, CASE WHEN s.nd THEN NULL ELSE s.v END AS value, f.covered, coalesce(s.nd, false) AS nodata FROM f LEFT JOIN s ON s.point_id = f.point_id)"""


def _samples(spark, sf):
    k = F.col("c_custkey")
    pts = T.table(spark, sf, "customer").select(k.alias("point_id"), (k * 37 % 1040 - 20.0).alias("x"), (k * 91 % 680 - 20.5).alias("y"))
    return A.bilinear(pts, _cells(spark, sf), _grid(spark, sf))


@query("bilinear_samples", "RAS-04", sql=f"WITH {_BIL} SELECT point_id, round(value, 9) AS value, covered, nodata FROM samples")
def _(spark, sf):
    return _samples(spark, sf).withColumn("value", R(F.col("value"), 9))


_LINES = """ln AS (SELECT c_custkey AS line_id, (c_custkey * 37 % 600) * 1.0 AS x0, (c_custkey * 91 % 500) * 1.0 AS y0, (c_custkey % 3) * 40.0 AS dx, (c_custkey % 4) * 30.0 AS dy FROM customer),
 st AS (SELECT *, greatest(1, CAST(ceil(sqrt(dx * dx + dy * dy) / 7.5) AS INTEGER)) AS n FROM ln),
 vx AS (SELECT line_id, CAST(i AS INTEGER) AS pos, x0 + dx * i / n AS x, y0 + dy * i / n AS y FROM st, LATERAL (SELECT unnest(range(0, n + 1)) AS i) t)"""


def _lines(spark, sf):
    k = F.col("c_custkey")
    x, y = k * 37 % 600 * F.lit(1.0), k * 91 % 500 * F.lit(1.0)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return T.table(spark, sf, "customer").select(k.alias("line_id"), F.array(point(x, y), point(x + k % 3 * 40.0, y + k % 4 * 30.0)).alias("pts"))


@query("densified_lines", "GEO-13", "UDF-06", sql=f"WITH {_LINES} SELECT line_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM vx")
def _(spark, sf):
    return _lines(spark, sf).select("line_id", F.posexplode(A.densified(F.col("pts"), 7.5)).alias("pos", "p")).select(
        "line_id", "pos", R(F.col("p.x")).alias("x"), R(F.col("p.y")).alias("y"))


@query("sampled_lines", "RAS-05", sql=f"WITH {_LINES}, " + _BIL.replace(_PTS, "pts AS (SELECT line_id * 1000 + pos AS point_id, x, y FROM vx)") +
       " SELECT point_id // 1000 AS line_id, CAST(point_id % 1000 AS INTEGER) AS pos, round(value, 9) AS z FROM samples")
def _(spark, sf):
    out = A.sampled_lines(_lines(spark, sf), _cells(spark, sf), _grid(spark, sf), 7.5, "dem-1")
    return out.select("line_id", "pos", R(F.col("z"), 9).alias("z"))


_NB = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def _hill_sql() -> str:
    joins, picks, gone = [], {}, []
    for i, (dr, dc) in enumerate(_NB):
        # edge replication reads the clamped cell; nodata spreads only from real neighbours
        joins.append(f"LEFT JOIN cells n{i} ON n{i}.row = greatest(0, least(63, g.row + {dr})) AND n{i}.col = greatest(0, least(w - 1, g.col + {dc}))")
        picks[(dr, dc)] = f"n{i}.value"
        gone.append(f"(n{i}.value IS NULL)")
    p = picks
    dx = f"(({p[-1, 1]} + 2 * {p[0, 1]} + {p[1, 1]}) - ({p[-1, -1]} + 2 * {p[0, -1]} + {p[1, -1]})) / 80.0"
    dy = f"(({p[1, -1]} + 2 * {p[1, 0]} + {p[1, 1]}) - ({p[-1, -1]} + 2 * {p[-1, 0]} + {p[-1, 1]})) / 80.0"
    return f"""WITH {_GRID_SQL}, g AS (SELECT r AS row, c AS col, w FROM dims, LATERAL (SELECT unnest(range(0, w)) AS c), (SELECT unnest(range(0, 64)) AS r)),
 d AS (SELECT g.row, g.col, {' OR '.join(gone)} AS bad, {dx} AS dx, {dy} AS dy FROM g {' '.join(joins)}),
 e AS (SELECT *, atan(sqrt(dx * dx + dy * dy)) AS sl, CASE WHEN atan2(dy, -dx) < 0 THEN atan2(dy, -dx) + 2 * pi() ELSE atan2(dy, -dx) END AS az FROM d)
SELECT row, col, CASE WHEN bad THEN -1 ELSE round(least(255, greatest(0, 255 * (cos(radians(45)) * cos(sl) + sin(radians(45)) * sin(sl) * cos(radians(135) - az)))), 5) END AS value FROM e"""


@query("hillshade", "RAS-06", sql=_hill_sql())
def _(spark, sf):
    return A.hillshade(_cells(spark, sf), _grid(spark, sf), tile=32).withColumn("value", R(F.col("value"), 5))


@query("dem_normalized", "RAS-07")
def _(spark, sf):
    width = _grid(spark, sf)["width"]
    grids = spark.createDataFrame([(1, 1, 0.0, 640.0, 10.0, 10.0, "EPSG:5070", width, 64)],
                                  "grid_id int, grid_pos int, origin_x double, origin_y double, pixel_w double, pixel_h double, crs string, width int, height int")
    target = dict(origin_x=15.0, origin_y=600.0, pixel_w=20.0, pixel_h=20.0, width=max(2, width // 4), height=16)
    out = A.normalized_dem(_cells(spark, sf).withColumn("grid_id", F.lit(1)), grids, target, lambda x, y: (x, y), 2)
    return out.withColumn("value", R(F.col("value")))


_RGBA = "SELECT l_partkey % 64 AS row, l_suppkey AS col, CAST(max(l_quantity) * 5 AS INTEGER) AS r, CAST(max(l_linenumber) * 30 AS INTEGER) AS g, CAST(min(l_quantity) AS INTEGER) AS b, CAST(count(*) * 37 % 256 AS INTEGER) AS a FROM lineitem GROUP BY 1, 2"


@query("alpha_over", "RAS-08", sql=f"""WITH l AS ({_RGBA}), base AS (SELECT row, col, b AS r, r AS g, g AS b, 255 - a AS a FROM l),
 m AS (SELECT l.row, l.col, base.r AS br, base.g AS bg, base.b AS bb, base.a / 255.0 AS ab, l.r, l.g, l.b, l.a / 255.0 AS ao FROM base JOIN l ON l.row = base.row AND l.col = base.col),
 o AS (SELECT *, ao + ab * (1 - ao) AS oa FROM m)
SELECT row, col, {', '.join(f"CASE WHEN oa > 0 THEN CAST(round_even((({c}) * ao + b{c} * ab * (1 - ao)) / oa, 0) AS INTEGER) ELSE 0 END AS {c}" for c in 'rgb')}, CAST(round_even(oa * 255, 0) AS INTEGER) AS a FROM o""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    layer = li.groupBy((F.col("l_partkey") % 64).alias("row"), F.col("l_suppkey").alias("col")).agg(
        (F.max("l_quantity") * 5).cast("int").alias("r"), (F.max("l_linenumber") * 30).cast("int").alias("g"),
        F.min("l_quantity").cast("int").alias("b"), (F.count("*") * 37 % 256).cast("int").alias("a"))
    base = layer.select("row", "col", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), (255 - F.col("a")).alias("a"))
    return A.composite(base, [layer])


@query("relief_layer", "RAS-08", sql=f"""WITH {_GRID_SQL} SELECT row, col, CAST(round_even(value / 255 * 120, 0) AS INTEGER) AS r, CAST(round_even(value / 255 * 200, 0) AS INTEGER) AS g,
 CAST(round_even(value / 255 * 90, 0) AS INTEGER) AS b, 102 AS a FROM cells""")
def _(spark, sf):
    return A.relief_layer(_cells(spark, sf), tint=(120, 200, 90), opacity=0.4)


@query("elevation_range", "RAS-09", sql=f"WITH {_GRID_SQL} SELECT min(value) AS z_min, max(value) AS z_max FROM cells WHERE value <> 50")
def _(spark, sf):
    return A.elevation_range(_cells(spark, sf), 50.0)


# order lines as river profiles: at most a handful of vertices per order
_PROF = """pv AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS z FROM lineitem),
 pq AS (SELECT *, last_value(z IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM pv)"""


def _profiles(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("z")).alias("v"))
    return li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["z"]).alias("z"))


@query("profile_inversions", "WIN-12", sql=f"""WITH {_PROF} SELECT l_orderkey, count(*) AS vertices, count(*) FILTER (z IS NULL) AS nodata, count(*) FILTER (z > prev + 2) AS inversions,
 coalesce(max(z - prev) FILTER (z > prev + 2), 0) AS max_rise FROM pq GROUP BY 1""")
def _(spark, sf):
    return _profiles(spark, sf).select("l_orderkey", A.profile_qa(F.col("z"), 2.0).alias("qa")).select("l_orderkey", "qa.*")


@query("monotonic_surface", "WIN-13", sql=f"""WITH {_PROF} SELECT l_orderkey, CAST(k - 1 AS INTEGER) AS pos, CASE WHEN z IS NOT NULL THEN min(z) OVER (PARTITION BY l_orderkey ORDER BY k) END AS surface FROM pv""")
def _(spark, sf):
    return _profiles(spark, sf).select("l_orderkey", F.posexplode(A.monotonic_surface(F.col("z"))).alias("pos", "surface"))


@query("profile_rollup", "AGG-34", sql=f"""WITH {_PROF} SELECT count(DISTINCT l_orderkey) AS lines, count(*) AS vertices, count(*) FILTER (z IS NULL) AS nodata, count(*) FILTER (z > prev) AS inversions,
 max(z - prev) FILTER (z > prev) AS max_rise FROM pq""")
def _(spark, sf):
    return A.qa_rollup(_profiles(spark, sf).select(A.profile_qa(F.col("z")).alias("qa")))


_ACC = """s AS (SELECT l_returnflag AS k, CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS value, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity + l_discount * 10 END AS expected FROM lineitem)"""


def _acc(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("value"),
                                                 F.when(F.col("l_discount") != 0, F.col("l_quantity") + F.col("l_discount") * 10).alias("expected"))


@query("error_metrics", "AGG-32", "AGG-35", sql=f"""WITH {_ACC}, m AS (SELECT k, count(value - expected) AS n_compared, count(*) - count(value - expected) AS n_skipped, max(abs(value - expected)) AS mx,
 avg(abs(value - expected)) AS mean_abs, sqrt(avg((value - expected) ** 2)) AS rmse FROM s GROUP BY 1)
SELECT k, n_compared, n_skipped, round(mx, 6) AS max_abs, round(mean_abs, 6) AS mean_abs, round(rmse, 6) AS rmse, mx <= 1.5 AS within_tolerance FROM m""")
def _(spark, sf):
    out = A.accuracy_verdict(A.error_metrics(_acc(spark, sf), ["k"]), 1.5)
    return out.select("k", "n_compared", "n_skipped", *[R(F.col(c)).alias(c) for c in ("max_abs", "mean_abs", "rmse")], "within_tolerance")


@query("coverage_tally", "AGG-33", sql=f"""WITH {_BIL} SELECT count(*) AS n_total, count(*) FILTER (covered AND NOT nodata) AS n_covered, count(*) FILTER (covered AND nodata) AS n_nodata, count(*) FILTER (NOT covered) AS n_uncovered,
 round(count(*) FILTER (covered AND NOT nodata) / count(*), 6) AS fraction FROM samples""")
def _(spark, sf):
    return A.coverage(_samples(spark, sf)).withColumn("fraction", R(F.col("fraction")))


@query("dem_tiles", "SRC-20", "UDF-06", sql="""WITH b AS (SELECT s_suppkey AS box_id, -124.6::DOUBLE + (s_suppkey % 20) * 0.3::DOUBLE AS x0, 41.2::DOUBLE + (s_suppkey % 7) * 0.5::DOUBLE AS y0, 0.7::DOUBLE + (s_suppkey % 3) AS d FROM supplier),
 x AS (SELECT box_id, w, s FROM b, LATERAL (SELECT unnest(range(CAST(floor(x0) AS BIGINT), CAST(ceil(x0 + d) AS BIGINT))) AS w) p, LATERAL (SELECT unnest(range(CAST(floor(y0) AS BIGINT), CAST(ceil(y0 + d) AS BIGINT))) AS s) q)
SELECT box_id, printf('n%02dw%03d', s + 1, abs(w)) AS tile FROM x""")
def _(spark, sf):
    k = F.col("s_suppkey")
    x, y, d = -124.6 + k % 20 * 0.3, 41.2 + k % 7 * 0.5, 0.7 + k % 3
    boxes = T.table(spark, sf, "supplier").select(k.alias("box_id"), x.alias("min_lon"), y.alias("min_lat"), (x + d).alias("max_lon"), (y + d).alias("max_lat"))
    return A.dem_cells(boxes)
