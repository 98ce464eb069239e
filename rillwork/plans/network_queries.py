"""River-network jobs over the tree the part table spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.fixed_values import PALETTES
from rillwork.operators import network as N
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import SEGMENTS_SQL, R

_LEVELS = 24  # levels the SQL answers unroll; enough for 2^24 parts

NEON = list(PALETTES["neon"])


@query("network_build", "NET-01", "GEO-10", sql="""WITH p AS (
 SELECT l_orderkey AS pos, l_linenumber AS part, l_partkey % 97 AS x0, l_suppkey % 89 AS y0,
        l_partkey % 97 + l_quantity AS x1, l_suppkey % 89 + (l_linenumber - 3) AS y1,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
e AS (SELECT pos, k, x0, y0, CASE WHEN l2 THEN x0 ELSE x1 END AS x1, CASE WHEN l2 THEN y0 ELSE y1 END AS y1
  FROM (SELECT *, part = 7 AS l2 FROM p))
SELECT row_number() OVER (ORDER BY pos, k) - 1 AS segment_id, CAST(x0 AS DOUBLE)::VARCHAR || '_' || CAST(y0 AS DOUBLE)::VARCHAR AS u,
 CAST(x1 AS DOUBLE)::VARCHAR || '_' || CAST(y1 AS DOUBLE)::VARCHAR AS v, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS length
FROM e WHERE x0 <> x1 OR y0 <> y1""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    x0, y0 = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 89).cast("double")
    loop = F.col("l_linenumber") == 7
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pts = F.array(point(x0, y0), point(
        F.when(loop, x0).otherwise(x0 + F.col("l_quantity")),
        F.when(loop, y0).otherwise(y0 + F.col("l_linenumber") - 3)))
    # an order's lines (at most a handful) are the parts of one multipart feature
    lines = li.groupBy(F.col("l_orderkey").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", pts.alias("pts")))).alias("_l"))
    lines = lines.select("pos", F.lit("0000").alias("huc4"), F.lit(None).cast("int").alias("ftype"),
                         F.transform("_l", lambda l: l["pts"]).alias("parts"))
    segments, _ = N.build_segments(lines)
    return segments.select("segment_id", "u", "v", R(F.col("length")).alias("length"))


@query("sources_outlets", "NET-02", sql=f"""WITH {SEGMENTS_SQL}
SELECT u AS node, 'source' AS kind FROM seg WHERE u NOT IN (SELECT v FROM seg)
UNION ALL SELECT DISTINCT v, 'outlet' FROM seg WHERE v NOT IN (SELECT u FROM seg)""")
def _(spark, sf):
    seg = T.part_segments(spark, sf)
    return N.sources(seg).withColumn("kind", F.lit("source")).unionByName(
        N.outlets(seg).withColumn("kind", F.lit("outlet")))


@query("network_statistics", "AGG-02", sql=f"""WITH {SEGMENTS_SQL}, n AS (SELECT u AS node FROM seg UNION SELECT v FROM seg)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM seg) AS edges,
 (SELECT count(*) FROM n WHERE node NOT IN (SELECT v FROM seg)) AS sources,
 (SELECT count(*) FROM n WHERE node NOT IN (SELECT u FROM seg)) AS outlets, (SELECT sum(length) FROM seg) AS total_length""")
def _(spark, sf):
    return N.statistics(T.part_segments(spark, sf))


_UP_SQL = f"""WITH RECURSIVE {SEGMENTS_SQL}, up AS (SELECT u AS node FROM seg WHERE v = 5
 UNION SELECT s.u FROM seg s JOIN up ON s.v = up.node)"""


@query("upstream_nodes", "NET-03", sql=_UP_SQL + " SELECT node FROM up WHERE node <> 5")
def _(spark, sf):
    return N.upstream(T.part_segments(spark, sf), 5)


@query("downstream_nodes", "NET-03", sql=f"""WITH RECURSIVE {SEGMENTS_SQL}, dn AS (
 SELECT v AS node FROM seg WHERE u = (SELECT max(u) FROM seg)
 UNION SELECT s.v FROM seg s JOIN dn ON s.u = dn.node) SELECT node FROM dn""")
def _(spark, sf):
    seg = T.part_segments(spark, sf)
    last = seg.agg(F.max("u")).first()[0]
    return N.downstream(seg, last)


@query("basin_segments", "NET-04", sql=_UP_SQL + """
 SELECT segment_id, u, v FROM seg WHERE (u = 5 OR u IN (SELECT node FROM up)) AND (v = 5 OR v IN (SELECT node FROM up))""")
def _(spark, sf):
    return N.basin(T.part_segments(spark, sf), 5).select("segment_id", "u", "v")


def _by_level(expr: str, first: str) -> str:
    """Bottom-up SQL over the heap: one expression per level, children joined in."""
    parts = [f"l{_LEVELS} AS (SELECT s.u, CAST(1 AS BIGINT) AS o FROM seg s WHERE s.lvl = {_LEVELS})"]
    for d in range(_LEVELS - 1, -1, -1):
        parts.append(f"l{d} AS (SELECT s.u, {expr} AS o FROM seg s LEFT JOIN l{d + 1} c ON c.u // 2 = s.u "
                     f"WHERE s.lvl = {d} GROUP BY s.u)")
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(_LEVELS + 1))
    return f"WITH {SEGMENTS_SQL}, {', '.join(parts)} SELECT u - 1 AS segment_id, o AS {first} FROM ({union})"


@query("strahler_order", "NET-05", sql=_by_level(
    "CASE WHEN count(c.u) = 0 THEN 1 WHEN count(c.u) = 2 AND min(c.o) = max(c.o) THEN max(c.o) + 1 ELSE max(c.o) END",
    "stream_order"))
def _(spark, sf):
    return N.strahler_order(T.part_segments(spark, sf)).select("segment_id", "stream_order")


@query("shreve_order", "NET-06", sql=_by_level(
    "CAST(coalesce(sum(c.o), 1) AS BIGINT)", "stream_order"))
def _(spark, sf):
    return N.shreve_order(T.part_segments(spark, sf)).select("segment_id", "stream_order")


_ANC_SQL = f"""WITH RECURSIVE {SEGMENTS_SQL}, anc AS (
 SELECT u AS h, u AS a FROM seg UNION ALL SELECT h, a // 2 FROM anc WHERE a // 2 > 0)"""


@query("downstream_accumulation", "NET-07", sql=_ANC_SQL + """
SELECT a.a AS hydroseq, sum(s.length) AS q, round(sum(p.p_retailprice), 4) AS price FROM anc a JOIN seg s ON s.u = a.h
JOIN part p ON p.p_partkey = s.segment_id GROUP BY 1""")
def _(spark, sf):
    reaches = T.part_reaches(spark, sf).select(
        "hydroseq", "dnhydroseq", F.col("q_incr").alias("q"), F.col("p_retailprice").alias("price"))
    return N.accumulate_downstream(reaches, ["q", "price"]).withColumn("price", R(F.col("price"), 4))


@query("cumulative_length", "NET-08", "NET-10", sql=_ANC_SQL + """
SELECT a.a - 1 AS segment_id, sum(s.length) AS cum_length FROM anc a JOIN seg s ON s.u = a.h GROUP BY 1""")
def _(spark, sf):
    return N.cumulative_length(T.part_segments(spark, sf)).select("segment_id", "cum_length")


@query("hack_order", "NET-09", sql=f"""WITH RECURSIVE {SEGMENTS_SQL}, anc AS (
 SELECT u AS h, u AS a FROM seg UNION ALL SELECT h, a // 2 FROM anc WHERE a // 2 > 0),
cum AS (SELECT a.a AS u, sum(s.length) AS c FROM anc a JOIN seg s ON s.u = a.h GROUP BY 1),
side AS (SELECT u, CASE WHEN row_number() OVER (PARTITION BY u // 2 ORDER BY c DESC, u DESC) = 1 THEN 0 ELSE 1 END AS x FROM cum)
SELECT a.h - 1 AS segment_id, 1 + CAST(sum(s.x) AS BIGINT) AS stream_order FROM anc a JOIN side s ON s.u = a.a GROUP BY 1""")
def _(spark, sf):
    return N.hack_order(T.part_segments(spark, sf)).select("segment_id", "stream_order")


@query("custom_order", "NET-10", "UDF-01", sql=f"WITH {SEGMENTS_SQL} SELECT segment_id, length * 2 AS stream_order FROM seg")
def _(spark, sf):
    return N.assign_stream_order(T.part_segments(spark, sf), "custom", lambda df: df["length"] * 2).select(
        "segment_id", "stream_order")


_ADJ_SQL = f"""WITH {SEGMENTS_SQL}, t AS (SELECT u AS node, huc4 AS code FROM seg UNION SELECT v, huc4 FROM seg),
adj AS (SELECT DISTINCT x.code AS a, y.code AS b FROM t x JOIN t y ON x.node = y.node AND x.code <> y.code)"""


@query("watershed_adjacency", "NET-11", sql=_ADJ_SQL + " SELECT a, b FROM adj")
def _(spark, sf):
    return N.adjacency(T.part_segments(spark, sf))


@query("greedy_colors", "NET-12")
def _(spark, sf):
    seg = T.part_segments(spark, sf)
    codes = seg.select(F.col("huc4").alias("code"))
    out = N.greedy_color(codes, N.adjacency(seg))
    return out.select("code", "color", N.palette_color(F.col("color"), NEON).alias("hex"))


@query("cycled_colors", "NET-13", sql=f"""WITH {SEGMENTS_SQL}, c AS (SELECT DISTINCT huc4 AS code FROM seg)
SELECT code, ['{"','".join(NEON)}'][(dense_rank() OVER (ORDER BY code) - 1) % 12 + 1] AS hex FROM c""")
def _(spark, sf):
    return N.cycled_colors(T.part_segments(spark, sf).select(F.col("huc4").alias("code")), NEON)


@query("huc_groups", "AGG-01", sql=f"""WITH {SEGMENTS_SQL}
SELECT substr(huc4, 1, 4) AS huc, count(*) AS segments, sum(length) AS length FROM seg GROUP BY 1""")
def _(spark, sf):
    return N.group_by_huc(T.part_segments(spark, sf), 8)


@query("asset_lineage", "NET-14", sql="""WITH RECURSIVE e AS (
 SELECT DISTINCT l_suppkey AS child, l_suppkey // 2 AS parent FROM lineitem WHERE l_suppkey > 1),
w AS (SELECT child, parent FROM e UNION SELECT w.child, e.parent FROM w JOIN e ON e.child = w.parent)
SELECT child AS node FROM w WHERE parent = 3""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").where("l_suppkey > 1")
    edges = li.select(F.col("l_suppkey").alias("u"), F.floor(F.col("l_suppkey") / 2).alias("v"))
    edges = edges.where("u <> v").distinct()
    return N.upstream(edges, 3)


@query("state_combined_outlet", "NET-15", "SRT-02", sql="""WITH f AS (
 SELECT s_nationkey AS basin, l_suppkey AS reach, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
   sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
y AS (SELECT basin, reach, sum(q) AS t FROM f WHERE year = (SELECT min(year) FROM f) GROUP BY 1, 2),
o AS (SELECT basin, arg_max(reach, (t, -reach)) AS reach FROM y GROUP BY 1)
SELECT f.year, f.month, sum(f.q) AS q FROM f JOIN o ON f.reach = o.reach GROUP BY 1, 2""")
def _(spark, sf):
    sup = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("reach"), F.col("s_nationkey").alias("basin"))
    flow = T.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("reach"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    first = flow.agg(F.min("year")).scalar()
    yearly = flow.where(F.col("year") == first).groupBy("reach").agg(F.sum("q").alias("t"))
    outlet = yearly.join(sup, "reach").groupBy("basin").agg(
        F.max_by("reach", F.struct("t", -F.col("reach"))).alias("reach"))
    return flow.join(outlet, "reach", "left_semi").groupBy("year", "month").agg(F.sum("q").alias("q"))


def _main_stem(spark, sf):
    reaches = T.part_reaches(spark, sf)
    flow = N.accumulate_downstream(reaches.select("hydroseq", "dnhydroseq", F.col("q_incr").alias("flow")), ["flow"])
    deepest = reaches.agg(F.max("hydroseq").alias("h"))
    steps = F.expr("transform(sequence(0, cast(length(bin(h)) - 1 as int)), i -> shiftright(h, i))")
    path = deepest.select(F.posexplode(steps).alias("step", "hydroseq"))
    return reaches.select("hydroseq", "dnhydroseq").join(flow, "hydroseq"), path


_STEM_SQL = _ANC_SQL + """, flow AS (SELECT a.a AS hydroseq, sum(s.length) AS flow FROM anc a JOIN seg s ON s.u = a.h GROUP BY 1),
 top AS (SELECT max(u) AS h FROM seg), path AS (SELECT CAST(i AS INTEGER) AS step, h >> CAST(i AS BIGINT) AS hydroseq FROM top, LATERAL (SELECT unnest(range(0, length(bin(h)))) AS i) t)"""


@query("longitudinal_profile", "WIN-10", sql=_STEM_SQL + " SELECT step, p.hydroseq, flow FROM path p JOIN flow f ON f.hydroseq = p.hydroseq")
def _(spark, sf):
    return N.checked_profile(*_main_stem(spark, sf))


@query("longitudinal_frames", "WIN-11", sql=_STEM_SQL + """ SELECT step, p.hydroseq, flow, round(flow / (SELECT flow FROM flow WHERE hydroseq = 1), 6) AS fraction
FROM path p JOIN flow f ON f.hydroseq = p.hydroseq""")
def _(spark, sf):
    return N.longitudinal_frames(*_main_stem(spark, sf)).withColumn("fraction", R(F.col("fraction")))
