"""Flow model, climate inputs, classification, settings and styling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import fixed_values as X
from rillwork.functions import settings as G
from rillwork.functions import series as S
from rillwork.functions import styling as Y
from rillwork.functions import vectors as V
from rillwork.operators import classify as K
from rillwork.operators import flow as W
from rillwork.operators import hydrographs as H
from rillwork.operators import ledger as L
from rillwork.operators.scale import row_numbers
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import HYDRO_SQL, INDEX_SQL, R
from rillwork.sources import layers as Ly
from rillwork.session import checkpointed
from rillwork.sources import tables as Tb


# supplier-year climate: quantity as precipitation, discount as temperature
_CLIM = """clim AS (SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS m,
 sum(l_quantity) AS p, round(avg(l_discount) * 200 - 6, 4) AS t FROM lineitem GROUP BY 1, 2, 3),
full_clim AS (SELECT c.* FROM clim c SEMI JOIN (SELECT site, year FROM clim GROUP BY 1, 2 HAVING count(*) = 12) k ON k.site = c.site AND k.year = c.year),
parts AS (SELECT *, p * least(1, greatest(0, (3 - t) / 4)) AS s, least(1, greatest(0, t / 6)) AS f FROM full_clim)"""
_SNOW = _CLIM + """, pack AS (SELECT site, year, 0 AS i, CAST(0 AS DOUBLE) AS pack, CAST(0 AS DOUBLE) AS melt FROM parts WHERE m = 1
 UNION ALL SELECT k.site, k.year, k.i + 1, (k.pack + x.s) * (1 - x.f), (k.pack + x.s) * x.f FROM pack k JOIN parts x
  ON x.site = k.site AND x.year = k.year AND x.m = k.i % 12 + 1 WHERE k.i < 36),
rm AS (SELECT x.site, x.year, x.m AS month, x.p - x.s AS rain, k.melt FROM parts x JOIN pack k ON k.site = x.site AND k.year = x.year AND k.i = 24 + x.m)"""


def _climate(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        "l_quantity", "l_discount")
    cells = [F.sum(F.when(F.col("month") == m, F.col("l_quantity"))).alias(f"_p{m}") for m in V.MONTHS]
    cells += [F.round(F.avg(F.when(F.col("month") == m, F.col("l_discount"))) * 200 - 6, 4).alias(f"_t{m}") for m in V.MONTHS]
    wide = li.groupBy("site", "year").agg(*cells).select(
        "site", "year", F.array(*[F.col(f"_p{m}") for m in V.MONTHS]).alias("precip_mm"),
        F.array(*[F.col(f"_t{m}") for m in V.MONTHS]).alias("temp_c"))
    return wide.where(V.is_complete(F.col("precip_mm")))


@query("snow_balance", "FN-01", sql=f"WITH RECURSIVE {_SNOW} SELECT site, year, month, round(rain, 8) AS rain, round(melt, 4) AS melt FROM rm")
def _(spark, sf):
    out = W.snow_components(_climate(spark, sf))
    both = F.arrays_zip("rain", "melt")
    return out.select("site", "year", F.posexplode(both).alias("p", "z")).select(
        "site", "year", (F.col("p") + 1).alias("month"), R(F.col("z.rain"), 8).alias("rain"), R(F.col("z.melt"), 4).alias("melt"))


@query("normal_shape", "FN-02", sql=f"""WITH RECURSIVE {_SNOW} SELECT site, year, month, CASE WHEN avg(rain + melt) OVER w > 0 THEN round((rain + melt) / avg(rain + melt) OVER w, 6) ELSE 1 END AS v
FROM rm WINDOW w AS (PARTITION BY site, year)""")
def _(spark, sf):
    out = W.water_shape(_climate(spark, sf)).select("site", "year", F.col("shape").alias("q"))
    return V.month_rows(out, ["site", "year"]).withColumn("v", R(F.col("v")))


@query("snow_regime", "AGG-13", sql=f"""WITH RECURSIVE {_SNOW}, g AS (SELECT site, year, sum(rain) AS r, sum(melt) AS m, sum(month * melt) AS mm FROM rm GROUP BY 1, 2),
 f AS (SELECT *, CASE WHEN r + m > 0 THEN m / (r + m) ELSE 0 END AS fr FROM g)
SELECT site, year, round(fr, 6) AS snow_fraction, CASE WHEN fr >= 0.4 THEN 'snowmelt' WHEN fr <= 0.2 THEN 'rain' ELSE 'transitional' END AS regime,
 CASE WHEN m > 0 THEN round(mm / m, 6) END AS melt_center FROM f""")
def _(spark, sf):
    out = W.snow_components(_climate(spark, sf)).withColumn("fr", W.snow_fraction(F.col("rain"), F.col("melt")))
    center = F.when(V.total(F.col("melt")) > 0, V.center_of_timing(F.col("melt")))
    return out.select("site", "year", R(F.col("fr")).alias("snow_fraction"), W.regime(F.col("fr")).alias("regime"), R(center).alias("melt_center"))


# the part tree as a river; reaches take the climate of the suppliers in turn
def _reach_climate(spark, sf):
    """Suppliers whose record is whole in every year that any supplier has whole."""
    climate = checkpointed(_climate(spark, sf))
    years = climate.select("year").distinct()
    whole = climate.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") == years.agg(F.count("*")).scalar())
    turns = checkpointed(row_numbers(whole.select("site"), [], ["site"], "turn"))
    reaches = T.part_reaches(spark, sf).select("hydroseq").withColumn("turn", F.pmod("hydroseq", turns.agg(F.count("*")).scalar()) + 1)
    return reaches.join(turns, "turn").join(climate, "site").drop("site", "turn")


_TURNS = """ys AS (SELECT DISTINCT year FROM full_clim),
 turns AS (SELECT site, row_number() OVER (ORDER BY site) AS turn FROM (SELECT site FROM full_clim GROUP BY 1 HAVING count(DISTINCT year) = (SELECT count(*) FROM ys))),
 src AS (SELECT p_partkey + 1 AS h, t.site FROM part JOIN turns t ON t.turn = (p_partkey + 1) % (SELECT count(*) FROM turns) + 1)"""
_FLOW = _SNOW + f""", {_TURNS}, sh AS (SELECT site, year, month, CASE WHEN avg(rain + melt) OVER w > 0 THEN (rain + melt) / avg(rain + melt) OVER w ELSE 1 END AS shape
  FROM rm WINDOW w AS (PARTITION BY site, year)),
 anc AS (SELECT p_partkey + 1 AS h, p_partkey + 1 AS a FROM part UNION ALL SELECT h, a // 2 FROM anc WHERE a // 2 > 0),
 loc AS (SELECT src.h, s.year, s.month, s.shape * p.p_size AS v FROM src JOIN part p ON p.p_partkey + 1 = src.h JOIN sh s ON s.site = src.site),
 flow AS (SELECT a.a AS hydroseq, l.year, l.month, sum(l.v) AS v FROM loc l JOIN anc a ON a.h = l.h GROUP BY 1, 2, 3)"""


@query("yearly_flow", "FN-03", "FN-04", "UDF-03", sql=f"WITH RECURSIVE {_FLOW} SELECT hydroseq, year, month, round(v, 4) AS v FROM flow")
def _(spark, sf):
    reaches = T.part_reaches(spark, sf).select("hydroseq", "dnhydroseq", "q_incr")
    climate = _reach_climate(spark, sf)
    years = [r["year"] for r in climate.select("year").distinct().collect()]  # calendar years
    out = W.flow_from_source(reaches, lambda _: climate, years)
    return V.month_rows(out, ["hydroseq", "year"]).withColumn("v", R(F.col("v"), 4))


@query("climate_gaps", "FN-04", sql=f"""WITH {_CLIM}, {_TURNS} SELECT p_partkey + 1 AS hydroseq, year FROM part, ys WHERE (p_partkey + 1) % 10 = 3 AND year = 1997""")
def _(spark, sf):
    held = _reach_climate(spark, sf).where("NOT (hydroseq % 10 = 3 AND year = 1997)")
    return W.uncovered(T.part_reaches(spark, sf).select("hydroseq"), held)


@query("mass_balance", "AGG-43", sql=f"""WITH {HYDRO_SQL}, y AS (SELECT site, year, avg(v) AS m, sum(v) AS s FROM hyd GROUP BY 1, 2),
 a AS (SELECT l_suppkey AS site, sum(l_quantity) / 84 AS qama FROM lineitem GROUP BY 1), r AS (SELECT m / qama AS x FROM y JOIN a ON a.site = y.site WHERE qama > 1)
SELECT round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90 FROM r""")
def _(spark, sf):
    flow = T.complete_hydrograph(spark, sf).withColumnRenamed("site", "hydroseq")
    qama = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("hydroseq")).agg((F.sum("l_quantity") / 84).alias("qama"))
    out = W.mass_balance(flow, qama)
    return out.select(*[R(F.col(c)).alias(c) for c in out.columns])


@query("peak_month_counts", "AGG-43", sql=f"""WITH {HYDRO_SQL}, p AS (SELECT site, year, arg_min(month, (-v, month)) AS month FROM hyd GROUP BY 1, 2)
SELECT CAST(m AS INTEGER) AS month, count(p.site) AS reaches FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN p ON p.month = m GROUP BY 1""")
def _(spark, sf):
    return W.peak_month_counts(T.complete_hydrograph(spark, sf))


@query("band_numbers", "FN-05", sql="SELECT DISTINCT year(l_shipdate) AS year, month(l_shipdate) AS month, (year(l_shipdate) - 1895) * 12 + month(l_shipdate) AS band FROM lineitem")
def _(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).distinct()
    return rows.withColumn("band", W.band_number(F.col("year"), F.col("month")))


_GRID_INV = (0.31, 0.0, 2.0, 0.0, -0.17, 40.0)


@query("grid_cells", "GEO-16", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(0, least(19, floor(0.31 * l_quantity + 2))) AS INTEGER) AS col,
 CAST(greatest(0, least(29, floor(-0.17 * (l_suppkey % 300) + 40))) AS INTEGER) AS row FROM lineitem""")
def _(spark, sf):
    row, col = W.grid_cell(F.col("l_quantity"), F.col("l_suppkey") % 300, _GRID_INV, 20, 30)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", row.alias("row"), col.alias("col"))


@query("nodata_fill", "PRJ-11", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0.05 OR l_tax = 0.08 THEN 10.0 ELSE l_discount END AS v FROM lineitem""")
def _(spark, sf):
    v = F.when(F.col("l_tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", W.filled(v, 0.05, 10.0).alias("v"))


@query("gridded_climate", "SRC-13", sql="""WITH c AS (SELECT l_suppkey % 8 AS r, l_partkey % 8 AS c, year(l_shipdate) AS year, month(l_shipdate) AS month, max(l_quantity) AS v, max(l_tax) AS t FROM lineitem GROUP BY ALL),
 g AS (SELECT r, c, year FROM c GROUP BY ALL), mm AS (SELECT g.*, unnest(range(1, 13)) AS month FROM g)
SELECT p_partkey + 1 AS hydroseq, CAST(mm.year AS INTEGER) AS year, CAST(mm.month AS INTEGER) AS month, CASE WHEN c.v IS NULL OR c.v = 50 THEN 0 ELSE c.v END AS precip, coalesce(c.t, 10) AS temp
FROM part JOIN mm ON mm.r = p_partkey % 8 AND mm.c = p_size % 8 LEFT JOIN c ON c.r = mm.r AND c.c = mm.c AND c.year = mm.year AND c.month = mm.month""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem")
    base = li.select((F.col("l_suppkey") % 8).alias("row"), (F.col("l_partkey") % 8).alias("col"), F.year("l_shipdate").alias("year"),
                     F.month("l_shipdate").alias("month"), F.array(
                         F.struct(F.lit("precip").alias("var"), F.col("l_quantity").alias("value")),
                         F.struct(F.lit("temp").alias("var"), F.col("l_tax").alias("value"))).alias("x"))
    cells = base.select("row", "col", "year", "month", F.explode("x").alias("x")).select("row", "col", "year", "month", "x.*")
    reaches = T.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("hydroseq"), (F.col("p_partkey") % 8).alias("row"), (F.col("p_size") % 8).alias("col"))
    out = W.sampled_climate(reaches, cells, nodata=50.0)
    return out.select("hydroseq", "year", F.posexplode(F.arrays_zip("precip_mm", "temp_c")).alias("p", "z")).select(
        "hydroseq", "year", (F.col("p") + 1).alias("month"), F.col("z.precip_mm").alias("precip"), F.col("z.temp_c").alias("temp"))


@query("climatology_stack", "SRC-11", sql="""WITH m AS (SELECT l_partkey AS id, month(l_shipdate) AS month, max(l_quantity) AS p, max(l_suppkey) AS t FROM lineitem GROUP BY ALL),
 i AS (SELECT id, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT id FROM m))
SELECT i.id AS nhdplus_id, CAST(i.month AS INTEGER) AS month, coalesce(p / 100, 0) AS precip, coalesce(t / 100, 10) AS temp FROM i LEFT JOIN m ON m.id = i.id AND m.month = i.month""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("nhdplus_id"), F.month("l_shipdate").alias("month"),
                                               F.col("l_quantity").alias("p"), F.col("l_suppkey").cast("double").alias("t"))
    out = W.climatology(li.withColumnRenamed("p", "value"), li.withColumnRenamed("t", "value"))
    return out.select("nhdplus_id", F.posexplode(F.arrays_zip("precip_mm", "temp_c")).alias("p", "z")).select(
        "nhdplus_id", (F.col("p") + 1).alias("month"), F.col("z.precip_mm").alias("precip"), F.col("z.temp_c").alias("temp"))


_NET = """WITH e AS (SELECT p_partkey AS id, p_brand AS huc4, p_retailprice AS qama FROM part), v AS (SELECT l_partkey AS id, min(l_orderkey) AS hs, min(l_suppkey) AS dn FROM lineitem GROUP BY 1),
 x AS (SELECT c_custkey AS id, round(c_acctbal, 2) AS lon, c_nationkey * 1.0 AS lat FROM customer), j AS (SELECT e.*, v.hs, v.dn, x.lon, x.lat FROM e JOIN v ON v.id = e.id LEFT JOIN x ON x.id = e.id WHERE v.hs > 0),
 md AS (SELECT huc4, quantile_cont(lon, 0.5) AS ml, quantile_cont(lat, 0.5) AS mt FROM j GROUP BY 1)"""


@query("network_table", "SRC-12", "JN-01", sql=_NET + " SELECT id AS nhdplus_id, hs AS hydroseq, dn AS dnhydroseq, round(coalesce(lon, ml), 6) AS lon, round(coalesce(lat, mt), 6) AS lat FROM j JOIN md ON md.huc4 = j.huc4")
def _(spark, sf):
    erom = T.table(spark, sf, "part").select(F.col("p_partkey").alias("nhdplus_id"), F.col("p_brand").alias("huc4"), F.col("p_retailprice").alias("qama"))
    vaa = T.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("nhdplus_id")).agg(
        F.min("l_orderkey").alias("hydroseq"), F.min("l_suppkey").alias("dnhydroseq"))
    pos = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("nhdplus_id"), F.round("c_acctbal", 2).alias("lon"), F.col("c_nationkey").cast("double").alias("lat"))
    return W.build_network(erom, vaa, pos).select("nhdplus_id", "hydroseq", "dnhydroseq", R(F.col("lon")).alias("lon"), R(F.col("lat")).alias("lat"))


@query("lookup_defaults", "JN-02", sql="""SELECT p_partkey AS nhdplus_id, coalesce(s.o, 1) AS stream_order, coalesce(c.f, 0) AS flow, coalesce(l.q, 0) AS january
FROM part LEFT JOIN (SELECT s_suppkey AS id, s_nationkey AS o FROM supplier) s ON s.id = p_partkey LEFT JOIN (SELECT c_custkey AS id, c_acctbal AS f FROM customer) c ON c.id = p_partkey
LEFT JOIN (SELECT l_suppkey AS id, sum(l_quantity) FILTER (month(l_shipdate) = 1) AS q FROM lineitem GROUP BY 1) l ON l.id = p_partkey""")
def _(spark, sf):
    rows = T.table(spark, sf, "part").select(F.col("p_partkey").alias("nhdplus_id"))
    orders = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("nhdplus_id"), F.col("s_nationkey").alias("stream_order"))
    flows = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("nhdplus_id"), F.col("c_acctbal").alias("flow"))
    li = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("nhdplus_id"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("v"))
    out = W.with_lookup(rows, orders, flows, V.month_slots(li, ["nhdplus_id"], "month", "v"))
    return out.select("nhdplus_id", "stream_order", "flow", F.coalesce(F.element_at("q", 1), F.lit(0.0)).alias("january"))


@query("monthly_flow_rounded", "SRC-17", sql=f"WITH {HYDRO_SQL} SELECT site, year, month, round(v / 7, 4) AS v FROM hyd")
def _(spark, sf):
    out = T.complete_hydrograph(spark, sf).withColumn("q", V.rounded(F.transform("q", lambda x: x / 7), 4))
    return V.month_rows(out, ["site", "year"])


# --- text sources ---------------------------------------------------------------------

def _gauge_lines(spark, sf):
    ev = T.table(spark, sf, "events").select(F.concat(F.lit("gauge-"), F.col("user_id") % 10).alias("file"), "ts", "value", "event_type")
    day = F.date_format("ts", "yyyy-MM-dd")
    shown = F.when(F.col("event_type") == "error", F.lit("Ice")).otherwise(F.col("value").cast("string"))
    data = ev.select("file", F.concat_ws("\t", F.lit("USGS"), "file", day, shown, F.lit("A")).alias("value"))
    heads = ev.select("file").distinct().select("file", F.explode(F.array(
        F.lit("# daily values"), F.lit("agency_cd\tsite_no\tdatetime\t1_00060_00003\t1_00060_00003_cd"),
        F.lit("5s\t15s\t20d\t14n\t10s"))).alias("value"))
    return heads.unionByName(data)


_DAILY_SQL = """d AS (SELECT concat('gauge-', user_id % 10) AS file, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, value AS cfs FROM events WHERE event_type <> 'error')"""


@query("gauge_months", "SRC-06", sql=f"WITH {_DAILY_SQL} SELECT file, year, month, round(avg(cfs), 6) AS v FROM d GROUP BY 1, 2, 3")
def _(spark, sf):
    return V.month_rows(Tb.gauge_months(_gauge_lines(spark, sf)), ["file", "year"]).where("v IS NOT NULL").withColumn("v", R(F.col("v")))


@query("gauge_sites", "SRC-07", sql="""WITH s AS (SELECT concat('n', s_nationkey) AS file, s_suppkey AS k, s_acctbal AS lat FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT file, arg_min(lat, k) AS lat, CAST(min(k) AS DOUBLE) AS lon, CASE WHEN min(k) % 2 = 0 THEN 'NAD27' ELSE 'NAD83' END AS datum FROM s GROUP BY file""")
def _(spark, sf):
    sup = T.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    lat = F.when(k % 3 == 0, F.lit("unknown")).otherwise(F.col("s_acctbal").cast("string"))
    data = sup.select(F.concat(F.lit("n"), "s_nationkey").alias("file"), (k + 10).alias("line_no"), F.concat_ws(
        "\t", F.lit("USGS"), k.cast("string"), lat, k.cast("string"), F.when(k % 2 == 0, "NAD27").otherwise(F.lit(" "))).alias("value"))
    heads = data.select("file").distinct().select("file", F.posexplode(F.array(
        F.lit("# site"), F.lit("agency_cd\tsite_no\tdec_lat_va\tdec_long_va\tdec_coord_datum_cd"), F.lit("5s\t15s\t16s\t16s\t10s"))).alias("line_no", "value"))
    return Tb.gauge_sites(heads.select("file", F.col("line_no").cast("bigint").alias("line_no"), "value").unionByName(data))


@query("oni_index", "SRC-08", sql="""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_orderkey % 700 / 100.0), 6) AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(spark, sf):
    anom = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.format_string("%.2f", F.col("o_orderkey") % 700 / 100))
    lines = T.table(spark, sf, "orders").select(F.concat_ws("  ", F.lit(" DJF"), F.year("o_orderdate").cast("string"), F.lit("26.1"), anom).alias("value"))
    return Tb.oni_index(lines).withColumn("value", R(F.col("value")))


@query("pdo_index", "SRC-09", sql="""WITH m AS (SELECT 1900 + l_suppkey AS year, month(l_shipdate) AS month, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT year, round(avg(v), 6) AS value FROM m WHERE v < 50 GROUP BY 1""")
def _(spark, sf):
    li = T.table(spark, sf, "lineitem").select((F.col("l_suppkey") + 1900).alias("year"), F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("v"))
    wide = V.month_slots(li, ["year"], "month", "v", F.max)
    shown = F.transform("q", lambda x: F.when(x.isNull() | (x >= 50), F.lit("99.99")).otherwise(F.format_string("%.1f", x)))
    lines = wide.select(F.concat(F.col("year").cast("string"), F.lit("   "), F.array_join(shown, "  ")).alias("value"))
    return Tb.pdo_index(lines).select(F.col("year").cast("bigint").alias("year"), R(F.col("value")).alias("value"))


@query("facility_points", "SRC-14", sql="SELECT concat('kind', s_nationkey % 4) AS category, s_acctbal AS lon, CAST(s_suppkey AS DOUBLE) AS lat, s_name AS name FROM supplier WHERE s_nationkey % 4 <> 3")
def _(spark, sf):
    sup = T.table(spark, sf, "supplier")
    text = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.concat(F.lit("kind"), F.col("s_nationkey") % 4).alias("category"), F.col("s_name").alias("name")).alias("properties"),
        F.struct(F.array("s_acctbal", F.col("s_suppkey").cast("double")).alias("coordinates")).alias("geometry"))).alias("features")))
    docs = sup.select(F.from_json(text, Tb.FEATURE_COLLECTION).alias("d")).select("d.features")
    styles = spark.createDataFrame([("kind0",), ("kind1",), ("kind2",)], "category string")
    return Tb.facility_points(docs, styles)


@query("request_log", "SRC-15", sql="SELECT concat('REQ-', o_orderkey) AS request_id, o_orderpriority AS product, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, sf):
    text = F.to_json(F.struct(F.concat(F.lit("REQ-"), "o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("product"), F.col("o_orderstatus").alias("status")))
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.substring(text, 1, 20)).otherwise(text)
    return Tb.parse_requests(T.table(spark, sf, "orders").select(broken.alias("value"))).select("request_id", "product", "status")


# --- layers and classification -----------------------------------------------------------

_CODES = (390, 436, 493, 312, 445, 460, 466, 361, 378, 458, 487, 431, 488, 343, 369, 455, 336, 999)


def _code_sql(expr: str) -> str:
    return f"CASE {expr} % {len(_CODES) + 1} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CODES)) + " END"


def _features(spark, sf):
    k = F.col("l_partkey")
    code = F.expr(_code_sql("(l_partkey + l_linenumber)"))
    return T.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("nhdwaterbody", "NHDArea", "NHDPoint", "NHDLINE", "NHDFlowline")]), (k % 5 + 1).cast("int")).alias("layer"),
        code.cast("string").alias("FTYPE"), F.when(k % 2 == 0, F.concat(F.lit("Deep Inlet "), k)).otherwise(F.concat(F.lit("Bay "), k)).alias("gnis_name"),
        F.when(k % 3 == 0, k.cast("string")).alias("permanent_identifier"), F.col("l_suppkey").cast("string").alias("NHDPlusID"))


_FEATURES_SQL = f"""feat AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_partkey % 5 AS ly, {_code_sql('(l_partkey + l_linenumber)')} AS code,
 CASE WHEN l_partkey % 2 = 0 THEN concat('Deep Inlet ', l_partkey) ELSE concat('Bay ', l_partkey) END AS name,
 CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END AS source_id FROM lineitem)"""


@query("layer_scan", "SRC-01", "SRC-02", "PRJ-06", sql=f"WITH {_FEATURES_SQL} SELECT id, source_id, code AS ftype FROM feat WHERE ly IN (0, 1)")
def _(spark, sf):
    return K.with_codes(Ly.family(_features(spark, sf), "waterbody")).select("id", "source_id", "ftype")


def _class_sql(classes: dict, labels: dict, policy: str, scope: str, layers: str, inlet: bool = False) -> str:
    arms = " ".join(f"WHEN {c} THEN '{n}'" for c, n in classes.items())
    names = " ".join(f"WHEN {c} THEN '{n}'" for c, n in labels.items())
    cls = f"CASE code {arms} ELSE 'excluded' END"
    if inlet:
        cls = f"CASE WHEN code = 312 AND contains(lower(name), 'inlet') THEN 'inlet' ELSE {cls} END"
    return f"""WITH {_FEATURES_SQL}, c AS (SELECT id, code, {cls} AS class, CASE code {names} ELSE 'unknown' END AS label FROM feat WHERE ly IN ({layers}))
SELECT id, class, CASE WHEN code IS NULL THEN 'excluded: source FType missing; cannot classify by type/code'
 WHEN class = 'excluded' THEN concat('excluded: FType ', code, ' (', label, ') is not an included {scope} under policy {policy}')
 ELSE concat('classified as ', class, ': FType ', code, ' (', label, ')') END AS inclusion_reason, CASE WHEN code IS NULL THEN 'missing_ftype' ELSE '' END AS flags FROM c"""


def _classified(fn, fam):
    def run(spark, sf):
        out = fn(K.with_codes(Ly.family(_features(spark, sf), fam)))
        return out.select("id", "class", "inclusion_reason", F.array_join("qa_flags", ",").alias("flags"))
    return run


query("classify_waterbodies", "PRJ-02", sql=_class_sql(X.WATERBODY_CLASS, X.WATERBODY_LABEL, X.WATERBODY_POLICY, "water class", "0, 1", True))(
    _classified(K.classify_waterbodies, "waterbody"))
query("classify_areal", "PRJ-03", sql=_class_sql(X.AREAL_CLASS, X.AREAL_LABEL, X.AREAL_POLICY, "areal natural feature", "0, 1"))(
    _classified(K.classify_areal, "waterbody"))
query("classify_points", "PRJ-04", sql=_class_sql(X.POINT_CLASS, X.POINT_LABEL, X.POINT_POLICY, "natural point feature", "2"))(
    _classified(K.classify_points, "point"))
query("classify_structures", "PRJ-05", sql=_class_sql(X.STRUCTURE_CLASS, X.STRUCTURE_LABEL, X.STRUCTURE_POLICY, "hydro structure", "3"))(
    _classified(K.classify_structures, "line"))


@query("channel_classes", "PRJ-01", sql="""WITH s AS (SELECT p_partkey AS segment_id, CASE p_size % 8 WHEN 0 THEN 460 WHEN 1 THEN 336 WHEN 2 THEN 428 WHEN 3 THEN 558 WHEN 4 THEN 334 WHEN 5 THEN 566 WHEN 6 THEN 999 END AS f FROM part)
SELECT segment_id, CASE f WHEN 336 THEN 'canal_ditch' WHEN 428 THEN 'pipeline' WHEN 558 THEN 'artificial_path' WHEN 334 THEN 'connector' WHEN 566 THEN 'coastline' ELSE 'stream' END AS channel,
 CASE f WHEN 336 THEN '8,4' WHEN 428 THEN '2,4' WHEN 558 THEN '6,3,2,3' END AS dash FROM s""")
def _(spark, sf):
    code = F.expr("CASE p_size % 8 WHEN 0 THEN 460 WHEN 1 THEN 336 WHEN 2 THEN 428 WHEN 3 THEN 558 WHEN 4 THEN 334 WHEN 5 THEN 566 WHEN 6 THEN 999 END")
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("segment_id"), K.channel_class(code).alias("channel"), K.channel_dash(code).alias("dash"))


@query("minimum_order", "PRJ-07", sql="SELECT p_brand AS huc, count(*) AS kept FROM part WHERE p_size >= 48 GROUP BY 1")
def _(spark, sf):
    seg = T.table(spark, sf, "part").select(F.col("p_brand").alias("huc"), F.col("p_size").alias("stream_order"))
    return K.minimum_order(seg, 48).groupBy("huc").agg(F.count("*").alias("kept"))


@query("region_alias", "PRJ-08", sql=f"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'conus' WHEN 1 THEN 'oregon' WHEN 2 THEN 'Alaska' ELSE 'Narnia' END AS a FROM orders),
 s AS (SELECT unnest(['{"','".join(X.STATES)}']) AS region)
SELECT s.region, count(*) AS n FROM r JOIN s ON (lower(r.a) = lower(s.region)) OR (r.a = 'conus' AND s.region NOT IN ('Hawaii', 'Alaska')) GROUP BY 1""")
def _(spark, sf):
    asked = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'conus' WHEN 1 THEN 'oregon' WHEN 2 THEN 'Alaska' ELSE 'Narnia' END")
    out = G.expand_regions(T.table(spark, sf, "orders").select(asked.alias("region")))
    return out.where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"))


@query("month_selection", "PRJ-09", sql=f"WITH {HYDRO_SQL} SELECT site, year, sum(v) AS v FROM hyd WHERE month IN (11, 12, 1, 2) GROUP BY 1, 2")
def _(spark, sf):
    long = V.month_rows(T.complete_hydrograph(spark, sf), ["site", "year"])
    return long.where(G.month_filter(G.parse_months("nov-feb"))).groupBy("site", "year").agg(F.sum("v").alias("v"))


@query("year_selection", "PRJ-10", "UDF-06", sql=f"WITH {HYDRO_SQL} SELECT DISTINCT site, year FROM hyd WHERE year IN (1996, 1998, 1999)")
def _(spark, sf):
    years = G.normalize_years([1999, 1996, 1998, 1996])
    return T.complete_hydrograph(spark, sf).where(F.col("year").isin(*years)).select("site", "year")


# --- styling --------------------------------------------------------------------------------

@query("order_widths", "FN-06", sql="SELECT p_partkey, round(CASE WHEN p_size <= 1 THEN 0.5 ELSE 0.5 + (p_size - 1) / ((SELECT max(p_size) FROM part) - 1.0) * 1.0 END, 6) AS width FROM part")
def _(spark, sf):
    part = T.table(spark, sf, "part")
    top = part.agg(F.max("p_size")).scalar()
    return part.select("p_partkey", R(Y.order_width(F.col("p_size"), top, 0.5)).alias("width"))


@query("flow_widths", "FN-07", sql="""WITH l AS (SELECT c_custkey, ln(greatest(c_acctbal, 0.01)) AS v FROM customer)
SELECT c_custkey, round(0.4 + 2.0 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS width FROM l""")
def _(spark, sf):
    return Y.flow_widths(T.table(spark, sf, "customer"), "c_acctbal", 0.4).select("c_custkey", R(F.col("width")).alias("width"))


@query("scaled_widths", "FN-08", sql="""SELECT p_partkey, round(0.2 + 1.8 * ((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())) ** 1.5, 6) AS width FROM part""")
def _(spark, sf):
    return Y.scaled_widths(T.table(spark, sf, "part"), "p_retailprice", 0.2, 2.0, 1.5).select("p_partkey", R(F.col("width")).alias("width"))


@query("monthly_width_frames", "FN-09", sql=f"""WITH {HYDRO_SQL}, s AS (SELECT ln(greatest(min(v), 0.01)) AS lo, ln(greatest(max(v), 0.01)) AS hi FROM hyd WHERE v > 0)
SELECT site, year, month, round(0.2 + 2.8 * least(1, greatest(0, (ln(greatest(v, 0.01)) - lo) / greatest(hi - lo, 1e-9))), 6) AS width FROM hyd, s""")
def _(spark, sf):
    out = Y.monthly_width_frames(T.complete_hydrograph(spark, sf), 0.2, 3.0)
    return V.month_rows(out, ["site", "year"], "widths", "width").withColumn("width", R(F.col("width")))


@query("hypsometric_colors", "FN-10", sql="""WITH a AS (SELECT quantile_cont(p_retailprice, 0.9) AS an FROM part), t AS (SELECT p_partkey, least(1, greatest(0, p_retailprice / an)) ** 0.75 AS t FROM part, a)
SELECT p_partkey, concat('#', lower(lpad(to_hex(CAST(round_even(26 + 229 * t, 0) AS BIGINT)), 2, '0')), lower(lpad(to_hex(CAST(round_even(72 + 183 * t, 0) AS BIGINT)), 2, '0')), lower(lpad(to_hex(CAST(round_even(156 + 99 * t, 0) AS BIGINT)), 2, '0'))) AS color FROM t""")
def _(spark, sf):
    from rillwork.operators.scale import exact_percentiles
    part = T.table(spark, sf, "part")
    anchor = exact_percentiles(part, "p_retailprice", [0.9]).select("p0").scalar()
    return part.select("p_partkey", Y.hypsometric_color(F.col("p_retailprice"), anchor).alias("color"))


@query("reach_elevations", "FN-11", "FN-12", sql="""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN -9998 ELSE l_quantity * 100 END AS a, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS b FROM lineitem),
 v AS (SELECT *, list_filter([a, b], lambda x: x IS NOT NULL AND x > -9998) AS l FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(list_avg(l), 0) / 100, 7) AS mean_m, round(coalesce(list_max(l), 0) / 100, 7) AS max_m, round(coalesce(list_max(l), 0) / 100 * 1.5 + 3, 7) AS shown_m FROM v""")
def _(spark, sf):
    lo = F.when(F.col("l_tax") == 0, F.lit(None)).when(F.col("l_discount") == 0, F.lit(-9998.0)).otherwise(F.col("l_quantity") * 100)
    hi = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    mean, top = Y.reach_elevation(lo, hi)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R(mean, 7).alias("mean_m"), R(top, 7).alias("max_m"),
                                                 R(Y.display_elevation(top, 1.5, 3.0), 7).alias("shown_m"))


@query("number_text", "FN-13", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN t IN ('-0', '') THEN '0' ELSE t END AS text FROM (
 SELECT *, regexp_replace(regexp_replace(printf('%.2f', l_extendedprice - 40000), '0+$', ''), '\\.$', '') AS t FROM lineitem)""")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 Y.number_text(F.col("l_extendedprice") - 40000, 2).alias("text"))


@query("sample_values", "FN-16", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN l_quantity END AS value FROM lineitem")
def _(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Y.sample_value(
        F.col("l_quantity"), F.col("l_returnflag") != "R", F.col("l_linestatus") != "O").alias("value"))


@query("provenance_rules", "FN-17", sql="""SELECT page_id, 'resolution_m' AS rule FROM pages WHERE page_id % 7 - 1 <= 0 UNION ALL SELECT page_id, 'checksum' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 'horizontal_crs' FROM pages WHERE page_id % 3 = 0""")
def _(spark, sf):
    k = F.col("page_id")
    rows = T.table(spark, sf, "pages").select("page_id", F.col("url").alias("source_url"), F.lit("dem").alias("source_product"), F.lit("2024-01-01").alias("acquisition_date"),
                                              F.when(k % 3 == 0, " ").otherwise("EPSG:5070").alias("horizontal_crs"), F.when(k % 5 != 0, "abc").alias("checksum"),
                                              (k % 7 - 1).cast("double").alias("resolution_m"))
    return L.violations(rows, "page_id", Y.provenance_rules())


# --- notebook summaries ---------------------------------------------------------------------

@query("basin_discharge", "AGG-26", "JN-22", sql="""WITH d AS (SELECT substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 5, 3) AS huc4, count(*) AS reaches, max(c_acctbal) AS q_max, round(sum(c_acctbal), 4) AS q_total FROM customer WHERE c_acctbal > 0 GROUP BY 1),
 p AS (SELECT concat(substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 5, 3), 'xx') AS code, p_partkey FROM part)
SELECT p.p_partkey, reaches, q_max, q_total FROM p LEFT JOIN d ON d.huc4 = substr(p.code, 1, 3)""")
def _(spark, sf):
    cust = T.table(spark, sf, "customer").where("c_acctbal > 0")
    code = lambda c: F.substring(F.lpad(F.col(c).cast("string"), 8, "0"), 5, 3)
    basins = cust.groupBy(code("c_custkey").alias("huc4")).agg(F.count("*").alias("reaches"), F.max("c_acctbal").alias("q_max"), R(F.sum("c_acctbal"), 4).alias("q_total"))
    polygons = T.table(spark, sf, "part").select("p_partkey", code("p_partkey").alias("huc4"))
    return polygons.join(basins, "huc4", "left").select("p_partkey", "reaches", "q_max", "q_total")


@query("basins_by_state", "AGG-27", sql="""WITH s AS (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS state FROM part)
SELECT state, count(DISTINCT p_partkey % 100) AS basins, sum(p_size) AS total_km2 FROM s GROUP BY 1""")
def _(spark, sf):
    rows = T.table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("b"), "p_size", F.explode(F.split("p_name", " ")).alias("state"))
    return rows.groupBy("state").agg(F.count_distinct("b").alias("basins"), F.sum("p_size").alias("total_km2"))


@query("basin_clusters", "AGG-28")
def _(spark, sf):
    from rillwork.operators.clusters import basin_clusters
    feats = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("basin")).agg(
        F.sum("l_quantity").alias("area"), F.max("l_extendedprice").alias("q_max"), F.avg("l_tax").alias("density"), F.avg("l_discount").alias("mean_q"))
    return basin_clusters(feats, ["area", "q_max", "density", "mean_q"])


@query("largest_basins", "SRT-05", sql="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def _(spark, sf):
    return T.table(spark, sf, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select("c_custkey", "c_acctbal")


@query("label_candidates", "SRT-08", sql="""WITH b AS (SELECT p_name AS name, max(p_retailprice) AS flow, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS point FROM part WHERE trim(p_name) <> '' GROUP BY 1)
SELECT name, flow, point FROM b ORDER BY flow DESC, name LIMIT 8""")
def _(spark, sf):
    named = T.table(spark, sf, "part").where(F.trim("p_name") != "")
    best = named.groupBy(F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("flow"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("point"))
    return best.orderBy(F.col("flow").desc(), "name").limit(8)


@query("basin_union", "SET-01", sql="""WITH u AS (SELECT c_custkey AS id, c_acctbal AS v, 0 AS l FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier)
SELECT id, arg_max(v, l) AS v FROM u GROUP BY 1""")
def _(spark, sf):
    a = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    b = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return Ly.union_basins([a, b], "id")


@query("all_basins", "SET-07", sql="SELECT p_brand, min(p_partkey) AS pos FROM part GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("pos"))


@query("huc_prefix_match", "JN-21", sql="SELECT c_custkey FROM customer WHERE starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0007') OR starts_with(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '00012')")
def _(spark, sf):
    units = T.table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"))
    from rillwork.operators.spatial import prefix_match
    return prefix_match(units, "code", ["0007", "00012"]).select("c_custkey")
