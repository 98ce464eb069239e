"""Facility records, operator times and the watershed report over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.functions import vectors as V
from rillwork.operators import facilities as B
from rillwork.operators import network as N
from rillwork.plans import standins as T
from rillwork.plans.hydrograph_queries import _TREND_SQL, TAIL_SQL
from rillwork.plans.registry import query
from rillwork.plans.report import watershed_report
from rillwork.plans.standins import ANNUAL_SQL, HYDRO_SQL, INDEX_SQL, R


def _registry(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        (k + 110000000000).cast("string").alias("REGISTRY_ID"), F.concat(F.lit(" "), "s_name").alias("PRIMARY_NAME"), F.lit("Leesburg").alias("CITY_NAME"),
        F.when(k % 2 == 0, "va").otherwise("MD").alias("STATE_CODE"), F.when(k % 9 == 0, "n/a").otherwise((k / 10).cast("string")).alias("LATITUDE83"),
        F.lit("-77.5").alias("LONGITUDE83"), F.lit("221310").alias("NAICS_CODES"))


@query("registry_rows", "FAC-01", sql="SELECT CAST(s_suppkey + 110000000000 AS VARCHAR) AS external_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'VA' ELSE 'MD' END AS jurisdiction, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey / 10 END AS lat FROM supplier")
def _(spark, sf):
    return B.normalize_registry(_registry(spark, sf)).select("external_id", "name", "jurisdiction", "lat")


@query("authority_match", "FAC-02", sql="SELECT c_custkey AS candidate_id, s_suppkey AS facility_id, 1.0 AS confidence FROM customer JOIN supplier ON s_suppkey = c_custkey % 150")
def _(spark, sf):
    cand = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.lit("EPA_FRS").alias("authority"), (F.col("c_custkey") % 150 + 110000000000).cast("string").alias("external_id"))
    known = B.normalize_registry(_registry(spark, sf)).withColumn("facility_id", F.col("external_id").cast("bigint") - 110000000000)
    return B.match_by_authority(cand, known).select("candidate_id", "facility_id", "confidence")


@query("likeness_match", "FAC-03", sql="""WITH k AS (SELECT s_suppkey AS f, concat('Water Works ', s_suppkey % 40) AS n, s_nationkey % 3 AS j, 39.0 + (s_suppkey % 10) * 0.05 AS lat, -77.0 + (s_suppkey // 10) * 0.05 AS lon FROM supplier),
 c AS (SELECT p_partkey AS candidate_id, concat('water works, ', p_partkey % 40, CASE WHEN p_size % 4 = 0 THEN ' plant' ELSE '' END) AS n, p_size % 3 AS j, 39.0 + (p_partkey % 10) * 0.05 + (p_size % 5) * 0.001 AS lat, -77.0 + (p_partkey // 10 % 10) * 0.05 AS lon FROM part),
 m AS (SELECT c.candidate_id, k.f, 2 * 6371008.8 * asin(sqrt(sin(radians(k.lat - c.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(k.lat)) * sin(radians(k.lon - c.lon) / 2) ** 2)) AS d, string_split(regexp_replace(k.n, 'W', 'w', 'g'), ' ') AS a, string_split(replace(c.n, ',', ''), ' ') AS b FROM c JOIN k ON c.j = k.j),
 s AS (SELECT candidate_id, f, round(0.5 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.2 + 0.3 * greatest(0, 1 - d / 500), 6) AS score FROM m WHERE d <= 500),
 b AS (SELECT candidate_id, max(score) AS score, count(*) FILTER (score = mx) AS eq, arg_min(f, (-score, f)) AS f FROM (SELECT *, max(score) OVER (PARTITION BY candidate_id) AS mx FROM s) GROUP BY 1)
SELECT c.candidate_id, b.f AS facility_id, coalesce(round(b.score, 4), 0) AS confidence, CASE WHEN b.score >= 0.85 AND b.eq = 1 THEN 'linked' WHEN b.score >= 0.6 THEN 'review' ELSE 'distinct' END AS decision FROM c LEFT JOIN b ON b.candidate_id = c.candidate_id""")
def _(spark, sf):
    k = F.col("s_suppkey")
    known = T.table(spark, sf, "supplier").select(k.alias("facility_id"), F.concat(F.lit("Water Works "), k % 40).alias("name"), F.lit("Main St").alias("address"),
                                                  (F.col("s_nationkey") % 3).alias("jurisdiction"), (39.0 + k % 10 * 0.05).alias("lat"), (-77.0 + F.floor(k / 10) * 0.05).alias("lon"))
    p, s = F.col("p_partkey"), F.col("p_size")
    cand = T.table(spark, sf, "part").select(p.alias("candidate_id"), F.concat(F.lit("water works, "), p % 40, F.when(s % 4 == 0, " plant").otherwise("")).alias("name"), F.lit("main st").alias("address"),
                                             (s % 3).alias("jurisdiction"), (39.0 + p % 10 * 0.05 + s % 5 * 0.001).alias("lat"), (-77.0 + F.floor(p / 10) % 10 * 0.05).alias("lon"))
    return B.match_by_likeness(cand, known).withColumn("confidence", R(F.col("confidence"), 4))


_MEAS = """m AS (SELECT l_suppkey AS facility_id, CASE l_linenumber % 3 WHEN 0 THEN 'withdrawal' WHEN 1 THEN 'discharged' ELSE 'delivered' END AS measure_type, CASE WHEN l_returnflag = 'R' THEN 'reported' ELSE 'measured' END AS quantity_status,
 CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS v, l_shipdate AS ps, l_shipdate + INTERVAL 30 DAY AS pe FROM lineitem)"""


def _measurements(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("facility_id"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'withdrawal' WHEN 1 THEN 'discharged' ELSE 'delivered' END").alias("measure_type"),
        F.when(F.col("l_returnflag") == "R", "reported").otherwise("measured").alias("quantity_status"), F.when(F.col("l_tax") != 0, F.col("l_quantity")).cast("decimal(20,6)").alias("canonical_value"),
        F.col("l_shipdate").alias("period_start"), (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("period_end"))


@query("measurement_totals", "FAC-04", sql=f"""WITH {_MEAS} SELECT facility_id, quantity_status, sum(v) AS total_value, count(v) AS count, count(*) - count(v) AS unavailable FROM m
WHERE measure_type = 'discharged' AND ps >= TIMESTAMP '1997-01-01' AND pe <= TIMESTAMP '1998-12-31' GROUP BY 1, 2""")
def _(spark, sf):
    stamp = lambda s: F.lit(s).cast("timestamp")
    out = B.aggregate_measurements(_measurements(spark, sf), "discharged", start=stamp("1997-01-01"), end=stamp("1998-12-31"), by_facility=True)
    return out.withColumn("total_value", F.col("total_value").cast("double"))


@query("source_keys", "FAC-05", sql="SELECT concat('BULK:', s_suppkey) AS source_key FROM supplier")
def _(spark, sf):
    return B.keyed_source(T.table(spark, sf, "supplier"), "bulk_file", "s_suppkey").select("source_key")


@query("source_registry", "FAC-06", sql="SELECT c_mktsegment AS jurisdiction, CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE 'unverified' END AS standing, count(*) AS n FROM customer GROUP BY 1, 2")
def _(spark, sf):
    reg = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("jurisdiction"), F.when(F.col("c_custkey") % 3 == 0, True).alias("verified"))
    return B.registry_partition(reg).groupBy("jurisdiction", "standing").agg(F.count("*").alias("n"))


@query("evidence_ranking", "FAC-07", sql="""WITH e AS (SELECT l_suppkey AS f, CASE least(l_linenumber, l_suppkey % 8) WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 END AS rank, l_orderkey AS ev FROM lineitem)
SELECT s_suppkey AS facility_id, min(rank) AS rank, CASE WHEN min(rank) IS NULL THEN 'candidate' ELSE 'water_relevant' END AS standing FROM supplier LEFT JOIN e ON e.f = s_suppkey GROUP BY 1""")
def _(spark, sf):
    kind = F.expr("CASE least(l_linenumber, l_suppkey % 8) WHEN 1 THEN 'operator_disclosure' WHEN 2 THEN 'capacity_agreement' WHEN 3 THEN 'other_permit' WHEN 4 THEN 'withdrawal_permit' WHEN 5 THEN 'metered_volume' ELSE 'naics' END")
    ev = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("facility_id"), kind.alias("kind"), F.col("l_orderkey").alias("evidence_id"))
    return B.best_evidence(T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("facility_id")), ev).select("facility_id", "rank", "standing")


@query("public_claims", "FAC-08", sql="""WITH c AS (SELECT o_orderkey, o_custkey % 5 AS au, o_orderdate AS as_of, CASE o_orderkey % 3 WHEN 0 THEN 'publishable_precise' WHEN 1 THEN 'publishable_generalized' ELSE 'internal_only' END AS eligibility, o_totalprice AS lat FROM orders WHERE o_orderstatus = 'F'),
 a AS (SELECT n_nationkey AS alert_id, n_nationkey % 5 AS au, TIMESTAMP '1996-01-10' + INTERVAL (n_nationkey * 40) DAY AS f, TIMESTAMP '1996-01-10' + INTERVAL (n_nationkey * 40 + 75) DAY AS t FROM nation WHERE n_nationkey % 2 = 0),
 h AS (SELECT c.o_orderkey, a.alert_id FROM c JOIN a ON a.au = c.au AND c.as_of BETWEEN a.f AND a.t)
SELECT c.o_orderkey, eligibility, CASE WHEN eligibility = 'publishable_precise' THEN lat END AS lat, h.alert_id FROM c LEFT JOIN h ON h.o_orderkey = c.o_orderkey WHERE eligibility <> 'internal_only'""")
def _(spark, sf):
    k = F.col("o_orderkey")
    claims = T.table(spark, sf, "orders").select(k, (F.col("o_custkey") % 5).alias("authority"), F.col("o_orderdate").alias("as_of"),
                                                 F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'publishable_precise' WHEN 1 THEN 'publishable_generalized' ELSE 'internal_only' END").alias("eligibility"),
                                                 F.when(F.col("o_orderstatus") == "F", "approved").otherwise("open").alias("review"), F.col("o_totalprice").alias("lat"), F.col("o_totalprice").alias("lon"))
    n = F.col("n_nationkey")
    begin = F.lit("1996-01-10").cast("timestamp")
    alerts = T.table(spark, sf, "nation").select(n.alias("alert_id"), (n % 5).cast("bigint").alias("authority"), (begin + F.make_dt_interval(n * 40)).alias("valid_from"),
                                                 (begin + F.make_dt_interval(n * 40 + 75)).alias("valid_to"), (n % 2 == 0).alias("active"))
    return B.attach_alerts(B.public_claims(claims), alerts, "o_orderkey").select("o_orderkey", "eligibility", "lat", "alert_id")


@query("operator_times", "FAC-10", sql="""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'proof_ready' WHEN 'click' THEN 'revision_requested' WHEN 'error' THEN 'render_failed' ELSE 'note' END AS event FROM events),
 p AS (SELECT user_id, epoch(date_trunc('second', min(ts) FILTER (event = 'accepted'))) AS a, epoch(date_trunc('second', min(ts) FILTER (event = 'proof_ready'))) AS p, count(*) FILTER (event = 'revision_requested') AS r, count(*) FILTER (event = 'render_failed') AS f FROM e GROUP BY 1)
SELECT count(*) AS requests, round(avg(r), 6) AS revisions_per_request, round(avg(CASE WHEN f > 0 THEN 1 ELSE 0 END), 6) AS failure_rate, round(quantile_cont((p - a) / 3600.0, 0.5) FILTER (p >= a), 5) AS median_hours, round(quantile_cont((p - a) / 3600.0, 0.9) FILTER (p >= a), 5) AS p90_hours FROM p""")
def _(spark, sf):
    ev = F.expr("CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'proof_ready' WHEN 'click' THEN 'revision_requested' WHEN 'error' THEN 'render_failed' ELSE 'note' END")
    out = B.operator_times(T.table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.col("ts").alias("at"), ev.alias("event")))
    return out.select("requests", *[R(F.col(c)).alias(c) for c in ("revisions_per_request", "failure_rate")], *[R(F.col(c), 5).alias(c) for c in ("median_hours", "p90_hours")])


def _trend_sql(name, values):
    return f"{name} AS (WITH vals AS ({values}){_TREND_SQL.format(src='vals')} SELECT * FROM verdict)"


_R_SQL = "CASE WHEN count(*) >= 2 AND stddev_pop(a.value) <> 0 AND stddev_pop(i.value) <> 0 THEN round(corr(a.value, i.value), 4) END"


@query("watershed_report", "AGG-44", sql=f"""WITH {ANNUAL_SQL}, {INDEX_SQL},
{_trend_sql('tm', 'SELECT * FROM annual')},
{_trend_sql('tl', 'SELECT site, year, min(v) AS value FROM hyd WHERE month IN (6, 7, 8) GROUP BY 1, 2')},
{_trend_sql('tc', 'SELECT site, year, sum(month * v) / sum(v) AS value FROM hyd GROUP BY 1, 2')},
g AS (SELECT l_suppkey AS site, year(l_shipdate) AS year, month(l_shipdate) AS month, sum(l_extendedprice / 2000) AS obs FROM lineitem GROUP BY 1, 2, 3),
pairs AS (SELECT h.site, h.v AS model, g.obs FROM hyd h JOIN g ON g.site = h.site AND g.year = h.year AND g.month = h.month),
sk AS (SELECT site, avg(model - obs) AS bias, sqrt(avg((model - obs) ** 2)) AS rmse, corr(model, obs) AS r,
  1 - sum((obs - model) ** 2) / (var_pop(obs) * count(*)) AS nse FROM pairs GROUP BY 1),
r0 AS (SELECT a.site, {_R_SQL} AS r FROM annual a JOIN idx i ON i.index = 'oni' AND a.year = i.year GROUP BY 1),
r1 AS (SELECT a.site, {_R_SQL} AS r FROM annual a JOIN idx i ON i.index = 'oni' AND a.year = i.year + 1 GROUP BY 1)
SELECT tm.site, tm.n, tm.s, round(tm.tau, 4) AS tau, round(tm.slope, 4) AS slope, tm.trend, tl.trend AS low_trend, round(tl.slope, 4) AS low_slope,
  tc.trend AS ct_trend, round(tc.slope * 10 * 30.4368, 4) AS ct_days_per_decade, round(sk.r, 4) AS pearson_r, round(sk.nse, 4) AS nse,
  round(sk.bias, 4) AS bias, round(sk.rmse, 4) AS rmse, CASE WHEN sk.nse >= 0.75 AND sk.r >= 0.9 THEN 'good' WHEN sk.nse >= 0.5 AND sk.r >= 0.7 THEN 'moderate' ELSE 'weak' END AS verdict,
  r0.r AS index_r, r1.r AS index_r_lag1, round({TAIL_SQL.replace('z', 'tm.z')}, 4) AS p
FROM tm LEFT JOIN tl ON tl.site = tm.site LEFT JOIN tc ON tc.site = tm.site LEFT JOIN sk ON sk.site = tm.site
LEFT JOIN r0 ON r0.site = tm.site LEFT JOIN r1 ON r1.site = tm.site""")
def _(spark, sf):
    hydro = T.complete_hydrograph(spark, sf)
    li = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_extendedprice") / 2000).alias("v"))
    gauge = V.month_slots(li, ["site", "year"], "month", "v")
    oni = T.climate_index(spark, sf).where("index = 'oni'").select("year", "value")
    out = watershed_report(hydro, gauge, oni)
    figures = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[R(F.col(c), 4).alias(c) if c in figures else c for c in out.columns])
