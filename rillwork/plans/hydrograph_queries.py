"""Hydrograph statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.functions import series as S
from rillwork.functions import vectors as V
from rillwork.operators import hydrographs as H
from rillwork.plans import standins as T
from rillwork.plans.registry import query
from rillwork.plans.standins import ANNUAL_SQL, HYDRO_SQL, INDEX_SQL, MONTHLY_SQL, PAIRS_SQL, R

Q = "q"


@query("peak_flow", "AGG-03", sql=f"WITH {HYDRO_SQL} SELECT site, year, max(v) AS peak FROM hyd GROUP BY 1, 2")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select("site", "year", V.peak_flow(Q).alias("peak"))


@query("low_flow", "AGG-04", sql=f"""WITH {HYDRO_SQL}
SELECT site, year, min(v) AS low FROM hyd WHERE month IN (6, 7, 8) GROUP BY 1, 2""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select("site", "year", V.low_flow(Q).alias("low"))


@query("center_of_timing", "AGG-05", sql=f"""WITH {HYDRO_SQL}
SELECT site, year, round(sum(month * v) / sum(v), 6) AS center FROM hyd GROUP BY 1, 2""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select(
        "site", "year", R(V.center_of_timing(Q)).alias("center"))


@query("flashiness", "AGG-06", sql=f"""WITH {HYDRO_SQL}, d AS (
 SELECT site, year, v, abs(v - lag(v) OVER (PARTITION BY site, year ORDER BY month)) AS dv FROM hyd)
SELECT site, year, round(sum(dv) / sum(v), 6) AS flashiness FROM d GROUP BY 1, 2""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select(
        "site", "year", R(V.flashiness(Q)).alias("flashiness"))


@query("seasonal_ratio", "AGG-07", sql=f"""WITH {HYDRO_SQL}
SELECT site, year, round(avg(v) FILTER (month IN (11, 12, 1, 2, 3, 4))
     / avg(v) FILTER (month BETWEEN 5 AND 10), 6) AS ratio FROM hyd GROUP BY 1, 2""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select(
        "site", "year", R(V.seasonal_ratio(Q)).alias("ratio"))


_FDC = (5.0, 10.0, 50.0, 90.0, 95.0)
_FDC_SQL = " UNION ALL ".join(
    f"SELECT site, {{dec}} {x}::DOUBLE AS exceedance, round(quantile_cont(v, {(100 - x) / 100}), 6) AS flow "
    f"FROM hyd GROUP BY ALL" for x in _FDC)


@query("flow_duration", "AGG-08", sql=f"WITH {HYDRO_SQL} " + _FDC_SQL.replace("{dec}", ""))
def _(spark, sf):
    return H.flow_duration(T.complete_hydrograph(spark, sf), _FDC).withColumn("flow", R(F.col("flow")))


@query("decade_flow_duration", "AGG-09",
       sql=f"WITH {HYDRO_SQL} " + _FDC_SQL.replace("{dec}", "CAST(floor(year / 5.0) * 5 AS INTEGER) AS decade,"))
def _(spark, sf):
    return H.decade_flow_duration(T.complete_hydrograph(spark, sf), _FDC, 5).withColumn(
        "flow", R(F.col("flow")))


_TREND_SQL = """, pos AS (SELECT site, value, row_number() OVER (PARTITION BY site ORDER BY year) AS k,
  count(*) OVER (PARTITION BY site) AS n FROM {src}),
pr AS (SELECT a.site, a.n, sign(b.value - a.value) AS sg, (b.value - a.value) / (b.k - a.k) AS slope
       FROM pos a JOIN pos b ON a.site = b.site AND a.k < b.k WHERE a.n >= 3),
mk AS (SELECT site, n, CAST(sum(sg) AS BIGINT) AS s, quantile_cont(slope, 0.5) AS slope FROM pr GROUP BY 1, 2),
trend AS (SELECT site, n, s, s / (n * (n - 1) / 2.0) AS tau, slope,
   CASE WHEN s > 0 THEN (s - 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0)
        WHEN s < 0 THEN (s + 1) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0) ELSE 0 END AS z FROM mk),
verdict AS (SELECT *, CASE WHEN abs(z) > 1.959963984540054 AND s > 0 THEN 'increasing'
   WHEN abs(z) > 1.959963984540054 AND s < 0 THEN 'decreasing' ELSE 'none' END AS trend FROM trend)"""


def _annual_series(spark, sf):
    return S.yearly_series(T.annual_means(spark, sf), ["site"], "year", "value")


@query("mann_kendall", "AGG-10", sql=f"""WITH {ANNUAL_SQL}{_TREND_SQL.format(src='annual')}
SELECT site, n, s, round(tau, 6) AS tau, trend FROM verdict""")
def _(spark, sf):
    return S.with_trend(_annual_series(spark, sf)).select("site", "n", "s", R(F.col("tau")).alias("tau"), "trend")


#: Two-sided normal tail of ``z`` by the gamma series of erf.
TAIL_SQL = """CASE WHEN z = 0 THEN 1 ELSE 1 - list_sum([exp((2 * i + 1) * ln(abs(z) / sqrt(2)) - z * z / 2 - lgamma(i + 1.5)) FOR i IN range(200)]) END"""


@query("mann_kendall_p", "AGG-10", "UDF-05", sql=f"""WITH {ANNUAL_SQL}{_TREND_SQL.format(src='annual')}
SELECT site, n, s, round({TAIL_SQL}, 6) AS p FROM verdict""")
def _(spark, sf):
    out = S.with_trend(_annual_series(spark, sf))
    z = S.kendall_z(F.col("s"), F.col("n"))
    return out.select("site", "n", "s", R(S.two_sided_p(z)).alias("p"))


@query("sens_slope", "AGG-11", sql=f"""WITH {ANNUAL_SQL}{_TREND_SQL.format(src='annual')}
SELECT site, round(slope, 6) AS slope FROM verdict""")
def _(spark, sf):
    return S.with_trend(_annual_series(spark, sf)).select("site", R(F.col("slope")).alias("slope"))


@query("timing_trend", "AGG-12", sql=f"""WITH {HYDRO_SQL}, ct AS (
  SELECT site, year, sum(month * v) / sum(v) AS value FROM hyd GROUP BY 1, 2)
{_TREND_SQL.format(src='ct')}
SELECT site, n AS years, round(slope, 6) AS slope_months_per_year,
       round(slope * 10 * 30.4368, 4) AS days_per_decade, trend FROM verdict""")
def _(spark, sf):
    centers = T.complete_hydrograph(spark, sf).select(
        "site", "year", V.center_of_timing(Q).alias("value"))
    out = S.with_trend(S.yearly_series(centers, ["site"], "year", "value").drop("years"))
    return out.select("site", F.col("n").alias("years"), R(F.col("slope")).alias("slope_months_per_year"),
                      R(F.col("slope") * 10 * S.DAYS_PER_MONTH, 4).alias("days_per_decade"), "trend")


@query("phase_composites", "AGG-14", sql=f"""WITH {HYDRO_SQL}, {INDEX_SQL}, ph AS (
 SELECT h.site, h.year, h.month, h.v, CASE WHEN i.value >= 0.5 THEN 'warm' WHEN i.value <= -0.5 THEN 'cool'
   ELSE 'neutral' END AS phase FROM hyd h JOIN idx i ON h.year = i.year AND i.index = 'oni')
SELECT p.site, p.phase, p.month, round(avg(p.v), 6) AS v, string_agg(DISTINCT p.year::VARCHAR, ',' ORDER BY p.year::VARCHAR) AS years
FROM ph p GROUP BY 1, 2, 3""")
def _(spark, sf):
    oni = T.climate_index(spark, sf).where("index = 'oni'").select("year", "value")
    out = H.composite_hydrographs(T.complete_hydrograph(spark, sf), oni)
    return V.month_rows(out, ["site", "phase", "years"]).select(
        "site", "phase", "month", R(F.col("v")).alias("v"),
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@query("validation_metrics", "AGG-15", "AGG-17", sql=f"""WITH {PAIRS_SQL}, agg AS (
 SELECT site, count(*) AS n, avg(model - obs) AS bias, sqrt(avg((model - obs) ** 2)) AS rmse,
        corr(model, obs) AS r, 1 - sum((obs - model) ** 2) / (var_pop(obs) * count(*)) AS nse FROM pairs GROUP BY 1)
SELECT site, n, round(bias, 6) AS bias, round(rmse, 6) AS rmse, round(r, 6) AS pearson_r, round(nse, 6) AS nse,
  CASE WHEN nse >= 0.75 AND r >= 0.9 THEN 'good' WHEN nse >= 0.5 AND r >= 0.7 THEN 'moderate' ELSE 'weak' END AS verdict
FROM agg""")
def _(spark, sf):
    out = H.validation(T.model_pairs(spark, sf), ["site"])
    return out.select("site", "n", *[R(F.col(c)).alias(c) for c in ("bias", "rmse", "pearson_r", "nse")], "verdict")


@query("seasonal_skill", "AGG-16", sql=f"""WITH {PAIRS_SQL}, m AS (
 SELECT site, month, avg(model) AS m, avg(obs) AS o FROM pairs GROUP BY 1, 2)
SELECT site, month, round(1 - abs(m - o) / (abs(m) + abs(o)), 6) AS skill FROM m""")
def _(spark, sf):
    pairs = T.model_pairs(spark, sf)
    both = V.month_slots(pairs, ["site"], "month", "model", F.avg, "m").join(
        V.month_slots(pairs, ["site"], "month", "obs", F.avg, "o"), "site")
    out = both.select("site", V.seasonal_skill(F.col("m"), F.col("o")).alias("q"))
    return V.month_rows(out, ["site"]).where("v IS NOT NULL").select("site", "month", R(F.col("v")).alias("skill"))


@query("annual_mean_peak_month", "AGG-18", sql=f"""WITH {HYDRO_SQL}
SELECT site, year, round(avg(v), 6) AS annual_mean, CAST(arg_min(month, (-v, month)) AS INTEGER) AS peak_month
FROM hyd GROUP BY 1, 2""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select(
        "site", "year", R(V.mean(Q)).alias("annual_mean"), V.peak_month(Q).alias("peak_month"))


@query("network_peak_month", "AGG-19", sql=f"""WITH {HYDRO_SQL},
 t AS (SELECT month, sum(v) AS total FROM hyd GROUP BY 1),
 b AS (SELECT month FROM t ORDER BY total DESC, month LIMIT 1)
SELECT h.site, h.month AS peak_month, sum(h.v) AS flow FROM hyd h WHERE h.month = (SELECT month FROM b) GROUP BY 1, 2""")
def _(spark, sf):
    long = V.month_rows(T.complete_hydrograph(spark, sf), ["site"])
    totals = long.groupBy("month").agg(F.sum("v").alias("total"))
    best = totals.agg(F.max_by("month", F.struct("total", -F.col("month"))).alias("m"))
    return (long.where(F.col("month") == best.scalar()).groupBy("site", F.col("month").alias("peak_month"))
            .agg(F.sum("v").alias("flow")))


@query("region_monthly_precip", "AGG-20", sql="""
SELECT CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(l_quantity) / 100, 6) AS precip
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def _(spark, sf):
    keep = T.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    li = T.table(spark, sf, "lineitem").join(keep, "l_suppkey", "left_semi")
    return li.groupBy(F.month("l_shipdate").alias("month")).agg(
        R(F.coalesce(F.avg("l_quantity") / 100, F.lit(0.0))).alias("precip"))


@query("typical_year", "AGG-21", sql=f"""WITH {MONTHLY_SQL}
SELECT site, month, round(avg(v), 6) AS mean, {', '.join(f"round(quantile_cont(v, {p}), 6) AS {n}"
 for p, n in ((.1, 'p10'), (.25, 'p25'), (.5, 'median'), (.75, 'p75'), (.9, 'p90')))} FROM monthly GROUP BY 1, 2""")
def _(spark, sf):
    out = H.typical_year(T.hydrograph(spark, sf))
    return out.select("site", "month", *[R(F.col(c)).alias(c) for c in ("mean", "p10", "p25", "median", "p75", "p90")])


@query("month_boxes", "AGG-22", sql=f"""WITH {MONTHLY_SQL}, b AS (
 SELECT site, month, quantile_cont(v, .25) AS q1, quantile_cont(v, .5) AS q2, quantile_cont(v, .75) AS q3 FROM monthly GROUP BY 1, 2)
SELECT m.site, m.month, q1, any_value(q2) AS median, q3,
 min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM monthly m JOIN b ON m.site = b.site AND m.month = b.month GROUP BY m.site, m.month, q1, q3""")
def _(spark, sf):
    return H.month_boxes(T.hydrograph(spark, sf))


_NATION_SQL = """nat AS (SELECT s_nationkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year,
 avg(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def _nation_annual(spark, sf):
    sup = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    li = T.table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("t"), F.count("*").alias("c"))
    return li.join(sup, "l_suppkey").groupBy(F.col("s_nationkey").alias("site"), "year").agg(
        (F.sum("t") / F.sum("c")).alias("value"))


@query("gauge_correlation", "AGG-23", "SET-03", sql=f"""WITH {_NATION_SQL},
 yr AS (SELECT year FROM nat GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT site) FROM nat)),
 k AS (SELECT * FROM nat WHERE year IN (SELECT year FROM yr))
SELECT a.site AS a, b.site AS b, round(corr(a.value, b.value), 5) AS r FROM k a JOIN k b ON a.year = b.year GROUP BY 1, 2""")
def _(spark, sf):
    nat = _nation_annual(spark, sf)
    gauges = T.table(spark, sf, "supplier").agg(F.count_distinct("s_nationkey")).scalar()
    return H.gauge_correlation(nat, gauges).withColumn("r", R(F.col("r"), 5))


def _metrics_long(spark, sf):
    return T.complete_hydrograph(spark, sf).select(
        "site", "year", V.mean(Q).alias("mean"), V.peak_flow(Q).alias("peak")).unpivot(
        ["site", "year"], ["mean", "peak"], "metric", "value")


_METRICS_SQL = """mets AS (SELECT site, year, 'mean' AS metric, avg(v) AS value FROM hyd GROUP BY 1, 2
 UNION ALL SELECT site, year, 'peak', max(v) FROM hyd GROUP BY 1, 2)"""


@query("climate_correlation", "AGG-24", "JN-09", sql=f"""WITH {HYDRO_SQL}, {INDEX_SQL}, {_METRICS_SQL}
SELECT m.site, m.metric, i.index, count(*) AS n,
  CASE WHEN count(*) >= 2 AND stddev_pop(m.value) <> 0 AND stddev_pop(i.value) <> 0
       THEN round(corr(m.value, i.value), 5) END AS r
FROM mets m JOIN idx i ON m.year = i.year GROUP BY 1, 2, 3""")
def _(spark, sf):
    return H.correlate(_metrics_long(spark, sf), T.climate_index(spark, sf),
                       ["site", "metric", "index"]).withColumn("r", R(F.col("r"), 5))


@query("lagged_correlation", "JN-10", sql=f"""WITH {HYDRO_SQL}, {INDEX_SQL}, {_METRICS_SQL}
SELECT m.site, m.metric, i.index, count(*) AS n,
  CASE WHEN count(*) >= 2 AND stddev_pop(m.value) <> 0 AND stddev_pop(i.value) <> 0
       THEN round(corr(m.value, i.value), 5) END AS r
FROM mets m JOIN idx i ON m.year = i.year + 1 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return H.correlate(_metrics_long(spark, sf), T.climate_index(spark, sf),
                       ["site", "metric", "index"], lag=1).withColumn("r", R(F.col("r"), 5))


@query("index_range", "SRC-10", sql=f"WITH {INDEX_SQL} SELECT index, year, value FROM idx WHERE year BETWEEN 1996 AND 1999")
def _(spark, sf):
    return T.climate_index(spark, sf).where(F.col("year").between(1996, 1999))


@query("common_years", "SET-03", sql=f"""WITH {HYDRO_SQL}, {INDEX_SQL}
SELECT year FROM hyd INTERSECT SELECT year FROM idx""")
def _(spark, sf):
    return T.complete_hydrograph(spark, sf).select("year").intersect(T.climate_index(spark, sf).select("year"))


@query("complete_years", "SET-06", sql=f"WITH {HYDRO_SQL} SELECT DISTINCT site, year FROM hyd")
def _(spark, sf):
    return H.complete_years(T.hydrograph(spark, sf)).select("site", "year")


@query("membership_subset", "SET-05", sql=f"""WITH {HYDRO_SQL}
SELECT site, year, sum(v) AS flow FROM hyd WHERE site IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) GROUP BY 1, 2""")
def _(spark, sf):
    hydro = T.complete_hydrograph(spark, sf)
    keep = T.table(spark, sf, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("site"))
    keep = keep.join(hydro, "site", "left_semi")
    return H.select_members(hydro, keep).select("site", "year", V.total(Q).alias("flow"))


_PROFILE_SQL = f"""WITH {HYDRO_SQL}, y AS (
 SELECT site, year, avg(v) AS mean, max(v) AS peak, min(v) FILTER (month IN (6,7,8)) AS low,
   avg(v) FILTER (month IN (11,12,1,2,3,4)) / avg(v) FILTER (month BETWEEN 5 AND 10) AS ratio FROM hyd GROUP BY 1, 2),
fl AS (SELECT site, year, sum(dv) / sum(v) AS flash FROM (SELECT site, year, v,
   abs(v - lag(v) OVER (PARTITION BY site, year ORDER BY month)) AS dv FROM hyd) GROUP BY 1, 2),
ct AS (SELECT site, sum(month * v) / sum(v) AS cot FROM hyd GROUP BY 1),
s AS (SELECT y.site, avg(mean) AS mean, avg(peak) AS peak, avg(low) AS low, avg(flash) AS flash, any_value(cot) AS cot,
   avg(ratio) AS ratio FROM y JOIN fl ON y.site = fl.site AND y.year = fl.year JOIN ct ON ct.site = y.site GROUP BY 1)
SELECT site, {', '.join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-9), 5) AS {c}"
  for c in ('mean', 'peak', 'low', 'flash', 'cot', 'ratio'))} FROM s"""


@query("river_profile", "AGG-25", sql=_PROFILE_SQL)
def _(spark, sf):
    hydro = T.complete_hydrograph(spark, sf)
    metrics = ("mean", "peak", "low", "flash", "cot", "ratio")
    cells = [F.avg(F.element_at("q", m)).alias(f"_m{m}") for m in V.MONTHS]
    sites = hydro.groupBy("site").agg(
        F.avg(V.mean(Q)).alias("mean"), F.avg(V.peak_flow(Q)).alias("peak"),
        F.avg(V.low_flow(Q)).alias("low"), F.avg(V.flashiness(Q)).alias("flash"),
        F.avg(V.seasonal_ratio(Q)).alias("ratio"), *cells)
    sites = sites.withColumn("cot", V.center_of_timing(F.array(*[F.col(f"_m{m}") for m in V.MONTHS])))
    sites = sites.select("site", *metrics)
    spans = sites.agg(F.struct(*[F.min(c).alias(f"{c}_lo") for c in metrics],
                               *[F.max(c).alias(f"{c}_hi") for c in metrics]))
    with_span = sites.withColumn("_s", spans.scalar())
    return with_span.select("site", *[
        R((F.col(c) - F.col(f"_s.{c}_lo")) / (F.col(f"_s.{c}_hi") - F.col(f"_s.{c}_lo") + 1e-9), 5).alias(c)
        for c in metrics])


@query("linear_trend", "AGG-29", sql=f"""WITH {ANNUAL_SQL}, f AS (
 SELECT site, regr_slope(value, year) AS slope, regr_intercept(value, year) AS icpt, min(year) AS y0, max(year) AS y1 FROM annual GROUP BY 1),
sg AS (SELECT a.site, stddev_samp(value - (slope * year + icpt)) AS sigma FROM annual a JOIN f ON a.site = f.site GROUP BY 1)
SELECT f.site, CAST(g.year AS INTEGER) AS year, round(slope, 5) AS slope, round(sigma, 5) AS sigma, round(slope * g.year + icpt, 4) AS predicted
FROM f JOIN sg ON f.site = sg.site, LATERAL (SELECT unnest(range(f.y0, f.y1 + 6)) AS year) g""")
def _(spark, sf):
    out = H.linear_trend(T.annual_means(spark, sf))
    return out.select("site", "year", R(F.col("slope"), 5).alias("slope"), R(F.col("sigma"), 5).alias("sigma"),
                      R(F.col("predicted"), 4).alias("predicted"))


@query("early_late_shift", "AGG-30", sql=f"""WITH {HYDRO_SQL}, yrs AS (
 SELECT site, list(DISTINCT year ORDER BY year) AS l FROM hyd GROUP BY 1),
mid AS (SELECT site, l[CAST(floor(len(l) / 2.0) AS INTEGER) + 1] AS mid FROM yrs)
SELECT h.site, h.month, round(avg(v) FILTER (year >= mid) - avg(v) FILTER (year < mid), 6) AS shift
FROM hyd h JOIN mid ON h.site = mid.site GROUP BY 1, 2""")
def _(spark, sf):
    return H.early_late_shift(T.complete_hydrograph(spark, sf)).withColumn("shift", R(F.col("shift")))


@query("density_estimate", "AGG-31", sql=f"""WITH {ANNUAL_SQL}, st AS (
 SELECT site, count(*) AS n, stddev_samp(value) * count(*) ** (-0.2) AS h, min(value) * 0.7 AS lo, max(value) * 1.3 AS hi
 FROM annual GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(value) > 0),
g AS (SELECT st.*, i, lo + (hi - lo) * i / 199.0 AS x FROM st, (SELECT unnest(range(200)) AS i))
SELECT g.site, CAST(i AS INTEGER) AS i, round(x, 5) AS x, round(sum(exp(-0.5 * ((x - a.value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM g JOIN annual a ON a.site = g.site GROUP BY g.site, i, x""")
def _(spark, sf):
    out = H.density(T.annual_means(spark, sf))
    return out.select("site", "i", R(F.col("x"), 5).alias("x"), R(F.col("density")).alias("density"))


# --- windows --------------------------------------------------------------------

@query("percentile_rank_outside", "WIN-01", sql=f"""WITH {ANNUAL_SQL},
 asked AS (SELECT s_suppkey AS site, round(s_acctbal / 50, 2) AS asked FROM supplier)
SELECT a.site, asked, round(least(1, greatest(0, sum(CASE WHEN value < asked THEN 1 ELSE 0 END) / (count(*) - 1))), 6) AS percentile
FROM annual a JOIN asked q ON a.site = q.site GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    asked = T.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("site"), F.round(F.col("s_acctbal") / 50, 2).alias("asked"))
    return H.percentile_rank(T.annual_means(spark, sf), asked, ["site"]).withColumn(
        "percentile", R(F.col("percentile")))


@query("rank_years", "WIN-02", sql=f"""WITH {ANNUAL_SQL}, r AS (
 SELECT site, year, round(value, 6) AS value, row_number() OVER (PARTITION BY site ORDER BY value, year) AS rank,
  round(percent_rank() OVER (PARTITION BY site ORDER BY value), 6) AS percentile, count(*) OVER (PARTITION BY site) AS n FROM annual)
SELECT site, year, value, rank, percentile FROM r WHERE n >= 2""")
def _(spark, sf):
    return H.rank_years(T.annual_means(spark, sf)).select(
        "site", "year", R(F.col("value")).alias("value"), "rank", R(F.col("percentile")).alias("percentile"))


@query("record_book", "WIN-03", sql=f"""WITH {HYDRO_SQL}, m AS (
 SELECT site, year, min(v) FILTER (month IN (6,7,8)) AS low, max(v) AS peak FROM hyd GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY low, year) AS rl, percent_rank() OVER (PARTITION BY site ORDER BY low) AS pl,
  row_number() OVER (PARTITION BY site ORDER BY peak DESC, year) AS rp, percent_rank() OVER (PARTITION BY site ORDER BY peak) AS pp,
  count(*) OVER (PARTITION BY site) AS n FROM m)
SELECT site, year, low AS value, rl AS rank, round(pl, 6) AS percentile, 'driest_summers' AS board FROM r WHERE n >= 2 AND rl <= 5
UNION ALL SELECT site, year, peak, rp, round(pp, 6), 'wettest_years' FROM r WHERE n >= 2 AND rp <= 5""")
def _(spark, sf):
    return H.record_book(T.complete_hydrograph(spark, sf)).withColumn("percentile", R(F.col("percentile")))


def _rolling_sql(w: int) -> str:
    return f"""WITH {ANNUAL_SQL}, r AS (SELECT site, row_number() OVER w - 1 AS start,
 avg(value) OVER f AS mean, count(*) OVER f AS c FROM annual
 WINDOW w AS (PARTITION BY site ORDER BY year), f AS (PARTITION BY site ORDER BY year ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))
SELECT site, start, start + {w - 1} AS "end", round(mean, 6) AS mean FROM r WHERE c = {w}"""


@query("rolling_normals", "WIN-04", sql=_rolling_sql(3))
def _(spark, sf):
    return H.rolling_normals(T.annual_means(spark, sf), 3).withColumn("mean", R(F.col("mean")))


@query("rolling_mean_five", "WIN-09", sql=_rolling_sql(5))
def _(spark, sf):
    return H.rolling_normals(T.annual_means(spark, sf), 5).withColumn("mean", R(F.col("mean")))


@query("anomaly_stripes", "WIN-05", sql=f"""WITH {ANNUAL_SQL}, d AS (SELECT site, year, value - avg(value) OVER (PARTITION BY site) AS anomaly FROM annual)
SELECT site, year, round(anomaly, 5) + 0.0 AS anomaly, CASE WHEN max(abs(anomaly)) OVER (PARTITION BY site) <> 0 THEN
 round(anomaly / max(abs(anomaly)) OVER (PARTITION BY site), 5) + 0.0 END AS stripe FROM d""")
def _(spark, sf):
    return H.anomalies(T.annual_means(spark, sf)).select(
        "site", "year", R(F.col("anomaly"), 5).alias("anomaly"), R(F.col("stripe"), 5).alias("stripe"))


@query("cumulative_departure", "WIN-06", sql=f"""WITH {ANNUAL_SQL}, d AS (SELECT site, year, value - avg(value) OVER (PARTITION BY site) AS x FROM annual)
SELECT site, year, round(sum(x) OVER (PARTITION BY site ORDER BY year), 5) + 0.0 AS departure FROM d""")
def _(spark, sf):
    return H.cumulative_departure(T.annual_means(spark, sf)).select(
        "site", "year", R(F.col("departure"), 5).alias("departure"))


@query("cumulative_flow", "WIN-06", sql=f"""WITH {MONTHLY_SQL}, g AS (
 SELECT DISTINCT site, year FROM monthly), f AS (SELECT site, year, unnest(range(1, 13)) AS month FROM g)
SELECT f.site, f.year, CAST(f.month AS INTEGER) AS month, sum(coalesce(v, 0)) OVER (PARTITION BY f.site, f.year ORDER BY f.month) AS v
FROM f LEFT JOIN monthly m ON m.site = f.site AND m.year = f.year AND m.month = f.month""")
def _(spark, sf):
    out = T.hydrograph(spark, sf).select("site", "year", H.cumulative_flow(Q).alias("q"))
    return V.month_rows(out, ["site", "year"])


@query("autocorrelation", "WIN-07", sql=f"""WITH {ANNUAL_SQL}, c AS (
 SELECT site, row_number() OVER (PARTITION BY site ORDER BY year) AS k, value - avg(value) OVER (PARTITION BY site) AS d,
  count(*) OVER (PARTITION BY site) AS n, var_pop(value) OVER (PARTITION BY site) AS p FROM annual),
l AS (SELECT DISTINCT site, n, p, unnest(range(16)) AS lag FROM c),
x AS (SELECT l.site, l.lag, l.n, l.p, sum(a.d * b.d) AS dot FROM l LEFT JOIN c a ON a.site = l.site
   LEFT JOIN c b ON b.site = a.site AND b.k = a.k + l.lag GROUP BY ALL)
SELECT site, CAST(lag AS INTEGER) AS lag, CASE WHEN lag >= n THEN 0.0 WHEN p > 0 THEN round(dot / (n - lag) / p, 5) + 0.0 END AS acf, round(1.96 / sqrt(n), 6) AS band FROM x""")
def _(spark, sf):
    return H.autocorrelation(T.annual_means(spark, sf)).select(
        "site", "lag", R(F.col("acf"), 5).alias("acf"), R(F.col("band")).alias("band"))


@query("return_period", "WIN-08", sql=f"""WITH {HYDRO_SQL}, p AS (SELECT site, year, max(v) AS value FROM hyd GROUP BY 1, 2)
SELECT site, year, value, round((count(*) OVER (PARTITION BY site) + 1) / row_number() OVER (PARTITION BY site ORDER BY value DESC, year), 6) AS return_period FROM p""")
def _(spark, sf):
    peaks = T.complete_hydrograph(spark, sf).select("site", "year", V.peak_flow(Q).alias("value"))
    return H.return_period(peaks).withColumn("return_period", R(F.col("return_period")))


@query("cyclic_frames", "WIN-17", sql=f"""WITH {HYDRO_SQL}, f AS (
 SELECT site, year, unnest(range(24)) AS frame FROM hyd GROUP BY 1, 2)
SELECT f.site, f.year, CAST(frame AS INTEGER) AS frame, a.month, round(frame * 0.5 - floor(frame * 0.5), 6) AS frac,
 round(a.v + (b.v - a.v) * (frame * 0.5 - floor(frame * 0.5)), 6) AS v
FROM f JOIN hyd a ON a.site = f.site AND a.year = f.year AND a.month = CAST(floor(frame * 0.5) AS INTEGER) % 12 + 1
 JOIN hyd b ON b.site = f.site AND b.year = f.year AND b.month = (CAST(floor(frame * 0.5) AS INTEGER) + 1) % 12 + 1""")
def _(spark, sf):
    rows = T.complete_hydrograph(spark, sf).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(23))))
    month, frac, v = V.cyclic_month_value(Q, F.col("frame"), 24)
    return rows.select("site", "year", "frame", month.alias("month"), R(frac).alias("frac"), R(v).alias("v"))


# --- top-k ------------------------------------------------------------------------

@query("analog_years", "SRT-01", sql=f"""WITH {HYDRO_SQL}, t AS (SELECT site, max(year) AS ty FROM hyd GROUP BY 1),
 c AS (SELECT h.site, h.year, t.ty AS target_year, corr(h.v, g.v) AS r FROM hyd h JOIN t ON t.site = h.site
   JOIN hyd g ON g.site = h.site AND g.year = t.ty AND g.month = h.month WHERE h.year <> t.ty GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY r DESC NULLS LAST, year) AS rank FROM c)
SELECT site, year, target_year, round(r, 6) AS similarity, rank FROM k WHERE rank <= 3""")
def _(spark, sf):
    hydro = T.complete_hydrograph(spark, sf)
    target = hydro.groupBy("site").agg(F.max("year").alias("target_year"))
    return H.analog_years(hydro, target, 3).withColumn("similarity", R(F.col("similarity")))


@query("driest_wettest", "SRT-04", sql=f"""WITH {MONTHLY_SQL}, a AS (SELECT site, year, sum(v) AS total FROM monthly GROUP BY 1, 2)
(SELECT 'driest' AS board, site, year, total FROM a ORDER BY total, site, year LIMIT 3)
UNION ALL (SELECT 'wettest', site, year, total FROM a ORDER BY total DESC, site, year LIMIT 3)""")
def _(spark, sf):
    totals = T.table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("total"))
    dry = totals.orderBy("total", "site", "year").limit(3).withColumn("board", F.lit("driest"))
    wet = totals.orderBy(F.col("total").desc(), "site", "year").limit(3).withColumn("board", F.lit("wettest"))
    return dry.unionByName(wet)
