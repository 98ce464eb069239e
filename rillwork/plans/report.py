"""Watershed report: one summary row per watershed, joined from the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions import series as S
from rillwork.functions import vectors as V
from rillwork.operators import hydrographs as H


def watershed_report(hydro: DataFrame, gauge: DataFrame, index: DataFrame) -> DataFrame:
    """``hydro(site, year, q)`` of each watershed's outlet, ``gauge(site, year, q)`` observed,
    ``index(year, value)``. Long-record and low-flow trend, timing drift, validation over
    the common years, climate correlation at lags 0 and 1."""
    q = F.col("q")
    mean = hydro.select("site", "year", V.mean(q).alias("value"))
    low = hydro.select("site", "year", V.low_flow(q).alias("value"))
    timing = hydro.select("site", "year", V.center_of_timing(q).alias("value"))

    def trend(metric: DataFrame, prefix: str) -> DataFrame:
        out = S.with_trend(S.yearly_series(metric, ["site"], "year", "value", "_v").drop("years"), "_v", prefix=prefix)
        return out.drop("_v")

    model = V.month_rows(hydro, ["site", "year"], value="model")
    seen = V.month_rows(gauge, ["site", "year"], value="obs")
    skill = H.validation(model.join(seen, ["site", "year", "month"]), ["site"]).select(
        "site", "pearson_r", "nse", "bias", "rmse", "verdict")
    r0 = H.correlate(mean, index, ["site"]).select("site", F.col("r").alias("index_r"))
    r1 = H.correlate(mean, index, ["site"], lag=1).select("site", F.col("r").alias("index_r_lag1"))
    out = trend(mean, "").join(trend(low, "low_").select("site", "low_trend", "low_slope"), "site", "left")
    out = out.join(trend(timing, "ct_").select("site", "ct_trend", (F.col("ct_slope") * 10 * S.DAYS_PER_MONTH).alias("ct_days_per_decade")), "site", "left")
    for part in (skill, r0, r1):
        out = out.join(part, "site", "left")
    return out.withColumn("p", S.two_sided_p(S.kendall_z(F.col("s"), F.col("n"))))


def report_boards(hydro: DataFrame, index: DataFrame, exceedance, analogs: int = 6) -> dict[str, DataFrame]:
    """The report's lists as tables: analog years, record book, decade curves, phase composites."""
    target = hydro.groupBy("site").agg(F.max("year").alias("target_year"))
    return {"analogs": H.analog_years(hydro, target, analogs), "records": H.record_book(hydro),
            "decade_curves": H.decade_flow_duration(hydro, exceedance), "composites": H.composite_hydrographs(hydro, index)}


def outlet_flow(flow: DataFrame, membership: DataFrame) -> DataFrame:
    """Monthly series of each basin's outlet: its reach with the largest mean flow."""
    mean = flow.groupBy("hydroseq").agg(F.avg(V.mean(F.col("q"))).alias("m"))
    outlet = mean.join(membership, "hydroseq").groupBy("basin").agg(F.max_by("hydroseq", F.struct("m", -F.col("hydroseq"))).alias("hydroseq"))
    return flow.join(outlet, "hydroseq").select(F.col("basin").alias("site"), "year", "q")
