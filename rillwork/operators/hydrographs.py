"""Hydrograph statistics: records, curves, composites, validation, teleconnection.

Inputs are ``hydrograph(site, year, q)`` with twelve-slot arrays, or long
``(key, year, value)`` series. Each site-year is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.functions import series as S
from rillwork.functions import vectors as V
from rillwork.operators.scale import row_numbers
from rillwork.session import broadcast_if_small, checkpointed


def complete_years(hydro: DataFrame, q: str = "q") -> DataFrame:
    return hydro.where(V.is_complete(F.col(q)))


def _percents(exceedance: Sequence[float]) -> list[float]:
    out = [float(x) for x in exceedance]
    if not out:
        raise ValueError("no exceedance quantiles")
    if any(x < 0 or x > 100 for x in out):
        raise ValueError("exceedance quantiles must be within 0..100")
    return out


def flow_duration(hydro: DataFrame, exceedance: Sequence[float], keys: Sequence[str] = ("site",),
                  ) -> DataFrame:
    """Flow exceeded q % of the time, pooled over a key's months (at most 12 per year)."""
    wanted = _percents(exceedance)
    pooled = V.month_rows(hydro, list(keys))
    ranks = F.array(*[F.lit((100.0 - x) / 100.0) for x in wanted])
    curves = pooled.groupBy(*keys).agg(F.percentile("v", ranks).alias("_f"))
    labels = F.array(*[F.lit(x) for x in wanted])
    return curves.select(*keys, F.explode(F.arrays_zip(labels.alias("exceedance"),
                                                       F.col("_f").alias("flow"))).alias("_z")
                         ).select(*keys, "_z.exceedance", "_z.flow")


def decade_flow_duration(hydro: DataFrame, exceedance: Sequence[float], size: int = 10) -> DataFrame:
    if size < 1:
        raise ValueError("decade size must be at least 1")
    bucketed = hydro.withColumn("decade", (F.floor(F.col("year") / size) * size).cast("int"))
    return flow_duration(bucketed, exceedance, ("site", "decade"))


def composite_hydrographs(hydro: DataFrame, index: DataFrame, warm_min: float = 0.5,
                          cool_max: float = -0.5) -> DataFrame:
    """Mean month vector per climate phase, with the member years of the phase."""
    if not cool_max < warm_min:
        raise ValueError("cool_max must be below warm_min")
    v = F.col("value")
    phase = F.when(v >= warm_min, "warm").when(v <= cool_max, "cool").otherwise("neutral")
    joined = hydro.join(broadcast_if_small(index), "year")
    tagged = joined.select("site", "year", "q", phase.alias("phase"))
    cells = [F.avg(F.element_at("q", m)).alias(f"_m{m}") for m in V.MONTHS]
    wide = tagged.groupBy("site", "phase").agg(
        *cells, F.array_sort(F.collect_set("year")).alias("years"))
    return wide.select("site", "phase", "years",
                       F.array(*[F.col(f"_m{m}") for m in V.MONTHS]).alias("q"))


# --- model against observation ------------------------------------------------

GOOD = (0.75, 0.9)
MODERATE = (0.5, 0.7)


def verdict(nse: Column, r: Column) -> Column:
    return (F.when((nse >= GOOD[0]) & (r >= GOOD[1]), "good")
            .when((nse >= MODERATE[0]) & (r >= MODERATE[1]), "moderate")
            .otherwise("weak"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation aggregate over complete pairs; null, not an error, for a constant side."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def validation(pairs: DataFrame, keys: Sequence[str], model: str = "model",
               obs: str = "obs") -> DataFrame:
    """Bias, RMSE, Pearson r, Nash-Sutcliffe and verdict over pairs finite on both sides."""
    m, o = F.col(model), F.col(obs)
    usable = pairs.where(finite(m) & finite(o))
    sums = usable.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(m - o).alias("bias"),
        F.sqrt(F.avg(F.pow(m - o, 2))).alias("rmse"),
        pearson(m, o).alias("_r"),
        F.stddev_pop(m).alias("_sm"), F.stddev_pop(o).alias("_so"),
        F.sum(F.pow(o - m, 2)).alias("_sse"), F.var_pop(o).alias("_vo"))
    r = F.when((F.col("n") >= 2) & (F.col("_sm") != 0) & (F.col("_so") != 0), F.col("_r"))
    nse = F.when(F.col("_vo") != 0, 1 - F.col("_sse") / (F.col("_vo") * F.col("n")))
    scored = sums.select(*keys, "n", "bias", "rmse", r.alias("pearson_r"), nse.alias("nse"))
    return scored.withColumn("verdict", verdict(F.col("nse"), F.col("pearson_r")))


def align_index(metric: DataFrame, index: DataFrame, lag: int = 0) -> DataFrame:
    """metric[y] next to index[y - lag] over the common years."""
    shifted = index.select((F.col("year") + lag).alias("year"), F.col("value").alias("index_value"),
                           *[c for c in index.columns if c not in ("year", "value")])
    return metric.join(broadcast_if_small(shifted), "year")


def correlate(metric: DataFrame, index: DataFrame, keys: Sequence[str], lag: int = 0) -> DataFrame:
    pairs = align_index(metric, index, lag)
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), pearson(F.col("value"), F.col("index_value")).alias("_r"),
        F.stddev_pop("value").alias("_a"), F.stddev_pop("index_value").alias("_b"))
    r = F.when((F.col("n") >= 2) & (F.col("_a") != 0) & (F.col("_b") != 0), F.col("_r"))
    return out.select(*keys, "n", r.alias("r"))


def select_members(rows: DataFrame, members: DataFrame, id_col: str = "site") -> DataFrame:
    """The rows of the named members; a null id or one without rows is an error, with examples."""
    wanted = members.select(id_col).distinct()
    known = rows.select(F.col(id_col).alias("_known")).distinct()
    unknown = wanted.join(known, F.col(id_col) == F.col("_known"), "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"ids outside the series: {[r[0] for r in unknown]}")
    return rows.join(wanted, id_col, "left_semi")


# --- ranks and records over a site's years ------------------------------------

def rank_years(metric: DataFrame, keys: Sequence[str] = ("site",), ascending: bool = True,
               n: int | None = None) -> DataFrame:
    """1-based rank of ``value`` (ties by year) and its position in the record."""
    if n is not None and n < 1:
        raise ValueError("n must be at least 1")
    v = F.col("value")
    order = v.asc() if ascending else v.desc()
    part = Window.partitionBy(*keys)
    out = (metric.withColumn("rank", F.row_number().over(part.orderBy(order, "year")))
           .withColumn("percentile", F.percent_rank().over(part.orderBy(v)))
           .withColumn("_n", F.count("*").over(part)))
    out = out.where(F.col("_n") >= 2).drop("_n")
    return out.where(F.col("rank") <= n) if n else out


def percentile_rank(record: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where an outside value falls in a record: count(below)/(n-1), clamped to 0..1."""
    below = F.sum(F.when(F.col("value") < F.col("asked"), 1).otherwise(0))
    joined = record.join(asked, list(keys))
    out = joined.groupBy(*keys, "asked").agg(below.alias("_b"), F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_b") / (F.col("_n") - 1)))
    return out.where(F.col("_n") >= 2).select(*keys, "asked", share.alias("percentile"))


def record_book(hydro: DataFrame, summer: Sequence[int] = (6, 7, 8), n: int | None = 5) -> DataFrame:
    q = F.col("q")
    lows = hydro.select("site", "year", V.low_flow(q, summer).alias("value"))
    peaks = hydro.select("site", "year", V.peak_flow(q).alias("value"))
    return (rank_years(lows, n=n).withColumn("board", F.lit("driest_summers"))
            .unionByName(rank_years(peaks, ascending=False, n=n)
                         .withColumn("board", F.lit("wettest_years"))))


def rolling_normals(metric: DataFrame, window: int = 30, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Mean of every full run of ``window`` values, by start and end position."""
    if window < 1:
        raise ValueError("window must be at least 1")
    by_year = Window.partitionBy(*keys).orderBy("year")
    frame = by_year.rowsBetween(0, window - 1)
    out = (metric.withColumn("start", F.row_number().over(by_year) - 1)
           .withColumn("mean", F.avg("value").over(frame))
           .withColumn("_n", F.count("value").over(frame)))
    return (out.where(F.col("_n") == window)
            .select(*keys, "start", (F.col("start") + window - 1).alias("end"), "mean"))


def anomalies(metric: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Departure from the site mean, and the same scaled by the largest departure."""
    part = Window.partitionBy(*keys)
    out = metric.withColumn("anomaly", F.col("value") - F.avg("value").over(part))
    scale = F.max(F.abs("anomaly")).over(part)
    return out.withColumn("stripe", F.try_divide(F.col("anomaly"), scale))


def cumulative_departure(metric: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy(*keys)
    out = metric.withColumn("_d", F.col("value") - F.avg("value").over(part))
    return out.withColumn("departure", F.sum("_d").over(run)).drop("_d")


def cumulative_flow(q: Column) -> Column:
    """Running monthly sum within a year; a missing month adds nothing."""
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.aggregate(
        F.slice(q, F.lit(1), m), F.lit(0.0),
        lambda acc, x: acc + F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def autocorrelation(metric: DataFrame, lags: int = 15, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Lagged autocorrelation 0..lags and the 95 % band, from each site's yearly array."""
    base = S.yearly_series(metric, keys, "year", "value", "_v")
    v, n = F.col("_v"), F.size("_v")
    mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
    base = base.withColumn("_n", n).withColumn("_c", S.bound(mean, lambda m: F.transform(v, lambda x: x - m)))
    c = F.col("_c")
    power = F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) / F.col("_n")
    rows = base.withColumn("_p", power).withColumn(
        "lag", F.explode(F.sequence(F.lit(0), F.lit(lags))))
    left = F.slice(c, F.lit(1), F.greatest(F.col("_n") - F.col("lag"), F.lit(0)))
    right = F.slice(c, F.col("lag") + 1, F.col("_n"))
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    acf = F.when(F.col("lag") >= F.col("_n"), F.lit(0.0)).otherwise(
        F.try_divide(dot / (F.col("_n") - F.col("lag")), F.col("_p")))
    return rows.select(*keys, "lag", acf.alias("acf"), (1.96 / F.sqrt("_n")).alias("band"))


def return_period(metric: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    part = Window.partitionBy(*keys)
    rank = F.row_number().over(part.orderBy(F.col("value").desc(), "year"))
    return metric.select(*keys, "year", "value",
                         ((F.count("*").over(part) + 1) / rank).alias("return_period"))


def analog_years(hydro: DataFrame, target: DataFrame, n: int | None = None) -> DataFrame:
    """Other years of a site ranked by Pearson similarity of the month vectors.

    ``target(site, target_year)`` names one year per site; undefined similarity sorts last.
    """
    if n is not None and n < 1:
        raise ValueError("n must be at least 1")
    chosen = (hydro.join(target, "site").where(F.col("year") == F.col("target_year"))
              .select("site", F.col("year").alias("target_year"), F.col("q").alias("_t")))
    pairs = hydro.join(chosen, "site").where(F.col("year") != F.col("target_year"))
    scored = pairs.select("site", "year", "target_year",
                          vector_correlation(F.col("q"), F.col("_t")).alias("similarity"))
    order = Window.partitionBy("site").orderBy(
        F.col("similarity").isNull(), F.col("similarity").desc(), "year")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n) if n else ranked


def vector_correlation(a: Column, b: Column) -> Column:
    """Pearson r of two equally long arrays; null when either is constant."""
    def deviations(v: Column) -> Column:
        return S.bound(V.mean(v), lambda m: F.transform(v, lambda x: x - m))

    dev_a, dev_b = deviations(a), deviations(b)
    cov = V.total(F.zip_with(dev_a, dev_b, lambda x, y: x * y))
    pa = V.total(F.transform(dev_a, lambda x: x * x))
    pb = V.total(F.transform(dev_b, lambda x: x * x))
    return F.when((pa > 0) & (pb > 0), cov / F.sqrt(pa * pb))


# --- climatology and distribution ---------------------------------------------

def typical_year(hydro: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Mean, median and percentile envelope per month over a site's years."""
    long = V.month_rows(hydro, list(keys)).where(F.col("v").isNotNull())
    ranks = F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    out = long.groupBy(*keys, "month").agg(F.avg("v").alias("mean"),
                                           F.percentile("v", ranks).alias("_p"))
    names = ("p10", "p25", "median", "p75", "p90")
    return out.select(*keys, "month", "mean",
                      *[F.col("_p")[i].alias(nm) for i, nm in enumerate(names)])


def month_boxes(hydro: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Quartiles, 1.5 IQR whisker ends and outlier count per month."""
    long = V.month_rows(hydro, list(keys)).where(F.col("v").isNotNull())
    part = Window.partitionBy(*keys, "month")
    ranks = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    boxed = long.withColumn("_p", F.percentile("v", ranks).over(part))
    q1, q3 = F.col("_p")[0], F.col("_p")[2]
    inside = F.col("v").between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return boxed.groupBy(*keys, "month").agg(
        F.first("_p")[0].alias("q1"), F.first("_p")[1].alias("median"),
        F.first("_p")[2].alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def gauge_correlation(metric: DataFrame, gauges: int | Column, block: int = 512) -> DataFrame:
    """Pearson r between every two gauges over the years all ``gauges`` gauges share.

    A gauge's years are one array, bounded by the calendar; ``block`` gauges make a matrix,
    and every two blocks meet in one task, which gives their part of the answer.
    """
    # years of a calendar: a few hundred at most
    years = [r["year"] for r in metric.groupBy("year").agg(F.count("*").alias("_n")).where(F.col("_n") == gauges).collect()]
    series = metric.where(F.col("year").isin(years)).groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("year", "value"))), lambda s: s["value"].cast("double")).alias("values"))
    laid = checkpointed(row_numbers(series, [], ["site"], "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / block)))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, -(-laid.count() // block) - 1)).cast("bigint")))
    own = lambda side: [F.col("site").alias(f"site_{side}"), F.col("values").alias(f"values_{side}")]
    left = laid.select(*own("a"), F.col("_block").alias("i"), blocks.alias("j"))
    right = laid.select(*own("b"), blocks.alias("i"), F.col("_block").alias("j"))

    def correlate(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def standard(values: pd.Series) -> np.ndarray:
            x = np.array(values.tolist(), dtype=float)
            flat = x.max(axis=1) == x.min(axis=1)
            x = x - x.mean(axis=1, keepdims=True)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return x / np.where(flat[:, None] | (size == 0), np.nan, size)

        if not len(a) or not len(b):
            return pd.DataFrame({"a": a["site_a"][:0], "b": b["site_b"][:0], "r": np.empty(0)})
        r = standard(a["values_a"]) @ standard(b["values_b"]).T
        return pd.DataFrame({"a": np.repeat(a["site_a"].to_numpy(), len(b)), "b": np.tile(b["site_b"].to_numpy(), len(a)), "r": r.ravel()})

    kind = dict(metric.dtypes)["site"]
    out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(correlate, f"a {kind}, b {kind}, r double")
    return out.select("a", "b", F.when(~F.isnan("r"), F.col("r")).alias("r"))


def linear_trend(metric: DataFrame, ahead: int = 5, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Least-squares line per site, residual spread, and its value up to ``ahead`` years on."""
    fits = metric.groupBy(*keys).agg(
        F.regr_slope("value", F.col("year").cast("double")).alias("slope"),
        F.regr_intercept("value", F.col("year").cast("double")).alias("intercept"),
        F.min("year").alias("_first"), F.max("year").alias("_last"))
    residual = metric.join(fits, list(keys)).withColumn(
        "_e", F.col("value") - (F.col("slope") * F.col("year") + F.col("intercept")))
    spread = residual.groupBy(*keys).agg(F.stddev_samp("_e").alias("sigma"))
    years = F.sequence(F.col("_first"), F.col("_last") + ahead)
    return (fits.join(spread, list(keys)).withColumn("year", F.explode(years))
            .select(*keys, "year", "slope", "sigma",
                    (F.col("slope") * F.col("year") + F.col("intercept")).alias("predicted")))


def early_late_shift(hydro: DataFrame) -> DataFrame:
    """Month means from the middle year on, minus those before it."""
    years = hydro.groupBy("site").agg(F.array_sort(F.collect_set("year")).alias("_y"))
    mid = years.select("site", F.element_at(
        "_y", (F.floor(F.size("_y") / 2) + 1).cast("int")).alias("mid"))
    long = V.month_rows(hydro.join(mid, "site"), ["site", "year", "mid"])
    late = F.col("year") >= F.col("mid")
    return long.groupBy("site", "month").agg(
        (F.avg(F.when(late, F.col("v"))) - F.avg(F.when(~late, F.col("v")))).alias("shift"))


def density(metric: DataFrame, points: int = 200, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Gaussian kernel density of yearly values (Scott bandwidth) on an even grid."""
    base = S.yearly_series(metric, keys, "year", "value", "_v").where(F.size("_v") >= 2)
    v, n = F.col("_v"), F.size("_v")
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)
    base = base.withColumn("_h", F.sqrt(var) * F.pow(n.cast("double"), F.lit(-0.2)))
    base = base.where(F.col("_h") > 0)
    lo, hi = F.array_min(v) * 0.7, F.array_max(v) * 1.3
    rows = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = lo + (hi - lo) * F.col("i") / (points - 1)
    rows = rows.withColumn("x", x)
    kernel = F.aggregate(v, F.lit(0.0), lambda a, s: a + F.exp(
        -0.5 * F.pow((F.col("x") - s) / F.col("_h"), 2)))
    scale = n * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return rows.select(*keys, "i", "x", (kernel / scale).alias("density"))
