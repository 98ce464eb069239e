"""Trend and rank functions over one value per calendar year.

A site's yearly series holds one value per calendar year, so its length is
bounded by the calendar (``MAX_YEARS``), not by the data; pairwise work inside
such an array stays small however many rows the site had.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_YEARS = 2_000
DAYS_PER_MONTH = 30.4368


def yearly_series(df: DataFrame, keys: Sequence[str], year: str, value: str,
                  name: str = "series") -> DataFrame:
    """``(keys, series)``: values ordered by year. Needs one row per key and year.

    A key with more than ``MAX_YEARS`` rows is an error, since it cannot be a yearly series.
    """
    gathered = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
                     ).alias("_s"))
    too_long = F.raise_error(F.concat(F.lit("more than one value a year: "), F.size("_s"), F.lit(" rows of one key")))
    gathered = gathered.withColumn("_s", F.when(F.size("_s") > MAX_YEARS, too_long).otherwise(F.col("_s")))
    return gathered.select(
        *keys,
        F.transform("_s", lambda s: s["v"]).alias(name),
        F.transform("_s", lambda s: s["y"]).alias("years"))


def median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    lo = F.element_at(sorted_values, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(sorted_values, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def mann_kendall_s(v: Column) -> Column:
    """Sum of signs over all ordered pairs."""
    def against_later(i: Column) -> Column:
        here = F.element_at(v, i)
        return F.aggregate(F.slice(v, i + 1, F.size(v)), F.lit(0.0),
                           lambda acc, x: acc + F.signum(x - here))
    return F.aggregate(F.sequence(F.lit(1), F.size(v)), F.lit(0.0),
                       lambda acc, i: acc + against_later(i)).cast("int")


def sens_slope(v: Column) -> Column:
    """Median slope over all pairs of positions."""
    def slopes_from(i: Column) -> Column:
        here = F.element_at(v, i)
        return F.transform(F.slice(v, i + 1, F.size(v)),
                           lambda x, k: (x - here) / (k + 1))
    return F.when(F.size(v) >= 2, median(F.array_sort(F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(v)), slopes_from)))))


def kendall_tau(s: Column, n: Column) -> Column:
    return s / (n * (n - 1) / 2)


def kendall_z(s: Column, n: Column) -> Column:
    """Continuity-corrected score under the no-tie variance."""
    spread = F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return F.when(s > 0, (s - 1) / spread).when(s < 0, (s + 1) / spread).otherwise(F.lit(0.0))


def trend_label(s: Column, n: Column, alpha: float = 0.05) -> Column:
    """Verdict without the p-value: p < alpha is |z| beyond the normal quantile."""
    critical = NormalDist().inv_cdf(1 - alpha / 2)
    strong = F.abs(kendall_z(s, n)) > critical
    return (F.when(strong & (s > 0), "increasing").when(strong & (s < 0), "decreasing")
            .otherwise("none"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail probability erfc(|z| / sqrt 2).

    Below 3 the power series of erf, beyond it the continued fraction of erfc; both are
    carried far enough for double precision.
    """
    def tail(x: Column) -> Column:
        square, series, fraction = x * x, F.lit(1.0), x
        for k in range(70, 0, -1):
            series = 1 + series * square * (2 / (2 * k + 1))
        for k in range(40, 0, -1):
            fraction = x + (k / 2) / fraction
        decay = F.exp(-square) / math.sqrt(math.pi)
        return F.when(x < 3, 1 - 2 * decay * x * series).otherwise(decay / fraction)

    return bound(F.abs(z) / math.sqrt(2.0), tail)


def with_trend(df: DataFrame, series: str = "series", alpha: float = 0.05,
               prefix: str = "") -> DataFrame:
    """Adds n, S, tau, Sen slope and verdict; series shorter than 3 are dropped."""
    v = F.col(series)
    out = df.where(F.size(v) >= 3).withColumn(f"{prefix}n", F.size(v))
    out = out.withColumn(f"{prefix}s", mann_kendall_s(v))
    s, n = F.col(f"{prefix}s"), F.col(f"{prefix}n")
    return (out.withColumn(f"{prefix}tau", kendall_tau(s, n))
            .withColumn(f"{prefix}slope", sens_slope(v))
            .withColumn(f"{prefix}trend", trend_label(s, n, alpha)))
