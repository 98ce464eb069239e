"""Climate-driven monthly flow: snow balance, shape, scaling, downstream accumulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import vectors as V
from rillwork.operators.network import accumulate_downstream, refuse_bad_topology
from rillwork.operators.scale import exact_percentiles
from rillwork.session import checkpointed

# degrees Celsius: all snow at or below, all rain at or above; melt starts / is complete
ALL_SNOW, ALL_RAIN, MELT_START, MELT_FULL = -1.0, 3.0, 0.0, 6.0
FILL_PRECIP_MM, FILL_TEMP_C = 0.0, 10.0
FIRST_CLIMATE_YEAR = 1895
SNOWMELT_MIN, RAIN_MAX = 0.4, 0.2


def _share(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def snow_components(climate: DataFrame, precip: str = "precip_mm", temp: str = "temp_c") -> DataFrame:
    """Adds ``rain`` and ``melt`` arrays: a snow pack run three times through the year.

    The pack a year leaves behind is linear in the pack it starts with
    (kept share x start + what one year from empty leaves), so the two spin-up
    years collapse to arithmetic: one fold finds the two numbers, a second one
    writes the last year out month by month.
    """
    month = F.zip_with(precip, temp, lambda p, t: F.struct(
        (p * _share((ALL_RAIN - t) / (ALL_RAIN - ALL_SNOW))).alias("snow"),
        _share((t - MELT_START) / (MELT_FULL - MELT_START)).alias("share")))
    out = climate.withColumn("_mon", month)
    out = out.withColumn("_year", F.aggregate(
        "_mon", F.struct(F.lit(0.0).alias("left"), F.lit(1.0).alias("kept")),
        lambda a, x: F.struct(((a["left"] + x["snow"]) * (1 - x["share"])).alias("left"),
                              (a["kept"] * (1 - x["share"])).alias("kept"))))
    start = F.col("_year.left") * (1 + F.col("_year.kept"))
    none = F.array().cast("array<double>")
    out = out.withColumn("melt", F.aggregate(
        "_mon", F.struct(start.alias("pack"), none.alias("melt")),
        lambda a, x: F.struct(((a["pack"] + x["snow"]) * (1 - x["share"])).alias("pack"),
                              F.array_append(a["melt"], (a["pack"] + x["snow"]) * x["share"]).alias("melt")),
        lambda a: a["melt"]))
    rain = F.zip_with(precip, "_mon", lambda p, x: p - x["snow"])
    return out.withColumn("rain", rain).drop("_mon", "_year")


def available_water(climate: DataFrame) -> DataFrame:
    """Adds ``available``: rain plus melt per month."""
    parts = snow_components(climate)
    return parts.withColumn("available", F.zip_with("rain", "melt", lambda a, b: a + b))


def water_shape(climate: DataFrame) -> DataFrame:
    """Adds ``shape``: available water scaled to mean 1."""
    wet = available_water(climate)
    return wet.withColumn("shape", normal_shape(F.col("available")))


def normal_shape(q: Column) -> Column:
    """Twelve-vector scaled to mean 1; all ones where the mean is not positive."""
    mean = V.mean(q)
    scaled = F.zip_with(q, F.array_repeat(mean, 12), lambda x, m: x / m)
    return F.when(mean > 0, scaled).otherwise(F.array_repeat(F.lit(1.0), 12))


def snow_fraction(rain: Column, melt: Column) -> Column:
    water = V.total(rain) + V.total(melt)
    return F.when(water > 0, V.total(melt) / water).otherwise(F.lit(0.0))


def regime(fraction: Column, snow_min: float = SNOWMELT_MIN, rain_max: float = RAIN_MAX) -> Column:
    if not 0.0 <= rain_max < snow_min <= 1.0:
        raise ValueError("thresholds must satisfy 0 <= rain_max < snow_min <= 1")
    return (F.when(fraction >= snow_min, "snowmelt").when(fraction <= rain_max, "rain")
            .otherwise("transitional"))


def monthly_flow(reaches: DataFrame, climate: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Accumulated monthly flow per reach and year as ``(hydroseq, year, q)``.

    All years run in one job: the year is only one more key of the values, the
    river pointers are shared. ``climate(hydroseq, year, precip_mm, temp_c)`` must
    cover every reach once in every year asked for (by default: every year it holds);
    a gap, a repeated id or a pointer that does not run downstream raises.
    """
    pointers = reaches.select("hydroseq", "dnhydroseq")
    refuse_bad_topology(pointers)
    chosen = climate.where(F.col("year").isin(*years)) if years else climate
    shaped = water_shape(chosen).select("hydroseq", "year", F.col("shape").alias("_shape"))
    incr = F.greatest(F.col("q_incr"), F.lit(0.0))
    names = [f"m{m}" for m in V.MONTHS]
    local = checkpointed(reaches.join(shaped, "hydroseq").select(
        "hydroseq", "year", *[(F.element_at("_shape", m) * incr).alias(f"m{m}") for m in V.MONTHS]))
    _refuse_gaps(reaches, local, len(set(years)) if years else None)
    total = accumulate_downstream(local, names, ["year"], pointers)
    return total.select("hydroseq", "year", F.array(*names).alias("q"))


def _refuse_gaps(reaches: DataFrame, local: DataFrame, years: int | None) -> None:
    if years is None:
        years = local.select("year").distinct().count()
    held = local.groupBy("hydroseq").agg(F.count("*").alias("_n"), F.count_distinct("year").alias("_y"))
    bad = reaches.select("hydroseq").join(held, "hydroseq", "left").where(
        (F.coalesce("_y", F.lit(0)) != years) | (F.col("_n") != F.col("_y"))).limit(3).collect()
    if bad:
        raise ValueError(f"climate must hold each reach once in {years} years: " + ", ".join(
            f"{r['hydroseq']} has {r['_n'] or 0} rows in {r['_y'] or 0} years" for r in bad))


def uncovered(reaches: DataFrame, climate: DataFrame) -> DataFrame:
    """Reach-years the climate misses; a run on them would be an error."""
    years = climate.select("year").distinct()
    spans = years.agg(F.collect_set("year").alias("y"))  # one entry per calendar year
    want = reaches.select("hydroseq").withColumn("year", F.explode(spans.scalar()))
    return want.join(climate.select("hydroseq", "year"), ["hydroseq", "year"], "left_anti")


def mass_balance(flow: DataFrame, qama: DataFrame, floor: float = 1.0) -> DataFrame:
    """Median, P10 and P90 of mean monthly flow over mean annual flow, reaches above ``floor``."""
    ratio = flow.join(qama.where(F.col("qama") > floor), "hydroseq").select(
        (V.mean(F.col("q")) / F.col("qama")).alias("ratio"))
    out = exact_percentiles(ratio, "ratio", [0.5, 0.1, 0.9])
    return out.select(F.col("p0").alias("median"), F.col("p1").alias("p10"), F.col("p2").alias("p90"))


def peak_month_counts(flow: DataFrame) -> DataFrame:
    """Reaches per peak month, every month listed."""
    counted = flow.groupBy(V.peak_month(F.col("q")).alias("month")).agg(F.count("*").alias("reaches"))
    months = flow.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(counted, "month", "left").select("month", F.coalesce("reaches", F.lit(0)).alias("reaches"))


# --- climate inputs -------------------------------------------------------------------

def band_number(year: Column, month: Column, first_year: int = FIRST_CLIMATE_YEAR,
                one_based: bool = True) -> Column:
    """Band of a month in a grid stacked from ``first_year``; out of range raises."""
    ok = (year >= first_year) & month.between(1, 12)
    band = (year - first_year) * 12 + (month - 1) + (1 if one_based else 0)
    return F.when(F.assert_true(ok, F.lit("month outside the record")).isNull(), band)


def grid_cell(lon: Column, lat: Column, inverse: tuple[float, ...], width: int,
              height: int) -> tuple[Column, Column]:
    """``(row, col)`` of a point under the inverse affine, held inside the grid."""
    a, b, c, d, e, f = (float(v) for v in inverse)
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x))).cast("int")
    return clamp(d * lon + e * lat + f, height), clamp(a * lon + b * lat + c, width)


def filled(value: Column, nodata: float | None, fill: float) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if nodata is not None:
        bad = bad | (value == nodata)
    return F.when(bad, F.lit(float(fill))).otherwise(value)


def sampled_climate(reaches: DataFrame, cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """Twelve-month precipitation and temperature per reach and year off a gridded record.

    ``reaches(hydroseq, row, col)``, ``cells(var, year, month, row, col, value)`` with
    var ``precip`` or ``temp``. Cells shrink to twelve slots before they meet the
    reaches, so many reaches may share one cell.
    """
    def stack(var: str, fill: float, name: str) -> DataFrame:
        one = cells.where(F.col("var") == var)
        slots = V.month_slots(one, ["row", "col", "year"], "month", "value", F.max, name)
        return slots.withColumn(name, F.transform(name, lambda x: filled(x, nodata, fill)))
    both = stack("precip", FILL_PRECIP_MM, "precip_mm").join(
        stack("temp", FILL_TEMP_C, "temp_c"), ["row", "col", "year"], "full_outer")
    both = both.withColumn("precip_mm", F.coalesce("precip_mm", F.array_repeat(F.lit(FILL_PRECIP_MM), 12)))
    both = both.withColumn("temp_c", F.coalesce("temp_c", F.array_repeat(F.lit(FILL_TEMP_C), 12)))
    return reaches.join(both, ["row", "col"]).select("hydroseq", "year", "precip_mm", "temp_c")


def climatology(precip: DataFrame, temp: DataFrame) -> DataFrame:
    """Stack monthly ``(nhdplus_id, month, value)`` hundredths into arrays, gaps filled."""
    p = V.month_slots(precip, ["nhdplus_id"], "month", "value", F.max, "precip_mm")
    t = V.month_slots(temp, ["nhdplus_id"], "month", "value", F.max, "temp_c")
    scale = lambda name, fill: F.coalesce(
        F.transform(name, lambda x: F.coalesce(x / 100, F.lit(fill))), F.array_repeat(F.lit(fill), 12))
    return p.join(t, "nhdplus_id", "full_outer").select(
        "nhdplus_id", scale("precip_mm", FILL_PRECIP_MM).alias("precip_mm"), scale("temp_c", FILL_TEMP_C).alias("temp_c"))


def value_column(columns: list[str], prefix: str) -> str:
    """The data column of a monthly table: first one with the prefix, missing-counts aside."""
    for name in columns:
        if name.startswith(prefix) and not name.startswith("Miss"):
            return name
    raise KeyError(f"no {prefix!r} column among {columns}")


def build_network(discharge: DataFrame, attributes: DataFrame, positions: DataFrame) -> DataFrame:
    """Reaches with topology and a position; a missing position takes the basin median."""
    joined = discharge.join(attributes, "nhdplus_id").dropna(subset=["hydroseq", "dnhydroseq"])
    joined = joined.where("hydroseq > 0").join(positions, "nhdplus_id", "left")
    lon = exact_percentiles(joined, "lon", [0.5], ["huc4"]).withColumnRenamed("p0", "_lon")
    lat = exact_percentiles(joined, "lat", [0.5], ["huc4"]).withColumnRenamed("p0", "_lat")
    out = joined.join(lon, "huc4", "left").join(lat, "huc4", "left")
    return out.withColumn("lon", F.coalesce("lon", "_lon")).withColumn(
        "lat", F.coalesce("lat", "_lat")).drop("_lon", "_lat")


def with_lookup(rows: DataFrame, orders: DataFrame, flows: DataFrame, monthly: DataFrame | None = None) -> DataFrame:
    """Left lookups with their defaults: order 1, flow 0, missing monthly row all zero."""
    out = rows.join(orders, "nhdplus_id", "left").join(flows, "nhdplus_id", "left")
    out = out.withColumn("stream_order", F.coalesce("stream_order", F.lit(1))).withColumn(
        "flow", F.coalesce("flow", F.lit(0.0)))
    if monthly is not None:
        out = out.join(monthly, "nhdplus_id", "left").withColumn(
            "q", F.coalesce("q", F.array_repeat(F.lit(0.0), 12)))
    return out


def write_monthly_flow(flow: DataFrame, path: str, partition: str = "huc4") -> None:
    """Every reach's vector to four decimals, one folder per basin."""
    rounded = flow.withColumn("q", V.rounded(F.col("q"), 4))
    rounded.write.mode("overwrite").partitionBy(partition).parquet(path)


ClimateSource = Callable[[list[int]], DataFrame]
"""Anything that returns ``climate(hydroseq, year, precip_mm, temp_c)`` for given years."""


def flow_from_source(reaches: DataFrame, source: ClimateSource, years: list[int]) -> DataFrame:
    """Monthly flow with the climate record behind one call; swap the source freely."""
    return monthly_flow(reaches, source(years), years)
