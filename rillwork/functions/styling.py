"""Widths, colours and number text derived from network values.

Scaling constants that depend on the whole network (largest order, span of the
flow) come in as one-row DataFrames and are attached as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X

FLOOR = 1e-2


def number_text(value: Column, places: int) -> Column:
    """Fixed decimals without trailing zeros or a negative zero."""
    text = F.format_string(f"%.{places}f", value)
    if places:
        text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(text.isin("-0", "", "-"), "0").otherwise(text)


def order_width(order: Column, max_order: Column, base: float, scale: float = 3.0) -> Column:
    top = base * scale
    frac = (order - 1) / (max_order - 1)
    return (F.when((max_order <= 1) | (order <= 1), F.lit(float(base)))
            .when(order >= max_order, F.lit(float(top)))
            .otherwise(base + (top - base) * frac))


def _ln(q: Column) -> Column:
    return F.ln(F.greatest(q, F.lit(FLOOR)))


def _span(df: DataFrame, value: Column) -> Column:
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()


def flow_widths(df: DataFrame, flow: str, base: float, scale: float = 6.0) -> DataFrame:
    """Width growing with the logarithm of flow between the network's extremes."""
    top = base * scale
    out = df.withColumn("_span", _span(df, _ln(F.col(flow))))
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    width = F.when(hi - lo < 1e-9, F.lit(float(base))).otherwise(
        base + (top - base) * ((_ln(F.col(flow)) - lo) / (hi - lo)))
    return out.withColumn("width", width).drop("_span")


def scaled_widths(df: DataFrame, metric: str, width_min: float, width_max: float,
                  gamma: float = 1.0, log: bool = False) -> DataFrame:
    value = _ln(F.col(metric)) if log else F.col(metric).cast("double")
    out = df.withColumn("_span", _span(df, value))
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    shaped = F.pow((value - lo) / (hi - lo), F.lit(float(gamma)))
    width = F.when(hi - lo < 1e-9, F.lit(float(width_min))).otherwise(
        width_min + (width_max - width_min) * shaped)
    return out.withColumn("width", width).drop("_span")


def monthly_width_frames(df: DataFrame, width_min: float, width_max: float, q: str = "q") -> DataFrame:
    """Twelve widths per reach on one log span held fixed over all months."""
    positive = df.select(F.explode(q).alias("v")).where("v > 0")
    bounds = positive.agg(F.struct(
        F.coalesce(_ln(F.min("v")), F.lit(FLOOR_LN)).alias("lo"),
        F.coalesce(_ln(F.max("v")), F.lit(FLOOR_LN)).alias("hi"))).scalar()
    out = df.withColumn("_span", bounds)
    lo = F.col("_span.lo")
    span = F.greatest(F.col("_span.hi") - lo, F.lit(1e-9))
    share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_ln(x) - lo) / span))
    return out.withColumn("widths", F.transform(q, lambda x: width_min + (width_max - width_min) * share(x))).drop("_span")


FLOOR_LN = -4.605170185988091  # ln(0.01)


def hypsometric_color(elevation: Column, anchor: Column, gamma: float = 0.75,
                      low: tuple[int, int, int] = X.HYPSO_LOW, high: tuple[int, int, int] = X.HYPSO_HIGH) -> Column:
    """Hex tint from sea level to the anchor elevation; channels round half to even."""
    t = F.when(anchor <= 0, F.lit(0.0)).otherwise(F.pow(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), elevation / anchor)), F.lit(float(gamma))))
    channel = lambda a, b: F.lower(F.lpad(F.hex(F.rint(a + (b - a) * t).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), *[channel(a, b) for a, b in zip(low, high)])


def reach_elevation(lowest_cm: Column, highest_cm: Column, nodata: float = -9998.0) -> tuple[Column, Column]:
    """Mean and maximum elevation in metres; sentinels, nulls and NaN are left out."""
    seen = F.filter(F.array(lowest_cm, highest_cm), lambda x: x.isNotNull() & ~F.isnan(x) & (x > nodata))
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x / 100)
    mean = F.when(F.size(seen) > 0, total / F.size(seen)).otherwise(F.lit(0.0))
    return mean, F.coalesce(F.array_max(seen) / 100, F.lit(0.0))


def display_elevation(z: Column, exaggeration: float, lift: float = 0.0) -> Column:
    return z * exaggeration + lift


def sample_value(value: Column, covered: Column, nodata: Column) -> Column:
    return F.when(covered & ~nodata, value)


PROVENANCE_REQUIRED = ("source_product", "source_url", "acquisition_date", "horizontal_crs", "checksum")


def provenance_rules(required=PROVENANCE_REQUIRED) -> dict[str, Column]:
    """Required text must not be blank, resolution must be positive; vertical fields are free."""
    rules = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) != "" for name in required}
    rules["resolution_m"] = F.col("resolution_m") > 0
    return rules
