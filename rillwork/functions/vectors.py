"""Column functions over twelve-slot monthly arrays (index 0 is January).

A missing month is null. Metrics follow the propagating convention: a null in
any month they read makes the result null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = tuple(range(1, 13))


def check_months(months: Sequence[int]) -> tuple[int, ...]:
    """Months as ints in 1..12; an empty window or a bad month is an error."""
    out = tuple(int(m) for m in months)
    if not out:
        raise ValueError("month window is empty")
    if any(not 1 <= m <= 12 for m in out):
        raise ValueError(f"months must be within 1..12, got {months!r}")
    return out


def month_slots(df: DataFrame, keys: Sequence[str], month: str, value: str,
                how=F.sum, name: str = "q") -> DataFrame:
    """Long monthly rows to one twelve-slot array per key, in a single shuffle.

    Twelve conditional aggregates combine on the map side, so a key holding most
    of the rows costs no more than any other and nothing is collected.
    """
    cells = [how(F.when(F.col(month) == m, F.col(value))).alias(f"_m{m}") for m in MONTHS]
    wide = df.groupBy(*keys).agg(*cells)
    return wide.select(*keys, F.array(*[F.col(f"_m{m}") for m in MONTHS]).alias(name))


def month_rows(df: DataFrame, keys: Sequence[str], q: str = "q", value: str = "v") -> DataFrame:
    """One row per month from a twelve-slot array."""
    return df.select(*keys, F.posexplode(q).alias("_pos", value)).select(
        *keys, (F.col("_pos") + 1).alias("month"), value)


def is_complete(q: Column) -> Column:
    """True when all twelve months are present and finite."""
    return (F.size(q) == 12) & ~F.exists(q, lambda x: x.isNull() | F.isnan(x))


def total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda acc, x: acc + x)


def mean(q: Column) -> Column:
    return total(q) / F.size(q)


def _at(q: Column, months: Sequence[int]) -> list[Column]:
    return [F.element_at(q, int(m)) for m in months]


def _mean_of(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out / len(parts)


def peak_flow(q: Column) -> Column:
    return F.when(is_complete(q), F.array_max(q))


def low_flow(q: Column, months: Sequence[int] = (6, 7, 8)) -> Column:
    parts = _at(q, check_months(months))
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, F.array_min(F.array(*parts)))


def center_of_timing(q: Column) -> Column:
    """Flow-weighted mean month; null when the year carries no flow."""
    moment = F.aggregate(
        F.zip_with(q, F.sequence(F.lit(1), F.lit(12)), lambda v, m: v * m),
        F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(moment, total(q))


def flashiness(q: Column) -> Column:
    steps = F.zip_with(F.slice(q, 2, 11), F.slice(q, 1, 11), lambda b, a: F.abs(b - a))
    return F.try_divide(total(steps), total(q))


def seasonal_ratio(q: Column, wet: Sequence[int] = (11, 12, 1, 2, 3, 4)) -> Column:
    wet = check_months(wet)
    dry = [m for m in MONTHS if m not in set(wet)]
    if not dry:
        raise ValueError("wet window leaves no dry months")
    return F.try_divide(_mean_of(_at(q, wet)), _mean_of(_at(q, dry)))


def peak_month(q: Column) -> Column:
    """First month (1-based) holding the maximum."""
    return F.when(is_complete(q), F.array_position(q, F.array_max(q)).cast("int"))


def seasonal_skill(model: Column, obs: Column) -> Column:
    """Symmetric agreement per month; null where a month is missing or both are 0."""
    def one(m: Column, o: Column) -> Column:
        denom = F.abs(m) + F.abs(o)
        return F.when(denom != 0, 1 - F.abs(m - o) / denom)
    return F.zip_with(model, obs, one)


def rounded(q: Column, places: int) -> Column:
    return F.transform(q, lambda x: F.round(x, places))


def cyclic_month_value(q: Column, frame: Column, frames: int) -> tuple[Column, Column, Column]:
    """Frame number to (first month, blend fraction, interpolated value); Dec wraps to Jan."""
    phase = frame * F.lit(12.0) / frames
    whole = F.floor(phase).cast("int")
    frac = phase - whole
    first = F.element_at(q, whole % 12 + 1)
    second = F.element_at(q, (whole + 1) % 12 + 1)
    return whole % 12 + 1, frac, first + (second - first) * frac
