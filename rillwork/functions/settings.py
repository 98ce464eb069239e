"""Run settings as values and tables: regions, months, year sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork import fixed_values as X

_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december")


def _month(token: str) -> int:
    token = token.strip().lower()
    for i, name in enumerate(_NAMES, 1):
        if token in (name, name[:3]):
            return i
    if token.isdigit() and 1 <= int(token) <= 12:
        return int(token)
    raise ValueError(f"invalid month {token!r}")


def parse_months(value: str | None) -> tuple[int, ...]:
    """Empty for annual; one month; or an inclusive range that may wrap past December."""
    text = "" if value is None else str(value).strip().lower()
    if text in ("", "annual", "all", "mean"):
        return ()
    if "-" not in text:
        return (_month(text),)
    ends = text.split("-")
    if len(ends) != 2 or not all(ends):
        raise ValueError(f"invalid month range {value!r}")
    first, last = _month(ends[0]), _month(ends[1])
    return tuple((first - 1 + k) % 12 + 1 for k in range((last - first) % 12 + 1))


def month_filter(months: tuple[int, ...], column: str = "month"):
    return F.lit(True) if not months else F.col(column).isin(*months)


def normalize_years(years: Iterable[int], first: int = 1895, latest: int | None = None) -> list[int]:
    """Distinct ascending years within the record."""
    out = set()
    for y in years:
        if isinstance(y, bool) or not isinstance(y, int):
            raise ValueError(f"year must be an int, got {y!r}")
        if y < first or (latest is not None and y > latest):
            raise ValueError(f"year {y} lies outside the record")
        out.add(y)
    if not out:
        raise ValueError("no years given")
    return sorted(out)


def expand_regions(requests: DataFrame, regions: tuple[str, ...] = X.STATES) -> DataFrame:
    """``region`` rows with the contiguous-states alias spelled out and names canonical."""
    contiguous = [s for s in regions if s not in X.NON_CONTIGUOUS]
    asked = F.upper(F.trim("region"))
    canonical = F.create_map(*[x for s in regions for x in (F.lit(s.upper()), F.lit(s))])
    spelled = F.when(asked == "CONUS", F.array(*[F.lit(s) for s in contiguous])).otherwise(
        F.array(F.try_element_at(canonical, asked)))
    return requests.withColumn("_asked", F.col("region")).withColumn("region", F.explode(spelled))


def unknown_regions(requests: DataFrame, regions: tuple[str, ...] = X.STATES) -> DataFrame:
    return expand_regions(requests, regions).where("region IS NULL").select(F.col("_asked").alias("region"))


def basin_level(region, level):
    """A contiguous-states run on the default level works on two-digit basins."""
    return F.when((F.upper(region) == "CONUS") & (level == "HUC4"), "HUC2").otherwise(level)
