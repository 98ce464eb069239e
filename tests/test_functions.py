"""Known answers for hydrograph vectors, settings and text."""

import pytest
from pyspark.sql import functions as F

from rillwork.functions import series as S
from rillwork.functions import settings as G
from rillwork.functions import styling as Y
from rillwork.functions import vectors as V
from rillwork.operators import flow as W
from rillwork.operators import hydrographs as H
from rillwork.operators import orders as O
from rillwork.operators import raster as A


def one(spark, q, *cols):
    return spark.createDataFrame([(q,)], "q array<double>").select(*cols).first()


def test_center_and_shape(spark):
    july = [0.0] * 6 + [5.0] + [0.0] * 5
    assert one(spark, july, V.center_of_timing("q"))[0] == 7.0
    assert one(spark, [2.0] * 12, V.center_of_timing("q"))[0] == 6.5
    assert one(spark, [0.0] * 12, V.center_of_timing("q"))[0] is None
    assert one(spark, [0.0] * 12, W.normal_shape(F.col("q")))[0] == [1.0] * 12
    assert abs(sum(one(spark, [float(i) for i in range(1, 13)], W.normal_shape(F.col("q")))[0]) - 12) < 1e-12


def test_missing_month_spreads(spark):
    gap = [1.0] * 5 + [None] + [1.0] * 6
    row = one(spark, gap, V.peak_flow("q"), V.low_flow("q"), V.low_flow("q", (1, 2)), V.flashiness("q"))
    assert list(row) == [None, None, 1.0, None]


def test_bad_windows():
    for months in ((), (0,), (13,)):
        with pytest.raises(ValueError):
            V.check_months(months)
    with pytest.raises(ValueError):
        W.regime(None, 0.2, 0.4)


def test_snow_bucket(spark):
    climate = spark.createDataFrame([([50.0] * 12, [-5.0] * 3 + [10.0] * 9)], "precip_mm array<double>, temp_c array<double>")
    water = W.available_water(climate).first().available
    assert water[0] < 1 and water[1] < 1 and water[3] > 100
    assert abs(sum(water) - 600) < 1e-6


def test_validation_cases(spark):
    rows = [("same", float(i), float(i)) for i in range(12)] + [("off", i + 3.0, float(i)) for i in range(12)] + [("mean", 5.5, float(i)) for i in range(12)]
    rows += [("gap", None, 1.0), ("gap", 2.0, 2.0), ("gap", float("nan"), 3.0), ("gap", 4.0, 4.0)]
    out = {r.k: r for r in H.validation(spark.createDataFrame(rows, "k string, model double, obs double"), ["k"]).collect()}
    assert out["same"].nse == 1 and abs(out["same"].pearson_r - 1) < 1e-12 and out["same"].verdict == "good"
    assert abs(out["off"].bias - 3) < 1e-12 and abs(out["mean"].nse) < 1e-12 and out["mean"].pearson_r is None
    assert out["gap"].n == 2


def test_trend(spark):
    df = spark.createDataFrame([("s", 1990 + i, float(v)) for i, v in enumerate([1, 2, 4, 8, 9, 12])], "site string, year int, value double")
    r = S.with_trend(S.yearly_series(df, ["site"], "year", "value")).first()
    assert (r.s, r.tau, r.trend) == (15, 1.0, "increasing") and abs(r.slope - 2.25) < 0.2


def test_settings():
    assert G.parse_months("nov-feb") == (11, 12, 1, 2) and G.parse_months("jul") == (7,) and G.parse_months("annual") == ()
    with pytest.raises(ValueError):
        G.parse_months("13")
    assert G.normalize_years([2001, 1999, 2001]) == [1999, 2001]
    for bad in ([], [True], [1800]):
        with pytest.raises(ValueError):
            G.normalize_years(bad)


def test_text_and_colour(spark):
    row = spark.range(1).select(Y.number_text(F.lit(-0.001), 2), Y.number_text(F.lit(12.50), 2), Y.hypsometric_color(F.lit(0.0), F.lit(10.0)),
                                Y.hypsometric_color(F.lit(10.0), F.lit(10.0)), O.print_cost(F.lit("24x36"), F.lit("canvas"))).first()
    assert list(row) == ["0", "12.5", "#1a489c", "#ffffff", 7000]


def test_profiles(spark):
    row = one(spark, [10.0, None, 12.0, 9.0, 9.5], A.profile_qa(F.col("q"), 0.6), A.monotonic_surface(F.col("q"), 0.6), A.monotonic_surface(F.col("q"), 0.0, False))
    assert (row[0].inversions, row[0].nodata, row[0].max_rise) == (1, 1, 2.0)
    assert row[1] == [10.0, None, 10.0, 9.0, 9.5] and row[2] == [10.0, None, 12.0, 9.0, 9.5]


def test_two_sided_p(spark):
    import math

    zs = [i / 8 for i in range(-80, 81)] + [4.2426, 4.2427, 20.0, 37.0, None]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        want = None if r.z is None else math.erfc(abs(r.z) / math.sqrt(2))
        assert r.p is None if want is None else abs(r.p - want) <= 1e-10 * want + 1e-300


def test_series_of_more_than_a_value_a_year(spark):
    df = spark.range(S.MAX_YEARS + 1).selectExpr("1 AS site", "id AS year", "1.0D AS value")
    with pytest.raises(Exception, match="more than one value a year"):
        S.yearly_series(df, ["site"], "year", "value").collect()


def test_members_outside_the_series(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 7.0)], "site int, q double")
    assert H.select_members(rows, spark.createDataFrame([(1,), (1,)], "site int")).count() == 2
    for bad in (9, None):
        with pytest.raises(ValueError, match="outside the series"):
            H.select_members(rows, spark.createDataFrame([(1,), (bad,)], "site int"))
