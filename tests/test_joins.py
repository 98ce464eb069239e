"""Interval joins and correlations against plain loops."""

import datetime as dt
import random

import numpy as np

from rillwork.operators import raster as A
from rillwork.operators import facilities, hydrographs


def test_alerts_of_any_length(spark):
    rnd = random.Random(2)
    day = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 4000))
    claims = [(i, rnd.randint(0, 2), day()) for i in range(300)] + [(900, 1, None), (901, None, day())]
    alerts = []
    for i in range(60):
        a = day()
        alerts.append((i, rnd.randint(0, 2), a, a + dt.timedelta(hours=rnd.choice([0, 3, 50, 900, 30_000, 200_000])), rnd.random() < 0.8))
    alerts += [(90, 1, None, day(), True), (91, 1, day(), None, True), (92, 1, dt.datetime(2009, 1, 1), dt.datetime(2001, 1, 1), True)]
    want = set()
    for k, au, at in claims:
        hit = {(k, i) for i, b, f, t, on in alerts if on and b == au and at and f and t and f <= at <= t}
        want |= hit or {(k, None)}
    got = facilities.attach_alerts(spark.createDataFrame(claims, "id long, authority long, as_of timestamp"),
                                   spark.createDataFrame(alerts, "alert_id long, authority long, valid_from timestamp, valid_to timestamp, active boolean"), "id")
    assert {(r["id"], r["alert_id"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_gauge_correlation_by_blocks(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(7, 20))
    values[3] = 4.0
    rows = [(f"g{g}", 1980 + y, float(values[g, y])) for g in range(7) for y in range(20)] + [("g1", 2050, 1.0)]
    metric = spark.createDataFrame(rows, "site string, year int, value double")
    for block in (2, 512):
        got = {(r["a"], r["b"]): r["r"] for r in hydrographs.gauge_correlation(metric, 7, block).collect()}
        assert len(got) == 49
        for a in range(7):
            for b in range(7):
                if 3 in (a, b):
                    assert got[f"g{a}", f"g{b}"] is None
                else:
                    assert abs(got[f"g{a}", f"g{b}"] - np.corrcoef(values[a], values[b])[0, 1]) < 1e-9
    assert hydrographs.gauge_correlation(metric.limit(0), 7).count() == 0


def test_sampled_lines_bring_their_place_along(spark):
    lines = spark.createDataFrame([(1, [(5.0, 15.0), (25.0, 15.0)]), (2, [(90.0, 5.0), (95.0, 5.0)])], "line_id bigint, pts array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(r, c, 10.0 * c + r) for r in range(2) for c in range(3)], "row bigint, col bigint, value double")
    out = A.sampled_lines(lines, cells, dict(origin_x=0.0, origin_y=20.0, pixel_w=10.0, pixel_h=10.0, width=3, height=2), 10.0, "d")
    assert sorted((r.line_id, r.pos, r.x, r.y, r.z) for r in out.collect()) == [
        (1, 0, 5.0, 15.0, 0.0), (1, 1, 15.0, 15.0, 10.0), (1, 2, 25.0, 15.0, 20.0), (2, 0, 90.0, 5.0, None), (2, 1, 95.0, 5.0, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
