"""Cutting, dissolving and repairing polygons against even-odd tests of random points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.functions import geometry as G
from rillwork.operators import overlay as O
from rillwork.operators import selection as Z
from rillwork.operators import spatial as S


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def box(x0, y0, x1, y1):
    return [[ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]


def star(rnd, cx, cy, n, r):
    return [[ring(*[(cx + r * (0.4 + 0.6 * rnd.random()) * math.cos(2 * math.pi * k / n),
                     cy + r * (0.4 + 0.6 * rnd.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)])]]


def holds(parts, x, y):
    inside = False
    for part in parts or []:
        for own in part:
            for a, b in zip(own, own[1:]):
                if (a["y"] > y) != (b["y"] > y) and a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) < x:
                    inside = not inside
    return inside


@pytest.mark.parametrize("together", [4, 16, 96])
def test_repair_keeps_the_even_odd_ground(monkeypatch, together):
    monkeypatch.setattr(O, "TOGETHER", together)
    rnd = random.Random(together)
    for k in range(60):
        at = (lambda: float(rnd.randint(0, 8))) if k % 2 else (lambda: rnd.random() * 8)
        given = [[ring(*[(at(), at()) for _ in range(rnd.randint(3, 25))])]]
        parts = O.as_rows(O.valid_parts(given))
        for _ in range(60):
            x, y = rnd.random() * 9 - 0.5, rnd.random() * 9 - 0.5
            assert holds(given, x, y) == holds(parts, x, y)
        for part in parts:
            for n, own in enumerate(part):
                assert len({(p["x"], p["y"]) for p in own}) == len(own) - 1
                turn = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(own, own[1:]))
                assert (turn > 0) == (n == 0)


def test_known_repairs():
    bow = O.valid_parts([[ring((0, 0), (4, 4), (4, 0), (0, 4))]])
    assert bow == [[[(0, 0), (2, 2), (0, 4), (0, 0)]], [[(2, 2), (4, 0), (4, 4), (2, 2)]]]
    # a hole that touches its shell in one point stays a hole
    touching = O.valid_parts([[ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 4), (2, 3), (2, 5), (0, 4))]])
    assert [len(p) for p in touching] == [2]
    assert not Z.meets_itself(box(0, 0, 4, 4)) and Z.meets_itself([[ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))]])
    assert Z.meets_itself([[ring((0, 0), (4, 0), (4, 4), (4, 0))]])  # a spike
    assert O.valid_parts([[]]) == [] and not Z.meets_itself([[]])


@pytest.mark.parametrize("cell", [9.0, 200.0])
def test_cut_and_dissolve_against_points(spark, cell):
    rnd = random.Random(7)
    areas = [(i, star(rnd, rnd.uniform(10, 90), rnd.uniform(10, 90), rnd.randint(3, 12), 22)) for i in range(7)]
    areas += [(50, box(20, 20, 40, 40)), (51, box(40, 20, 60, 40)), (52, box(300, 300, 310, 310)), (53, box(310, 310, 320, 320))]
    polygons = [(i, star(rnd, rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.randint(3, 9), 12)) for i in range(20)]
    polygons += [(60, box(25, 25, 55, 35)), (61, box(-90, -90, -80, -80)), (62, None), (63, box(305, 305, 315, 315))]
    a = spark.createDataFrame(areas, f"poly_pos bigint, parts {G.GEOMETRY}")
    p = spark.createDataFrame(polygons, f"pos bigint, parts {G.GEOMETRY}").withColumn("changed", F.lit("clash"))
    got = {r["pos"]: r for r in O.clip_polygons(p, O.union_tiles(a, cell), cell).collect()}
    whole = {r["region"]: r["parts"] for r in O.dissolved(a, cell).collect()}
    assert len(got) == len(polygons) and got[60]["outcome"] == "covered" and got[61]["outcome"] == got[62]["outcome"] == "dropped"
    assert got[60]["parts"][0][0][0]["x"] == 25.0 and len(got[63]["parts"]) == 2
    assert {got[i]["outcome"] for i in range(20)} == {"covered", "partial", "dropped"}
    assert len(whole[52]) == 2 and 53 not in whole  # boxes that meet in a corner are one region of two parts
    for _ in range(500):
        x, y = rnd.uniform(-5, 105), rnd.uniform(-5, 105)
        inside = any(holds(q, x, y) for _, q in areas)
        assert sum(holds(q, x, y) for q in whole.values()) == inside
        for i, q in polygons[:20]:
            assert holds(got[i]["parts"], x, y) == (inside and holds(q, x, y))


def test_area_of_cut_rings_is_the_shared_area(spark):
    rnd = random.Random(5)
    a = spark.createDataFrame([(i, star(rnd, 50 + 9 * i, 50, 9, 30)) for i in range(4)], f"poly_pos bigint, parts {G.GEOMETRY}")
    p = spark.createDataFrame([(i, star(rnd, rnd.uniform(20, 90), rnd.uniform(30, 70), 7, 15)) for i in range(12)], f"pos bigint, parts {G.GEOMETRY}")
    region = O.union_tiles(a, 11.0)
    cut = {r["pos"]: r["a"] for r in O.clip_polygons(p, region, 11.0).select("pos", G.area(F.col("parts")).alias("a")).collect()}
    shared = S.tiles_overlap(S.tiles(p, "pos", 11.0), region.withColumn("k", F.lit(0)), "pos", "k", 11.0)
    for r in shared.collect():
        assert abs(r["shared"] - cut[r["pos"]]) < 1e-5
    # ground of several areas counts once
    ones = S.overlap_fraction(p.select("pos", F.col("pos").cast("string").alias("huc4"), "parts"), a, 11.0, 0.0)
    assert ones.agg(F.max("fraction")).first()[0] <= 1 + 1e-9


def test_selection_of_cut_shapes(spark):
    # two lakes of other shapes are the same once cut; the third shares an edge with what is left of the first
    rows = [(1, "a", box(-10, 0, 20, 10)), (2, "b", box(-30, 0, 20, 10)), (3, "c", box(20, 2, 30, 8)), (4, "d", [[ring((5, 40), (9, 44), (9, 40), (5, 44))]])]
    feats = spark.createDataFrame([(i, s, "lake", "Polygon", g, "EPSG:5070", "") for i, s, g in rows],
                                  f"pos bigint, source_id string, class string, geom_type string, parts {G.GEOMETRY}, crs string, inclusion_reason string")
    region = spark.createDataFrame([(0, box(0, -5, 60, 60)), (1, box(0, -5, 30, 60))], f"poly_pos bigint, parts {G.GEOMETRY}")
    chosen = Z.select_waterbodies(feats, region, 16.0)
    got = {r["pos"]: r for r in chosen.collect()}
    assert got[1]["bucket"] == got[3]["bucket"] == got[4]["bucket"] == "selected" and got[1]["area_m2"] == pytest.approx(200)
    assert got[2]["reason"].startswith("excluded: duplicate geometry of 'a'")
    assert got[1]["clipped"] and not got[3]["clipped"] and got[4]["geom_type"] == "MultiPolygon"
    assert min(q["x"] for q in got[1]["parts"][0][0]) == pytest.approx(0, abs=1e-6)
    flagged, pairs = Z.flag_shared_edges(chosen)
    assert [tuple(r) for r in pairs.collect()] == [(1, 3)]
    assert {r["pos"] for r in flagged.where("shared_edge").collect()} == {1, 3}


def test_tiles_with_many_edges_are_quartered():
    angles = np.linspace(0, 2 * math.pi, 3001)[:-1]
    wheel = [[ring(*[(100 + (50 + 3 * (k % 2)) * math.cos(t), 100 + 50 * math.sin(t)) for k, t in enumerate(angles)])]]
    parts = O.valid_parts(wheel)
    assert sum(len(r) - 1 for p in parts for r in p) >= 2990


def test_a_county_that_is_not_there_is_refused(spark):
    counties = spark.createDataFrame([("53", "King", 1)], "statefp string, name string, poly_pos bigint")
    assert Z.county_boundary(counties, "53", " KING ").count() == 1
    with pytest.raises(ValueError, match="no county"):
        Z.county_boundary(counties, "54", "King")


def test_ground_filled_by_one_area_is_not_divided_for_the_others(monkeypatch):
    rnd = random.Random(5)
    boxes = [(rnd.uniform(-30, -1), rnd.uniform(-30, -1), rnd.uniform(40, 62), rnd.uniform(40, 62)) for _ in range(150)]
    regions = [(True, np.array([(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)])) for x0, y0, x1, y1 in boxes]
    seen, plain = [], O.arrange
    monkeypatch.setattr(O, "arrange", lambda *a: seen.append(len(a[4])) or plain(*a))
    step = O.step_of(64.0)
    found = list(O.dissolving(0.0, 0.0, 64.0, 64.0, [(c, np.rint(e / step) * step) for c, e in regions], step))
    assert sum(seen) < 8 * len(boxes)
    kept = [e for _, _, own in found for p in own for e in p.kept(lambda m: m.any(axis=1))[0].tolist()]
    far = max(p for line in kept for p in line)
    assert abs(far - max(max(b[2:]) for b in boxes)) < 1e-6
    joined = {(int(n[full]), int(k)) for n, full, _ in found if full is not None for k in n}
    assert {k for _, k in joined} == set(range(len(boxes)))


def test_outlines_are_checked_and_repaired_together_as_one_by_one(spark):
    rnd = random.Random(6)
    outlines = []
    for k in range(120):
        size, cx, cy = rnd.choice([6, 6, 30]), rnd.randrange(40), rnd.randrange(40)
        outlines.append([[ring(*[(cx + rnd.randrange(size), cy + rnd.randrange(size)) for _ in range(rnd.randrange(3, 9))])
                          for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(1, 3))])
    outlines += [box(0, 0, 4, 4), [], None, star(rnd, 0, 0, 150, 9.0), [[ring((0, 0), (4, 4), (4, 0), (0, 4))]]]
    rows = spark.createDataFrame(list(enumerate(outlines)), f"pos bigint, parts {G.GEOMETRY}").coalesce(1)
    out = rows.select("pos", Z.outline_check("parts").alias("c")).select("pos", "c.*").collect()
    bad = 0
    for r in out:
        geom = outlines[r.pos]
        assert r.invalid == (geom is not None and Z.meets_itself(geom))
        if r.invalid:
            bad += 1
            assert [[[(p.x, p.y) for p in own] for own in part] for part in r.parts] == O.valid_parts(geom)
    assert 20 < bad < len(outlines)


def test_many_small_tiles_are_arranged_as_one_by_one():
    rnd = random.Random(8)
    step = O.step_of(16.0)
    tiles = []
    for _ in range(60):
        own = []
        for _ in range(2):
            pts = [(rnd.randrange(-4, 20), rnd.randrange(-4, 20)) for _ in range(rnd.randrange(3, 7))]
            own.append((even_odd_at(pts, -0.3, -0.2), np.array([(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1])], dtype=float)))
        tiles.append(own)
    box = (-0.3, -0.2, 15.7, 15.8)
    e = np.vstack([x for own in tiles for _, x in own])
    group = np.repeat(np.arange(60), [sum(len(x) for _, x in own) for own in tiles])
    side = np.concatenate([np.repeat([0, 1], [len(own[0][1]), len(own[1][1])]) for own in tiles])
    at, many = O.arrange_many(np.tile(box, (60, 1)), np.array([[c for c, _ in own] for own in tiles]), e, group, side, np.full(60, step))
    seen = 0
    for k, own in enumerate(tiles):
        for one in O.arrange(*box, own, step):
            mine = at == k
            for name in ("ends", "border", "below", "above", "own", "rising"):
                assert np.array_equal(getattr(many, name)[mine], getattr(one, name)), (k, name)
            seen += mine.sum()
    assert seen == len(at) > 300


def even_odd_at(pts, x, y):
    return holds([[ring(*pts)]], x, y)
