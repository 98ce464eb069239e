"""Simplified paths against the answer by hand."""

import math

import numpy as np

from rillwork.operators import selection as Z


def path(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


PATHS = "pos bigint, pts array<struct<x:double,y:double>>, width double"


def test_simplified_paths_lose_small_bends(spark):
    rows = [(1, path((0, 0), (5, 0.4), (10, 0)), 1.0), (2, path((0, 0), (5.2, 9), (10, 0)), 3.0), (3, path((2, 2)), 9.0), (4, path((0, 0), (4, 0)), 2.0)]
    out = {r.pos: [(p.x, p.y) for p in r.pts] for r in Z.simplified(spark.createDataFrame(rows, PATHS), 1.0).collect()}
    assert out == {1: [(0, 0), (10, 0)], 2: [(0, 0), (5, 9), (10, 0)], 4: [(0, 0), (4, 0)]}


def test_widest_paths_take_ties_in_source_order(spark):
    line = path((0, 0), (4, 0))
    rows = [(5, line, 7.0), (3, line, 7.0), (2, line, 8.0), (1, line, 1.0), (4, path((2, 2)), 9.0)]
    out = Z.widest_paths(spark.createDataFrame(rows, PATHS), 2.0, 2, 1.0).collect()
    assert [r.pos for r in out] == [2, 3]


def test_chords_of_many_paths_are_split_as_of_one():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 40, 60)
    xy = np.rint(rnd.uniform(0, 30, (sizes.sum(), 2)))
    out = Z.thinned_paths(xy, sizes, 4.0)

    def kept(a, b):
        if b - a < 2:
            return {a, b}
        d = xy[b] - xy[a]
        t = np.clip([(xy[k] - xy[a]) @ d / (d @ d) if d.any() else 0 for k in range(a + 1, b)], 0, 1)
        gap = [math.hypot(*(xy[k] - xy[a] - s * d)) for k, s in zip(range(a + 1, b), t)]
        k = int(np.argmax(gap))
        return kept(a, a + 1 + k) | kept(a + 1 + k, b) if gap[k] > 4.0 else {a, b}

    want, at = set(), 0
    for n in sizes.tolist():
        want |= kept(at, at + n - 1) if n else set()
        at += n
    assert set(np.flatnonzero(out).tolist()) == want
