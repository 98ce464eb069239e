"""Cutting, dissolving and repairing polygons tile by tile.

Inside a tile the edges of all regions that meet there are split where they cross or
touch, and each piece learns on which of its sides every region lies, from the tile's
corner and the pieces left of it. Pieces between wanted and unwanted ground are kept.
Pieces end at tile borders in points that both tiles compute alike, so rings are put
together per polygon by their end points, wherever their pieces were cut.

Coordinates are laid on a grid of a fine power of two (``step_of``), so that points
computed in different tiles are equal or clearly apart.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import geometry as G
from rillwork.operators import spatial as S
from rillwork.session import checkpointed

#: Edges of a tile that are compared with each other at once; more are dealt to quarter tiles.
TOGETHER, DEEPEST = 96, 16

#: Pairs of edges of many small tiles that are compared at once.
PAIRS = 500_000

EDGE = "struct<x0:double,y0:double,x1:double,y1:double>"
PIECE = "struct<x0:double,y0:double,x1:double,y1:double,b0:boolean,b1:boolean>"


def step_of(cell: float) -> float:
    return 2.0 ** (round(math.log2(cell)) - 30)


def snapped(parts: Column, step: float) -> Column:
    at = lambda v: F.rint(v / step) * step
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.struct(at(p["x"]).alias("x"), at(p["y"]).alias("y")))))


# --- inside one tile --------------------------------------------------------------------------

class Pieces:
    """Pieces of edges inside one tile, each from its lesser to its greater end point.

    ``ends`` are the end points in the tile, ``span`` the same or, where a piece leaves
    the tile, the end of its edge beyond; ``border`` tells which ends lie on a border only;
    ``below`` and ``above`` tell the regions that hold the side with the lesser x and the
    other side (for level pieces: above and below in that order), ``own`` the regions
    whose outline the piece belongs to; ``rising`` tells pieces of edges that do not fall.
    """

    def __init__(self, n: int = 0):
        self.ends, self.span, self.border = np.empty((0, 4)), np.empty((0, 4)), np.empty((0, 2), dtype=bool)
        self.below = self.above = self.own = np.empty((0, n), dtype=bool)
        self.rising = np.empty(0, dtype=bool)

    def kept(self, wanted: Callable[[np.ndarray], np.ndarray], spans: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pieces between wanted and unwanted ground with the wanted side on their left, and their border flags."""
        if not len(self.ends):
            return np.empty((0, 4)), np.empty((0, 2), dtype=bool)
        small, large = wanted(self.below), wanted(self.above)
        at = small != large
        e, b = (self.span if spans else self.ends)[at], self.border[at]
        # the side with the lesser x is on the left of a rising piece; above is on the left of a level one
        forward = small[at] == self.rising[at]
        e, b = np.where(forward[:, None], e, e[:, [2, 3, 0, 1]]), np.where(forward[:, None], b, b[:, ::-1])
        return e, b


def _ordered(e: np.ndarray) -> np.ndarray:
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    return np.where(back[:, None], e[:, [2, 3, 0, 1]], e)


def _within(e: np.ndarray, left: float, low: float, right: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Range of each edge's parameter inside the box."""
    t0, t1 = np.zeros(len(e)), np.ones(len(e))
    for a, d, lo, hi in ((e[:, 0], e[:, 2] - e[:, 0], left, right), (e[:, 1], e[:, 3] - e[:, 1], low, high)):
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (lo - a) / d, (hi - a) / d
        flat, out = d == 0, (d == 0) & ((a < lo) | (a > hi))
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(u, v)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(u, v)))
        t1 = np.where(out, -1.0, t1)
    return t0, t1


def _meetings(e: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Edge numbers and the points at which other edges cross them or end on them."""
    n, near = len(e), 2 * step
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    who, at = [], []
    for a in range(0, n, max(1, 200_000 // n)):
        b = min(n, a + max(1, 200_000 // n))
        box = ((lo[a:b, None] <= hi[None] + near) & (lo[None] <= hi[a:b, None] + near)).all(axis=2)
        i, j = np.nonzero(box)
        i += a
        i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        found = _pair_meetings(e, i, j, np.full(len(i), step))
        who += found[0]
        at += found[1]
    if not who:
        return np.empty(0, dtype=int), np.empty((0, 2))
    return np.concatenate(who), np.concatenate(at)


def _pair_meetings(e: np.ndarray, i: np.ndarray, j: np.ndarray, step: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """``_meetings`` of the given pairs of edges, each on its own grid."""
    near, grid = 2 * step, step[:, None]
    size = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    p, q = e[i], e[j]
    d, g = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]
    w = q[:, :2] - p[:, :2]
    den = d[:, 0] * g[:, 1] - d[:, 1] * g[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, 0] * g[:, 1] - w[:, 1] * g[:, 0]) / den
        u = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / den
    slack_t, slack_u = near / size[i], near / size[j]
    hit = (den != 0) & (t > -slack_t) & (t < 1 + slack_t) & (u > -slack_u) & (u < 1 + slack_u)
    point = p[:, :2] + np.nan_to_num(np.clip(t, 0, 1))[:, None] * d
    point = np.rint(point / grid) * grid
    for k in (p[:, :2], p[:, 2:], q[:, :2], q[:, 2:]):  # a crossing beside an end is that end
        close = (np.abs(point - k) <= near[:, None]).all(axis=1)
        point = np.where(close[:, None], k, point)
    who, at = [i[hit], j[hit]], [point[hit], point[hit]]
    for one, other, k in ((i, p, q[:, :2]), (i, p, q[:, 2:]), (j, q, p[:, :2]), (j, q, p[:, 2:])):
        along = other[:, 2:] - other[:, :2]
        r = k - other[:, :2]
        s = (r * along).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.abs(r[:, 0] * along[:, 1] - r[:, 1] * along[:, 0]) / size[one]
        on = (off <= near) & (s > 0) & (s < size[one] ** 2)
        who.append(one[on])
        at.append(k[on])
    return who, at


def grouped_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places before and after each other with equal numbers in the sorted ``group``."""
    stop = np.searchsorted(group, group, side="right")
    n = stop - np.arange(len(group)) - 1
    i = np.repeat(np.arange(len(group)), n)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def arrange_many(boxes: np.ndarray, corners: np.ndarray, e: np.ndarray, group: np.ndarray, region: np.ndarray,
                 step: np.ndarray) -> tuple[np.ndarray, Pieces]:
    """``arrange`` without quartering for many small tiles at once: ``(tile of each piece, pieces)``.

    ``boxes`` and ``step`` by tile, ``corners`` by tile and region; edges with their tile and region. Spans are not told.
    """
    n, out = corners.shape[1], Pieces(corners.shape[1])
    nothing = np.empty(0, dtype=int), out
    e = _ordered(e)
    order = np.lexsort((*e.T[::-1], group))
    order = order[(e[order, :2] != e[order, 2:]).any(axis=1)]
    e, group, region = e[order], group[order], region[order]
    if not len(e):
        return nothing
    d = e[:, 2:] - e[:, :2]
    along = np.where(np.abs(d[:, 0]) >= np.abs(d[:, 1]), 0, 1)
    main = d[np.arange(len(e)), along]
    left, low, right, high = boxes[group].T
    t0, t1 = _within(e, left, low, right, high)
    i, j = grouped_pairs(group)
    lo, hi, near = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:]), 2 * step[group][:, None]
    close = ((lo[i] <= hi[j] + near[i]) & (lo[j] <= hi[i] + near[i])).all(axis=1)
    i, j = i[close], j[close]
    met = _pair_meetings(e, i, j, step[group[i]])
    who, at = np.concatenate(met[0]), np.concatenate(met[1])
    rows, grid = np.arange(len(e)), step[group][:, None]
    tw = (at[np.arange(len(who)), along[who]] - e[who, along[who]]) / main[who]
    ends = np.rint((e[:, :2] + t0[:, None] * d) / grid) * grid, np.rint((e[:, :2] + t1[:, None] * d) / grid) * grid
    ends = (np.where((t0 <= 0)[:, None], e[:, :2], ends[0]), np.where((t1 >= 1)[:, None], e[:, 2:], ends[1]))
    stops_who = np.concatenate([rows, rows, who])
    stops_t = np.concatenate([np.maximum(t0, 0), np.minimum(t1, 1), tw])
    stops_at = np.concatenate([ends[0], ends[1], at]) + 0.0
    stops_border = np.concatenate([t0 > 0, t1 < 1, np.zeros(len(who), dtype=bool)])
    used = (t0[stops_who] <= t1[stops_who]) & (stops_t >= t0[stops_who]) & (stops_t <= t1[stops_who])
    stops_who, stops_t, stops_at, stops_border = (v[used] for v in (stops_who, stops_t, stops_at, stops_border))
    order = np.lexsort((stops_border, stops_at[:, 1], stops_at[:, 0], stops_t, stops_who))
    stops_who, stops_at, stops_border = stops_who[order], stops_at[order], stops_border[order]
    if not len(stops_who):
        return nothing
    same = (stops_who[1:] == stops_who[:-1]) & (stops_at[1:] == stops_at[:-1]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    marked = np.minimum.reduceat(stops_border.astype(int), first).astype(bool)
    g_who, g_at = stops_who[first], stops_at[first]
    nxt = np.flatnonzero(g_who[1:] == g_who[:-1])
    who, raw, border = g_who[nxt], np.column_stack([g_at[nxt], g_at[nxt + 1]]), np.column_stack([marked[nxt], marked[nxt + 1]])
    mid = (raw[:, :2] + raw[:, 2:]) / 2
    here = (mid[:, 0] >= left[who]) & (mid[:, 0] < right[who]) & (mid[:, 1] >= low[who]) & (mid[:, 1] < high[who])
    who, raw, border = who[here], raw[here], border[here]
    if not len(who):
        return nothing
    turned = (raw[:, 0] > raw[:, 2]) | ((raw[:, 0] == raw[:, 2]) & (raw[:, 1] > raw[:, 3]))
    raw, border = np.where(turned[:, None], raw[:, [2, 3, 0, 1]], raw), np.where(turned[:, None], border[:, ::-1], border)
    order = np.lexsort((*raw.T[::-1], group[who]))
    who, raw, border = who[order], raw[order], border[order]
    tile = group[who]
    new = np.concatenate([[True], (tile[1:] != tile[:-1]) | (raw[1:] != raw[:-1]).any(axis=1)])
    first, place = np.flatnonzero(new), np.cumsum(new) - 1
    tile = tile[first]
    out.ends = out.span = raw[first]
    out.border = np.minimum.reduceat(border.astype(int), first).astype(bool)
    out.rising = e[who[first], 1] <= e[who[first], 3]
    out.own = np.bincount(place * n + region[who], minlength=len(first) * n).reshape(-1, n) % 2 == 1
    # the path to the middle of a piece meets every edge of its tile, as in ``_sides``
    begin, end = np.searchsorted(group, tile), np.searchsorted(group, tile, side="right")
    base = np.cumsum(end - begin) - (end - begin)
    piece = np.repeat(np.arange(len(first)), end - begin)
    edge = begin[piece] + np.arange(len(piece)) - base[piece]
    member = np.zeros(len(piece), dtype=bool)
    member[base[place] + who - begin[place]] = True
    px, py = ((out.ends[:, :2] + out.ends[:, 2:]) / 2)[piece].T
    ax, ay, bx, by = e[edge].T
    x, y = left[edge], low[edge]
    with np.errstate(divide="ignore", invalid="ignore"):
        yc = ay + (by - ay) * ((x - ax) / (bx - ax))
        xc = ax + (bx - ax) * ((py - ay) / (by - ay))
    crosses, falls = (ax >= x) != (bx >= x), by < ay
    passed = np.where(member, ~falls, yc <= py)
    starts = np.where(crosses, passed != falls, ax >= x)
    up = crosses & (yc >= y) & passed
    across = ((ay > py) != (by > py)) & starts & (xc < px) & ~member
    turns = np.bincount(piece * n + region[edge], up.astype(int) + across, len(first) * n).reshape(-1, n) % 2 == 1
    out.below = corners[tile] ^ turns
    out.above = out.below ^ out.own
    return tile, out


def arrange(left: float, low: float, right: float, high: float, regions: list[tuple[bool, np.ndarray]], step: float,
            depth: int = 0, outer: tuple | None = None) -> list[Pieces]:
    """Pieces of all outlines inside a tile; ``regions`` are (corner inside, edges that touch the tile)."""
    if outer is None:
        outer, regions = (left, low, right, high), [(c, _ordered(e)) for c, e in regions]
    counts = [len(e) for _, e in regions]
    n = len(regions)
    if not sum(counts):
        return []
    if sum(counts) > TOGETHER and depth < DEEPEST and right - left > 64 * step:
        out = []
        mx, my = _free_split(left, low, right, high, np.vstack([e for _, e in regions if len(e)]), step)
        for x0, x1, y0, y1 in ((left, mx, low, my), (mx, right, low, my), (left, mx, my, high), (mx, right, my, high)):
            held = []
            for corner, e in regions:
                # corners stand for the ground just left of and below them
                inside = corner if (x0, y0) == (left, low) else _corner(x0, y0, left, low, corner, e)
                t0, t1 = _within(e, x0 - step, y0 - step, x1 + step, y1 + step) if len(e) else (np.empty(0), np.empty(0))
                held.append((inside, e[t0 <= t1]))
            if depth + 1 < DEEPEST and all(len(h) == c for (_, h), c in zip(held, counts)) and depth > 8:
                held_depth = DEEPEST
            else:
                held_depth = depth + 1
            out += arrange(x0, y0, x1, y1, held, step, held_depth, outer)
        return out

    e = _ordered(np.vstack([x for _, x in regions if len(x)]))
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort(e.T[::-1])
    e, owner = e[order], owner[order]
    whole = (e[:, :2] != e[:, 2:]).any(axis=1)
    e, owner = e[whole], owner[whole]
    if not len(e):
        return []
    d = e[:, 2:] - e[:, :2]
    along = np.where(np.abs(d[:, 0]) >= np.abs(d[:, 1]), 0, 1)
    main = d[np.arange(len(e)), along]
    t0, t1 = _within(e, left, low, right, high)
    o0, o1 = _within(e, *outer)
    who, at = _meetings(e, step)
    rows = np.arange(len(e))
    tw = (at[np.arange(len(who)), along[who]] - e[who, along[who]]) / main[who]
    ends = np.rint((e[:, :2] + t0[:, None] * d) / step) * step, np.rint((e[:, :2] + t1[:, None] * d) / step) * step
    ends = (np.where((t0 <= 0)[:, None], e[:, :2], ends[0]), np.where((t1 >= 1)[:, None], e[:, 2:], ends[1]))
    # a stop that lies on a border and nowhere else is marked, so that it can be left out of the ring
    stops_who = np.concatenate([rows, rows, who])
    stops_t = np.concatenate([np.maximum(t0, 0), np.minimum(t1, 1), tw])
    stops_at = np.concatenate([ends[0], ends[1], at])
    stops_border = np.concatenate([t0 > 0, t1 < 1, np.zeros(len(who), dtype=bool)])
    used = t0[stops_who] <= t1[stops_who]
    used &= (stops_t >= t0[stops_who]) & (stops_t <= t1[stops_who])
    stops_who, stops_t, stops_at, stops_border = (v[used] for v in (stops_who, stops_t, stops_at, stops_border))
    order = np.lexsort((stops_border, stops_at[:, 1], stops_at[:, 0], stops_t, stops_who))
    stops_who, stops_t, stops_at, stops_border = (v[order] for v in (stops_who, stops_t, stops_at, stops_border))
    same = (stops_who[1:] == stops_who[:-1]) & (stops_at[1:] == stops_at[:-1]).all(axis=1)
    # equal stops fold into one, marked only if all of them are
    group = np.concatenate([[0], np.cumsum(~same)]) if len(stops_who) else np.empty(0, dtype=int)
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(stops_who) else np.empty(0, dtype=int)
    if not len(first):
        return []
    marked = np.minimum.reduceat(stops_border.astype(int), first).astype(bool)
    g_who, g_t, g_at = stops_who[first], stops_t[first], stops_at[first]
    last_t = np.maximum.reduceat(stops_t, first)
    del group
    nxt = np.flatnonzero(g_who[1:] == g_who[:-1])
    who, a, b = g_who[nxt], g_at[nxt], g_at[nxt + 1]
    mid = (a + b) / 2
    # a piece belongs to the tile that its middle lies in
    here = (mid[:, 0] >= left) & (mid[:, 0] < right) & (mid[:, 1] >= low) & (mid[:, 1] < high)
    span_a = np.where((g_t[nxt] <= np.maximum(o0[who], 0))[:, None] & marked[nxt][:, None], e[who, :2], a)
    span_b = np.where((last_t[nxt + 1] >= np.minimum(o1[who], 1))[:, None] & marked[nxt + 1][:, None], e[who, 2:], b)
    border = np.column_stack([marked[nxt], marked[nxt + 1]])
    raw = np.column_stack([a, b])
    turned = (raw[:, 0] > raw[:, 2]) | ((raw[:, 0] == raw[:, 2]) & (raw[:, 1] > raw[:, 3]))
    raw, span = np.where(turned[:, None], raw[:, [2, 3, 0, 1]], raw), np.column_stack([span_a, span_b])
    span, border = np.where(turned[:, None], span[:, [2, 3, 0, 1]], span), np.where(turned[:, None], border[:, ::-1], border)
    raw, span, border, own = raw[here], span[here], border[here], owner[who][here]
    if not len(raw):
        return []
    distinct, place = np.unique(raw, axis=0, return_inverse=True)
    place = place.reshape(-1)
    out = Pieces(n)
    out.ends = distinct
    out.span = np.empty_like(distinct)
    out.span[place] = span
    out.border = np.ones((len(distinct), 2), dtype=bool)
    np.logical_and.at(out.border, place, border)
    source = np.empty(len(distinct), dtype=int)
    source[place] = who[here]
    out.rising = e[source, 1] <= e[source, 3]
    parity = np.zeros((len(distinct), n), dtype=int)
    np.add.at(parity, (place, own), 1)
    out.own = parity % 2 == 1
    mx, my = (distinct[:, 0] + distinct[:, 2]) / 2, (distinct[:, 1] + distinct[:, 3]) / 2
    out.below = np.empty((len(distinct), n), dtype=bool)
    for k, (corner, _) in enumerate(regions):
        mine = np.flatnonzero(owner == k)
        number = np.full(len(e), -1)
        number[mine] = np.arange(len(mine))
        out.below[:, k] = _sides(mx, my, left, low, corner, e[mine], place[own == k], number[who[here][own == k]])
    out.above = out.below ^ out.own
    return [out]


def dissolving(left: float, low: float, right: float, high: float, regions: list[tuple[bool, np.ndarray]], step: float,
               ) -> Iterator[tuple[np.ndarray, int | None, list[Pieces]]]:
    """``arrange`` for the union of many regions: quarters that one region fills are not divided further.

    Gives ``(numbers, full, pieces)`` per leaf: the regions that reach into it, the one that
    fills it (its place among the numbers) or None, and the pieces of the others, whose columns follow ``numbers``.
    """
    edges = [_ordered(e) for _, e in regions]
    todo = [(left, low, right, high, np.arange(len(regions)), np.array([c for c, _ in regions], dtype=bool),
             np.vstack(edges) if edges else np.empty((0, 4)), np.repeat(np.arange(len(regions)), [len(e) for e in edges]), 0)]
    while todo:
        left_, low_, right_, high_, numbers, corners, e, owner, depth = todo.pop()
        counts = np.bincount(owner, minlength=len(numbers))
        reach = corners | (counts > 0)
        place = np.cumsum(reach) - 1
        numbers, corners, counts, owner = numbers[reach], corners[reach], counts[reach], place[owner]
        if not len(numbers):
            continue
        full = np.flatnonzero(corners & (counts == 0))
        if len(full):
            yield numbers, int(full[0]), []
            continue
        if len(e) <= TOGETHER or depth >= DEEPEST or right_ - left_ <= 64 * step:
            order = np.argsort(owner, kind="stable")
            own = list(zip(corners.tolist(), np.split(e[order], np.cumsum(counts)[:-1])))
            yield numbers, None, arrange(left_, low_, right_, high_, own, step, DEEPEST, (left, low, right, high))
            continue
        mx, my = _free_split(left_, low_, right_, high_, e, step)
        for x0, x1, y0, y1 in ((left_, mx, low_, my), (mx, right_, low_, my), (left_, mx, my, high_), (mx, right_, my, high_)):
            inside = corners
            if (x0, y0) != (left_, low_):
                inside = corners ^ (np.bincount(owner, _turns(x0, y0, left_, low_, e), len(numbers)) % 2 == 1)
            t0, t1 = _within(e, x0 - step, y0 - step, x1 + step, y1 + step)
            at = t0 <= t1
            deeper = DEEPEST if at.all() and depth > 8 else depth + 1
            todo.append((x0, y0, x1, y1, numbers, inside, e[at], owner[at], deeper))


def _free_split(left, low, right, high, e, step) -> tuple[float, float]:
    """A point near the middle that makes no corner of a quarter tile lie on an edge's line."""
    d = e[:, 2:] - e[:, :2]
    size = np.maximum(np.hypot(d[:, 0], d[:, 1]), step)
    for k in range(12):
        mx, my = (np.rint((a + (0.5 + (r - 0.5) / (k + 3)) * (b - a)) / step) * step
                  for a, b, r in ((left, right, 0.3819 + 0.021 * k), (low, high, 0.6377 - 0.017 * k)))
        off = min((np.abs((x - e[:, 0]) * d[:, 1] - (y - e[:, 1]) * d[:, 0]) / size).min()
                  for x, y in ((mx, my), (mx, low), (left, my)))
        if off > 4 * step:
            break
    return mx, my


def _corner(x: float, y: float, left: float, low: float, corner: bool, e: np.ndarray) -> bool:
    """Whether the ground just left of and below a point of the tile is inside."""
    if not len(e):
        return bool(corner)
    return bool(corner) != bool(_turns(x, y, left, low, e).sum() % 2)


def _turns(x: float, y: float, left: float, low: float, e: np.ndarray) -> np.ndarray:
    """How often each edge changes sides between the tile's corner and the ground just left of and below a point."""
    ax, ay, bx, by = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        yc = ay + (by - ay) * ((left - ax) / (bx - ax))
        xc = ax + (bx - ax) * ((y - ay) / (by - ay))
    crosses, rises, passed = (ax >= left) != (bx >= left), by > ay, yc < y
    # what is passed on the way up decides as well on which side of the border an edge is at that height
    starts = np.where(crosses, np.where(rises, passed, ~passed), ax >= left)
    up = crosses & (yc >= low) & passed
    # an edge through the path's end point lies left of it just below if it rises to the right
    across = ((ay >= y) != (by >= y)) & starts & ((xc < x) | ((xc == x) & rises))
    return up.astype(int) + across


def _sides(mx, my, left, low, corner, e, piece, edge) -> np.ndarray:
    """For the middle of every piece, whether the region holds its left bank, with lesser x or above.

    The path leads from the corner up the left border and then right; ``(piece, edge)``
    are the pairs of a piece and the edges it lies on, which the path does not cross at
    its end, and of which it passes below those that fall.
    """
    out = np.full(len(mx), bool(corner))
    if not len(e):
        return out
    ax, ay, bx, by = (c[None] for c in e.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        yc = ay + (by - ay) * ((left - ax) / (bx - ax))
    crosses, falls = (ax >= left) != (bx >= left), by < ay
    room = max(1, 500_000 // len(e))
    order = np.argsort(piece, kind="stable")
    piece, edge = piece[order], edge[order]
    for a in range(0, len(mx), room):
        b = min(len(mx), a + room)
        px, py = mx[a:b, None], my[a:b, None]
        member = np.zeros((b - a, len(e)), dtype=bool)
        i, j = np.searchsorted(piece, (a, b))
        member[piece[i:j] - a, edge[i:j]] = True
        with np.errstate(divide="ignore", invalid="ignore"):
            xc = ax + (bx - ax) * ((py - ay) / (by - ay))
        passed = np.where(member, ~falls, yc <= py)
        # what is passed on the way up decides as well on which side of the border an edge is at that height
        starts = np.where(crosses, passed != falls, ax >= left)
        up = crosses & (yc >= low) & passed
        across = ((ay > py) != (by > py)) & starts & (xc < px) & ~member
        out[a:b] ^= ((up.sum(axis=1) + across.sum(axis=1)) % 2).astype(bool)
    return out


def _array(edges) -> np.ndarray:
    return np.array([(k["x0"], k["y0"], k["x1"], k["y1"]) for k in edges], dtype=float).reshape(-1, 4)


def _box(ci: int, cj: int, cell: float) -> tuple[float, float, float, float]:
    return (ci - S._SHIFT) * cell, (cj - S._SHIFT) * cell, (ci + 1 - S._SHIFT) * cell, (cj + 1 - S._SHIFT) * cell


# --- rings from pieces ------------------------------------------------------------------------

def _healed(pieces: np.ndarray, near: float) -> np.ndarray:
    """Pieces whose ends lie together.

    Two tiles may have an edge of a dissolved region in pieces of its own each, whose
    ends on the border between them then lie a step apart.
    """
    open_: dict = defaultdict(int)
    for x0, y0, x1, y1 in pieces.tolist():
        open_[x0, y0] += 1
        open_[x1, y1] -= 1
    if not any(open_.values()):
        return pieces
    ends = np.vstack([pieces[:, :2], pieces[:, 2:]])
    points, at = np.unique(ends, axis=0, return_inverse=True)
    at = at.reshape(-1)
    excess = np.bincount(at[:len(pieces)], minlength=len(points)) - np.bincount(at[len(pieces):], minlength=len(points))
    starts, stops = np.flatnonzero(excess > 0), np.flatnonzero(excess < 0)
    moved = points.copy()
    for k in stops:  # few; points are sorted by x
        a, b = np.searchsorted(points[starts, 0], (points[k, 0] - near, points[k, 0] + near + near))
        own = starts[a:b]
        own = own[(np.abs(points[own] - points[k]) <= near).all(axis=1)]
        if len(own):
            moved[k] = points[own[0]]
    return np.column_stack([moved[at[:len(pieces)]], moved[at[len(pieces):]]])


def rings_of(pieces: np.ndarray, border: np.ndarray, near: float) -> list[list[list[tuple[float, float]]]]:
    """Polygon parts from directed pieces with the inside on their left: shells turn left, holes right.

    At a point with several ways on, the walk takes the first one clockwise from where it
    came, which keeps to one face; a ring that meets itself in a point is split there.
    Points that lie on tile borders only are left out.
    """
    if not len(pieces):
        return []
    pieces = _healed(pieces, near)
    whole = (pieces[:, :2] != pieces[:, 2:]).any(axis=1)
    pieces, border = pieces[whole], border[whole]
    after = defaultdict(list)
    for k, (x0, y0, x1, y1) in enumerate(pieces.tolist()):
        after[(x0, y0)].append(k)
    ends = [((a, b), (c, d)) for a, b, c, d in pieces.tolist()]
    used = [False] * len(ends)
    loops = []
    for start in range(len(ends)):
        if used[start]:
            continue
        walk, k = [], start
        while not used[k]:
            used[k] = True
            walk.append(k)
            here = ends[k][1]
            ways = [w for w in after[here] if not used[w]]
            if not ways:
                break
            if len(ways) > 1:
                back = math.atan2(ends[k][0][1] - here[1], ends[k][0][0] - here[0])
                turn = lambda w: (back - math.atan2(ends[w][1][1] - here[1], ends[w][1][0] - here[0])) % (2 * math.pi)
                ways.sort(key=lambda w: turn(w) or 2 * math.pi)
            k = ways[0]
        # split where a point comes twice
        path, place = [], {}
        for k in walk:
            a = ends[k][0]
            if a in place:
                at = place[a]
                loops.append(path[at:])
                for gone in path[at:]:
                    place.pop(ends[gone][0], None)
                path = path[:at]
            place[a] = len(path)
            path.append(k)
        if path and ends[path[-1]][1] == ends[path[0]][0]:
            loops.append(path)
    shells, holes = [], []
    for loop in loops:
        points = [ends[k][0] for i, k in enumerate(loop) if not (border[k][0] and border[loop[i - 1]][1])]
        ring = _straightened(points)
        if len(ring) < 3:
            continue
        area = sum((a[0] - ring[0][0]) * (b[1] - ring[0][1]) - (b[0] - ring[0][0]) * (a[1] - ring[0][1])
                   for a, b in zip(ring, ring[1:] + ring[:1])) / 2
        at = ring.index(min(ring))
        ring = ring[at:] + ring[:at] + [ring[at]]
        if area > 0:
            shells.append((area, ring))
        elif area < 0:
            holes.append(ring)
    shells.sort(key=lambda s: (s[0], s[1]))
    parts = [[ring] for _, ring in shells]
    boxes = [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for _, r in shells]
    for hole in sorted(holes):
        mx, my = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        for k, (x0, y0, x1, y1) in enumerate(boxes):  # smallest shell first
            if x0 <= mx <= x1 and y0 <= my <= y1 and _holds(shells[k][1], mx, my):
                parts[k].append(hole)
                break
    return sorted(parts, key=lambda p: p[0])


def _straightened(points: list) -> list:
    """Without equal neighbours."""
    return [p for i, p in enumerate(points) if p != points[i - 1] or len(points) == 1]


def _holds(ring: list, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and ax + (bx - ax) * ((y - ay) / (by - ay)) < x:
            inside = not inside
    return inside


def as_rows(parts: list) -> list:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


# --- a region's union ---------------------------------------------------------------------------

def union_tiles(areas: DataFrame, cell: float, key: str = "poly_pos") -> DataFrame:
    """``(ci, cj, corner_inside, edges)`` of the ground that any of the areas covers.

    Areas may overlap or touch: edges inside the union are gone, so what lies in several
    areas counts once. Tiles that one area alone touches stay as they are; no tile holds
    more than the edges that touch it.
    """
    step = step_of(cell)
    single = S.tiles(areas.select(key, snapped(F.col("parts"), step).alias("parts")), key, cell)
    met = single.groupBy("ci", "cj").agg(
        F.bool_or("corner_inside").alias("corner_inside"), F.collect_list(F.struct("corner_inside", "edges")).alias("own"))
    edged = F.filter("own", lambda o: F.size(o["edges"]) > 0)
    full = F.exists("own", lambda o: o["corner_inside"] & (F.size(o["edges"]) == 0))
    none = F.array().cast(f"array<{EDGE}>")
    met = met.select("ci", "cj", F.col("corner_inside") | full, edged.alias("own"), full.alias("full")).toDF(
        "ci", "cj", "corner_inside", "own", "full")
    plain = met.where(F.col("full") | (F.size("own") < 2)).select("ci", "cj", "corner_inside", F.when(
        F.col("full") | (F.size("own") == 0), none).otherwise(F.element_at("own", 1)["edges"]).alias("edges"))

    def dissolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = [(o["corner_inside"], _array(o["edges"])) for o in r.own]
                kept = [p.kept(lambda m: m.any(axis=1), spans=True)[0] for *_, found in dissolving(*_box(r.ci, r.cj, cell), own, step) for p in found]
                rows.append([dict(zip(("x0", "y0", "x1", "y1"), e)) for k in kept for e in k.tolist()])
            yield pd.DataFrame({"ci": pdf.ci, "cj": pdf.cj, "corner_inside": pdf.corner_inside, "edges": rows})

    mixed = met.where(~F.col("full") & (F.size("own") > 1)).select("ci", "cj", "corner_inside", "own")
    return plain.unionByName(mixed.mapInPandas(dissolve, f"ci bigint, cj bigint, corner_inside boolean, edges array<{EDGE}>"))


def _stitched(pieces: DataFrame, key: str, near: float) -> DataFrame:
    """``(key, parts)`` from ``(key, pieces)``; a row's pieces are one polygon."""
    kind = dict(pieces.dtypes)[key]

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own in pdf.pieces:
                flags = np.array([(k["b0"], k["b1"]) for k in own], dtype=bool).reshape(-1, 2)
                rows.append(as_rows(rings_of(_array(own), flags, near)))
            yield pd.DataFrame({key: pdf[key], "parts": rows})

    return pieces.select(key, "pieces").mapInPandas(stitch, f"{key} {kind}, parts {G.GEOMETRY}")


def dissolved(areas: DataFrame, cell: float, key: str = "poly_pos") -> DataFrame:
    """``(region, parts)``: the union of the areas, one row for each connected outline group.

    Outlines that meet in a point belong together; a hole is joined to its shell by the
    areas that lie between them, so rows are grouped by the areas' own connections.
    """
    step = step_of(cell)
    laid = checkpointed(S.tiles(areas.select(key, snapped(F.col("parts"), step).alias("parts")), key, cell))
    # areas of one tile that touch or overlap belong to one region
    met = laid.groupBy("ci", "cj").agg(F.collect_list(F.struct(F.col(key).alias("k"), "corner_inside", "edges")).alias("own"))

    def touching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                keys = [o["k"] for o in r.own]
                own = [(o["corner_inside"], _array(o["edges"])) for o in r.own]
                at: dict = {}
                met = set()
                for numbers, full, found in dissolving(*_box(r.ci, r.cj, cell), own, step):
                    if full is not None:  # ground that one area fills joins all that reach into it
                        met |= {(numbers[full], k) for k in numbers.tolist()}
                    for p in found:
                        held = p.below | p.above | p.own
                        for line, mine in zip(p.ends.tolist(), held):
                            n = numbers[mine].tolist()
                            met |= {(n[0], k) for k in n[1:]}
                            for point in ((line[0], line[1]), (line[2], line[3])):
                                first = at.setdefault(point, n[0]) if n else None
                                if n and first != n[0]:
                                    met.add((first, n[0]))
                rows += [(keys[i], keys[j]) for i, j in met if i != j]
            yield pd.DataFrame(rows, columns=["a", "b"])

    kind = dict(areas.dtypes)[key]
    links = checkpointed(met.mapInPandas(touching, f"a {kind}, b {kind}").distinct())
    alone = laid.select(F.col(key).alias("a"), F.col(key).alias("b")).distinct()
    groups = checkpointed(S.components(links.union(alone)).select(F.col("node").alias(key), F.col("root").alias("region")))
    # each region is dissolved on its own tiles
    tagged = laid.join(groups, key)
    per = tagged.groupBy("region", "ci", "cj").agg(F.collect_list(F.struct("corner_inside", "edges")).alias("own"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = [(o["corner_inside"], _array(o["edges"])) for o in r.own]
                for p in (p for *_, found in dissolving(*_box(r.ci, r.cj, cell), own, step) for p in found):
                    e, b = p.kept(lambda m: m.any(axis=1))
                    rows += [(r.region, dict(zip(("x0", "y0", "x1", "y1", "b0", "b1"), (*k, *f)))) for k, f in zip(e.tolist(), b.tolist())]
            yield pd.DataFrame(rows, columns=["region", "piece"])

    pieces = per.mapInPandas(cut, f"region {kind}, piece {PIECE}").groupBy("region").agg(F.collect_list("piece").alias("pieces"))
    return _stitched(pieces, "region", 4 * step)


# --- cutting --------------------------------------------------------------------------------------

def clip_polygons(polygons: DataFrame, region: DataFrame, cell: float) -> DataFrame:
    """Adds ``outcome`` and puts the part inside the region in place of ``parts``.

    ``polygons(pos, parts, ..)``; ``region`` as from ``union_tiles``. Outcome is covered
    (parts as they were), partial (cut rings) or dropped (no shared area, parts null).
    Only polygons that reach an outline of the region or leave it are cut.
    """
    step = step_of(cell)
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(polygons.select("pos", snapped(F.col("parts"), step).alias("parts")).repartition(tasks, "pos"))
    # the part of a tile that a polygon can reach: its bounds with a rim that is no round number
    low, high = (lambda c: S.cell_edge(F.col(c), cell)), (lambda c: S.cell_edge(F.col(c) + 1, cell))
    rim = cell * 0.0030517578125 + 5 * step
    reach = laid.select("pos", G.bounds(F.col("parts")).alias("_b"))
    own = S.tiles(laid, "pos", cell).join(reach, "pos").select(
        "pos", "ci", "cj", "corner_inside", "edges",
        F.greatest(low("ci"), F.col("_b.min_x") - rim).alias("bx0"), F.greatest(low("cj"), F.col("_b.min_y") - rim).alias("by0"),
        F.least(high("ci"), F.col("_b.max_x") + rim).alias("bx1"), F.least(high("cj"), F.col("_b.max_y") + rim).alias("by1"))
    theirs = region.select("ci", "cj", F.col("corner_inside").alias("cb"), F.col("edges").alias("eb"))
    # outlines of the region that do not come near the polygon only tell whether its ground is inside
    near = F.filter("eb", lambda e: (F.least(e["x0"], e["x1"]) <= F.col("bx1")) & (F.greatest(e["x0"], e["x1"]) >= F.col("bx0"))
                    & (F.least(e["y0"], e["y1"]) <= F.col("by1")) & (F.greatest(e["y0"], e["y1"]) >= F.col("by0")))
    inside = S.inside_tile(F.col("bx0"), F.col("by0"), low("ci"), low("cj"), F.coalesce(F.col("cb"), F.lit(False)),
                           F.coalesce("eb", F.array().cast(f"array<{EDGE}>")))
    met = checkpointed(S.skew_join(checkpointed(own), theirs, ["ci", "cj"], "left").withColumn("cb", inside).withColumn("eb", near))
    plain = F.coalesce(F.size("eb") == 0, F.lit(True))
    full = F.col("cb") & plain
    state = met.groupBy("pos").agg(F.bool_and(full).alias("covered"), F.bool_and(plain & ~full).alias("dropped"))
    mixed = met.join(state.where("NOT covered AND NOT dropped").select("pos"), "pos", "left_semi").repartition(tasks, "pos", "ci", "cj")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("x0", "y0", "x1", "y1", "b0", "b1")
        for pdf in batches:
            edges = [(_array(r.edges), _array([] if r.eb is None else r.eb)) for r in pdf.itertuples(index=False)]
            boxes = pdf[["bx0", "by0", "bx1", "by1"]].to_numpy(dtype=float)
            corners = np.empty((len(pdf), 2), dtype=bool)
            for k, (r, (ea, eb)) in enumerate(zip(pdf.itertuples(index=False), edges)):
                tile = _box(r.ci, r.cj, cell)
                corners[k] = _corner(r.bx0, r.by0, tile[0], tile[1], r.corner_inside, _ordered(ea)), r.cb
            kept, changed, seen = [[] for _ in edges], np.zeros(len(edges), dtype=bool), np.zeros(len(edges), dtype=bool)

            def take(k: np.ndarray, p: Pieces) -> None:
                e, b = p.kept(lambda m: m.all(axis=1))
                turned = p.below.all(axis=1) != p.above.all(axis=1)
                for n, line, flags in zip(k[turned].tolist(), e.tolist(), b.tolist()):
                    kept[n].append(dict(zip(names, (*line, *flags))))
                seen[k] = True
                changed[k[p.own[:, 0] != turned]] = True

            sizes = np.array([len(a) + len(b) for a, b in edges])
            for k in np.flatnonzero(sizes > TOGETHER).tolist():
                found = arrange(*boxes[k], list(zip(corners[k].tolist(), edges[k])), step)
                for p in found:
                    take(np.full(len(p.ends), k), p)
            few = np.flatnonzero((sizes > 0) & (sizes <= TOGETHER))
            for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(sizes[few] ** 2) // PAIRS)) + 1):
                if not len(some):
                    continue
                e = np.vstack([x for k in some for x in edges[k]])
                counts = np.array([[len(x) for x in edges[k]] for k in some])
                group = np.repeat(np.arange(len(some)), counts.sum(axis=1))
                side = np.repeat(np.tile([0, 1], len(some)), counts.reshape(-1))
                at, p = arrange_many(boxes[some], corners[some], e, group, side, np.full(len(some), step))
                take(some[at], p)
            # ground of the polygon without any pieces is lost where the region does not hold it
            changed |= ~seen & corners[:, 0] & ~corners[:, 1]
            yield pd.DataFrame({"pos": pdf.pos, "changed": changed, "pieces": kept})

    kind = dict(polygons.dtypes)["pos"]
    pieces = mixed.mapInPandas(cut, f"pos {kind}, changed boolean, pieces array<{PIECE}>")
    whole = checkpointed(pieces.groupBy("pos").agg(F.bool_or("changed").alias("changed"), F.flatten(F.collect_list("pieces")).alias("pieces")))
    rings = _stitched(whole.where("changed"), "pos", 4 * step).withColumnRenamed("parts", "_cut")
    outcome = (F.when(F.col("covered") | (F.col("changed") == F.lit(False)), "covered")
               .when(F.size("_cut") > 0, "partial").otherwise("dropped"))
    found = state.join(whole.select("pos", "changed"), "pos", "left").join(rings, "pos", "left").select(
        "pos", outcome.alias("_outcome"), "_cut")
    rest = [F.col(c) for c in polygons.columns if c not in ("parts", "outcome")]
    kept = F.coalesce("_outcome", F.lit("dropped"))
    return polygons.join(found, "pos", "left").select(*rest, kept.alias("outcome"), F.when(kept == "covered", F.col("parts")).when(
        kept == "partial", F.col("_cut")).alias("parts"))


# --- repair ------------------------------------------------------------------------------------------

def valid_parts(parts) -> list:
    """The even-odd ground of outlines that cross or touch themselves, as valid polygon parts."""
    e = np.array([(a["x"], a["y"], b["x"], b["y"]) for part in parts for ring in part
                  for a, b in zip(ring[:-1], ring[1:])], dtype=float).reshape(-1, 4)
    if not len(e):
        return []
    lo, hi = np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
    size = float(max(*(hi - lo), np.abs(e).max() * 1e-6, 1e-9))
    step = step_of(size)
    e = np.rint(e / step) * step
    pad = size / 16
    found = arrange(lo[0] - pad, lo[1] - pad, hi[0] + pad, hi[1] + pad, [(False, e)], step)
    kept = [p.kept(lambda m: m[:, 0]) for p in found]
    if not kept:
        return []
    return rings_of(np.vstack([k[0] for k in kept]), np.vstack([k[1] for k in kept]), 4 * step)


def valid_parts_many(e: np.ndarray, group: np.ndarray) -> list[list]:
    """``valid_parts`` of many outlines of few edges each; edges come sorted by their outline's number, from 0."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lo = np.minimum.reduceat(np.minimum(e[:, :2], e[:, 2:]), first)
    hi = np.maximum.reduceat(np.maximum(e[:, :2], e[:, 2:]), first)
    size = np.maximum((hi - lo).max(axis=1), np.maximum(np.maximum.reduceat(np.abs(e).max(axis=1), first) * 1e-6, 1e-9))
    step = 2.0 ** (np.rint(np.log2(size)) - 30)
    e = np.rint(e / step[group][:, None]) * step[group][:, None]
    pad = size[:, None] / 16
    tile, pieces = arrange_many(np.hstack([lo - pad, hi + pad]), np.zeros((len(first), 1), dtype=bool), e, group, np.zeros(len(e), dtype=int), step)
    tile = tile[pieces.below[:, 0] != pieces.above[:, 0]]
    ends, border = pieces.kept(lambda m: m[:, 0])
    at = np.searchsorted(tile, np.arange(len(first) + 1))
    return [rings_of(ends[a:b], border[a:b], 4 * s) for a, b, s in zip(at, at[1:], step.tolist())]
