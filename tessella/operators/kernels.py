"""Small vectorised helpers for polygons and names. They see one pair, group or batch at a time; Spark does the rest.

A polygon is a list of rings (arrays x and y, closed), outer rings and holes alike: a point is inside where it lies within an
odd number of rings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

Rings = list[tuple[np.ndarray, np.ndarray]]
RADIUS_KM = 6378.137


def rings_of(geom) -> Rings:
    """Rings of a geometry cell as pandas gives it; one without rings is the rectangle of its box."""
    if geom["rings"] is None:
        x1, y1, x2, y2 = (geom[k] for k in ("xmin", "ymin", "xmax", "ymax"))
        return [(np.array([x1, x2, x2, x1, x1], float), np.array([y1, y1, y2, y2, y1], float))]
    return [(np.asarray(r["xs"], float), np.asarray(r["ys"], float)) for r in geom["rings"]]


def edges(rings: Rings) -> np.ndarray:
    """Rows x1, y1, x2, y2."""
    return np.concatenate([np.column_stack((x[:-1], y[:-1], x[1:], y[1:])) for x, y in rings]) if rings else np.zeros((0, 4))


def contains(rings: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ray cast for many points, in lots that bound the memory."""
    e = edges(rings)
    x1, y1, x2, y2 = e[e[:, 1] != e[:, 3]].T[:, None]
    inside, rows = np.zeros(len(x), bool), max(1, 1_000_000 // max(1, x1.size))
    for k in range(0, len(x), rows):
        px, py = x[k : k + rows, None], y[k : k + rows, None]
        inside[k : k + rows] = (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum(1) % 2 == 1
    return inside


def cells_of(rings: Rings, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (rows of cx, cy) that a polygon's edges pass, and cells that lie in it whole."""
    e = edges(rings)
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first, last = np.floor(low / size - 1e-9).astype(np.int64), np.floor(high / size + 1e-9).astype(np.int64)
    edge = np.repeat(np.arange(len(e)), last - first + 1)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[edge]
    tall = np.where(high > low, high - low, 1)[edge]
    up = e[edge, 3] >= e[edge, 1]
    start, end = np.where(up, e[edge, 0], e[edge, 2]), np.where(up, e[edge, 2], e[edge, 0])
    at = lambda y: start + (end - start) * np.clip((y - low[edge]) / tall, 0, 1)
    flat = (high == low)[edge]
    xa, xb = np.where(flat, start, at(row * size)), np.where(flat, end, at((row + 1) * size))
    left, right = np.floor(np.minimum(xa, xb) / size - 1e-9).astype(np.int64), np.floor(np.maximum(xa, xb) / size + 1e-9).astype(np.int64)
    n = right - left + 1
    column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
    passed = np.unique(np.column_stack((column, np.repeat(row, n))), axis=0)
    (x1, y1), (x2, y2) = passed.min(0), passed.max(0)
    grid = np.ones((x2 - x1 + 1, y2 - y1 + 1), bool)
    grid[passed[:, 0] - x1, passed[:, 1] - y1] = False
    other = np.argwhere(grid) + [x1, y1]
    middle = (other + 0.5) * size
    return passed, other[contains(rings, middle[:, 0], middle[:, 1])]


def representative_point(rings: Rings) -> tuple[float, float]:
    """The middle of the widest stretch inside at mid-height (a little lower where only a vertex is there)."""
    e = edges(rings)
    lo, hi = e[:, [1, 3]].min(), e[:, [1, 3]].max()
    for part in (0.5, 0.4871, 0.31, 0.73):
        y = lo + (hi - lo) * part
        cross = e[(e[:, 1] > y) != (e[:, 3] > y)]
        if len(cross) >= 2:
            x = np.sort(cross[:, 0] + (y - cross[:, 1]) * (cross[:, 2] - cross[:, 0]) / (cross[:, 3] - cross[:, 1]))
            wide = x[1::2] - x[: len(x) // 2 * 2 : 2]
            k = int(wide.argmax())
            if wide[k] > 0:
                return float((x[2 * k] + x[2 * k + 1]) / 2), float(y)
    return float(e[0, 0]), float(e[0, 1])


def _convex(rings: Rings) -> bool:
    if len(rings) != 1 or len(rings[0][0]) < 4:
        return False
    x, y = rings[0]
    dx, dy = np.diff(x), np.diff(y)
    turn = dx * np.roll(dy, -1) - dy * np.roll(dx, -1)
    return bool((turn >= -1e-15).all() or (turn <= 1e-15).all())


def spherical_km2(x: np.ndarray, y: np.ndarray) -> float:
    """Signed area of a closed ring on the sphere."""
    s = np.sin(np.radians(y))
    return float((np.radians(np.diff(x)) * (s[1:] + s[:-1])).sum() / 2) * RADIUS_KM**2


def _crossings(e: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross, in lots that bound the memory."""
    found = [np.zeros(0)]
    rows = max(1, 2_000_000 // max(1, len(e)))
    for k in range(0, len(e), rows):
        some = slice(k, k + rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (at[None, :] - at[some, None]) / (slope[some, None] - slope[None, :])
        low, high = np.maximum(e[None, :, 1], e[some, None, 1]), np.minimum(e[None, :, 3], e[some, None, 3])
        found.append(y[np.isfinite(y) & (y > low) & (y < high)])
    return np.concatenate(found)


def _sweep(sets: list[np.ndarray], inside: Callable[[np.ndarray], np.ndarray]) -> tuple[list[tuple[float, float, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Slabs between the heights of all vertices and crossings of some sets of directed edges: (low, high, left edges, right edges)
    of what `inside` keeps, with slope and offset of every edge. inside sees, set by set and from left to right, how often each
    set's edges have turned round so far (up counts 1, down -1)."""
    e = np.concatenate([np.zeros((0, 4)), *sets])
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = e[:, 1] != e[:, 3]
    e, own = e[keep].copy(), own[keep]
    if not len(e):
        return [], np.zeros(0), np.zeros(0)
    down = e[:, 1] > e[:, 3]
    turn = np.where(down, -1, 1)
    e[down] = e[down][:, [2, 3, 0, 1]]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    at = e[:, 0] - slope * e[:, 1]
    y = np.unique(np.concatenate((e[:, 1], e[:, 3], _crossings(e, slope, at))))
    y = y[np.concatenate(([True], np.diff(y) > 1e-13))]
    out = []
    order = np.argsort(e[:, 1], kind="stable")
    begins = np.searchsorted(e[order, 1], (y[:-1] + y[1:]) / 2, "right")
    live, seen = np.zeros(0, np.int64), 0
    for lo, hi, upto in zip(y[:-1], y[1:], begins, strict=True):
        mid = (lo + hi) / 2
        live = np.concatenate((live[e[live, 3] > mid], order[seen:upto][e[order[seen:upto], 3] > mid]))
        seen = upto
        if len(live) < 2:
            continue
        x = at[live] + slope[live] * mid
        by_x = np.argsort(x, kind="stable")
        live, x = live[by_x], x[by_x]
        turns = np.zeros((len(sets), len(live)), np.int64)
        turns[own[live], np.arange(len(live))] = turn[live]
        # edges that lie on one another are passed together
        last = np.append(np.flatnonzero(np.diff(x) > 1e-12 * np.maximum(1.0, np.abs(x[1:]))), len(x) - 1)
        on = np.concatenate(([False], inside(np.cumsum(turns, axis=1))[last[np.searchsorted(last, np.arange(len(x)))]]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        if len(edge) >= 2:
            out.append((lo, hi, live[edge[0::2]][: len(edge) // 2], live[edge[1::2]]))
    return out, slope, at


#: What is inside of two polygons, each by the number of its rings that a point lies in (odd: inside).
RULES = {
    "and": lambda t: (t[0] % 2 == 1) & (t[1] % 2 == 1),
    "or": lambda t: (t[0] % 2 == 1) | (t[1] % 2 == 1),
    "minus": lambda t: (t[0] % 2 == 1) & (t[1] % 2 == 0),
    "xor": lambda t: (t[0] + t[1]) % 2 == 1,
}


def slabs(a: Rings, b: Rings, op: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boolean of two polygons as trapezoids (closed rings). op: and, or, minus, xor."""
    found, slope, at = _sweep([edges(a), edges(b)], RULES[op])
    out = []
    for lo, hi, left, right in found:
        x = np.array([at[left] + slope[left] * lo, at[right] + slope[right] * lo, at[right] + slope[right] * hi, at[left] + slope[left] * hi])
        for c in x[:, (x[1] - x[0] > 1e-13) | (x[2] - x[3] > 1e-13)].T:
            out.append((np.append(c, c[0]), np.array([lo, lo, hi, hi, lo])))
    return out


def stitch(starts: np.ndarray, ends: np.ndarray) -> Rings:
    """Rings from directed edges, whose corners agree: at a corner that several leave the sharpest left turn is taken, so that
    rings that touch there stay apart. Corners on a straight line are left out."""
    leave: dict[tuple, list[int]] = {}
    for k, s in enumerate(map(tuple, starts.tolist())):
        leave.setdefault(s, []).append(k)
    used, rings = np.zeros(len(starts), bool), []
    to = [tuple(x) for x in ends.tolist()]
    way = np.arctan2(*(ends - starts).T[::-1])
    for k in range(len(starts)):
        if used[k]:
            continue
        walk = []
        while not used[k]:
            used[k] = True
            walk.append(k)
            free = [j for j in leave.get(to[k], ()) if not used[j]]
            if not free:
                break
            k = max(free, key=lambda j, k=k: (way[j] - way[k] + np.pi) % (2 * np.pi)) if len(free) > 1 else free[0]
        p, bent = starts[walk], np.zeros(1, bool)
        while len(p) and not bent.all():  # again, as a spike that goes leaves its foot twice
            before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
            bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 1e-9 * np.hypot(*before.T) * np.hypot(*after.T)
            p = p[bent]
        if len(p) >= 3:
            rings.append((np.append(p[:, 0], p[0, 0]), np.append(p[:, 1], p[0, 1])))
    return rings


def _rings(found, slope: np.ndarray, at: np.ndarray) -> Rings:
    """Slabs as rings: sides stay, and of the horizontal edges those parts that only one of two slabs has. Outer rings run
    counter-clockwise, holes clockwise."""
    if not found:
        return []
    levels: dict[float, list[tuple[np.ndarray, int, int]]] = {}
    for k, (lo, hi, left, right) in enumerate(found):
        for y, kind in ((lo, 1), (hi, -1)):
            levels.setdefault(y, []).append((np.stack((at[left] + slope[left] * y, at[right] + slope[right] * y)), kind, k))
    # corners of one height that differ by rounding only are one corner
    at_height: dict[tuple[float, int], np.ndarray] = {}
    starts, ends = [], []
    for y, parts in levels.items():
        x = np.sort(np.concatenate([p.ravel() for p, _, _ in parts]))
        new = np.concatenate(([True], np.diff(x) > 1e-11 * max(1.0, abs(x[-1]), abs(x[0]))))
        place, kept = np.cumsum(new) - 1, x[new]
        cover = np.zeros(len(kept) + 1, np.int64)
        for p, kind, k in parts:
            i = place[np.searchsorted(x, p)]
            at_height[y, k] = kept[i]
            np.add.at(cover, i[0], kind)
            np.add.at(cover, i[1], -kind)
        cover = np.cumsum(cover)[:-1]
        for j in np.flatnonzero(cover):
            a, b = (kept[j], y), (kept[j + 1], y)
            starts.append(a if cover[j] > 0 else b)  # what lies above is walked to the right, what lies below to the left
            ends.append(b if cover[j] > 0 else a)
    for k, (lo, hi, _, _) in enumerate(found):
        low, high = at_height[lo, k], at_height[hi, k]
        for i in range(low.shape[1]):
            if low[0, i] == low[1, i] and high[0, i] == high[1, i]:
                continue
            starts += [(low[1, i], lo), (high[0, i], hi)]
            ends += [(high[1, i], hi), (low[0, i], lo)]
    return stitch(np.array(starts), np.array(ends))


def overlay(a: Rings, b: Rings, op: str) -> Rings:
    """Boolean of two polygons as rings. op: and, or, minus, xor. overlay(a, [], "or") mends rings that cross or touch themselves."""
    return _rings(*_sweep([edges(a), edges(b)], RULES[op]))


def ring_area(x: np.ndarray, y: np.ndarray) -> float:
    """Planar area of a closed ring, positive counter-clockwise."""
    return float(((x[:-1] - x[0]) * (y[1:] - y[0]) - (x[1:] - x[0]) * (y[:-1] - y[0])).sum() / 2)


def directed(rings: Rings) -> Rings:
    """Rings of a polygon whose rings don't cross, outer ones counter-clockwise, holes clockwise, whatever they were."""
    out = []
    for k, (x, y) in enumerate(rings):
        depth = sum(bool(contains([r], (x[:1] + x[1:2]) / 2, (y[:1] + y[1:2]) / 2)[0]) for j, r in enumerate(rings) if j != k)
        out.append((x, y) if (ring_area(x, y) > 0) == (depth % 2 == 0) else (x[::-1], y[::-1]))
    return out


def union_all(parts: list[Rings]) -> Rings:
    """Union of many polygons in one sweep: all that any of them winds round."""
    parts = [directed(p) for p in parts if p]
    return _rings(*_sweep([edges([r for p in parts for r in p])], lambda t: t[0] < 0)) if parts else []


def less(rings: Rings, masks: list[Rings]) -> Rings:
    """A polygon less all of some others, in one sweep."""
    mask = [r for m in masks for r in directed(m)]
    return _rings(*_sweep([edges(rings), edges(mask)], lambda t: (t[0] % 2 == 1) & (t[1] >= 0)))


def snapped(e: np.ndarray, same: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of edges, with corners closer than `same` made one; edges that become points are gone."""
    p = np.concatenate((e[:, :2], e[:, 2:]))
    by_x = np.argsort(p[:, 0], kind="stable")
    column = np.empty(len(p), np.int64)
    column[by_x] = np.cumsum(np.concatenate(([0], np.diff(p[by_x, 0]) > same)))
    order = np.lexsort((p[:, 1], column))
    new = np.concatenate(([True], (np.diff(column[order]) > 0) | (np.diff(p[order, 1]) > same)))
    q = np.empty_like(p)
    q[order] = p[order][new][np.cumsum(new) - 1]
    starts, ends = q[: len(e)], q[len(e) :]
    keep = np.any(starts != ends, axis=1)
    return starts[keep], ends[keep]


def offset(rings: Rings, d: float, steps: int = 16, corners: bool = False) -> Rings:
    """Directed rings moved out by d > 0 (in by -d): corners become arcs of `steps` pieces a quarter turn. What the moved rings
    wind round is the polygon and all within d of it; moved in, what all of d around lies in the polygon. With `corners`, those of
    a turn up to 120 degrees stay corners."""
    moved, sign = [], 1 if d > 0 else -1
    for x, y in rings:
        p = np.column_stack((x, y))[:-1]
        p = p[np.any(p != np.roll(p, 1, axis=0), axis=1)]
        if sign < 0:
            p = p[::-1]
        if len(p) < 3:
            continue
        way = np.roll(p, -1, axis=0) - p
        angle = np.arctan2(way[:, 1], way[:, 0])
        normal = angle - np.pi / 2  # to the right: outside of a counter-clockwise ring
        line = []
        for k in range(len(p)):
            turn = (angle[k] - angle[k - 1] + np.pi) % (2 * np.pi) - np.pi
            if corners and 0 < turn <= np.pi * 2 / 3:
                a = normal[k - 1] + turn / 2
                line.append(p[k : k + 1] + abs(d) / np.cos(turn / 2) * np.array([[np.cos(a), np.sin(a)]]))
            elif turn > 0:
                n = max(1, int(np.ceil(turn / (np.pi / 2 / steps) - 1e-9)))
                a = normal[k - 1] + turn * np.arange(n + 1) / n
                line.append(p[k] + abs(d) * np.column_stack((np.cos(a), np.sin(a))))
            else:  # by way of the corner itself, so that the loop winds round nothing twice
                line.append(np.array([p[k] + abs(d) * np.array([np.cos(normal[k - 1]), np.sin(normal[k - 1])]), p[k], p[k] + abs(d) * np.array([np.cos(normal[k]), np.sin(normal[k])])]))
        q = np.concatenate(line)
        moved.append((np.append(q[:, 0], q[0, 0]), np.append(q[:, 1], q[0, 1])))
    return _rings(*_sweep([edges(moved)], (lambda t: t[0] < 0) if sign > 0 else (lambda t: t[0] > 0))) if moved else []


def close_gaps(rings: Rings, d: float) -> Rings:
    """Directed rings moved out by d and in again: gaps and inlets narrower than 2d close, straight sides and outer corners stay."""
    return offset(offset(rings, d, corners=True), -d, corners=True)


def rings_km2(rings: Rings) -> float:
    """Area on the sphere of directed rings, as overlay and the like return them."""
    return abs(sum(spherical_km2(*r) for r in rings))


def area_km2(rings: Rings) -> float:
    """Area of a polygon on the sphere."""
    return rings_km2(rings if len(rings) == 1 else directed(rings))


def clip_many(x: np.ndarray, y: np.ndarray, n: np.ndarray, cx: np.ndarray, cy: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many rings (rows, the first n corners of each; open) within as many convex counter-clockwise rings (m corners), half plane by
    half plane for all rows at once. Bridges of a concave ring enclose no area."""
    rows = np.arange(len(x))
    for k in range(cx.shape[1]):
        after = np.where(k + 1 < m, k + 1, 0)
        x1, y1, x2, y2 = (v[:, None] for v in (cx[:, k], cy[:, k], cx[rows, after], cy[rows, after]))
        place = np.arange(x.shape[1])
        there = place < n[:, None]
        side = np.where((k < m)[:, None], (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), 0.0)
        if (side >= 0)[there].all():
            continue
        ahead = np.where(place + 1 < n[:, None], place + 1, 0)
        nx, ny, ns = (np.take_along_axis(v, ahead, 1) for v in (x, y, side))
        cross = there & ((side >= 0) != (ns >= 0))
        t = np.divide(side, side - ns, out=np.zeros_like(side), where=cross)
        both = [np.stack(v, axis=2).reshape(len(x), -1) for v in ((x, x + t * (nx - x)), (y, y + t * (ny - y)), (there & (side >= 0), cross))]
        n = both[2].sum(1)
        order = np.argsort(~both[2], axis=1, kind="stable")[:, : max(1, int(n.max(initial=0)))]
        x, y = (np.take_along_axis(v, order, 1) for v in both[:2])
    return x, y, n


def _padded(rings: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings as rows of corners, without the last."""
    n = np.array([len(x) - 1 for x, _ in rings])
    out = np.zeros((2, len(rings), max(1, int(n.max(initial=0)))))
    for i, r in enumerate(rings):
        out[:, i, : n[i]] = np.array(r)[:, :-1]
    return out[0], out[1], n


#: Rings that are clipped at once.
LOT = 2048


def overlaps_km2(a: list[Rings], b: list[Rings]) -> np.ndarray:
    """Areas of the intersections of pairs of polygons on the sphere: all pairs with a convex side by clipping together, the few
    others by overlay. Rings of the other side count by how many of its rings they lie in."""
    known: dict[int, tuple[bool, list[int]]] = {}

    def about(g: Rings) -> tuple[bool, list[int]]:
        if id(g) not in known:
            depth = [sum(bool(contains([q], (r[0][:1] + r[0][1:2]) / 2, (r[1][:1] + r[1][1:2]) / 2)[0]) for q in g if q is not r) for r in g] if len(g) > 1 else [0] * len(g)
            known[id(g)] = _convex(g), [(-1) ** d for d in depth]
        return known[id(g)]

    out, rows = np.zeros(len(a)), []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        sides = [(s, c) for s, c in ((p, q), (q, p)) if about(c)[0]]
        if sides:
            s, c = min(sides, key=lambda v: len(v[1][0][0]))
            x, y = c[0]
            rows += [(i, r, sign, (x, y) if ring_area(x, y) > 0 else (x[::-1], y[::-1])) for r, sign in zip(s, about(s)[1], strict=True) if len(r[0]) > 3]
        else:
            out[i] = rings_km2(overlay(p, q, "and"))
    rows.sort(key=lambda v: (len(v[3][0]), len(v[1][0])))
    for k in range(0, len(rows), LOT):
        some = rows[k : k + LOT]
        x, y, n = clip_many(*_padded([v[1] for v in some]), *_padded([v[3] for v in some]))
        place = np.arange(x.shape[1])
        ahead = np.where(place + 1 < n[:, None], place + 1, 0)
        s = np.sin(np.radians(y))
        part = np.radians(np.take_along_axis(x, ahead, 1) - x) * (s + np.take_along_axis(s, ahead, 1)) / 2
        km2 = np.abs(np.where(place < n[:, None], part, 0).sum(1)) * RADIUS_KM**2
        np.add.at(out, [v[0] for v in some], km2 * [v[2] for v in some])
    return out


def _all_pairs(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair k, every i < na[k] with every j < nb[k]: k, i, j."""
    total = na * nb
    k = np.repeat(np.arange(len(na)), total)
    at = np.arange(len(k)) - np.repeat(np.cumsum(total) - total, total)
    return k, at // np.maximum(nb[k], 1), at % np.maximum(nb[k], 1)


def meet_many(a: list[Rings], b: list[Rings]) -> np.ndarray:
    """Whether the polygons of pairs share a point: edges that cross or touch, or one within the other. All edges of a lot of pairs
    are compared together."""
    once: dict[int, np.ndarray] = {}
    of = lambda g: once.setdefault(id(g), edges(g)) if id(g) not in once else once[id(g)]
    ea, eb = [of(g) for g in a], [of(g) for g in b]
    na, nb = np.array([len(e) for e in ea]), np.array([len(e) for e in eb])
    out, lot = np.zeros(len(a), bool), np.cumsum(na * nb) // 1_000_000
    for _, rows in pd.Series(lot).groupby(lot).indices.items():
        fa, fb = np.cumsum(na[rows]) - na[rows], np.cumsum(nb[rows]) - nb[rows]
        va, vb = np.concatenate([ea[i] for i in rows] + [np.zeros((0, 4))]), np.concatenate([eb[i] for i in rows] + [np.zeros((0, 4))])
        k, i, j = _all_pairs(na[rows], nb[rows])
        x1, y1, x2, y2 = va[fa[k] + i].T
        x3, y3, x4, y4 = vb[fb[k] + j].T
        near = (np.maximum(x1, x2) >= np.minimum(x3, x4)) & (np.maximum(x3, x4) >= np.minimum(x1, x2)) & (np.maximum(y1, y2) >= np.minimum(y3, y4)) & (np.maximum(y3, y4) >= np.minimum(y1, y2))
        k, (x1, y1, x2, y2, x3, y3, x4, y4) = k[near], (v[near] for v in (x1, y1, x2, y2, x3, y3, x4, y4))
        side = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
        hit = (side(x3, y3, x4, y4, x1, y1) * side(x3, y3, x4, y4, x2, y2) <= 0) & (side(x1, y1, x2, y2, x3, y3) * side(x1, y1, x2, y2, x4, y4) <= 0)
        out[rows[k[hit]]] = True
    for i in np.flatnonzero(~out & (na > 0) & (nb > 0)):
        out[i] = contains(a[i], eb[i][:1, 0], eb[i][:1, 1])[0] or contains(b[i], ea[i][:1, 0], ea[i][:1, 1])[0]
    return out


EARTH_KM = 6371.0088  # of distances


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def nearest(lat: np.ndarray, lng: np.ndarray, km: np.ndarray, plat: np.ndarray, plon: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each centre its points within km that are no farther than 1 mm beyond its k-th nearest: places of centres, of points, and km."""
    order = np.argsort(plat, kind="stable")
    sx, sy = plon[order], plat[order]
    dy = np.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    first, upto = np.searchsorted(sy, lat - dy, "left"), np.searchsorted(sy, lat + dy, "right")
    dx = np.degrees(np.arcsin(np.minimum(1.0, np.sin(np.radians(dy)) / np.cos(np.radians(lat))))) * (1 + 1e-9) + 1e-9
    at, places, far = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for i in range(len(lat)):
        near = first[i] + np.flatnonzero(np.abs(sx[first[i] : upto[i]] - lng[i]) <= dx[i])
        d = _km(lat[i], lng[i], sy[near], sx[near])
        most = km[i] if len(d) <= k else min(km[i], np.partition(d, k - 1)[k - 1] + 1e-6)
        some = d <= most
        places.append(near[some])
        far.append(d[some])
        at.append(np.full(len(far[-1]), i))
    return np.concatenate(at), order[np.concatenate(places)], np.concatenate(far)


def counts_within(lat: np.ndarray, lng: np.ndarray, km: np.ndarray, plat: np.ndarray, plon: np.ndarray, code: np.ndarray, kinds: int) -> np.ndarray:
    """A row a centre, a column a kind (code): the points within km. Points are sorted by strip of latitude and longitude; what a circle holds
    of a strip for certain is counted by places in that order, what its rim may pass (by 1e-9 degrees more) is measured."""
    out = np.zeros((len(lat), kinds), np.int64)
    if not len(lat) or not len(plat):
        return out
    south, west = plat.min(), plon.min()
    high, wide = plat.max() - south, plon.max() - west
    size, width = max(1.5 * np.sqrt(high * wide / len(plat)), high / 4096, 1e-9), 2 * wide + 1e-5
    strip = np.floor((plat - south) / size).astype(np.int64)
    order = np.lexsort((plon, strip))
    plat, plon, code, key = plat[order], plon[order], code[order], (strip * width + (plon - west))[order]
    upto = [np.concatenate(([0], np.cumsum(code == c))) for c in range(kinds)]
    dy = np.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    first = np.clip(np.floor((lat - dy - south) / size), 0, strip.max() + 1).astype(np.int64)
    n = np.maximum(0, np.clip(np.floor((lat + dy - south) / size), -1, strip.max()).astype(np.int64) - first + 1)
    for rows in np.split(np.arange(len(lat)), np.flatnonzero(np.diff(np.cumsum(n) // 200_000)) + 1):
        i = np.repeat(rows, n[rows])
        if not len(i):
            continue
        j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        low, top = south + j * size - 1e-9, south + (j + 1) * size + 1e-9
        y = lat[i]
        near, far = np.maximum(0.0, np.maximum(low - y, y - top)), np.maximum(np.abs(low - y), np.abs(top - y))
        part = lambda d: np.sin(np.radians(d) / 2) ** 2
        a, b = np.cos(np.radians(low)), np.cos(np.radians(top))
        widest = np.where((low < 0) & (top > 0), 1.0, np.maximum(a, b))
        half = lambda rest, c: 2 * np.degrees(np.arcsin(np.sqrt(np.clip(rest / np.maximum(1e-300, np.cos(np.radians(y)) * c), 0, 1))))
        whole = part(np.degrees(km[i] / EARTH_KM))
        outer, inner = half(whole - part(near), np.minimum(a, b)) * (1 + 1e-9) + 1e-9, half(whole - part(far), widest) * (1 - 1e-9) - 1e-9
        place = lambda v, side: np.searchsorted(key, j * width + np.clip(v - west, -2e-6, wide + 2e-6), side)
        start, end = place(lng[i] - outer, "left"), place(lng[i] + outer, "right")
        some = inner > 0
        begin, close = np.where(some, place(lng[i] - inner, "left"), end), np.where(some, place(lng[i] + inner, "right"), end)
        for c in range(kinds):
            out[:, c] += np.bincount(i, upto[c][close] - upto[c][begin], len(lat)).astype(np.int64)
        begins, lens, who = np.concatenate((start, close)), np.concatenate((begin - start, end - close)), np.concatenate((i, i))
        for lot in np.split(np.arange(len(who)), np.flatnonzero(np.diff(np.cumsum(lens) // 2_000_000)) + 1):
            k, w = lens[lot], np.repeat(who[lot], lens[lot])
            at = np.repeat(begins[lot] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            hit = _km(lat[w], lng[w], plat[at], plon[at]) <= km[w]
            out += np.bincount(w[hit] * kinds + code[at[hit]], minlength=out.size).reshape(out.shape)
    return out


def simplify(x: np.ndarray, y: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-point simplification of a line or closed ring: points stay that stand off a chord by more than the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        n = np.hypot(dx, dy)
        off = np.abs(px * dy - py * dx) / n if n else np.hypot(px, py)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return x[keep], y[keep]


def smooth(x: np.ndarray, y: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Corner cutting on a closed ring: each edge gives the points at a quarter and at three quarters."""
    x, y = x[:-1], y[:-1]
    if len(x) < 3:
        return np.append(x, x[:1]), np.append(y, y[:1])
    for _ in range(iterations):
        x, y = (np.column_stack((0.75 * v + 0.25 * np.roll(v, -1), 0.25 * v + 0.75 * np.roll(v, -1))).ravel() for v in (x, y))
    return np.append(x, x[0]), np.append(y, y[0])


def matching_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * matches / total length of pairs of texts, by matching blocks: the longest common stretch (the first in a, then in b), then
    the same to its left and to its right. All open parts of all pairs are searched together, round by round."""
    size = np.array([len(x) for x in (*a, *b)]).reshape(2, -1)
    chars = [np.zeros((len(a), max(1, int(n.max(initial=0)))), np.int32) for n in size]
    for some, texts, blank in ((chars[0], a, -1), (chars[1], b, -2)):
        some[:] = blank
        for i, t in enumerate(texts):
            some[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    pair = np.flatnonzero((size > 0).all(0))
    part = np.stack((0 * pair, size[0, pair], 0 * pair, size[1, pair]))
    total = np.zeros(len(a), np.int64)
    while len(pair):
        x, y = chars[0][pair], chars[1][pair]
        place = np.arange(y.shape[1])
        open_ = (place >= part[2][:, None]) & (place < part[3][:, None])
        run, best, end = np.zeros((len(pair), y.shape[1] + 1), np.int32), np.zeros(len(pair), np.int32), np.zeros((2, len(pair)), np.int64)
        for i in range(int(part[0].min()), int(part[1].max())):
            same = (x[:, i : i + 1] == y) & open_ & ((i >= part[0]) & (i < part[1]))[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            j = run[:, 1:].argmax(1)
            longest = run[np.arange(len(pair)), j + 1]
            more = longest > best
            best[more], end[0, more], end[1, more] = longest[more], i + 1, j[more] + 1
        np.add.at(total, pair, best)
        left = np.stack((part[0], end[0] - best, part[2], end[1] - best))
        right = np.stack((end[0], part[1], end[1], part[3]))
        pair, part = np.concatenate((pair, pair)), np.concatenate((left, right), axis=1)
        go = (np.concatenate((best, best)) > 0) & (part[0] < part[1]) & (part[2] < part[3])
        pair, part = pair[go], part[:, go]
    return 2 * total / np.maximum(size.sum(0), 1)


#: Pairs of circles that are held at once.
CIRCLES_AT_ONCE = 1 << 20


def open_arcs(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, first, last: the arcs of the circle of radius r around point i, angles from 0 to two pi, that no disc around another place
    covers. Neighbours lie in three rows of cells as wide as 2r, a stretch of each; what is covered so far is a running maximum of ends."""
    turn, cell = 2 * np.pi, 2 * r * (1 + 1e-9)
    row, col = np.floor(qy / cell), np.floor(qx / cell)
    west, south = (col.min(), row.min()) if len(qx) else (0.0, 0.0)
    wide = (col.max() - west if len(qx) else 0.0) + 4  # a free column at either end keeps rows apart
    code = (row - south) * wide + (col - west + 1)
    order = np.argsort(code, kind="stable")
    code, qx, qy = code[order], qx[order], qy[order]
    px, py = np.clip(np.floor(x / cell) - west + 1, -1, wide - 1), np.floor(y / cell) - south
    at = py[:, None] * wide + px[:, None] + np.array([-1.0, 0.0, 1.0]) * wide
    begin, end = np.searchsorted(code, at - 1, "left"), np.searchsorted(code, at + 1, "right")
    n = (end - begin).sum(1)
    upto, found, a = np.cumsum(n), [], 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CIRCLES_AT_ONCE, "right")))
        k = (end - begin)[a:b].ravel()
        j = np.repeat(begin[a:b].ravel() - np.cumsum(k) + k, k) + np.arange(k.sum())
        i = np.repeat(np.arange(a, b), n[a:b])
        dx, dy = qx[j] - x[i], qy[j] - y[i]
        apart = np.hypot(dx, dy)
        some = (apart > 0) & (apart < 2 * r)
        i, dx, dy, apart = i[some], dx[some], dy[some], apart[some]
        half = np.arccos(apart / (2 * r))
        s = np.mod(np.arctan2(dy, dx) - half, turn)
        e = s + 2 * half
        over, own = e > turn, np.arange(a, b)
        # an arc over the turn's end is two; the turn's end itself is there for all
        i = np.concatenate((i, i[over], own))
        s = np.concatenate((s, np.zeros(over.sum()), np.full(b - a, turn)))
        e = np.concatenate((np.minimum(e, turn), e[over] - turn, np.full(b - a, turn)))
        order = np.lexsort((e, s, i))
        i, s, e = i[order], s[order], e[order]
        by_end = np.argsort(e, kind="stable")
        rank = np.empty(len(e), np.int64)
        rank[by_end] = np.arange(len(e))
        top = e[by_end[np.maximum.accumulate((i - a) * len(e) + rank) % len(e)]]
        first = np.where(np.diff(i, prepend=-1) != 0, 0.0, np.concatenate(([0.0], top[:-1])))
        free = s - first > 1e-9
        found.append((i[free], first[free], s[free]))
        a = b
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def edges_in_boxes(e: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """What each edge (rows xa, ya, xb, yb of directed rings) adds to the area on the sphere that its ring encloses of a box: the strip
    between the edge, held within the box's heights, and the box's lower side."""
    xa, ya, xb, yb = np.moveaxis(e, -1, 0)
    left, right = np.minimum(xa, xb), np.maximum(xa, xb)
    left, right = np.maximum(left, x1), np.minimum(right, x2)
    rise = np.divide(yb - ya, xb - xa, out=np.zeros(np.broadcast_shapes(xa.shape)), where=xa != xb)
    run = np.divide(xb - xa, yb - ya, out=np.zeros_like(rise), where=ya != yb)
    right = np.maximum(left, right)
    ends = [np.where(ya == yb, left, np.clip(xa + (y - ya) * run, left, right)) for y in (y1, y2)]
    at = (left, np.minimum(*ends), np.maximum(*ends), right)
    low = np.sin(np.radians(y1))
    held = [np.sin(np.radians(np.clip(ya + (x - xa) * rise, y1, y2))) - low for x in at]
    area = sum((at[k + 1] - at[k]) * (held[k] + held[k + 1]) for k in range(3))
    return np.where(xb > xa, -1, 1) * np.radians(area) / 2 * RADIUS_KM**2


def overlaps_in_block(zones: np.ndarray, layer: np.ndarray, zone_rings: list[Rings | None], layer_rings: list[Rings | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """zones, layer (rows x1, y1, x2, y2), rings where a polygon is no rectangle -> i, j, km2, share of j for all pairs whose boxes meet.

    A polygon within a zone's rectangle counts whole; a polygon and a rectangle are measured edge by edge, two other polygons by clipping."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    if not len(zones) or not len(layer):
        return none
    rad = np.radians
    box_km2 = lambda x1, y1, x2, y2: rad(x2 - x1) * (np.sin(rad(y2)) - np.sin(rad(y1))) * RADIUS_KM**2
    order = np.argsort(layer[:, 1], kind="stable")
    layer, layer_rings = layer[order], [layer_rings[k] for k in order]
    shaped = np.array([r is not None for r in layer_rings])
    whole = box_km2(*layer.T)
    whole[shaped] = [area_km2(r) for r in layer_rings if r is not None]
    steep = lambda r: (lambda e: e[e[:, 0] != e[:, 2]])(edges(directed(r)))  # noqa: E731  edges that go up or down enclose nothing
    own = [steep(r) if r is not None else np.zeros((0, 4)) for r in layer_rings]
    upto = np.concatenate(([0], np.cumsum([len(e) for e in own])))
    all_edges = np.concatenate(own)
    x1, y1, x2, y2 = layer.T
    tall = (y2 - y1).max()
    first, last = np.searchsorted(y1, zones[:, 1] - tall - 1e-9, "left"), np.searchsorted(y1, zones[:, 3], "right")
    out = []
    for i, (zx1, zy1, zx2, zy2) in enumerate(zones.tolist()):
        part = slice(first[i], last[i])
        hit = first[i] + np.flatnonzero((x1[part] <= zx2) & (x2[part] >= zx1) & (y2[part] >= zy1))
        if not len(hit):
            continue
        km2, rings = np.zeros(len(hit)), zone_rings[i]
        odd = shaped[hit]
        if rings is None:
            within = (x1[hit] >= zx1) & (x2[hit] <= zx2) & (y1[hit] >= zy1) & (y2[hit] <= zy2)
            km2[within] = whole[hit[within]]
            some = ~within & ~odd
            b = layer[hit[some]]
            wide, high = np.minimum(b[:, 2], zx2) - np.maximum(b[:, 0], zx1), np.sin(rad(np.minimum(b[:, 3], zy2))) - np.sin(rad(np.maximum(b[:, 1], zy1)))
            km2[some] = rad(wide) * high * RADIUS_KM**2
            some = np.flatnonzero(~within & odd)
            n = upto[hit[some] + 1] - upto[hit[some]]
            at = np.repeat(upto[hit[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            km2[some] = np.abs(np.bincount(np.repeat(np.arange(len(some)), n), edges_in_boxes(all_edges[at], zx1, zy1, zx2, zy2), len(some)))
        else:
            e, flat = steep(rings), hit[~odd]
            rows = max(1, 1_000_000 // max(1, len(e)))
            parts = [edges_in_boxes(e[None], *(v[flat[k : k + rows], None] for v in (x1, y1, x2, y2))).sum(1) for k in range(0, len(flat), rows)]
            km2[~odd] = np.abs(np.concatenate(parts)) if parts else 0.0
            if odd.any():
                km2[odd] = overlaps_km2([rings] * int(odd.sum()), [layer_rings[k] for k in hit[odd]])
        out.append((np.full(len(hit), i), hit, km2))
    if not out:
        return none
    i, j, km2 = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, order[j], km2, np.minimum(1.0, np.divide(km2, whole[j], out=np.zeros_like(km2), where=whole[j] > 0))
