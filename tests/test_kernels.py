from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessella.operators import kernels as K


def box(x1, y1, x2, y2):
    return [(np.array([x1, x2, x2, x1, x1], float), np.array([y1, y1, y2, y2, y1], float))]


def star(seed, n=9, cx=0.0, cy=0.0):
    r = np.random.default_rng(seed)
    a = np.sort(r.uniform(0, 2 * np.pi, n))
    d = r.uniform(0.2, 1.0, n)
    x, y = cx + d * np.cos(a), cy + d * np.sin(a)
    return [(np.append(x, x[0]), np.append(y, y[0]))]


def area(rings):
    return sum(abs(((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2) for x, y in rings)


def test_rectangles():
    a, b = box(0, 0, 2, 2), box(1, 1, 3, 4)
    for op, want in (("and", 1), ("or", 9), ("minus", 3), ("xor", 8)):
        assert abs(area(K.slabs(a, b, op)) - want) < 1e-9
    assert K.meet_many([a, a, a, a], [b, box(5, 5, 6, 6), box(0.5, 0.5, 1, 1), box(2, 2, 3, 3)]).tolist() == [True, False, True, True]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_overlay_adds_up(s, t):
    a, b = star(s), star(t, cx=0.3)
    both, less = area(K.slabs(a, b, "and")), area(K.slabs(a, b, "minus"))
    whole = area(K.slabs(a, [], "or"))
    assert abs(both + less - whole) < 1e-7
    r = np.random.default_rng(1)
    x, y = r.uniform(-1, 1, 4000), r.uniform(-1, 1, 4000)
    assert abs((K.contains(a, x, y) & K.contains(b, x, y)).mean() * 4 - both) < 0.15


def signed(rings):
    return sum(K.ring_area(*r) for r in rings)


def circle(cx, cy, r, n=96):
    t = -2 * np.pi * np.arange(n + 1) / n
    return [(cx + r * np.cos(t), cy + r * np.sin(t))]


def simple(rings):
    return len(K.overlay(rings, [], "or")) == 1 and abs(signed(K.overlay(rings, [], "or")) - abs(signed(rings))) < 1e-12


def test_clips_of_a_batch_equal_overlays():
    """All kinds of pairs at once: convex with concave, both concave, with a hole, far away, circles."""
    a, b = [], []
    for s in range(25):
        for p, q in ((star(s), circle(0.2, 0.1, 0.5)), (circle(0.1 * s % 1, 0.2, 0.4, 12), box(0, 0, 0.5, 0.7)), (star(s), box(-0.2, -0.2, 0.5, 0.7)), (star(s), star(s + 500)), (box(-1, -1, 1, 1) + box(-0.5, -0.5, 0.5, 0.5), circle(0.3, 0.3, 0.6, 24)), (box(5, 5, 6, 6), circle(0.3, 0.3, 0.6))):
            a.append([(x * 0.01, y * 0.01) for x, y in p])
            b.append([(x * 0.01, y * 0.01) for x, y in q])
    want = np.array([sum(abs(K.spherical_km2(*r)) for r in K.slabs(p, q, "and")) for p, q in zip(a, b, strict=True)])
    assert np.allclose(K.overlaps_km2(a, b), want, rtol=1e-7, atol=1e-10)
    meet = K.meet_many(a, b)
    assert meet[want > 1e-9].all() and not meet[5::6].any()
    assert K.overlaps_km2([], []).tolist() == [] and K.meet_many([], []).tolist() == []


@pytest.mark.parametrize("op", sorted(K.RULES))
def test_rings_of_overlays(op):
    """The rings enclose what the trapezoids fill, holes counted off, and have no corner on a straight line."""
    for s in range(40):
        a, b = star(s), star(s + 1000, cx=0.3)
        rings = K.overlay(a, b, op)
        assert abs(signed(rings) - area(K.slabs(a, b, op))) < 1e-9
    assert [len(x) for x, _ in K.overlay(box(0, 0, 2, 2), box(1, 1, 3, 4), "or")] == [9]
    holed = K.overlay(box(0, 0, 3, 3), box(1, 1, 2, 2), "minus")
    assert [(len(x), round(K.ring_area(x, y), 9)) for x, y in holed] == [(5, 9), (5, -1)]


def test_union_of_tiles_is_their_outline():
    tiles = [box(i * 0.1, j * 0.1, (i + 1) * 0.1, (j + 1) * 0.1) for i in range(6) for j in range(6) if (i, j) != (2, 3)]
    assert sorted((len(x), round(K.ring_area(x, y), 9)) for x, y in K.union_all(tiles)) == [(5, -0.01), (5, 0.36)]
    many = [star(s, 12, s % 5 * 0.4, s // 5 * 0.4) for s in range(25)]
    many = [m for m in many if simple(m)]
    r = np.random.default_rng(0)
    x, y = r.uniform(-1, 2.6, 3000), r.uniform(-1, 2.6, 3000)
    assert (K.contains(K.union_all(many), x, y) == np.any([K.contains(m, x, y) for m in many], axis=0)).all()


def test_repair():
    bow = [(np.array([0, 1, 1, 0, 0.0]), np.array([0, 1, 0, 1, 0.0]))]
    assert sorted(round(K.ring_area(*r), 9) for r in K.overlay(bow, [], "or")) == [0.25, 0.25]
    touching = [(np.array([0, 3, 3, 0, 0, 1, 2, 1, 0.0, 0]), np.array([0, 0, 3, 3, 1.5, 2, 1.5, 1, 1.5, 0]))]  # a hole hung on one corner
    mended = K.overlay(touching, [], "or")
    assert abs(signed(mended) - 8) < 1e-9 and all(len(K.overlay([r], [], "or")) == 1 for r in mended)


def test_less_several():
    left = K.less(box(0, 0, 4, 1), [box(0.5, -1, 1, 2), box(2, 0.2, 2.5, 0.4), box(0.8, 0, 1.5, 1)])
    assert abs(signed(left) - (4 - 1 - 0.1)) < 1e-9 and len(left) == 3


def test_offset_is_the_set_of_near_places():
    r = np.random.default_rng(0)
    x, y = r.uniform(-1.2, 1.2, 2000), r.uniform(-1.2, 1.2, 2000)
    for s in range(20):
        a = K.directed(star(s))
        if not simple(a):
            continue
        e = K.edges(a)
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        t = np.clip(((x[:, None] - e[:, 0]) * dx + (y[:, None] - e[:, 1]) * dy) / (dx * dx + dy * dy), 0, 1)
        away = np.hypot(x[:, None] - e[:, 0] - t * dx, y[:, None] - e[:, 1] - t * dy).min(1)
        inside = K.contains(a, x, y)
        for d, want in ((0.15, inside | (away < 0.15)), (-0.05, inside & (away > 0.05))):
            got = K.offset(a, d, 32)
            wrong = (K.contains(got, x, y) if got else np.zeros(len(x), bool)) != want
            assert not (wrong & (abs(away - abs(d)) > 2e-3)).any()


def test_gaps_close_and_shapes_stay():
    narrow, wide = [*box(0, 0, 1, 1), *box(1.15, 0, 2, 1)], [*box(0, 0, 1, 1), *box(1.25, 0, 2, 1)]
    assert [(len(x), round(K.ring_area(x, y), 9)) for x, y in K.close_gaps(narrow, 0.1)] == [(5, 2)]
    assert sorted((len(x), round(K.ring_area(x, y), 9)) for x, y in K.close_gaps(wide, 0.1)) == [(5, 0.75), (5, 1)]
    slit = K.overlay(box(0, 0, 3, 3), box(1.45, 1, 1.55, 2), "minus")
    assert [(len(x), round(K.ring_area(x, y), 9)) for x, y in K.close_gaps(slit, 0.1)] == [(5, 9)]


def test_cells_of_polygons():
    r = np.random.default_rng(1)
    for s in range(20):
        g, size = (star(s), 0.11) if s % 2 else (box(-1, -1, 1, 0.33) + box(-0.5, -0.5, 0.5, 0.25), 0.17)
        passed, whole = (set(map(tuple, c.tolist())) for c in K.cells_of(g, size))
        x, y = r.uniform(-1.1, 1.1, 3000), r.uniform(-1.1, 1.1, 3000)
        assert not passed & whole
        for px, py, inside in zip(x, y, K.contains(g, x, y), strict=True):
            c = (int(np.floor(px / size)), int(np.floor(py / size)))
            assert c in passed or (c in whole) == inside


def test_representative_point_is_inside():
    for s in range(30):
        g = star(s)
        x, y = K.representative_point(g)
        assert K.contains(g, np.array([x]), np.array([y]))[0]


def test_lines():
    x, y = K.smooth(*box(0, 0, 1, 1)[0], 1)
    assert len(x) == 9 and x[0] == x[-1]
    x, y = K.simplify(np.array([0, 1, 2, 3.0]), np.array([0, 0.001, 0, 1.0]), 0.01)
    assert list(x) == [0, 2, 3]


def test_union():
    parts = [box(i, 0, i + 1, 1) for i in range(5)] + [box(0, 0, 2, 1)]
    assert abs(area(K.union_all(parts)) - 5) < 1e-9
    assert K.union_all([]) == []


def test_matching_ratios():
    """Against the standard library's matcher."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("ABCAÑ 1"), int(r.integers(0, 25))))
    pairs = [(word(), word()) for _ in range(400)] + [("LOMAS ALTAS", "LOMAS ALTAZ"), ("", ""), ("A", ""), ("", "B"), ("SAN JOSE DEL ARENAL", "ARENAL SAN JOSE")]
    got = K.matching_ratios(*map(list, zip(*pairs, strict=True)))
    want = [SequenceMatcher(None, a, b).ratio() if a or b else 0 for a, b in pairs]
    assert np.allclose(got, want, atol=1e-12) and not len(K.matching_ratios([], []))
