"""Polygons as columns: struct(xmin, ymin, xmax, ymax, rings array of struct(part, hole, xs, ys)), in degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GEOMETRY = "struct<xmin:double,ymin:double,xmax:double,ymax:double,rings:array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>>"
AREA_RADIUS_KM = 6378.137
DISTANCE_RADIUS_KM = 6371.0088


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geometry_of(rings: Column) -> Column:
    """A geometry from rings, with its box. Fails on coordinates that are not finite."""
    return let(rings, _geometry_of)


def _geometry_of(rings: Column) -> Column:
    xs, ys = F.flatten(F.transform(rings, lambda r: r["xs"])), F.flatten(F.transform(rings, lambda r: r["ys"]))
    whole = F.forall(F.concat(xs, ys), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    checked = F.when(whole, rings).otherwise(F.raise_error(F.lit("a coordinate is not finite")).cast("array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>"))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"), checked.alias("rings"))


def bbox(geom: Column) -> Column:
    return F.struct(*[geom[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    ring = F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), F.array(x1, x2, x2, x1, x1).alias("xs"), F.array(y1, y1, y2, y2, y1).alias("ys"))
    return F.struct(x1.alias("xmin"), y1.alias("ymin"), x2.alias("xmax"), y2.alias("ymax"), F.array(ring).alias("rings"))


def circle_ring(lat: Column, lon: Column, km: Column, steps: int = 96) -> Column:
    """A ring of `steps` points at a distance on the sphere, closed, as a geometry."""
    phi, d = F.radians(lat), km / DISTANCE_RADIUS_KM
    bearing = lambda i: i * (-2 * 3.141592653589793 / steps)
    y = lambda i: F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(bearing(i)))
    x = lambda i, v: F.radians(lon) + F.atan2(F.sin(bearing(i)) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(v))
    at = F.concat(F.sequence(F.lit(0), F.lit(steps - 1)), F.array(F.lit(0)))
    ring = lambda ys: F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), F.zip_with(at, ys, lambda i, v: F.degrees(x(i, v))).alias("xs"), F.transform(ys, F.degrees).alias("ys"))
    return geometry_of(F.array(let(F.transform(at, y), ring)))


def _ring_sum(ring: Column, term) -> Column:
    n = F.size(ring["xs"])
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    point = lambda i: (F.element_at(ring["xs"], i), F.element_at(ring["ys"], i))
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + term(*point(i), *point(i + 1)))


def spherical_area_km2(geom: Column) -> Column:
    """Outer rings less holes, on the sphere of the equator's radius."""
    return let(geom, _spherical_area_km2)


def _spherical_area_km2(geom: Column) -> Column:
    part = lambda r: F.abs(_ring_sum(r, lambda x1, y1, x2, y2: F.radians(x2 - x1) * (F.sin(F.radians(y1)) + F.sin(F.radians(y2))))) / 2
    return F.aggregate(geom["rings"], F.lit(0.0), lambda s, r: s + F.when(r["hole"], -part(r)).otherwise(part(r))) * (AREA_RADIUS_KM**2)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a ring; clockwise is positive."""
    return _ring_sum(ring, lambda x1, y1, x2, y2: x2 * y1 - x1 * y2) / 2


def orient_rings(geom: Column) -> Column:
    """Closed rings, outer ones clockwise and holes counter-clockwise; null without rings (points have none)."""

    def one(r: Column) -> Column:
        open_ = (F.element_at(r["xs"], 1) != F.element_at(r["xs"], -1)) | (F.element_at(r["ys"], 1) != F.element_at(r["ys"], -1))
        close = lambda a: F.when(open_, F.concat(a, F.slice(a, 1, 1))).otherwise(a)
        closed = F.struct(r["part"].alias("part"), r["hole"].alias("hole"), close(r["xs"]).alias("xs"), close(r["ys"]).alias("ys"))
        turned = F.struct(r["part"].alias("part"), r["hole"].alias("hole"), F.reverse(close(r["xs"])).alias("xs"), F.reverse(close(r["ys"])).alias("ys"))
        return F.when((signed_area(closed) > 0) == r["hole"], turned).otherwise(closed)

    return let(geom, lambda g: F.when(F.size(g["rings"]) > 0, geometry_of(F.transform(g["rings"], one))))


def area_m2(geom: Column, project) -> Column:
    """Planar area after a projection (lon, lat) -> struct(x, y)."""

    def part(r: Column) -> Column:
        p = F.arrays_zip(r["xs"], r["ys"])
        ring = lambda q: F.struct(F.transform(q, lambda v: v["x"]).alias("xs"), F.transform(q, lambda v: v["y"]).alias("ys"))
        return F.abs(let(F.transform(p, lambda v: project(v["xs"], v["ys"])), lambda q: let(ring(q), signed_area)))

    return F.aggregate(geom["rings"], F.lit(0.0), lambda s, r: s + F.when(r["hole"], -part(r)).otherwise(part(r)))


def reproject(geom: Column, project) -> Column:
    """The geometry with each corner (x, y) moved to project(x, y), a struct(x, y)."""

    def one(r: Column) -> Column:
        corners = F.transform(F.arrays_zip(r["xs"], r["ys"]), lambda v: project(v["xs"], v["ys"]))
        part = lambda q, name: F.transform(q, lambda v: v[name])
        return let(corners, lambda q: F.struct(r["part"].alias("part"), r["hole"].alias("hole"), part(q, "x").alias("xs"), part(q, "y").alias("ys")))

    return F.when(geom.isNotNull(), geometry_of(F.transform(geom["rings"], one)))


def smooth(geom: Column, iterations: int = 4) -> Column:
    """Corner cutting of closed rings: each edge gives the places at a quarter and at three quarters of it, again and again."""

    def once(v: Column) -> Column:
        two = lambda i: F.array(*[v[i] * a + v[F.when(i + 1 < F.size(v), i + 1).otherwise(0)] * (1 - a) for a in (0.75, 0.25)])
        return F.when(F.size(v) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(v) - 1), two))).otherwise(v)

    def closed(v: Column) -> Column:
        out = F.slice(v, F.lit(1), F.size(v) - 1)
        step = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), out, lambda w, _: once(w)) if iterations else out
        return let(step, lambda w: F.concat(w, F.slice(w, 1, 1)))

    one = lambda r: F.when(F.size(r["xs"]) > 3, F.struct(r["part"].alias("part"), r["hole"].alias("hole"), closed(r["xs"]).alias("xs"), closed(r["ys"]).alias("ys"))).otherwise(r)
    return F.when(geom.isNotNull(), geometry_of(F.transform(geom["rings"], one)))


def density(population: Column, area: Column) -> Column:
    """Inhabitants a square kilometre of an area in square metres, rounded half to even."""
    return F.bround(population / F.when(area != 0, area) * 1e6, 0)
