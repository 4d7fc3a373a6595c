"""Steps that failed on larger tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions.geometry import GEOMETRY
from tessella.functions.geometry import rectangle
from tessella.operators import kernels as K, matching, proxy, spatial, zones as Z
from tessella.plans.registry import queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_footprints_without_outlines_gather_no_cluster(spark):
    assert "InPandas" not in plan(queries()["disc_footprints"](spark, SF))
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 100.0, 0.0), ("b", 5.0, 5.0)], "cluster string, x double, y double")
    got, want = proxy.cluster_footprints(d, "cluster", outlines=False), proxy.cluster_footprints(d, "cluster").drop("geom")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_mean_of_a_polygon_at_a_tie(spark):
    """A sum of doubles that ends just below a tie must not round down, whatever the order."""
    rows = [("a", 0.1)] * 15 + [("b", -0.5), ("b", -0.5), ("c", 0.6), ("c", 0.7), ("c", 0.2)]  # 0.6 + 0.7 + 0.2 is 1.4999999999999998 in doubles
    got = {x.zone_id: x.avg for x in Z.value_stats_upper(spark.createDataFrame(rows, "zone_id string, valor_m2 double").coalesce(1)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1}


def test_search_is_done_once_a_text(spark):
    """Queries of one text share its hits; ranks are those of all hits by item_id."""
    items = spark.createDataFrame([(i, "COLONIA", f"small ring {i % 7}") for i in range(50)], "item_id long, TIPO string, NOM_ASEN string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(["ring", "small", "ring", "colonia ring 3", "nada", "ring aguascalientes", None, "x"] * 40)], "query_id long, text string")
    d = matching.search_catalogue(q, items, 3)
    got = {}
    for r in sorted(d.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.item_id))
    some, threes = [(1, 0), (2, 1), (3, 2)], [(1, 3), (2, 10), (3, 17)]
    assert got == {k: threes if k % 8 == 3 else some for k in range(320) if k % 8 in (0, 1, 2, 3, 5)}
    assert "contains" not in plan(d).lower()  # what meets is written for the few texts, not for each query


def test_rectangles_meet_shapes_without_a_kernel(spark):
    """Rectangles against polygons with holes and notches, some only touching, as the kernel has it."""
    rng = np.random.default_rng(7)
    boxes, shapes = [], []
    for i in range(80):
        x, y, w, h = (float(v) for v in (*rng.integers(0, 40, 2) / 1000, *rng.integers(1, 9, 2) / 1000))
        boxes.append((i, (x, y, x + w, y + h, None)))
        x, y, w = (float(v) for v in (*rng.integers(0, 40, 2) / 1000, rng.integers(4, 13) / 1000))
        ring = [(0, False, [x, x + w, x + w, x, x], [y, y, y + w, y + w, y]), (0, True, [x + w / 4, x + w / 4, x + w * 3 / 4, x + w * 3 / 4, x + w / 4], [y + w / 4, y + w * 3 / 4, y + w * 3 / 4, y + w / 4, y + w / 4])]
        notch = [(0, False, [x, x + w, x + w / 2, x + w / 2, x, x], [y, y, y + w / 2, y + w, y + w, y])]
        shapes.append((i, (x, y, x + w, y + w, ring if i % 2 else notch)))
    z = spark.createDataFrame(boxes, f"z long, geom {GEOMETRY}").select("z", rectangle(*[F.col(f"geom.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).alias("geom"))
    g = spark.createDataFrame(shapes, f"g long, geom {GEOMETRY}")
    d = spatial.polygons_intersecting(z, g, "z", "g")
    assert "InPandas" not in plan(d)
    one, two = {r.z: K.rings_of(r.geom.asDict(True)) for r in z.collect()}, {r.g: K.rings_of(r.geom.asDict(True)) for r in g.collect()}
    keys = [(a, b) for a in one for b in two]
    want = {k for k, m in zip(keys, K.meet_many([one[a] for a, _ in keys], [two[b] for _, b in keys]), strict=True) if m}
    assert {tuple(r) for r in d.collect()} == want and len(want) > 100
    assert {(r.z, r.g) for r in spatial.polygons_intersecting(g.withColumnRenamed("g", "z"), z.withColumnRenamed("z", "g"), "z", "g").collect()} == {(b, a) for a, b in want}


def test_nearest_returns_no_more_than_ties_beyond_k(spark):
    rng = np.random.default_rng(8)
    pts = pd.DataFrame({"sid": np.arange(3000), "lat": 21.9 + rng.random(3000) * 0.002, "lon": -102.3 + rng.random(3000) * 0.002})
    at = pd.DataFrame({"pid": np.arange(30), "lat": 21.9 + rng.random(30) * 0.002, "lng": -102.3 + rng.random(30) * 0.002})
    got = spatial.nearest_within(spark.createDataFrame(at), spark.createDataFrame(pts), "pid", "sid", F.lit(0.25), 0.25, 15).toPandas()
    assert got.groupby("pid").size().between(15, 17).all() and got["pid"].nunique() == 30
    for i, a in at.iterrows():
        km = np.sort(K._km(a["lat"], a["lng"], pts["lat"].to_numpy(), pts["lon"].to_numpy()))[:15]
        assert np.allclose(np.sort(got[got["pid"] == i]["dist_km"])[:15], km, atol=1e-9)
    far = spark.createDataFrame([(1, 0.0, 179.9999)], "pid long, lat double, lng double")
    over = spatial.nearest_within(far, spark.createDataFrame([(7, 0.0, -179.9999)], "sid long, lat double, lon double"), "pid", "sid", F.lit(0.25), 0.25, 15)
    assert [(r.pid, r.sid) for r in over.collect()] == [(1, 7)]


def test_points_of_circles_are_counted_in_blocks(spark):
    rng = np.random.default_rng(9)
    pts = pd.DataFrame({"lat": np.append(21.9 + rng.random(2000) * 0.02, [0.0, 90.0]), "lon": np.append(-102.3 + rng.random(2000) * 0.02, [-179.9999, 12.0]), "category": ["a", "b"] * 1001})
    at = pd.DataFrame({"zone_id": np.arange(42), "lat": np.append(21.9 + rng.random(40) * 0.02, [0.0, 89.999]), "lng": np.append(-102.3 + rng.random(40) * 0.02, [179.9999, -60.0]), "radius_km": np.append(rng.random(40), [0.1, 1.0])})
    d = spatial.counts_within(spark.createDataFrame(at), spark.createDataFrame(pts), "zone_id", "radius_km", 0.5, "category")
    want = {}
    for i, a in at.iterrows():
        for c, n in pts["category"][K._km(a["lat"], a["lng"], pts["lat"].to_numpy(), pts["lon"].to_numpy()) <= a["radius_km"]].value_counts().items():
            want[i, c] = n
    assert {(r.zone_id, r.category): r.k for r in d.collect()} == want and len(want) > 70


def test_shapes_of_one_task_are_dealt(spark):
    one = spark.range(20).select(F.col("id").alias("g"), F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(0.01).alias("xmax"), F.lit(0.01).alias("ymax"), F.expr("array(struct(0 as part, false as hole, array(0d, 0.01d, 0.01d, 0d) as xs, array(0d, 0d, 0.01d, 0d) as ys))").alias("rings")).alias("geom")).coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spatial.cell_classes(one, "g").rdd.getNumPartitions() == n
    assert spatial.with_representative(one, "g").rdd.getNumPartitions() >= n


def test_gis_columns_are_made_before_zones_meet(spark):
    for name in ("gis_colonias", "gis_landuse"):
        above = plan(queries()[name](spark, SF)).split("Join")[0]
        assert "round(" not in above and "rings" not in above


def test_dbscan_rounds_are_few_along_a_chain(spark, monkeypatch):
    n, calls, write = 120, [], proxy.written
    monkeypatch.setattr(proxy, "written", lambda d: calls.append(1) or write(d))
    d = spark.createDataFrame([(i * 53 % n, i * 40.0, 0.0) for i in range(n)], "id long, x double, y double")
    got = proxy.dbscan(d, "id", eps=50.0, min_samples=2).collect()
    assert len(got) == n and {r.cluster for r in got} == {0} and len(calls) < 40


def test_small_rectangles_have_small_cells(spark):
    """Many tiles within one wide cell: a point meets few of them, and each lies in few cells."""
    n, side = 40, 0.008 / 40
    low = lambda c, k: F.lit(c) + k * side
    tiles = spark.range(n * n).select(F.col("id").alias("gid"), rectangle(low(-102.299, F.col("id") % n), low(21.901, F.floor(F.col("id") / n)), low(-102.299, F.col("id") % n + 1), low(21.901, F.floor(F.col("id") / n) + 1)).alias("geom"))
    wide = spark.range(1).select(F.lit(5000).cast("long").alias("gid"), rectangle(F.lit(-102.35), F.lit(21.88), F.lit(-102.25), F.lit(21.9025)).alias("geom"))
    none = spark.range(1).select(F.lit(6000).cast("long").alias("gid"), rectangle(F.lit(-102.3), F.lit(21.9), F.lit(-102.3), F.lit(21.9)).alias("geom"))
    polys = tiles.unionByName(wide).unionByName(none)
    cells = spatial.box_cells(polys, "gid")
    assert cells.where("gid < 5000").groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 16
    assert cells.where("gid < 5000").groupBy("gid").count().agg(F.max("count")).first()[0] <= 9
    rng = np.random.default_rng(10)
    at = np.concatenate((rng.uniform((-102.2995, 21.9005), (-102.2905, 21.9095), (2000, 2)), [(-102.299, 21.901), (-102.299 + 3 * side, 21.901 + 2 * side), (-102.25, 21.89), (-102.35, 21.88), (-102.3, 21.9)]))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "pid long, lon double, lat double")
    boxes = [(r.gid, r.geom.xmin, r.geom.ymin, r.geom.xmax, r.geom.ymax) for r in polys.collect()]
    want = {(i, g) for i, (x, y) in enumerate(at) for g, x1, y1, x2, y2 in boxes if x1 <= x < x2 and y1 <= y < y2}
    got = spatial.points_in_polygons(points, polys, "pid", "gid", keep_all=True).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1500


def test_fits_have_as_many_tasks_as_rows_fill(spark, monkeypatch):
    """However many files the features lie in: each round of a fit pays for every task."""
    from pyspark import ml

    seen = []

    class Fitted:
        def __init__(self, stages):
            pass

        def fit(self, d):
            seen.append((d.rdd.getNumPartitions(), d.count()))

    monkeypatch.setattr(ml, "Pipeline", Fitted)
    d = spark.range(0, 950, numPartitions=8).select("id", F.rand(1).alias("nse_score"), F.rand(2).alias("x"))
    proxy.fit_proxy(d, cols=["x"])
    monkeypatch.setattr(proxy, "TASK_ROWS", 100)
    proxy.fit_proxy(d, cols=["x"])
    assert seen == [(1, 950), (10, 950)]


def test_open_arcs_by_brute_force(spark):
    """Circles meet others in blocks: no pair is joined, so none is broadcast; parted blocks and small lots give the same arcs."""
    rng = np.random.default_rng(4)
    p = [(c, float(x), float(y)) for c in "ab" for x, y in rng.uniform(-2500, 2500, (150, 2))]
    d = spark.createDataFrame(p, "cluster string, x double, y double")
    want, r, turn = [], 90.0, 2 * np.pi
    for c, x, y in p:
        met = [(turn, turn)]
        for o, qx, qy in p:
            apart = np.hypot(qx - x, qy - y)
            if o == c and 0 < apart < 2 * r:
                s, half = np.arctan2(qy - y, qx - x), np.arccos(apart / (2 * r))
                s = np.mod(s - half, turn)
                met += [(s, turn), (0.0, s + 2 * half - turn)] if s + 2 * half > turn else [(s, s + 2 * half)]
        upto = 0.0
        for s, e in sorted(met):
            if s - upto > 1e-9:
                want.append((c, x, y, round(upto, 7), round(s, 7)))
            upto = max(upto, e)
    at_once = K.CIRCLES_AT_ONCE
    for most in (proxy.MOST_POINTS, 7):
        arcs = proxy._open_arcs(d, d, "cluster", r, most)
        assert "CoGroup" in plan(arcs)
        assert sorted((a.cluster, a.x, a.y, round(a.first, 7), round(a.last, 7)) for a in arcs.collect()) == sorted(want)
    x, y = np.array([q[1:] for q in p if q[0] == "a"]).T
    try:
        K.CIRCLES_AT_ONCE = 20
        i, first, last = K.open_arcs(x, y, x, y, r)
    finally:
        K.CIRCLES_AT_ONCE = at_once
    assert sorted(("a", x[k], y[k], round(a, 7), round(b, 7)) for k, a, b in zip(i, first, last)) == sorted(w for w in want if w[0] == "a")


def test_overlaps_in_block_equal_clipping():
    """Rectangles and round zones over rectangles, Ls and polygons with a hole: as clipping pair by pair, without pairs of outlines."""
    rng = np.random.default_rng(3)
    box = lambda x1, y1, x2, y2: [(np.array([x1, x2, x2, x1, x1]), np.array([y1, y1, y2, y2, y1]))]
    grid = [(-102 + i * 0.001, 21.7 + j * 0.0012, -102 + (i + 1) * 0.001, 21.7 + (j + 1) * 0.0012) for i in range(9) for j in range(9)]

    def shape(k, x1, y1, x2, y2):
        h, v = (x1 + x2) / 2, y1 + (y2 - y1) * 0.6
        ell = [(np.array([x1, x2, x2, h, h, x1, x1]), np.array([y1, y1, v, v, y2, y2, y1]))]
        return (None, ell, box(x1, y1, x2, y2) + box(h, y1 + (y2 - y1) * 0.25, h + (x2 - x1) * 0.25, v))[k % 3]

    layer = [shape(k, *b) for k, b in enumerate(grid)]
    zones, rings = [], []
    for k in range(30):
        x, y, r = -102 + rng.uniform(0, 0.009), 21.7 + rng.uniform(0, 0.011), rng.uniform(0.0003, 0.004)
        t = np.linspace(0, 2 * np.pi, 97)
        zones.append((x - r, y - r, x + r, y + r))
        rings.append(None if k % 2 else [(x + r * np.cos(t), y + r * np.sin(t))])
    i, j, km2, frac = K.overlaps_in_block(np.array(zones), np.array(grid), rings, layer)
    want = K.overlaps_km2([rings[a] or box(*zones[a]) for a in i], [layer[b] or box(*grid[b]) for b in j])
    whole = np.array([K.area_km2(layer[b] or box(*grid[b])) for b in j])
    assert len(i) > 500 and np.abs(km2 - want).max() < 1e-12 and np.abs(frac - np.minimum(1, want / whole)).max() < 1e-9
    assert {(a, b) for a, b, v in zip(i, j, want) if v > 1e-12} == {(a, b) for a, b, v in zip(i, j, km2) if v > 1e-12}


def test_overlap_of_shapes_is_met_in_blocks(spark):
    z = spark.createDataFrame([(1, 0.001, 0.001, 0.015, 0.012), (2, 0.0, 0.0, 0.03, 0.03)], "zid long, a double, b double, c double, d double").select("zid", rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))
    ring = ([0.0, 0.02, 0.0, 0.0], [0.0, 0.0, 0.02, 0.0])
    t = spark.createDataFrame([(7, (0.0, 0.0, 0.02, 0.02, [(0, False, *ring)]), 5.0)], f"gid long, geom {GEOMETRY}, v double")
    d = spatial.overlap(z, t, "zid", "gid", keep=("v",))
    assert "CoGroup" in plan(d)
    got = {r.zid: (r.frac, r.v) for r in d.collect()}
    want = K.overlaps_km2([[(np.array([0.001, 0.015, 0.015, 0.001, 0.001]), np.array([0.001, 0.001, 0.012, 0.012, 0.001]))]], [[tuple(map(np.array, ring))]])[0] / K.area_km2([tuple(map(np.array, ring))])
    assert got[2] == (1.0, 5.0) and abs(got[1][0] - want) < 1e-9


def _squares(spark, rows, more):
    d = spark.createDataFrame(rows, f"gid long, a double, b double, c double, d double, {more}")
    return d.select("gid", rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"), *[x.split()[0] for x in more.split(", ")])


def _settlements(spark):
    rng = np.random.default_rng(8)
    rows = [(k, *map(float, (x, y, x + 0.002, y + 0.002)), "COLONIA", f"n{k % 6}", "M" if k % 4 else None, None if k % 5 == 0 else float(k % 3) + 0.5) for k, (x, y) in enumerate(rng.uniform(0, 0.04, (200, 2)))]
    zones = [(k, *map(float, (x, y, x + w, y + w))) for k, (x, y, w) in enumerate(np.column_stack((rng.uniform(0, 0.03, (25, 2)), rng.uniform(0.001, 0.03, 25))))]
    z = _squares(spark, [(*r, 0) for r in zones], "o int").select(F.col("gid").alias("zone_id"), "geom")
    return z, _squares(spark, rows, "TIPO string, NOM_ASEN string, municipio string, valor_m2 double")


def test_drawn_value_stats_send_no_pairs(spark):
    z, c = _settlements(spark)
    d = Z.drawn_value_stats(z, c)
    assert "CoGroup" in plan(d)
    want = Z.value_stats_upper(spatial.representative_in(c, z, "gid", "zone_id").join(c.drop("geom"), "gid"))
    cols = ["zone_id", "n", "med", "avg", "min", "max"]
    assert sorted(map(tuple, d.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_drawn_colonias_send_no_pairs(spark):
    """Rows of the settlements of a zone, equal ones counted, as the long form has them."""
    z, c = _settlements(spark)
    d = Z.drawn_colonias(z, c)
    assert "CoGroup" in plan(d)
    inside = spatial.representative_in(c, z, "gid", "zone_id").join(c.drop("geom"), "gid")
    stats = z.select("zone_id", *[F.lit(None).cast(k).alias(n) for n, k in (("tracts", "long"), ("people", "double"), ("score", "double"), ("pct_2dorm", "double"), ("pct_3cuart", "double"), ("level", "string"), ("tracts_by_level", "map<string,bigint>"))])
    long = Z.polygon_metric_rows(z.select("zone_id", F.lit(1.0).alias("km2")), stats, colonias=inside).where("metrica like 'colonia: %'")
    want = long.groupBy("zone_id", "metrica", "valor", "unidad").agg(F.count("*").alias("times"))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.collect())) and want.where("times > 1").count()
