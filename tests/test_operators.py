import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions.geometry import GEOMETRY
from tessella.functions.geometry import rectangle
from tessella.operators import census, directory, kernels as K, matching, proxy, series, spatial, zones as Z


def test_demographics(spark):
    d = spark.createDataFrame([("h", 0.5, 1000.0, 400.0, 12.0, None, "C+"), ("w", 1.0, 300.0, 100.0, None, 100.0, "A/B"), ("w", 0.5, 8000.0, 200.0, None, 40.0, "D"), ("n", 1.0, 1000.0, 300.0, 10.0, 80.0, "C"), ("n", 1.0, None, None, None, None, None)], "zone_id string, frac double, POBTOT double, TVIVPARHAB double, GRAPROES double, pct_inter double, nse_nivel string")
    r = {x.zone_id: x for x in Z.demographics(d).collect()}
    assert (r["h"].POBTOT, r["h"].TVIVPARHAB, r["h"].GRAPROES) == (500, 200, 12)
    assert (r["w"].POBTOT, r["w"].pct_inter) == (4300, 70)
    assert (r["n"].POBTOT, r["n"].GRAPROES, r["n"].pct_inter) == (1000, 10, 80)
    s = {x.zone_id: x for x in Z.level_shares(d).collect()}
    assert s["h"].level == "C+" and s["h"].shares == {"C+": 100.0}
    assert s["w"].level == "D" and s["w"].shares["A/B"] == pytest.approx(300 / 43)


def test_coverage_and_values(spark):
    pi = np.pi
    d = spark.createDataFrame([(pi * 4.5, pi * 9, 50.0), (28.27, 28.27, 0.0), (30.0, 28.27, 0.0), (0.0, 28.27, 100.0), (10.0, 0.0, None)], "a double, b double, want double")
    for r in d.select(Z.uncovered_pct(F.col("a"), F.col("b")).alias("x"), "want").collect():
        assert r.x == (None if r.want is None else pytest.approx(r.want))
    v = spark.createDataFrame([("a", 3000.0), ("a", 1000.0), ("a", 2000.0), ("b", 4000.0), ("b", 1000.0), ("b", 2000.0), ("b", 3000.0), ("c", 5000.0), ("c", None), ("d", None)], "zone_id string, valor_m2 double")
    r = {x.zone_id: (x.n, x.min, x.med, x.max) for x in Z.value_stats(v).collect()}
    assert r == {"a": (3, 1000, 2000, 3000), "b": (4, 1000, 2500, 4000), "c": (1, 5000, 5000, 5000)}
    u = {x.zone_id: (x.n, x.med, x.avg) for x in Z.value_stats_upper(v).collect()}
    assert u["b"] == (4, 3000, 2500)


def test_report_and_rows_agree(spark):
    z = spark.createDataFrame([(1, 21.9, -102.3, 3.0, 28.32, 14.0), (2, 21.9, -102.3, 1.0, 3.0, None)], "zone_id long, lat double, lng double, radius_km double, km2 double, tract_km2 double")
    rows = spark.createDataFrame([(1, 0.5, 1000.0, 400.0, 12.345, "C")], "zone_id long, frac double, POBTOT double, TVIVPARHAB double, GRAPROES double, nse_nivel string")
    pois = Z.poi_counts(spark.createDataFrame([(1, "Salud")], "zone_id long, category string"), z)
    projects = spark.createDataFrame([(1, "Vivanta", "horizontal", 1.183)], "zone_id long, nombre string, tipo string, dist_km double")
    rep = Z.zone_report(z, Z.demographics(rows), Z.level_shares(rows), pois=pois, projects=projects)
    r = {x.zone_id: x.report for x in rep.collect()}
    assert r[1].schema_version == 2 and r[1].metricas.poblacion_estimada == 500 and r[1].pois["Salud"] == 1 and len(r[1].pois) == 6
    assert r[2].proyectos == [] and r[2].metricas.poblacion_estimada is None
    m = {(x.zone_id, x.metrica): x.valor for x in Z.metric_rows(rep).collect()}
    assert m[1, "punto_lat"] == "21.900000" and m[1, "radio"] == "3" and m[2, "proyectos_vivienda_nueva"] == "0"
    assert m[1, "escolaridad_promedio"] == "12.35" and m[2, "poblacion_estimada"] == "s/d" and m[1, "poi_salud"] == "1" and m[1, "proyecto: Vivanta (horizontal)"] == "1.18"
    for name, _, n, _ in Z.METRICS:
        v = r[1].metricas[name]
        assert m[1, name] == ("s/d" if v is None else f"{v:.{n}f}")


def test_percentile_level(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3])], "id int, s double")
    r = {x.id: x.nse_nivel for x in census.percentile_level(d, "s").collect()}
    assert r == {0: "D+", 1: "C-", 2: "C-", 3: "A/B"}  # 25, 62.5, 62.5, 100
    c = census.minmax(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [x.a_norm for x in c] == [0.0, 1.0, None] and [x.b_norm for x in c] == [0.5] * 3


def test_series(spark):
    rows = [("m", 2025, 1, 184.57), ("m", 2026, 1, 206.10)] + [("m", 2025, q, 190.0) for q in (2, 3, 4)] + [("few", 2026, q, 1.0) for q in (1, 2, 3, 4)] + [("gap", 2020 + y, 1, 1.0) for y in (0, 1, 2, 3, 5)]
    r = {x.clave: x for x in series.latest_yoy(spark.createDataFrame(rows, "clave string, anio int, trimestre int, indice double")).collect()}
    assert round(r["m"].pct, 1) == 11.7 and r["few"].pct is None and r["gap"].pct is None


def test_population(spark):
    s = spark.createDataFrame([("A", 2020, 968960), ("A", 2040, 1164986), ("J", 2020, 132642), ("J", 2040, 161381)], "municipio string, anio int, pob long")
    z = spark.createDataFrame([(1, "A"), (1, "J")], "zone_id int, municipio string")
    assert {x.municipio: x.cambio_pct for x in census.population_context(z, s).collect()} == {"A": 20.2, "J": 21.7}


def _rects(spark, n, seed, name):
    r = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(r.uniform(0, 0.1, n), r.uniform(0, 0.1, n), r.uniform(0.001, 0.03, n), r.uniform(0.001, 0.03, n), strict=True))]
    d = spark.createDataFrame(rows, f"{name} int, x1 double, y1 double, x2 double, y2 double")
    return rows, d.select(name, rectangle(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("geom"))


@pytest.mark.parametrize("partitions", [1, 7])
def test_grid_joins_equal_all_pairs(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    a, da = _rects(spark, 25, 1, "zid")
    b, db = _rects(spark, 40, 2, "gid")
    meet = {(p[0], q[0]) for p, q in itertools.product(a, b) if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}
    assert {(x.zid, x.gid) for x in spatial.polygons_intersecting(da, db, "zid", "gid").collect()} == meet
    got = spatial.overlap(da, db, "zid", "gid").collect()
    assert {(x.zid, x.gid) for x in got} == meet and len(got) == len(meet) and all(0 < x.frac <= 1 for x in got)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(3).uniform(0, 0.12, (200, 2)))], "pid int, lon double, lat double")
    inside = {(p.pid, q[0]) for p in pts.collect() for q in b if q[1] < p.lon < q[3] and q[2] < p.lat < q[4]}
    assert {(x.pid, x.gid) for x in spatial.points_in_polygons(pts, db, "pid", "gid", keep_all=True).collect()} == inside
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_cascade_and_fuzzy(spark):
    v = matching.collapse_values(spark.createDataFrame([("Jesús María", 0, "1", "FRACCIONAMIENTO LOMAS ALTAS", 1000.0), ("Jesús María", 1, "2", "COLONIA VIÑEDOS PRIMERA SECCION", 2000.0), ("Jesús María", 2, "3", "PASEOS DEL SOL", 3000.0), ("Jesús María", 3, "3", "PASEOS DEL SOL", 3001.0), ("Jesús María", 4, "9", "BARATO", 99.0)], "municipio string, pos int, sector string, name string, value double"))
    assert {x.name: x.value for x in v.collect()}["PASEOS DEL SOL"] == 3000  # half to even
    p = spark.createDataFrame([(1, "FRACCIONAMIENTO", "Lomas Altas"), (2, "COLONIA", "Lomas Altas"), (3, "COLONIA", "Viñedos 1a Secc"), (4, "NINGUNO", "Viñedos"), (5, "NINGUNO", "Paseos Sol"), (6, "NINGUNO", "Lomas Altaz"), (7, "NINGUNO", "Barato")], "gid int, TIPO string, NOM_ASEN string").withColumn("municipio", F.lit("Jesús María"))
    r = {x.gid: (x.method, x.value) for x in matching.cascade_match(p, v).collect()}
    assert r == {1: ("exacto", 1000), 2: ("base", 1000), 3: ("canon", 2000), 4: ("sin_seccion", 2000), 5: ("slug", 3000)}
    f = matching.fuzzy_match(p.where("gid > 5"), v).collect()
    assert [(x.gid, x.value) for x in f] == [(6, 1000)] and f[0].method.startswith("fuzzy(0.91)")


def test_fuzzy_against_all_pairs(spark):
    """The best key of each name by the standard library's matcher over all keys of its municipality and first letter."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(8)
    words = ["LOMAS", "LOMA", "ALTAS", "ALTA", "SAN", "JOSE", "VIÑEDOS", "VINEDOS", "DEL", "SOL", "PASEO", "PASEOS", "XOLO", "QUINTA", "ZARCO", "EJIDO"]

    def name():
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
        k = r.randrange(len(t))
        return t if r.random() < 0.4 else t[:k] + r.choice("ABLSZX ") + t[k + r.randint(0, 1) :]

    keys = [(r.choice("MN"), i, "1", name(), float(100 + i)) for i in range(250)]
    v = matching.collapse_values(spark.createDataFrame(keys, "municipio string, pos int, sector string, name string, value double"))
    p = spark.createDataFrame([(i, r.choice("MN"), "", name()) for i in range(150)] + [(900, "M", "", None), (901, "M", "", "")], "gid int, municipio string, TIPO string, NOM_ASEN string")
    table = matching._keys(v).where("level = 2").groupBy("municipio", "key").agg(F.min("pos").alias("pos")).collect()
    want = {}
    for x in p.select("gid", "municipio", matching.S.canon(matching.S.norm_name(F.col("NOM_ASEN"))).alias("cn")).collect():
        if not x.cn:
            continue
        scored = [(SequenceMatcher(None, x.cn, k.key).ratio(), -k.pos, k.key) for k in table if k.municipio == x.municipio and k.key[0] == x.cn[0] and abs(len(k.key) - len(x.cn)) <= 6]
        if scored and max(scored)[0] >= 0.88:
            want[x.gid] = (max(scored)[2], round(max(scored)[0], 9))
    got = {x.gid: (x.method.split("→")[1], round(x.ratio, 9)) for x in matching.fuzzy_match(p, v).collect()}
    assert got == want and len(want) > 15


def test_dbscan_equals_brute_force(spark):
    r = np.random.default_rng(5)
    xy = np.concatenate((r.normal(0, 60, (60, 2)), r.normal(900, 90, (40, 2)), r.uniform(-2000, 2000, (120, 2)), np.zeros((9, 2))))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= 180**2
    core = d2.sum(1) >= 6
    label = np.arange(len(xy))
    for _ in range(len(xy)):
        new = np.array([min(label[d2[i] & core]) if core[i] else label[i] for i in range(len(xy))])
        if (new == label).all():
            break
        label = new
    want = {i: (bool(core[i]), int(label[i] if core[i] else label[d2[i] & core].min())) for i in range(len(xy)) if core[i] or (d2[i] & core).any()}
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    assert {x.id: (x.core, x.cluster) for x in proxy.dbscan(pts, "id").collect()} == want


def test_footprints_against_a_raster(spark):
    """A lone disc, twins and a far one, a crowd, a ring around a hole far from the origin, a lattice whose circles meet in threes."""
    r = np.random.default_rng(2)
    turn = np.arange(8) * np.pi / 4
    sets = {1: [[0, 0]], 2: [[0, 0], [0, 0], [5000, 0]], 3: r.normal(0, 200, (300, 2)), 4: np.column_stack((180 * np.cos(turn), 180 * np.sin(turn))) + 2.4e6, 5: [[i * 90, j * 90] for i in range(6) for j in range(6)], 6: r.uniform(-150, 150, (1500, 2))}
    rows = [(k, float(x), float(y)) for k, v in sets.items() for x, y in v] + [(None, 0.0, 0.0), (9, None, 1.0)]
    got = {f.cluster: f for f in proxy.cluster_footprints(spark.createDataFrame(rows, "cluster int, x double, y double"), "cluster").collect()}
    assert got.keys() == sets.keys()
    disc = np.pi * 90**2 / 1e6
    assert got[1].km2 == pytest.approx(disc) and got[2].km2 == pytest.approx(2 * disc) and got[2].x == pytest.approx(2500)
    for k in (3, 4, 5, 6):
        v = np.array(sets[k], float)
        low, high = v.min(0) - 91, v.max(0) + 91
        gx, gy = np.meshgrid(np.arange(low[0], high[0], 1.0) + 0.5, np.arange(low[1], high[1], 1.0) + 0.5)
        inside = np.zeros(gx.shape, bool)
        for x, y in v:
            inside |= (gx - x) ** 2 + (gy - y) ** 2 <= 8100
        f = got[k]
        rings = [(np.array(q.xs), np.array(q.ys)) for q in f.geom.rings]
        assert f.km2 == pytest.approx(inside.sum() / 1e6, rel=1e-3) and abs(f.x - gx[inside].mean()) < 0.5 and abs(f.y - gy[inside].mean()) < 0.5
        assert sum(K.ring_area(*q) for q in rings) / 1e6 == pytest.approx(f.km2, rel=2e-3)
    assert [q.hole for q in got[4].geom.rings] == [False, True] and len(got[5].geom.rings) == 1


def test_directory(spark):
    p = spark.createDataFrame([(1, 21.9, -102.3, "a"), (2, 21.9000001, -102.3, "a"), (3, 21.9, -102.3, "b")], "id int, lat double, lon double, category string")
    assert {x.id for x in directory.dedupe_points(p).collect()} == {1, 3}
    d, dims = directory.dictionary_encode(spark.createDataFrame([("bb",), ("a",), (None,)], "s string"), ["s"], {"s": directory.by_length("s")})
    assert {x.s: x.s_code for x in d.collect()} == {"a": 0, "bb": 1, None: None}


def cell(*rings):
    """A geometry cell of rings given as corners."""
    x, y = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return (min(x), min(y), max(x), max(y), [(0, k > 0, [p[0] for p in (*r, r[0])], [p[1] for p in (*r, r[0])]) for k, r in enumerate(rings)])


def square(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def test_erase(spark):
    _, a = _rects(spark, 1, 1, "gid")
    whole = spatial.erase(a, a.select(F.col("gid").alias("mid"), "geom").where("mid > 5"), "gid", "mid").first().km2
    assert whole > 0 and spatial.erase(a, a.select(F.col("gid").alias("mid"), "geom"), "gid", "mid").count() == 0
    p = spark.createDataFrame([(1, cell(square(0.0, 0.0, 0.03, 0.03)))], f"gid int, geom {GEOMETRY}")
    m = spark.createDataFrame([(1, cell(square(0.01, 0.01, 0.02, 0.02))), (2, cell(square(0.015, 0.015, 0.02, 0.02)))], f"mid int, geom {GEOMETRY}")
    left = spatial.erase(p, m, "gid", "mid").first()
    assert [(r.part, r.hole, len(r.xs)) for r in left.geom.rings] == [(0, False, 5), (0, True, 5)] and left.km2 == pytest.approx(8 / 9 * (0.03 * 111.3194908) ** 2, rel=1e-6)


@pytest.mark.parametrize("crowded", [1000, 3])
def test_dissolve(spark, crowded):
    """Tiles around a hole over many blocks, overlapping repeats, gaps; also with blocks parted in four."""
    n, side = 7, 0.03
    tiles = [("tiles", cell(square(-102.3 + i * side, 21.8 + j * side, -102.3 + (i + 1) * side, 21.8 + (j + 1) * side))) for i in range(n) for j in range(n) if (i, j) != (3, 3)]
    gaps = [("gaps", cell(square(a, 0.0, b, 0.1))) for a, b in ((0.0, 0.1), (0.1008, 0.2), (0.2022, 0.3), (0.25, 0.28))]
    d = spark.createDataFrame([*tiles, *tiles[:5], *gaps, ("none", None)], f"z string, geom {GEOMETRY}")
    shape = lambda r: sorted((q.part, q.hole, len(q.xs)) for q in r.geom.rings)
    plain = {r.z: r for r in spatial.dissolve(d, "z", crowded=crowded).collect()}
    assert plain.keys() == {"tiles", "gaps"} and shape(plain["tiles"]) == [(0, False, 5), (0, True, 5)] and shape(plain["gaps"]) == [(k, False, 5) for k in range(3)]
    closed = {r.z: r for r in spatial.dissolve(d, "z", gap=0.001, crowded=crowded).collect()}
    assert shape(closed["tiles"]) == shape(plain["tiles"]) and closed["tiles"].km2 == pytest.approx(plain["tiles"].km2, rel=1e-9)
    assert shape(closed["gaps"]) == [(k, False, 5) for k in range(2)]
    assert closed["gaps"].km2 - plain["gaps"].km2 == pytest.approx(0.0008 * 0.1 * 111.3194908**2, rel=1e-4)
    assert spatial.dissolve(d.limit(0), "z").count() == 0


def test_ray_casts_are_for_cells_on_the_outline(spark):
    """Points in polygons of any size by classes of cells against a plain ray cast; most points of a large one need none."""
    r = np.random.default_rng(4)
    shapes = []
    for k, (cx, cy, size, n) in enumerate([(-102.3, 21.8, 0.3, 40), (-102.2, 21.9, 0.02, 7), (10.0, 0.0, 8.0, 200), (-102.35, 21.7, 0.001, 5)]):
        a = np.linspace(0, 2 * np.pi, n, endpoint=False)
        d = size * (0.8 + 0.2 * np.sin(3 * a)) if k == 2 else size * r.uniform(0.6, 1.0, n)
        outer = list(zip((cx + d * np.cos(a)).tolist(), (cy + d * np.sin(a)).tolist(), strict=True))
        shapes.append((k, cell(outer, square(cx - size / 5, cy - size / 7, cx + size / 6, cy + size / 5))))
    polys = spark.createDataFrame(shapes, f"gid int, geom {GEOMETRY}")
    xy = np.concatenate([c + s * r.uniform(-1.1, 1.1, (1500, 2)) for c, s in ((np.array([-102.3, 21.8]), 0.3), (np.array([10.0, 0.0]), 8.0), (np.array([-102.2, 21.9]), 0.02), (np.array([-102.35, 21.7]), 0.001))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "pid int, lon double, lat double")
    rings = {k: [(np.array(q[2]), np.array(q[3])) for q in g[4]] for k, g in shapes}
    want = {(i, k) for k, g in rings.items() for i in np.flatnonzero(K.contains(g, xy[:, 0], xy[:, 1])).tolist()}
    got = spatial.points_in_polygons(points, polys, "pid", "gid", keep_all=True).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    classes = spatial.cell_classes(polys, "gid")
    assert classes.groupBy("gid").count().agg(F.max("count")).first()[0] <= (spatial.ACROSS + 4) ** 2
    whole, near = spatial.points_in_cells(points, classes, "pid", "gid")
    assert whole.count() > 2000 and near.where("gid = 2").count() < 0.35 * 1500


def test_conic_and_back(spark):
    from tessella.functions.scalars import from_lcc, to_lcc

    d = spark.createDataFrame([(float(x), float(y)) for x in np.linspace(-118, -86, 17) for y in np.linspace(14, 33, 20)], "lon double, lat double")
    r = d.withColumn("p", to_lcc(F.col("lon"), F.col("lat"))).withColumn("q", from_lcc(F.col("p.x"), F.col("p.y"))).withColumn("back", to_lcc(F.col("q.lon"), F.col("q.lat")))
    assert r.agg(F.max(F.hypot(F.col("p.x") - F.col("back.x"), F.col("p.y") - F.col("back.y")))).first()[0] < 1e-3
    assert r.agg(F.max(F.greatest(F.abs(F.col("q.lon") - F.col("lon")), F.abs(F.col("q.lat") - F.col("lat"))))).first()[0] < 1e-9


def test_registered_models_fit_all_trees(spark, monkeypatch):
    """Both queries of the boosted model fit as many trees as the reference (150), in validation and for good."""
    from tessella.operators import proxy
    from tessella.plans import queries

    asked = []

    class Asked(Exception):
        pass

    def regressor(**options):
        asked.append((options["maxIter"], options["maxDepth"], options["stepSize"]))
        raise Asked

    monkeypatch.setattr(proxy, "GBTRegressor", regressor)
    for query in (queries.proxy_validation, queries.cluster_scores):
        with pytest.raises(Asked):
            query(spark, "/root/testdata/sf0.001")
        assert set(asked) == {(150, 2, 0.05)}
        asked.clear()


def test_out_of_fold_predictions(spark):
    """Every row once, by a model of the other folds, and close to what the label is made of."""
    r = np.random.default_rng(0)
    x = r.uniform(0, 1, (400, len(directory.FEATURES)))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.5, 1.0, 0.0) + r.normal(0, 0.05, 400)
    d = spark.createDataFrame([(i, float(v), *map(float, row)) for i, (v, row) in enumerate(zip(y, x, strict=True))], ["gid", "nse_score", *directory.FEATURES])
    p = proxy.cross_val_predict(d, "gid", trees=30, rate=0.2)
    rows = p.collect()
    assert sorted(q.gid for q in rows) == list(range(400)) and {q.fold for q in rows} == set(range(5))
    m = proxy.validation_metrics(p, proxy.tercile_cuts(d, "nse_score")).first()
    assert m.n == 400 and m.r2 > 0.8 and m.correlation > 0.9 and m.accuracy > 0.7 and m.serious < 0.05


def test_within_distance_at_any_latitude_and_radius(spark):
    """Against brute force, near the poles, over the date line, with radii far above a cell."""
    import math
    import random

    r = random.Random(5)
    place = lambda: (r.choice([0, 21.8, 60, -72, 89.9, -89.99]) + r.uniform(-0.05, 0.05), r.choice([0, -102.3, 179.99, -179.99]) + r.uniform(-0.05, 0.05))
    centres = [(i, *place(), r.choice([0.0, 0.3, 2.0, 25.0])) for i in range(60)]
    points = [(i, max(-90.0, min(90.0, a)), o) for i, (a, o) in enumerate(place() for _ in range(300))]
    centres = [(i, max(-90.0, min(90.0, a)), o, k) for i, a, o, k in centres]

    def km(a1, o1, a2, o2):
        x = math.sin(math.radians(a2 - a1) / 2) ** 2 + math.cos(math.radians(a1)) * math.cos(math.radians(a2)) * math.sin(math.radians(o2 - o1) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(x)))

    want = {(c, p) for c, a, o, k in centres for p, b, q in points if km(a, o, b, q) <= k}
    got = spatial.within_distance(spark.createDataFrame(centres, "cid long, lat double, lng double, r double"), spark.createDataFrame(points, "pid long, lat double, lon double"), F.col("r"), 0.5).select("cid", "pid").collect()
    assert len(got) == len(want) > 500 and {tuple(x) for x in got} == want


def test_rectangles_are_settled_as_the_kernels_do(spark):
    """Rectangles by expressions against the same shapes with one corner more, which go to the kernels."""
    import random

    r = random.Random(6)

    def shape(i, x, y, w, h, more):
        xs, ys = [x, x + w, x + w, x, x], [y, y, y + h, y + h, y]
        if more:
            xs, ys = [x, x + w / 2, *xs[1:]], [y, y, *ys[1:]]
        return i, (x, y, x + w, y + h, [(0, False, xs, ys)])

    box = [(i, r.uniform(0, 0.1), r.uniform(0, 0.1), r.uniform(0.001, 0.03), r.uniform(0.001, 0.03)) for i in range(60)]
    table = lambda name, more: spark.createDataFrame([shape(*b, more) for b in box], f"{name} long, geom {GEOMETRY}")
    plain = {(x.z, x.g): (x.km2, x.frac) for x in spatial.overlap(table("z", False), table("g", False), "z", "g").collect()}
    for a, b in ((False, True), (True, False), (True, True)):
        other = {(x.z, x.g): (x.km2, x.frac) for x in spatial.overlap(table("z", a), table("g", b), "z", "g").collect()}
        assert other.keys() == plain.keys() and all(abs(other[k][0] - plain[k][0]) < 1e-9 and abs(other[k][1] - plain[k][1]) < 1e-9 for k in plain)
    meets = lambda a, b: {tuple(x) for x in spatial.polygons_intersecting(table("z", a), table("g", b), "z", "g").collect()}
    assert meets(False, False) == meets(True, False) == meets(True, True)


def test_nearest_meets_few_in_a_crowd(spark):
    """4,000 points within 250 m of each centre, some in one place: few meet, and the nearest are those of brute force."""
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"sid": np.arange(4000), "lat": 21.9 + rng.random(4000) * 0.001, "lon": -102.3 + rng.random(4000) * 0.001})
    pts.loc[:299, ["lat", "lon"]] = 21.9005, -102.2995
    at = pd.DataFrame({"pid": np.arange(20), "lat": 21.9 + rng.random(20) * 0.001, "lng": -102.3 + rng.random(20) * 0.001})
    at.loc[0, ["lat", "lng"]] = 21.9005, -102.2995
    at.loc[19, "lat"] = 21.9019  # beside the crowd
    a, p = spark.createDataFrame(at), spark.createDataFrame(pts)
    rad = lambda v: np.radians(v.to_numpy())
    h = np.sin((rad(pts["lat"])[None] - rad(at["lat"])[:, None]) / 2) ** 2 + np.cos(rad(pts["lat"]))[None] * np.cos(rad(at["lat"]))[:, None] * np.sin((rad(pts["lon"])[None] - rad(at["lng"])[:, None]) / 2) ** 2
    km = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
    for k in (1, 15):
        got = spatial.nearest_within(a, p, "pid", "sid", F.lit(0.25), 0.25, k).toPandas()
        assert (got["pid"] < 19).sum() <= 19 * 20 * k
        for i in range(20):
            order = np.lexsort((np.arange(4000), km[i].round(9)))[:k]
            mine = got[got["pid"] == i].assign(d=lambda x: x["dist_km"].round(9)).sort_values(["d", "sid"])["sid"].tolist()[:k]
            assert mine == [int(j) for j in order if km[i, j] <= 0.25]


def test_zones_meet_values_in_blocks(spark, monkeypatch):
    """Values, ranks and viewports of crowded blocks against brute force: blocks part their zones, edges count, ties go to the smaller gid."""
    monkeypatch.setattr(spatial, "MOST_ZONES", 7)
    rng = np.random.default_rng(9)
    box = lambda n, wide: (lambda x, y, w: pd.DataFrame({"x1": x, "y1": y, "x2": x + w, "y2": y + w}))(rng.integers(0, 40, n) / 1024, rng.integers(0, 40, n) / 1024, rng.integers(1, wide, n) / 1024)
    z, c = box(60, 30).assign(zone_id=np.arange(60)), box(300, 3).assign(gid=np.arange(300), v=rng.integers(0, 9, 300).astype(float))
    c.loc[::7, "v"] = None
    geom = rectangle(*[F.col(k) for k in ("x1", "y1", "x2", "y2")]).alias("geom")
    zs, cs = spark.createDataFrame(z).select("zone_id", geom), spark.createDataFrame(c).select("gid", geom, F.when(~F.isnan("v"), F.col("v")).alias("valor_m2"))
    stats, top = Z.zone_value_stats(zs, cs).toPandas().set_index("zone_id"), Z.zone_top_values(zs, cs, 5).toPandas()
    views = spark.createDataFrame(z.rename(columns={"zone_id": "view_id", "y1": "south", "y2": "north", "x1": "west", "x2": "east"})).withColumn("categories", F.array(F.lit("a"), F.lit("b")))
    pts = c.assign(id=c["gid"], lon=c["x1"], lat=c["y1"], category=np.where(c["gid"] % 3 == 0, "a", np.where(c["gid"] % 3 == 1, "b", "c")))
    seen = directory.viewport_points(spark.createDataFrame(pts[["id", "lon", "lat", "category"]]), views, cap=20).toPandas().set_index("view_id")
    for r in z.itertuples():
        met = c[(c["x1"] <= r.x2) & (c["x2"] >= r.x1) & (c["y1"] <= r.y2) & (c["y2"] >= r.y1)]
        v = met["v"].dropna()
        assert (r.zone_id in stats.index) == bool(len(v))
        if len(v):
            assert tuple(stats.loc[r.zone_id, ["n", "min", "med", "max"]]) == (len(v), v.min(), v.median(), v.max())
        best = met.assign(o=met["v"].fillna(0.0)).sort_values(["o", "gid"], ascending=[False, True])["gid"].tolist()[:5]
        assert top[top["zone_id"] == r.zone_id].sort_values("rank")["gid"].tolist() == best
        wx, wy = (r.x2 - r.x1) * 0.1, (r.y2 - r.y1) * 0.1
        ids = pts[(pts["lon"].between(r.x1 - wx, r.x2 + wx)) & pts["lat"].between(r.y1 - wy, r.y2 + wy) & (pts["category"] != "c")]["id"].tolist()
        assert seen.loc[r.zone_id, "n"] == len(ids) and (seen.loc[r.zone_id, "ids"] is None) == (len(ids) > 20) and (len(ids) > 20 or list(seen.loc[r.zone_id, "ids"]) == ids)


def test_landuse_areas_are_the_overlaps_added_up(spark):
    rng = np.random.default_rng(3)
    x, y, w = rng.random(80) * 0.05, rng.random(80) * 0.05, 0.001 + rng.random(80) * 0.02
    d = spark.createDataFrame(pd.DataFrame({"k": np.arange(80), "x1": x, "y1": y, "x2": x + w, "y2": y + w})).withColumn("geom", rectangle(*[F.col(k) for k in ("x1", "y1", "x2", "y2")]))
    z = d.where("k < 20").select(F.col("k").alias("zone_id"), "geom")
    u = d.where("k >= 20").select(F.col("k").alias("gid"), "geom", F.when(F.col("k") % 4 != 0, (F.col("k") % 4).cast("string")).alias("grupo"), (F.col("k") % 2).cast("string").alias("programa"))
    want = {tuple(r[:3]): r[3] for r in spatial.overlap(z, u, "zone_id", "gid").join(u, "gid").groupBy("zone_id", "grupo", "programa").agg(F.sum("km2")).collect()}
    got = {tuple(r[:3]): r[3] for r in Z.landuse_areas(z, u).collect()}
    assert want and got == pytest.approx(want, rel=1e-9)
