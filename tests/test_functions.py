import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G, scalars as S


def values(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_names(spark):
    n = lambda x: S.norm_name(F.lit(x))
    assert values(spark, n("Viñedos de San José."), n("VIÑEDOS"), n("Ðandú"), n("São Pão"), n("")) == ["VIÑEDOS DE SAN JOSE", "VIÑEDOS", "ÑANDU", "S O P O", ""]
    assert values(spark, S.search_key(F.lit("Ñandú  José")), S.search_key(F.lit("Ñ"))) == ["NANDU JOSE", "N"]
    t = S.split_type(F.lit("FRACCIONAMIENTO LOMAS"))
    assert values(spark, t["type"], t["base"], S.split_type(F.lit("LOMAS"))["type"]) == ["FRACCIONAMIENTO", "LOMAS", ""]
    assert values(spark, S.canon(F.lit("LOMAS 1RA SECC")), S.canon(F.lit("LOMAS SEGUNDA ETAPA")), S.canon(F.lit("LOMAS III"))) == ["LOMAS SECCION 1", "LOMAS ETAPA 2", "LOMAS 3"]
    assert values(spark, S.strip_section(F.lit("LOMAS SECCION 2")), S.strip_section(F.lit("LOMAS 2")), S.slug(F.lit("LOMAS DE LA LUZ"))) == ["LOMAS", "LOMAS", "LOMASLUZ"]
    assert len(S._ACCENTED) == len(S._PLAIN)


def test_numbers(spark):
    assert values(spark, S.to_number(F.lit("*")), S.to_number(F.lit(" 12.5 ")), S.ratio(F.lit(1.0), F.lit(0.0)), S.vacancy_pct(F.lit(1.0), F.lit(8.0))) == [None, 12.5, None, 12.5]
    assert values(spark, S.tract_key(F.lit("1"), F.lit("5"), F.lit("12345"), F.lit("7"))) == ["01005123450007"]
    assert values(spark, S.round_js(F.lit(2.5)), S.round_py(F.lit(2.5)), S.falsy_to_null(F.lit("")), S.falsy_to_null(F.lit(0.0))) == [3.0, 2.0, None, None]


def test_classes(spark):
    tl = lambda s, f, c=False: S.traffic_level(F.lit(s), F.lit(f), F.lit(c))
    assert values(spark, tl(90.0, 100.0), tl(89.0, 100.0), tl(70.0, 100.0), tl(40.0, 100.0), tl(39.0, 100.0), tl(5.0, 0.0), tl(90.0, 100.0, True)) == ["Fluido", "Lento", "Lento", "Congestionado", "Detenido", "Sin dato", "Vía cerrada"]
    assert values(spark, S.price_zone(F.lit(-102.2958), F.lit(21.8794)), S.price_zone(F.lit(-102.2958), F.lit(21.95)), S.price_zone(F.lit(-102.2), F.lit(21.8794))) == ["Centro", "Norte", "Oriente"]
    assert values(spark, S.monthly_payment(F.lit(1200.0), F.lit(0.0), F.lit(10))) == [10.0]
    assert values(spark, S.time_bands(F.lit(15.0)), S.car_budget_s(F.lit(15.0))) == [[5, 10, 15], 720]


@pytest.mark.parametrize("lon,lat,x,y", [(-102.2961, 21.8830, 779402.613, 2422335.259), (-102.3252, 21.8560, 776446.067, 2419291.742), (-102.0, 22.4, 808887.441, 2480185.952), (-102.9, 21.6, 717402.119, 2390020.739)])
def test_utm(spark, lon, lat, x, y):
    u = S.to_utm13(F.lit(lon), F.lit(lat))
    a, b = values(spark, u["x"], u["y"])
    assert abs(a - x) < 0.001 and abs(b - y) < 0.001


def test_utm_range(spark):
    assert values(spark, S.to_utm13(F.lit(2.3), F.lit(21.0))) == [None]


def test_circle(spark):
    g = G.circle_ring(F.lit(21.948892601256567), F.lit(-102.29632586250825), F.lit(3.0))
    km2, n = values(spark, G.spherical_area_km2(g), F.size(g["rings"][0]["xs"]))
    assert round(km2, 2) == 28.32 and n == 97


def test_rings(spark):
    square = G.rectangle(F.lit(-102.3), F.lit(21.8), F.lit(-102.2), F.lit(21.9))
    o = G.orient_rings(square)
    assert values(spark, G.signed_area(o["rings"][0]) > 0)[0]
    assert 100 < values(spark, G.area_m2(square, S.to_utm13))[0] / 1e6 < 130
    ring = F.struct(F.lit(0).alias("part"), F.lit(True).alias("hole"), F.array(*map(F.lit, (0.0, 1.0, 1.0))).alias("xs"), F.array(*map(F.lit, (0.0, 0.0, 1.0))).alias("ys"))
    hole = G.orient_rings(G.geometry_of(F.array(ring)))
    closed, area = values(spark, F.size(hole["rings"][0]["xs"]), G.signed_area(hole["rings"][0]))
    assert closed == 4 and area < 0
    with pytest.raises(Exception, match="not finite"):
        bad = F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), F.array(F.lit(float("nan"))).alias("xs"), F.array(F.lit(0.0)).alias("ys"))
        values(spark, G.geometry_of(F.array(bad)))
