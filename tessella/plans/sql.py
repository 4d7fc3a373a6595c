"""DuckDB SQL for the queries that SQL can say, on the same tables and the same formulas of keys."""

from __future__ import annotations

import math

from tessella.functions import scalars as S
from tessella.operators.zones import METRICS
from tessella.plans.adapters import HIGH, SOUTH, WEST, WIDE

R2 = "6378.137 * 6378.137"


def lon(k: str) -> str:
    return f"({WEST} + (({k}) * 7919) % 10007 / 10007.0::DOUBLE * {WIDE}::DOUBLE)"


def lat(k: str) -> str:
    return f"({SOUTH} + (({k}) * 104729) % 10009 / 10009.0::DOUBLE * {HIGH}::DOUBLE)"


def pick(names: list, n: str) -> str:
    return f"([{', '.join(repr(x) if isinstance(x, str) else str(x) for x in names)}])[({n}) % {len(names)} + 1]"


def cases(pairs, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {last} END"


def haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    return f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2)))))"


def price_zone(o: str, a: str) -> str:
    x, y = f"(({o} - {S.CENTRE_LON}) * cos(radians({S.CENTRE_LAT})) * 111.32)", f"(({a} - {S.CENTRE_LAT}) * 110.57)"
    b = f"fmod(degrees(atan2({x}, {y})) + 360, 360)"
    return cases([(f"sqrt({x} * {x} + {y} * {y}) < 1.7", "'Centro'"), *[(f"{b} < {upto}", f"'{n}'") for upto, n in S.ZONE_SECTORS]], "'Norte'")


def level_of(p: str) -> str:
    return cases([(f"{p} >= {c}", f"'{n}'") for n, c in S.LEVELS], "'E'")


BUSINESSES = f"""businesses AS (SELECT o_orderkey AS id, {lon('o_orderkey')} AS lon, {lat('o_orderkey')} AS lat,
  {pick(['Educación', 'Salud', 'Abasto', 'Bancos', 'Parques', 'Gasolineras'], 'o_orderkey * 31 % 97')} AS category,
  {pick(['46', '72', '81', '62', '61', '54', '31', '43', '71', '11'], 'o_orderkey * 17 % 101')} AS sector,
  'act ' || (o_orderkey * 13 % 7) AS nombre_act,
  {pick(['0 a 5 personas', '6 a 10 personas', '31 a 50 personas', '251 y más personas'], 'o_orderkey * 11 % 89')} AS per_ocu FROM orders)"""


def tiles(name: str, key: str, as_: str, shift: float = 0.0) -> str:
    g = f"(SELECT ceil(sqrt(count(*)))::BIGINT FROM {name})"
    return f"""{as_} AS (SELECT *, {key} AS gid, {WEST + shift} + ({key} % {g}) * ({WIDE}::DOUBLE / {g}) AS x1, {SOUTH + shift} + ({key} // {g}) * ({HIGH}::DOUBLE / {g}) AS y1,
  {WEST + shift} + ({key} % {g} + 1) * ({WIDE}::DOUBLE / {g}) AS x2, {SOUTH + shift} + ({key} // {g} + 1) * ({HIGH}::DOUBLE / {g}) AS y2 FROM {name})"""


def unless(n: int, v: str, k: str = "s_suppkey") -> str:
    return f"CASE WHEN {k} % {n} <> 0 THEN ({v})::DOUBLE END"


TRACTS = f"""{tiles('supplier', 's_suppkey', 'st')}, tracts AS (SELECT gid, x1, y1, x2, y2, '0100' || s_suppkey AS CVEGEO, {unless(11, '200 + s_suppkey * 37 % 4801')} AS POBTOT, {unless(13, '90 + s_suppkey * 19 % 2203')} AS POBFEM,
  (50 + s_suppkey * 7 % 1409)::DOUBLE AS TVIVPARHAB, {unless(17, '5 + s_suppkey * 29 % 131 / 10.0::DOUBLE')} AS GRAPROES, {unless(7, 's_suppkey * 41 % 1009 / 10.09::DOUBLE')} AS pct_inter,
  s_suppkey * 23 % 907 / 9.07::DOUBLE AS pct_2dorm, {unless(5, 's_suppkey * 3 % 701 / 7.01::DOUBLE')} AS pct_3cuart, s_acctbal / 10000 AS nse_score,
  {pick(['A/B', 'C+', 'C', 'C-', 'D+', 'D', 'E'], 's_suppkey * 5 % 7')} AS nse_nivel FROM st)"""
ZONES = f"""z0 AS (SELECT c_custkey AS zone_id, {lon('c_custkey')} AS lng, {lat('c_custkey')} AS lat, (c_custkey % 5 + 1) * 0.1::DOUBLE AS radius_km, (c_custkey % 6 + 1) * 0.002::DOUBLE AS half FROM customer),
zones AS (SELECT *, lng - half AS zx1, lat - half AS zy1, lng + half AS zx2, lat + half AS zy2 FROM z0)"""
COLONIAS = f"{tiles('part', 'p_partkey', 'colonias0', 0.00037)}, colonias AS (SELECT *, CASE WHEN p_partkey % 8 <> 0 THEN p_retailprice * 3.07::DOUBLE END AS valor_m2, p_type AS TIPO, p_brand AS municipio FROM colonias0)"


def area(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(radians({x2} - {x1}) * (sin(radians({y2})) - sin(radians({y1}))) * {R2})"


BOX = ("greatest(zx1, x1)", "greatest(zy1, y1)", "least(zx2, x2)", "least(zy2, y2)")
MEET = "zx1 < x2 AND x1 < zx2 AND zy1 < y2 AND y1 < zy2"
OVERLAP = f"rows AS (SELECT zones.zone_id, tracts.*, {area(*BOX)} AS km2, {area(*BOX)} / {area('x1', 'y1', 'x2', 'y2')} AS frac FROM zones JOIN tracts ON {MEET})"
RANK = cases([(f"level = '{n}'", str(i)) for i, n in enumerate(S.LEVEL_ORDER)], "99")


def wmean(v: str, w: str) -> str:
    return f"sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {v} * {w} * frac END) / sum(CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN {w} * frac END)"


DEMOGRAPHICS = f"""WITH {TRACTS}, {ZONES}, {OVERLAP},
levels AS (SELECT zone_id, nse_nivel AS level, sum(coalesce(POBTOT, 0) * frac) AS p FROM rows GROUP BY ALL),
best AS (SELECT zone_id, level FROM (SELECT *, sum(p) OVER (PARTITION BY zone_id) AS total, row_number() OVER (PARTITION BY zone_id ORDER BY p DESC, {RANK}) AS r FROM levels) WHERE r = 1 AND total > 0)
SELECT rows.zone_id, count(*) AS tracts, round(sum(coalesce(POBTOT, 0) * frac), 3) AS pobtot, round(sum(coalesce(POBFEM, 0) * frac), 3) AS pobfem, round(sum(coalesce(TVIVPARHAB, 0) * frac), 3) AS tvivparhab,
  round({wmean('GRAPROES', 'POBTOT')}, 3) AS graproes, round({wmean('pct_inter', 'TVIVPARHAB')}, 3) AS pct_inter, best.level AS level FROM rows LEFT JOIN best USING (zone_id) GROUP BY rows.zone_id, best.level"""

LANDUSE = f"""{tiles('part', 'p_partkey', 'landuse0')}, landuse AS (SELECT gid, x1, y1, x2, y2, {pick(['Habitacional', 'Mixto', 'Industrial', 'Especial'], 'p_partkey * 5 % 31')} AS grupo, {pick(['PA', 'PB'], 'p_partkey * 3 % 7')} AS programa FROM landuse0 WHERE p_partkey % 9 <> 4)"""
BANDS = f"""b0 AS (SELECT n_nationkey::BIGINT AS zone_id, {lon('n_nationkey * 41')} AS lng, {lat('n_nationkey * 43')} AS lat, b AS band_idx, (b + 1) * 0.013::DOUBLE AS h FROM nation, range(3) r(b)),
bands AS (SELECT zone_id, band_idx, ((band_idx + 1) * 5)::INT AS minutes, lng - h AS zx1, lat - h AS zy1, lng + h AS zx2, lat + h AS zy2 FROM b0)"""
SMALLEST = f"WITH {BUSINESSES}, {BANDS}, hits AS (SELECT zone_id, id, min(band_idx)::INT AS band_idx, min(minutes)::INT AS minutes FROM bands JOIN businesses ON lon BETWEEN zx1 AND zx2 AND lat BETWEEN zy1 AND zy2 GROUP BY ALL)"

CENSUS = f"""raw AS (SELECT c_custkey AS k, {pick(['1', '5', '9'], 'c_custkey')} AS mun FROM customer WHERE c_custkey % 7 <> 3), c AS (
  SELECT '01' || lpad(mun, 3, '0') || lpad((k % 50)::VARCHAR, 4, '0') || CASE WHEN length(k::VARCHAR) < 4 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS CVEGEO,
  CASE WHEN k % 19 <> 0 THEN (100 + k * 37 % 3001)::DOUBLE END AS pobtot, CASE WHEN k % 23 <> 0 THEN (20 + k * 11 % 701)::DOUBLE END AS p0, CASE WHEN k % 1009 <> 0 THEN (k * 3 % 97)::DOUBLE END AS p15, CASE WHEN k % 1013 <> 0 THEN (k * 5 % 101)::DOUBLE END AS p18, CASE WHEN k % 29 <> 0 THEN (k * 7 % 211)::DOUBLE END AS p60,
  CASE WHEN k % 31 <> 0 THEN (30 + k * 13 % 907)::DOUBLE END AS viv, CASE WHEN k % 17 <> 0 THEN round(4 + c_acctbal / 1000, 2) END AS esc, CASE WHEN k % 37 <> 0 THEN round(k * 9 % 301 / 100.0::DOUBLE, 2) END AS ocup,
  CASE WHEN k % 11 <> 0 THEN (k * 2 % 29)::DOUBLE END AS i0, CASE WHEN k % 997 <> 0 THEN (k * 4 % 23)::DOUBLE END AS p_0, CASE WHEN k % 991 <> 0 THEN (k * 6 % 27)::DOUBLE END AS a0, CASE WHEN k % 983 <> 0 THEN (k * 8 % 25)::DOUBLE END AS s0
  FROM raw JOIN customer ON k = c_custkey WHERE mun IN ('1', '5')),
d AS (SELECT *, i0 / viv AS inter, p_0 / viv AS pc, a0 / viv AS auto_, s0 / viv AS serv FROM c),
n AS (SELECT *, {' + '.join(f"{w} * coalesce(({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ()), 0.5)" for v, w in (('esc', 0.25), ('inter', 0.20), ('pc', 0.15), ('auto_', 0.15), ('serv', 0.15), ('ocup', -0.10)))} AS raw_score FROM d),
s AS (SELECT *, round_even((raw_score - min(raw_score) OVER ()) / (max(raw_score) OVER () - min(raw_score) OVER ()), 4) AS nse_score FROM n),
ranked AS (SELECT *, (rank() OVER (ORDER BY nse_score) - 1 + (count(*) OVER (PARTITION BY nse_score) + 1) / 2) / count(*) OVER () * 100 AS pct FROM s)"""

POPULATION = "pop AS (SELECT l_returnflag AS municipio, year(l_shipdate)::INT AS anio, sum(l_quantity)::BIGINT AS pob FROM lineitem GROUP BY ALL)"
INDEX = """idx AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'nacional' WHEN 'F' THEN 'estado' ELSE 'municipio' END AS clave, year(o_orderdate)::INT AS anio, quarter(o_orderdate)::INT AS trimestre,
  round(sum(round(o_totalprice * 100)::BIGINT) / count(*) / 10000, 2) AS indice FROM orders GROUP BY ALL),
yoy AS (SELECT a.clave, a.anio, a.trimestre, a.indice, (a.indice / b.indice - 1) * 100 AS pct FROM idx a LEFT JOIN idx b ON a.clave = b.clave AND a.anio = b.anio + 1 AND a.trimestre = b.trimestre)"""

VALUES = f"""v0 AS (SELECT {pick(['Aguascalientes', 'Jesús María'], 'p_partkey % 11')} AS municipio, p_partkey AS pos, (p_partkey % 9)::VARCHAR AS sector,
  trim({pick(['COLONIA ', '', 'FRACCIONAMIENTO '], 'p_partkey * 3 % 29')} || upper(p_name) || {pick(['', ' PRIMERA SECCION', ' SECCION 2'], 'p_partkey * 5 % 31')}) AS name, p_retailprice AS value FROM part),
vals AS (SELECT municipio, name, arg_min(sector, pos) AS sector, min(pos) AS pos, round_even(avg(CASE WHEN municipio = 'Aguascalientes' THEN floor(value) ELSE value END), 0)::BIGINT AS value FROM v0 WHERE value >= 100 GROUP BY municipio, name)"""

WORD = "[A-ZÑ0-9]"
SECTION = "|".join(S.SECTIONS)


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return squeezed(f"regexp_replace(translate(upper({x}), 'ÁÉÍÓÚ', 'AEIOU'), '[^A-ZÑ0-9 ]', ' ', 'g')")


def by_word(x: str, of: str) -> str:
    """Words of a name (single spaces) each as the expression `of` of w."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {of}), ' ')"


def canon(x: str) -> str:
    ordinals = cases([(f"w IN ({', '.join(map(repr, words))})", f"'{d}'") for d, words in S.ORDINALS.items()], "w")
    return squeezed(f"regexp_replace({by_word(by_word(x, 'CASE WHEN w = ' + repr('SECC') + ' THEN ' + repr('SECCION') + ' ELSE w END'), ordinals)}, '(^| )([0-9]) ({SECTION})( |$)', '\\1\\3 \\2\\4', 'g')")


def bare(x: str) -> str:
    return squeezed(f"regexp_replace(regexp_replace({x}, '(^| )({SECTION})( ?[0-9]+)?( |$)', ' ', 'g'), '\\s+[0-9]+$', '')")


def slug(x: str) -> str:
    return f"replace({by_word(x, 'CASE WHEN w IN (' + ', '.join(map(repr, S.CONNECTIVES)) + ') THEN ' + repr('') + ' ELSE w END')}, ' ', '')"


def leading(x: str) -> tuple[str, str]:
    """(type, base) of a name."""
    hits = [(f"starts_with({x}, '{t} ')", t) for t in S.SETTLEMENT_TYPES]
    return cases([(c, f"'{t}'") for c, t in hits], "''"), cases([(c, f"substr({x}, {len(t) + 2})") for c, t in hits], x)


NAMED = f"""p AS (SELECT p_partkey AS gid, {pick(['', 'Colonia ', 'Fraccionamiento ', 'unidad habitacional ', 'Zona ', 'Barrio de la '], 'p_partkey * 3 % 103')} || replace(replace(p_name, 'o', 'ó'), 'ng', 'ñg') || {pick(['', ' 1RA SECC', ' segunda sección', ' 2 SECCION', ' III ETAPA', ' sector 4'], 'p_partkey * 7 % 101')} AS name FROM part),
n AS (SELECT gid, name, {norm('name')} AS norm FROM p), t AS (SELECT *, {leading('norm')[0]} AS type, {leading('norm')[1]} AS base FROM n), c AS (SELECT *, {canon('base')} AS canon FROM t)"""
WORDS = ["small ring", "red widget", "blue bolt", "hot gear", "red rings", "blu bolt", "plaza nueva", "small ringe"]
POLYGONS = f"""polys AS (SELECT c_custkey AS gid, {pick(['Aguascalientes', 'Jesús María'], 'c_custkey')} AS municipio, {pick(['COLONIA', 'FRACCIONAMIENTO', 'BARRIO'], 'c_custkey * 7 % 13')} AS tipo, {pick(WORDS, 'c_custkey * 11 % 37')} || {pick(['', ' 1a secc', ' sección 2', ' III etapa'], 'c_custkey * 3 % 17')} AS nom FROM customer),
q AS (SELECT gid, municipio, tipo, {norm('nom')} AS nom, {canon(norm('nom'))} AS cn FROM polys), q2 AS (SELECT *, {bare('cn')} AS ss FROM q),
asks AS (SELECT gid, municipio, unnest([{{'turn': 0, 'm': 0, 'level': 0, 'key': tipo || ' ' || nom}}, {{'turn': 1, 'm': 1, 'level': 1, 'key': nom}}, {{'turn': 2, 'm': 2, 'level': 2, 'key': cn}}, {{'turn': 3, 'm': 2, 'level': 2, 'key': replace(cn, ' ', '')}},
  {{'turn': 4, 'm': 3, 'level': 3, 'key': ss}}, {{'turn': 5, 'm': 3, 'level': 1, 'key': ss}}, {{'turn': 6, 'm': 3, 'level': 2, 'key': ss}}, {{'turn': 7, 'm': 4, 'level': 4, 'key': {slug('cn')}}}, {{'turn': 8, 'm': 4, 'level': 4, 'key': {slug('ss')}}}], recursive := true) FROM q2)"""
KEYS = f"""k0 AS (SELECT *, {leading('name')[1]} AS base FROM vals), k1 AS (SELECT *, {canon('base')} AS cb FROM k0), k2 AS (SELECT *, {bare('cb')} AS ss FROM k1),
k3 AS (SELECT municipio, pos, sector, value, unnest([{{'level': 0, 'key': name}}, {{'level': 1, 'key': base}}, {{'level': 2, 'key': cb}}, {{'level': 2, 'key': replace(cb, ' ', '')}}, {{'level': 3, 'key': CASE WHEN ss <> cb THEN ss END}}, {{'level': 4, 'key': {slug('cb')}}}, {{'level': 4, 'key': {slug('ss')}}}], recursive := true) FROM k2),
keys AS (SELECT municipio, level, key, round_even(avg(value), 0)::BIGINT AS value, arg_min(sector, pos) AS sector FROM k3 WHERE key <> '' GROUP BY ALL)"""
ELEMENTS = f"""e0 AS (SELECT o_orderkey AS k, {pick(['school', 'clinic', 'bank', 'fuel', 'cafe'], 'o_orderkey * 3 % 7')} AS v FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 3 <> 0),
osm AS (SELECT k AS id, round({lat('k % 3001')}, 6) AS lat, round({lon('k % 3001')}, 6) AS lon, CASE v WHEN 'school' THEN 'Educación' WHEN 'clinic' THEN 'Salud' WHEN 'bank' THEN 'Bancos' ELSE 'Gasolineras' END AS category, 'amenity=' || v AS kind,
  CASE WHEN k % 4 = 0 THEN 'lugar ' || (k % 5) ELSE category || ' sin nombre' END AS name FROM e0 WHERE v <> 'cafe')"""


def utm_13(o: str, a: str) -> str:
    """x and y columns of UTM 13 (WGS 84) by the usual series."""
    e2 = "(2 / 298.257223563::DOUBLE - pow(1 / 298.257223563::DOUBLE, 2))"
    return f"""u0 AS (SELECT *, radians({a}) AS phi, radians({o} + 105) AS dl, {e2} AS q, {e2} / (1 - {e2}) AS ep FROM src),
u1 AS (SELECT *, 6378137 / sqrt(1 - q * pow(sin(phi), 2)) AS nu, pow(tan(phi), 2) AS t, ep * pow(cos(phi), 2) AS c, dl * cos(phi) AS w,
  6378137 * ((1 - q / 4 - 3 * q * q / 64 - 5 * pow(q, 3) / 256) * phi - (3 * q / 8 + 3 * q * q / 32 + 45 * pow(q, 3) / 1024) * sin(2 * phi) + (15 * q * q / 256 + 45 * pow(q, 3) / 1024) * sin(4 * phi) - 35 * pow(q, 3) / 3072 * sin(6 * phi)) AS m FROM u0),
utm AS (SELECT *, 500000 + 0.9996::DOUBLE * nu * (w + (1 - t + c) * pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(w, 5) / 120) AS east,
  0.9996::DOUBLE * (m + nu * tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(w, 6) / 720)) AS north FROM u1)"""


SQL: dict[str, str] = {
    "scalar_numbers": """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 500)::DOUBLE END AS n FROM customer)
SELECT k AS id, '01' || lpad((k % 11)::VARCHAR, 3, '0') || CASE WHEN length(k::VARCHAR) < 4 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END || '00A' || (k % 7) AS key, n,
  round(n / nullif(7.0 * (k % 3), 0), 6) AS ratio, round_even(n / nullif((k % 5 * 131)::DOUBLE, 0) * 100, 1) AS vacancy, nullif(n, 0) AS official, round(n / 4, 0) AS up, round_even(n / 4, 0) AS even FROM t""",
    "scalar_classes": f"""WITH t AS (SELECT s_suppkey AS k, s_acctbal AS v, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS w, (s_suppkey * 7 % 90 + 10)::VARCHAR AS code FROM supplier)
SELECT k AS id, {cases([(f"code = '{c}'", f"'{n}'") for c, n in S.SECTOR_CATEGORIES.items()], "'Otros'")} AS category,
  {pick(['Habitacional', 'Mixto', 'Comercial / Servicios', 'Agropecuario', 'Industrial', 'Conservación / Ecológico', 'Crecimiento futuro', 'Especial', 'Otro'], 'k')} AS grupo, {price_zone(lon('k'), lat('k'))} AS zona,
  CASE WHEN w IS NULL THEN 'sin dato' WHEN w >= 8000 THEN 'alto' WHEN w >= 4000 THEN 'medio' WHEN w >= 1000 THEN 'bajo' ELSE 'minimo' END AS class_a,
  CASE WHEN w >= 8000 THEN 'alto' WHEN w >= 4000 THEN 'medio' WHEN w >= 1000 THEN 'bajo' ELSE 'minimo' END AS class_b,
  CASE WHEN k % 30 < 8 THEN 'few' WHEN k % 10 / 10.0 > 0.35 THEN 'industrial' WHEN k % 7 / 7.0 > 0.5 AND k % 30 < 20 THEN 'single: giro' END AS reason,
  CASE WHEN round(v, 0) > round(10000 - v, 0) THEN '▲' WHEN round(v, 0) < round(10000 - v, 0) THEN '▼' ELSE '→' END AS trend FROM t""",
    "scalar_money_time": """WITH t AS (SELECT o_orderkey AS k, o_totalprice + 0.0123::DOUBLE AS c, (o_orderkey % 13)::DOUBLE / 1200 AS r, (o_orderkey % 4 + 1) * 60 AS n FROM orders),
p AS (SELECT k, CASE WHEN r = 0 THEN c / n ELSE c * r * pow(1 + r, n) / (pow(1 + r, n) - 1) END AS pay FROM t)
SELECT k AS id, round(pay, 2) AS payment, round(pay / 0.30::DOUBLE, 2) AS income, round((k % 50 + 10)::DOUBLE * 1 / 3)::INT AS band_1, round((k % 50 + 10)::DOUBLE * 2 / 3)::INT AS band_2, round((k % 50 + 10)::DOUBLE * 3 / 3)::INT AS band_3,
  round((k % 61)::DOUBLE * 60 / 1.25)::INT AS budget_s FROM p""",
    "traffic_levels": """WITH t AS (SELECT event_id AS id, value AS v, (props->>'$.k')::DOUBLE AS f, event_type FROM events)
SELECT id, CASE WHEN event_type = 'error' THEN 'Vía cerrada' WHEN f IS NULL OR f = 0 THEN 'Sin dato' WHEN v / f >= 0.9 THEN 'Fluido' WHEN v / f >= 0.7 THEN 'Lento' WHEN v / f >= 0.4 THEN 'Congestionado' ELSE 'Detenido' END AS nivel, round(v * 2 - f * 2, 4) AS demora FROM t""",
    "circle_areas": f"""WITH {ZONES}, steps AS (SELECT unnest(range(97)) AS i), p AS (SELECT zone_id, i, lng, radians(lat) AS phi, radius_km / 6371.0088 AS d, -2 * pi() / 96 * (i % 96) AS b FROM zones, steps),
q AS (SELECT zone_id, i, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b)) AS y, radians(lng) + atan2(sin(b) * sin(d) * cos(phi), cos(d) - sin(phi) * (sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b))) AS x FROM p),
e AS (SELECT zone_id, x, (lead(x) OVER w - x) * (sin(y) + sin(lead(y) OVER w)) AS t FROM q WINDOW w AS (PARTITION BY zone_id ORDER BY i))
SELECT zone_id, round(abs(sum(t)) / 2 * {R2}, 6) AS km2, 97 AS points, true AS clockwise, round(degrees(max(x) - min(x)), 6) AS wide FROM e GROUP BY zone_id""",
    "census_index": f"WITH {CENSUS} SELECT CVEGEO, nse_score, {level_of('pct')} AS nse_nivel, pobtot - p0 - (p15 + p18) - p60 AS pob_25_59, round_even(inter * 100, 1) AS pct_inter FROM ranked",
    "census_joins": f"""WITH {CENSUS}, t AS (SELECT c_custkey AS k, '01' || lpad({pick(['1', '5', '9'], 'c_custkey')}, 3, '0') || lpad((c_custkey % 50)::VARCHAR, 4, '0') || CASE WHEN length(c_custkey::VARCHAR) < 4 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS CVEGEO, {price_zone(lon('c_custkey'), lat('c_custkey'))} AS zona FROM customer)
SELECT t.CVEGEO, coalesce({level_of('pct')}, 'S/D') AS nse_nivel_, nullif(k % 4, 0)::DOUBLE AS im, nullif({pick(['Alto', '', 'Bajo'], 'k')}, '') AS grado, zona, CASE zona WHEN 'Centro' THEN 26000 WHEN 'Norte' THEN 23000 WHEN 'Poniente' THEN 17000 WHEN 'Oriente' THEN 15000 WHEN 'Sur' THEN 18000 ELSE 20000 END AS precio_min, ranked.CVEGEO IS NULL AS missing FROM t LEFT JOIN ranked USING (CVEGEO)""",
    "population_series": f"WITH {POPULATION} SELECT municipio, min(anio) OVER (PARTITION BY municipio) AS anio_min, max(anio) OVER (PARTITION BY municipio) AS anio_max, anio, pob FROM pop",
    "population_context": f"""WITH {POPULATION}, s AS (SELECT municipio, max(anio) AS anio_fin, arg_max(pob, anio) AS last, max(CASE WHEN anio = 1997 THEN pob END) AS base FROM pop GROUP BY 1)
SELECT c_custkey AS zone_id, municipio, anio_fin, CASE WHEN base > 0 THEN round((last / base - 1) * 100, 1) END AS cambio_pct FROM customer JOIN s ON municipio = {pick(['A', 'N', 'R'], 'c_custkey')}""",
    "price_index_yoy": f"WITH {INDEX} SELECT clave, anio, trimestre, indice, round(pct, 3) AS pct FROM yoy",
    "price_index_latest": f"WITH {INDEX} SELECT clave, anio, trimestre, round(pct, 3) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY anio DESC, trimestre DESC) AS r FROM yoy) WHERE r = 1",
    "zone_demographics": DEMOGRAPHICS,
    "whole_tracts": f"""WITH {TRACTS}, {ZONES}, rows AS (SELECT zone_id, tracts.* FROM zones JOIN tracts ON {MEET}), levels AS (SELECT zone_id, nse_nivel AS level, sum(coalesce(POBTOT, 0)) AS p FROM rows GROUP BY ALL),
best AS (SELECT zone_id, level FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY p DESC, {RANK}) AS r FROM levels) WHERE r = 1)
SELECT zone_id, count(*) AS tracts, sum(coalesce(POBTOT, 0)) AS people, round(sum(CASE WHEN POBTOT > 0 THEN nse_score * POBTOT END) / sum(CASE WHEN POBTOT > 0 AND nse_score IS NOT NULL THEN POBTOT END), 4) AS score,
  round(avg(pct_2dorm), 4) AS pct_2dorm, round(avg(coalesce(pct_3cuart, 0)), 4) AS pct_3cuart, best.level AS level, sum((nse_nivel = 'C')::INT)::BIGINT AS tracts_c FROM rows JOIN best USING (zone_id) GROUP BY zone_id, best.level""",
    "value_stats": f"WITH {COLONIAS}, {ZONES} SELECT zone_id, count(valor_m2) AS n, round(min(valor_m2), 4) AS least, round(median(valor_m2), 4) AS med, round(max(valor_m2), 4) AS most FROM zones JOIN colonias ON {MEET} WHERE valor_m2 IS NOT NULL GROUP BY zone_id",
    "value_stats_drawn": f"""WITH {COLONIAS}, {ZONES}, v AS (SELECT zone_id, valor_m2 FROM zones JOIN colonias ON (x1 + x2) / 2 >= zx1 AND (x1 + x2) / 2 < zx2 AND y1 + (y2 - y1) * 0.5::DOUBLE >= zy1 AND y1 + (y2 - y1) * 0.5::DOUBLE < zy2 WHERE valor_m2 IS NOT NULL)
SELECT zone_id, count(*)::INT AS n, round(list_sort(list(valor_m2))[(count(*) // 2 + 1)], 4) AS med, ((2 * sum(floor(valor_m2 * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT) + count(*) * 1000000) // (2000000 * count(*)))::BIGINT AS mean FROM v GROUP BY zone_id""",
    "top_values": f"WITH {COLONIAS}, {ZONES} SELECT zone_id, rank::INT AS rank, gid, round(valor_m2, 4) AS valor_m2 FROM (SELECT zone_id, gid, valor_m2, row_number() OVER (PARTITION BY zone_id ORDER BY coalesce(valor_m2, 0) DESC, gid) AS rank FROM zones JOIN colonias ON {MEET}) WHERE rank <= 12",
    "landuse_shares": f"""WITH {LANDUSE}, {ZONES}, o AS (SELECT zone_id, grupo, programa, {area(*BOX)} AS km2 FROM zones JOIN landuse ON {MEET}), a AS (SELECT zone_id, {area('zx1', 'zy1', 'zx2', 'zy2')} AS area FROM zones),
w AS (SELECT zone_id, sum(km2) AS zoned FROM o GROUP BY 1), p AS (SELECT zone_id, grupo, programa, sum(km2) AS km2 FROM o GROUP BY ALL UNION ALL SELECT zone_id, grupo, '-', sum(km2) FROM o GROUP BY ALL)
SELECT zone_id, grupo, programa, round(km2 / area * 100, 3) AS pct, round(km2 / zoned * 100, 3) AS pct_zoned FROM p JOIN w USING (zone_id) JOIN a USING (zone_id)
UNION ALL SELECT zone_id, '-', '-', round(greatest(0, 100 - zoned / area * 100), 3), round(greatest(0, 100 - zoned / area * 100), 3) FROM w JOIN a USING (zone_id)""",
    "zone_poi_counts": f"""WITH {BUSINESSES}, {ZONES}, cats AS (SELECT unnest({list(S.POI_CATEGORIES)}) AS category),
hits AS (SELECT zone_id, category, count(*) AS k FROM zones JOIN businesses ON abs(businesses.lat - zones.lat) < 0.006 AND {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} <= radius_km GROUP BY ALL)
SELECT zone_id, category, coalesce(k, 0) AS n FROM zones CROSS JOIN cats LEFT JOIN hits USING (zone_id, category)""",
    "zone_nearest": f"""WITH {BUSINESSES}, {ZONES}, hits AS (SELECT zone_id, id, round({haversine('zones.lat', 'lng', 'businesses.lat', 'lon')}, 6) AS dist_km FROM zones JOIN businesses ON abs(businesses.lat - zones.lat) < 0.006 AND {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} <= radius_km)
SELECT zone_id, rank::INT AS rank, id, dist_km FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY dist_km, id) AS rank FROM hits) WHERE rank <= 15""",
    "points_in_tracts": f"WITH {BUSINESSES}, {TRACTS} SELECT id, min(gid) AS gid FROM businesses JOIN tracts ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2 GROUP BY id",
    "gap_points": f"""WITH {BUSINESSES}, {TRACTS}, {COLONIAS} SELECT id FROM businesses b WHERE NOT EXISTS (SELECT 1 FROM tracts WHERE gid % 3 <> 1 AND b.lon >= x1 AND b.lon < x2 AND b.lat >= y1 AND b.lat < y2)
  AND EXISTS (SELECT 1 FROM colonias WHERE gid % 4 <> 2 AND b.lon >= x1 AND b.lon < x2 AND b.lat >= y1 AND b.lat < y2)""",
    "colonia_levels": f"WITH {TRACTS}, {COLONIAS} SELECT c.gid, coalesce(min(t.nse_nivel), '—') AS nivel FROM colonias c LEFT JOIN tracts t ON (c.x1 + c.x2) / 2 BETWEEN t.x1 AND t.x2 AND (c.y1 + c.y2) / 2 BETWEEN t.y1 AND t.y2 GROUP BY c.gid",
    "smallest_band": f"{SMALLEST} SELECT * FROM hits",
    "reach_counts": f"""{SMALLEST}, h AS (SELECT zone_id, category, band_idx, count(*) AS k FROM hits JOIN businesses USING (id) GROUP BY ALL), g AS (SELECT b.zone_id, b.band_idx, c.category FROM bands b JOIN (SELECT DISTINCT zone_id, category FROM h) c USING (zone_id))
SELECT g.zone_id, g.band_idx::INT AS band_idx, g.category, coalesce(sum(k), 0)::BIGINT AS n FROM g LEFT JOIN h ON g.zone_id = h.zone_id AND g.category = h.category AND h.band_idx <= g.band_idx GROUP BY ALL""",
    "reachable_projects": f"{SMALLEST} SELECT zone_id, rank::INT AS rank, id, minutes FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY minutes, id) AS rank FROM hits) WHERE rank <= 24",
    "ring_bands": f"""WITH {BANDS}, a AS (SELECT *, {area('zx1', 'zy1', 'zx2', 'zy2')} AS full_km2 FROM bands)
SELECT a.zone_id, a.band_idx::INT AS band_idx, a.minutes, round(a.full_km2 - coalesce(b.full_km2, 0), 5) AS km2, round(a.full_km2, 5) AS full_km2 FROM a LEFT JOIN a b ON a.zone_id = b.zone_id AND a.band_idx = b.band_idx + 1""",
    "nearest_segment": f"""WITH {BUSINESSES}, {ZONES}, h AS (SELECT zone_id, id, {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} AS d FROM zones JOIN businesses ON abs(businesses.lat - zones.lat) < 0.003 AND {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} <= 0.25)
SELECT zone_id, id AS seg_id, round(d * 1000, 3) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY d, id) AS r FROM h) WHERE r = 1""",
    "viewport_points": f"""WITH {BUSINESSES}, v AS (SELECT c_custkey AS view_id, {lat('c_custkey')} AS a, {lon('c_custkey')} AS o FROM customer),
h AS (SELECT view_id, id FROM v JOIN businesses ON lat BETWEEN (a - 0.004) - ((a + 0.004) - (a - 0.004)) * 0.1 AND (a + 0.004) + ((a + 0.004) - (a - 0.004)) * 0.1 AND lon BETWEEN (o - 0.004) - ((o + 0.004) - (o - 0.004)) * 0.1 AND (o + 0.004) + ((o + 0.004) - (o - 0.004)) * 0.1 AND category IN ('Salud', 'Abasto', 'Bancos'))
SELECT view_id, count(id) AS n, CASE WHEN count(id) <= 20 THEN count(id) ELSE -1 END::INT AS shown, CASE WHEN count(id) <= 20 THEN coalesce(min(id), -1) ELSE -1 END AS first_id FROM v LEFT JOIN h USING (view_id) GROUP BY view_id""",
    "erase": f"""WITH {TRACTS}, {COLONIAS}, o AS (SELECT t.gid, sum({area('greatest(t.x1, c.x1)', 'greatest(t.y1, c.y1)', 'least(t.x2, c.x2)', 'least(t.y2, c.y2)')}) AS km2 FROM tracts t JOIN colonias c ON TIPO = 'PROMO' AND t.x1 < c.x2 AND c.x1 < t.x2 AND t.y1 < c.y2 AND c.y1 < t.y2 GROUP BY 1)
SELECT t.gid, round({area('x1', 'y1', 'x2', 'y2')} - coalesce(km2, 0), 5) AS km2 FROM tracts t LEFT JOIN o USING (gid)""",
    "dissolve": f"WITH {COLONIAS} SELECT TIPO AS zona, round(sum({area('x1', 'y1', 'x2', 'y2')}), 4) AS km2 FROM colonias GROUP BY 1",
    "metric_rows": f"""WITH {TRACTS}, {ZONES}, {BUSINESSES}, {OVERLAP}, n AS (SELECT zone_id, count(*) AS k FROM rows GROUP BY 1),
h AS (SELECT zone_id, category, count(*) AS k FROM zones JOIN businesses ON abs(businesses.lat - zones.lat) < 0.006 AND {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} <= radius_km WHERE category IN ('Salud', 'Bancos') GROUP BY ALL)
SELECT zone_id, 'agebs_intersectadas' AS metrica, coalesce(k::VARCHAR, 's/d') AS valor, 'AGEBs' AS unidad FROM zones LEFT JOIN n USING (zone_id)
UNION ALL SELECT zones.zone_id, 'poi_' || lower(c), coalesce(k, 0)::VARCHAR, 'puntos' FROM zones CROSS JOIN (VALUES ('Salud'), ('Bancos')) v(c) LEFT JOIN h ON h.zone_id = zones.zone_id AND category = c""",
    "gis_layer": f"WITH {TRACTS}, {ZONES}, {OVERLAP} SELECT zone_id, CVEGEO, round(POBTOT, 0) AS POBTOT, round(GRAPROES, 2) AS ESCOLAR, round(round(frac, 4), 3) AS frac FROM rows",
    "collapsed_values": f"WITH {VALUES} SELECT municipio, name, sector, value FROM vals",
    "search": f"""WITH q0 AS (SELECT c_custkey AS query_id, upper({pick(['red', 'bolt', 'small ring', 'x', 'hot gear', 'nada'], 'c_custkey * 3 % 11')}) AS word, {pick(['', '', 'noise', 'noise'], 'c_custkey * 5 % 13')} AS noise, {pick(['', '', ' AGUASCALIENTES', ' JESUS MARIA'], 'c_custkey * 5 % 13')} AS tail FROM customer),
i AS (SELECT p_partkey AS item_id, upper(p_type || ' ' || p_name) AS key FROM part), a AS (SELECT query_id, item_id FROM q0 JOIN i ON length(word || tail) >= 2 AND contains(key, word || tail)),
b AS (SELECT query_id, item_id FROM q0 JOIN i ON noise = 'noise' AND length(word) >= 2 AND contains(key, word) WHERE query_id NOT IN (SELECT query_id FROM a)), h AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT query_id, rank::INT AS rank, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS rank FROM h) WHERE rank <= 8""",
    "category_counts": f"WITH {BUSINESSES} SELECT {cases([(f'sector = {chr(39)}{c}{chr(39)}', f'{chr(39)}{n}{chr(39)}') for c, n in S.SECTOR_CATEGORIES.items()], chr(39) + 'Otros' + chr(39))} AS category, count(*) AS n FROM businesses GROUP BY 1",
    "dictionary_codes": f"WITH {BUSINESSES} SELECT id, (dense_rank() OVER (ORDER BY nombre_act) - 1)::INT AS nombre_act_code, (dense_rank() OVER (ORDER BY length(per_ocu), per_ocu) - 1)::INT AS per_ocu_code FROM businesses",
    "business_mix": f"""WITH {BUSINESSES}, {TRACTS}, h AS (SELECT gid, businesses.* FROM businesses JOIN tracts ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2), a AS (SELECT gid, nombre_act, count(*) AS k FROM h GROUP BY ALL),
t AS (SELECT gid, nombre_act, k, sum(k) OVER (PARTITION BY gid) AS total, row_number() OVER (PARTITION BY gid ORDER BY k DESC, nombre_act) AS r FROM a)
SELECT gid, count(*) AS n, round(count(*) / 2.5, 4) AS density, round(avg((sector = '62')::INT), 6) AS pct_salud, round(avg((sector IN ('31', '32', '33'))::INT), 6) AS pct_industria, round(avg((per_ocu IN ('31 a 50 personas', '251 y más personas'))::INT), 6) AS pct_large,
  t.nombre_act AS top, round(t.k / t.total, 6) AS top_share FROM h JOIN t USING (gid) WHERE r = 1 GROUP BY gid, t.nombre_act, t.k, t.total""",
    "value_histogram": "SELECT (floor(o_totalprice / 1000) * 1000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1",
    "described_values": "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 3) AS mean, round(min(p_retailprice), 3) AS least, round(median(p_retailprice), 3) AS median, round(max(p_retailprice), 3) AS most, round(sum(p_retailprice), 3) AS total FROM part GROUP BY ALL",
    "landuse_union": f"""WITH t AS (SELECT p_partkey AS k, {pick(['A', 'B', 'C'], 'p_partkey')} AS programa, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey * 7 % 41) % 5 END AS u, p_size::DOUBLE AS h FROM part)
SELECT programa, {pick(['Habitacional', 'Mixto', '', 'Conservación / Ecológico', 'Mixto'], 'u')} AS grupo, count(*) AS n, sum(h) AS hectareas, sum((programa <> 'A')::INT)::BIGINT AS with_plan FROM t WHERE u IS NOT NULL AND u <> 2 GROUP BY ALL""",
    "totals_by_status": "SELECT coalesce(o_orderstatus, 'all') AS status, grouping(o_orderstatus)::INT AS is_total, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "terciles": "WITH c AS (SELECT quantile_cont(s_acctbal, 1 / 3) AS a, quantile_cont(s_acctbal, 2 / 3) AS b FROM supplier) SELECT s_suppkey, CASE WHEN s_acctbal >= b THEN 2 WHEN s_acctbal >= a THEN 1 ELSE 0 END::INT AS third FROM supplier, c",
    "compared_colonias": f"""WITH {TRACTS}, {COLONIAS}, l AS (SELECT c.gid, coalesce(min(t.nse_nivel), '—') AS nivel FROM colonias c LEFT JOIN tracts t ON (c.x1 + c.x2) / 2 BETWEEN t.x1 AND t.x2 AND (c.y1 + c.y2) / 2 BETWEEN t.y1 AND t.y2 GROUP BY 1)
SELECT municipio, rank::INT AS rank, gid, round(valor_m2, 4) AS valor_m2, nivel FROM (SELECT *, row_number() OVER (PARTITION BY municipio ORDER BY valor_m2 DESC, gid) AS rank FROM colonias WHERE valor_m2 IS NOT NULL) JOIN l USING (gid) WHERE rank <= 4""",
}
SQL |= {
    "scalar_names": f"WITH {NAMED}, b AS (SELECT *, {bare('canon')} AS bare FROM c) SELECT gid, norm, type, base, canon, bare, {slug('canon')} AS slug, {squeezed("translate(upper(name), 'ÁÉÍÓÚÑ', 'AEIOUN')")} AS search, CASE WHEN type = '' THEN '' ELSE type || ' ' END || base AS label, coalesce(nullif(trim(type), ''), 'sin tipo') AS shown FROM b",
    "cascade_match": f"WITH {VALUES}, {KEYS}, {POLYGONS}, h AS (SELECT gid, m, sector, value, row_number() OVER (PARTITION BY gid ORDER BY turn) AS r FROM asks JOIN keys USING (municipio, level, key)) SELECT gid, (['exacto', 'base', 'canon', 'sin_seccion', 'slug'])[m + 1] AS method, sector, value FROM h WHERE r = 1",
    "osm_points": f"WITH {ELEMENTS} SELECT id, lat, lon, category, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY round(lat, 5), round(lon, 5), category ORDER BY id) AS r FROM osm) WHERE r = 1",
    "osm_file": f"WITH {ELEMENTS} SELECT * FROM osm",
    "projections": f"""WITH src AS (SELECT c_custkey AS id, {lon('c_custkey')} AS lon, {lat('c_custkey')} AS lat FROM customer), {utm_13('lon', 'lat')}
SELECT id, round(east, 3) AS east, round(north, 3) AS north, round(lon, 7) AS lon, round(degrees(atan(sinh((2490000.0::DOUBLE + id) / 6378137))), 7) AS lat FROM utm""",
    "compared_set": SQL["compared_colonias"].split("SELECT municipio, rank")[0] + "SELECT municipio, gid, round(valor_m2, 4) AS valor_m2, nivel FROM colonias JOIN l USING (gid) WHERE gid IN (17, 3, 88, 5)",
    "reach_services": f"""{SMALLEST}, h AS (SELECT zone_id, category, count(*) AS n FROM hits JOIN businesses USING (id) GROUP BY ALL) SELECT zone_id, category, n, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, category)::INT AS rank FROM h""",
    "reach_projects": f"""{SMALLEST}, p AS (SELECT zone_id, minutes, 'obra ' || (id * 7 % 1009) || '/' || id AS nombre FROM hits WHERE id % 4 = 0) SELECT * FROM (SELECT zone_id, minutes, nombre, row_number() OVER (PARTITION BY zone_id ORDER BY minutes, nombre)::INT AS rank FROM p) WHERE rank <= 24""",
    "census_file": f"""SELECT {pick(['1', '5', '9'], 'c_custkey')} AS MUN, (c_custkey % 50)::VARCHAR AS LOC, c_custkey::VARCHAR AS AGEB, CASE WHEN c_custkey % 19 = 0 THEN '*' ELSE (100 + c_custkey * 37 % 3001)::VARCHAR END AS POBTOT, CASE WHEN c_custkey % 11 = 0 THEN '*' ELSE (c_custkey * 2 % 29)::VARCHAR END AS VPH_INTER,
  CASE WHEN c_custkey % 31 = 0 THEN '0' ELSE (30 + c_custkey * 13 % 907)::VARCHAR END AS TVIVPARHAB FROM customer WHERE c_custkey % 7 <> 3 AND c_custkey % 3 <> 2""",
    "business_snapshots": """SELECT o_orderkey AS id, 'Café "Ñandú" ' || o_orderkey AS nom_estab, strftime((SELECT max(o_orderdate) FROM orders), '%m/%Y') AS label FROM orders WHERE o_orderkey % 3 = 0""",
    "features_file": f"WITH {TRACTS} SELECT CVEGEO, POBTOT, nse_nivel, round({area('x1', 'y1', 'x2', 'y2')}, 6) AS km2, 1 AS rings FROM tracts",
    "features_table": f"WITH {ZONES} SELECT zone_id, round(zx1, 9) AS xmin, round(zy2, 9) AS ymax FROM zones",
    "webmap_file": f"""WITH t AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE {pick(['Habitacional popular', 'mixto', 'Vialidad primaria', 'Industria ligera'], 'p_partkey * 7 % 41')} END AS uso, round(p_size * 1.27::DOUBLE, 1) AS h, p_size::DOUBLE AS y FROM part WHERE p_partkey % 5 <> 0)
SELECT 'M' AS municipio, 'P' AS programa, uso, CASE uso WHEN 'mixto' THEN 'Mixto' WHEN 'Industria ligera' THEN 'Industrial' ELSE 'Habitacional' END AS grupo, count(*) AS n, round(sum(h), 1) AS hectareas, max(y) AS ymax FROM t WHERE uso NOT IN (' ', 'Vialidad primaria') GROUP BY ALL""",
    "compact_file": f"WITH {BUSINESSES} SELECT 'n' || id AS nombre, round(lat, 6) AS lat, round(lon, 6) AS lon, category AS categoria, nombre_act AS actividad, per_ocu AS tamano, (dense_rank() OVER (ORDER BY length(per_ocu), per_ocu) - 1)::INT AS tamano_code FROM businesses",
    "metrics_file": """SELECT c_nationkey::INT AS zone_id, 'clientes "' || c_mktsegment || '", total' AS metrica, count(*)::VARCHAR AS valor, 'clientes' AS unidad FROM customer GROUP BY ALL""",
    "reports_file": f"WITH {TRACTS}, {ZONES}, {OVERLAP}, n AS (SELECT zone_id, count(*) AS tracts FROM rows GROUP BY 1) SELECT zone_id, 2 AS schema_version, round(radius_km, 3) AS radio_km, tracts FROM zones LEFT JOIN n USING (zone_id)",
}
SQL["census_joins"] = SQL["census_joins"].replace(f"coalesce({level_of('pct')}, 'S/D') AS nse_nivel_", f"CASE WHEN ranked.CVEGEO IS NULL THEN 'S/D' ELSE {level_of('pct')} END AS nse_nivel").replace(", ranked.CVEGEO IS NULL AS missing", "")

#: The shapes of adapters.shaped: a tract's box less another box (none for every third).
SHAPED = f"""{TRACTS}, shaped AS (SELECT *, CASE gid % 3 WHEN 0 THEN x1 + (x2 - x1) * 0.5::DOUBLE WHEN 1 THEN x1 + (x2 - x1) * 0.5::DOUBLE ELSE x2 END AS hx1, CASE gid % 3 WHEN 1 THEN x1 + (x2 - x1) * 0.75::DOUBLE ELSE x2 END AS hx2,
  CASE gid % 3 WHEN 0 THEN y1 + (y2 - y1) * 0.6::DOUBLE WHEN 1 THEN y1 + (y2 - y1) * 0.25::DOUBLE ELSE y2 END AS hy1, CASE gid % 3 WHEN 1 THEN y1 + (y2 - y1) * 0.75::DOUBLE ELSE y2 END AS hy2 FROM tracts)"""
MISSING = f"CASE WHEN greatest(zx1, hx1) < least(zx2, hx2) AND greatest(zy1, hy1) < least(zy2, hy2) THEN {area('greatest(zx1, hx1)', 'greatest(zy1, hy1)', 'least(zx2, hx2)', 'least(zy2, hy2)')} ELSE 0 END"
SQL["shaped_demographics"] = f"""WITH {SHAPED}, {ZONES}, pairs AS (SELECT zone_id, shaped.*, {area(*BOX)} - {MISSING} AS km2, {area('x1', 'y1', 'x2', 'y2')} - {area('hx1', 'hy1', 'hx2', 'hy2')} AS whole FROM zones JOIN shaped ON {MEET}),
rows AS (SELECT *, km2 / whole AS frac FROM pairs WHERE km2 > 1e-12)
SELECT zone_id, count(*) AS tracts, round(sum(coalesce(POBTOT, 0) * frac), 3) AS pobtot, round(sum(coalesce(TVIVPARHAB, 0) * frac), 3) AS tvivparhab, round({wmean('GRAPROES', 'POBTOT')}, 3) AS graproes FROM rows GROUP BY zone_id"""
SQL["shaped_points"] = f"WITH {BUSINESSES}, {SHAPED} SELECT id, min(gid) AS gid FROM businesses JOIN shaped ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2 AND NOT (lon >= hx1 AND lon < hx2 AND lat >= hy1 AND lat < hy2) GROUP BY id"
SQL["shaped_meeting"] = f"""WITH {SHAPED}, {ZONES} SELECT zone_id, gid FROM zones JOIN shaped ON zx1 <= x2 AND x1 <= zx2 AND zy1 <= y2 AND y1 <= zy2
  AND NOT (gid % 3 = 0 AND zx1 > hx1 AND zy1 > hy1) AND NOT (gid % 3 = 1 AND zx1 > hx1 AND zx2 < hx2 AND zy1 > hy1 AND zy2 < hy2)"""
SQL["shaped_inside"] = f"""WITH {SHAPED}, {ZONES}, r AS (SELECT gid, CASE WHEN gid % 3 = 1 THEN (x1 + hx1) / 2 ELSE (x1 + x2) / 2 END AS x, y1 + (y2 - y1) * 0.5::DOUBLE AS y FROM shaped)
SELECT zone_id, gid FROM zones JOIN r ON x >= zx1 AND x < zx2 AND y >= zy1 AND y < zy2"""
SQL["dissolve_gaps"] = f"""WITH {tiles('part', 'p_partkey', 't')}, s AS (SELECT p_partkey // (SELECT ceil(sqrt(count(*)))::BIGINT FROM part) AS zona, min(x1) AS x1, min(y1) AS y1, max(x2 - (x2 - x1) * 0.05::DOUBLE) AS x2, max(y2) AS y2 FROM t GROUP BY 1)
SELECT zona, round({area('x1', 'y1', 'x2', 'y2')}, 4) AS km2, 1 AS rings, 5 AS corners FROM s"""
SQL["repaired"] = f"WITH {ZONES} SELECT zone_id, 2 AS rings, 0 AS holes, round(radians(zx2 - zx1) * (sin(radians(zy2)) - sin(radians(zy1))) / 2 * {R2}, 5) AS km2 FROM zones"
SQL["conic_back"] = f"SELECT c_custkey AS id, round({lon('c_custkey')}, 8) AS lon, round({lat('c_custkey')}, 8) AS lat FROM customer"


def _conic() -> tuple[str, str]:
    """x and y of a corner (px, py) on the national conic."""
    e, n, f, rho0 = S._lcc()
    t = f"(tan({math.pi / 4!r}::DOUBLE - radians(py) / 2) / pow((1 - {e!r}::DOUBLE * sin(radians(py))) / (1 + {e!r}::DOUBLE * sin(radians(py))), {e / 2!r}::DOUBLE))"
    rho = f"({6378137.0 * f!r}::DOUBLE * pow({t}, {n!r}::DOUBLE))"
    return f"{rho} * sin({n!r}::DOUBLE * radians(px + 102))", f"{rho0!r}::DOUBLE - {rho} * cos({n!r}::DOUBLE * radians(px + 102))"


SQL["conic_density"] = f"""WITH {TRACTS}, c AS (SELECT gid, POBTOT, k, CASE WHEN k IN (1, 2) THEN x2 ELSE x1 END AS px, CASE WHEN k >= 2 THEN y2 ELSE y1 END AS py FROM tracts, range(4) r(k)),
p AS (SELECT gid, POBTOT, k, {_conic()[0]} AS x, {_conic()[1]} AS y FROM c), e AS (SELECT a.gid, a.POBTOT, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS m2 FROM p a JOIN p b ON a.gid = b.gid AND b.k = (a.k + 1) % 4 GROUP BY ALL)
SELECT gid, round(m2 / 1e6, 6) AS km2, round_even(POBTOT / m2 * 1e6, 0) AS density FROM e"""
#: Discs of 90 m: what the circles of others within 180 m leave of each circle, added up by Green's theorem.
SQL["disc_footprints"] = f"""WITH {BUSINESSES}, p AS (SELECT DISTINCT sector AS cluster, (lon + 102.42) * 103000 AS x, (lat - 21.75) * 110700 AS y FROM businesses), c AS (SELECT *, floor(x / 180) AS cx, floor(y / 180) AS cy FROM p),
d AS (SELECT cluster, x, y, cx + dx AS cx, cy + dy AS cy FROM c, range(-1, 2) a(dx), range(-1, 2) b(dy)),
m AS (SELECT d.cluster, d.x, d.y, atan2(c.y - d.y, c.x - d.x) AS way, acos(sqrt(pow(c.x - d.x, 2) + pow(c.y - d.y, 2)) / 180) AS half FROM d JOIN c USING (cluster, cx, cy) WHERE sqrt(pow(c.x - d.x, 2) + pow(c.y - d.y, 2)) BETWEEN 1e-9 AND 180 - 1e-9),
w AS (SELECT cluster, x, y, CASE WHEN way - half < 0 THEN way - half + 2 * pi() ELSE way - half END AS s, half FROM m),
i AS (SELECT cluster, x, y, s, least(s + 2 * half, 2 * pi()) AS e FROM w UNION ALL SELECT cluster, x, y, 0, s + 2 * half - 2 * pi() FROM w WHERE s + 2 * half > 2 * pi() UNION ALL SELECT cluster, x, y, 2 * pi(), 2 * pi() FROM p),
g AS (SELECT cluster, x, y, coalesce(max(e) OVER (PARTITION BY cluster, x, y ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM i),
t AS (SELECT cluster, sum(90 * (90 * (b - a) + x * (sin(b) - sin(a)) - y * (cos(b) - cos(a))) / 2) AS area,
  sum(90 * (x * x * (sin(b) - sin(a)) + 180 * x * ((b - a) / 2 + (sin(2 * b) - sin(2 * a)) / 4) + 8100 * (sin(b) - pow(sin(b), 3) / 3 - sin(a) + pow(sin(a), 3) / 3)) / 2) AS mx,
  sum(90 * (y * y * (cos(a) - cos(b)) + 180 * y * ((b - a) / 2 - (sin(2 * b) - sin(2 * a)) / 4) + 8100 * (pow(cos(b), 3) / 3 - cos(b) - pow(cos(a), 3) / 3 + cos(a))) / 2) AS my FROM g WHERE b - a > 1e-9 GROUP BY 1)
SELECT cluster, round(area / 1e6, 6) AS km2, round(mx / area, 2) AS x, round(my / area, 2) AS y FROM t"""
#: Round zones as rings of 96 corners; the part of a tract's box in one is what lies between its edges, each held to the box: pieces of an
#: edge below, within and above it.
RING = f"""corner AS (SELECT zone_id, k, radians(lat) AS phi, radians(lng) AS lam, radius_km / 6371.0088 AS d, k * (-2 * pi() / 96) AS b FROM zones, range(96) r(k)),
ring AS (SELECT zone_id, k, lam, b, phi, d, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b)) AS v FROM corner),
ends AS (SELECT zone_id, k, degrees(lam + atan2(sin(b) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(v))) AS px, degrees(v) AS py FROM ring),
way AS (SELECT a.zone_id, CASE WHEN a.px < b.px THEN 1 ELSE -1 END AS sgn, least(a.px, b.px) AS xa, greatest(a.px, b.px) AS xb, CASE WHEN a.px < b.px THEN a.py ELSE b.py END AS ya, CASE WHEN a.px < b.px THEN b.py ELSE a.py END AS yb
  FROM ends a JOIN ends b ON a.zone_id = b.zone_id AND b.k = (a.k + 1) % 96 WHERE a.px <> b.px)"""


def held(x: str) -> str:
    return f"sin(radians(least(y2, greatest(y1, ya + ({x} - xa) * (yb - ya) / (xb - xa)))))"


def piece(a: str, b: str) -> str:
    return f"({b} - {a}) * ({held(a)} + {held(b)}) / 2"


SQL["zone_demographics_round"] = f"""WITH {TRACTS}, {ZONES}, {RING},
near AS (SELECT w.*, t.gid, t.x1, t.x2, t.y1, t.y2, t.POBTOT, greatest(xa, x1) AS xl, least(xb, x2) AS xr FROM way w JOIN tracts t ON xa < x2 AND xb > x1),
cut AS (SELECT *, CASE WHEN ya = yb THEN xl ELSE least(xr, greatest(xl, xa + (y1 - ya) * (xb - xa) / (yb - ya))) END AS c1, CASE WHEN ya = yb THEN xl ELSE least(xr, greatest(xl, xa + (y2 - ya) * (xb - xa) / (yb - ya))) END AS c2 FROM near),
o AS (SELECT zone_id, gid, any_value(POBTOT) AS pop, abs(sum(sgn * ({piece('xl', 'least(c1, c2)')} + {piece('least(c1, c2)', 'greatest(c1, c2)')} + {piece('greatest(c1, c2)', 'xr')}))) * pi() / 180 * {R2} AS km2, any_value({area('x1', 'y1', 'x2', 'y2')}) AS whole FROM cut GROUP BY ALL),
whole AS (SELECT zone_id, abs(sum(sgn * (xb - xa) * (sin(radians(ya)) + sin(radians(yb))) / 2)) * pi() / 180 * {R2} AS km2 FROM way GROUP BY 1)
SELECT o.zone_id, count(*) AS tracts, round(sum(coalesce(pop, 0) * least(1.0, o.km2 / whole)), 2) AS pobtot, round(greatest(0.0, least(100.0, (1 - sum(o.km2) / any_value(w.km2)) * 100)), 3) AS uncovered_pct
FROM o JOIN whole w USING (zone_id) WHERE o.km2 > 1e-6 GROUP BY o.zone_id"""
#: Names that the cascade leaves against keys of the same first letter: matching blocks by the longest common stretch of a part, then of
#: what is left and right of it. m: letters that agree, with the length of the stretch that starts there.
SQL["fuzzy_match"] = f"""WITH RECURSIVE {VALUES}, {KEYS}, {POLYGONS}, kk AS (SELECT municipio, key, min(pos) AS pos, round_even(avg(value), 0)::BIGINT AS value, arg_min(sector, pos) AS sector FROM k3 WHERE level = 2 AND key <> '' GROUP BY ALL),
rest AS (SELECT gid, municipio, cn FROM q WHERE cn <> '' AND gid NOT IN (SELECT gid FROM asks JOIN keys USING (municipio, level, key))),
cand AS (SELECT row_number() OVER () AS id, municipio, cn, key, length(cn) AS la, length(key) AS lb FROM (SELECT DISTINCT municipio, cn FROM rest) JOIN kk USING (municipio) WHERE left(cn, 1) = left(key, 1) AND abs(length(cn) - length(key)) <= 6),
same AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS g FROM cand, range(100) a(i), range(100) b(j) WHERE i < la AND j < lb AND substr(cn, i + 1, 1) = substr(key, j + 1, 1)),
m AS (SELECT id, i, j, max(i) OVER (PARTITION BY id, j - i, g) - i + 1 AS e FROM same),
r(id, a1, a2, b1, b2, s) AS (SELECT id, 0::BIGINT, la::BIGINT, 0::BIGINT, lb::BIGINT, 0::BIGINT FROM cand UNION ALL
  SELECT id, unnest([a1, i + k]), unnest([i, a2]), unnest([b1, j + k]), unnest([j, b2]), unnest([k, 0]) FROM (
    SELECT id, a1, a2, b1, b2, best // 1000000 AS k, 999 - best % 1000000 // 1000 AS i, 999 - best % 1000 AS j FROM (
      SELECT r.id, a1, a2, b1, b2, max(least(e, a2 - i, b2 - j) * 1000000 + (999 - i) * 1000 + 999 - j) AS best FROM r JOIN m ON r.id = m.id AND i >= a1 AND i < a2 AND j >= b1 AND j < b2 GROUP BY ALL))),
ratios AS (SELECT id, sum(s) AS hits FROM r GROUP BY id),
scored AS (SELECT municipio, cn, key, sector, value, pos, 2.0::DOUBLE * hits / (la + lb) AS ratio FROM cand JOIN ratios USING (id) JOIN kk USING (municipio, key)),
best AS (SELECT *, row_number() OVER (PARTITION BY municipio, cn ORDER BY ratio DESC, pos) AS o FROM scored WHERE ratio >= 0.88)
SELECT gid, 'fuzzy(' || printf('%.2f', ratio) || ')→' || key AS method, sector, value FROM rest JOIN best USING (municipio, cn) WHERE o = 1"""


def plain(x: str, n: int | None = None) -> str:
    v = f"round(({x})::DOUBLE, {n})" if n is not None else f"({x})::DOUBLE"
    return f"coalesce(regexp_replace({v}::VARCHAR, '\\.0$', ''), 's/d')"


def fixed(x: str, n: int) -> str:
    return f"coalesce(printf('%.{n}f', round(({x})::DOUBLE, {n})), 's/d')"


#: Figures of a zone's report: f has sums and means over tracts, area and cover; p people by level; u uses by programme.
REPORT = f"""{TRACTS}, {ZONES}, {OVERLAP}, {LANDUSE}, {BUSINESSES}, s AS (SELECT zone_id, count(*) AS n, sum(km2) AS covered, {', '.join(f'sum(coalesce({c}, 0) * frac) AS {c}' for c in ('POBTOT', 'POBFEM', 'TVIVPARHAB'))},
  {wmean('GRAPROES', 'POBTOT')} AS GRAPROES, {', '.join(f"{wmean(c, 'TVIVPARHAB')} AS {c}" for c in ('pct_inter', 'pct_2dorm', 'pct_3cuart'))} FROM rows GROUP BY zone_id),
f AS (SELECT z.*, s.* EXCLUDE (zone_id), {area('zx1', 'zy1', 'zx2', 'zy2')} AS km2 FROM zones z LEFT JOIN s USING (zone_id)), f2 AS (SELECT *, greatest(0.0, least(100.0, (1 - coalesce(covered, 0) / km2) * 100)) AS uncovered FROM f),
p AS (SELECT zone_id, nse_nivel AS level, sum(coalesce(POBTOT, 0) * frac) AS p FROM rows GROUP BY ALL), p2 AS (SELECT *, sum(p) OVER (PARTITION BY zone_id) AS total FROM p),
best AS (SELECT zone_id, level FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY p DESC, {RANK}) AS r FROM p2) WHERE r = 1 AND total > 0),
o AS (SELECT zone_id, grupo, programa, {area(*BOX)} AS part FROM zones JOIN landuse ON {MEET}), u AS (SELECT zone_id, grupo, programa, sum(part) / any_value(km2) * 100 AS pct FROM o JOIN f USING (zone_id) GROUP BY ALL)"""
SHOWN = {"area_buffer": "km2", "agebs_intersectadas": "n", "pct_area_sin_ageb": "uncovered", "poblacion_estimada": "POBTOT", "viviendas_habitadas_estimadas": "TVIVPARHAB", "escolaridad_promedio": "GRAPROES", "pct_viviendas_internet": "pct_inter", "pct_viviendas_2mas_recamaras": "pct_2dorm", "pct_viviendas_3mas_cuartos": "pct_3cuart", "poblacion_femenina": "POBFEM"}
FIGURES = " UNION ALL ".join(f"SELECT zone_id, '{m}' AS metrica, {fixed(SHOWN.get(m, 'NULL'), n)} AS valor, '{u}' AS unidad FROM f2" for m, _, n, u in METRICS)
SQL["metric_rows"] = f"""WITH {REPORT}, cats AS (SELECT unnest({list(S.POI_CATEGORIES)}) AS category),
h AS (SELECT zone_id, category, count(*) AS k FROM zones JOIN businesses ON abs(businesses.lat - zones.lat) < 0.006 AND {haversine('zones.lat', 'lng', 'businesses.lat', 'lon')} <= radius_km GROUP BY ALL)
{FIGURES} UNION ALL SELECT zone_id, 'punto_lat', {fixed('lat', 6)}, 'grados' FROM f UNION ALL SELECT zone_id, 'punto_lng', {fixed('lng', 6)}, 'grados' FROM f UNION ALL SELECT zone_id, 'radio', {plain('radius_km')}, 'km' FROM f
UNION ALL SELECT zone_id, 'nse_' || level || '_pct_poblacion', {fixed('p / total * 100', 1)}, '% de población' FROM p2 WHERE total > 0
UNION ALL SELECT zone_id, 'uso_suelo: ' || grupo || ' — ' || programa, {fixed('pct', 1)}, '% del área del buffer' FROM u
UNION ALL SELECT zone_id, 'uso_suelo: sin zonificación PDU', {fixed('greatest(0, 100 - coalesce(zoned, 0))', 1)}, '% del área del buffer' FROM f LEFT JOIN (SELECT zone_id, sum(pct) AS zoned FROM u GROUP BY 1) w USING (zone_id)
UNION ALL SELECT zone_id, 'poi_' || lower(category), coalesce(k, 0)::VARCHAR, 'puntos' FROM zones CROSS JOIN cats LEFT JOIN h USING (zone_id, category)"""
SQL["gis_zones"] = f"""WITH {REPORT} SELECT zone_id, 'radio ' || {plain('radius_km')} || ' km' AS TIPO, round(radius_km, 2) AS RADIO_KM, round(lat, 6) AS LAT, round(lng, 6) AS LON, round(km2, 2) AS AREA_KM2, round(100 - uncovered, 1) AS COB_AGEB, round(POBTOT, 0) AS POB_TOT,
  round(POBFEM, 0) AS POB_FEM, round(TVIVPARHAB, 0) AS VIV_HAB, round(GRAPROES, 2) AS ESCOLARID, round(pct_inter, 1) AS PCT_INTER, level AS NSE_PRED, round(zx1, 6) AS xmin FROM f2 LEFT JOIN best USING (zone_id)"""
SQL["gis_colonias"] = f"WITH {COLONIAS}, {ZONES} SELECT zone_id, p_name AS NOM_ASEN, TIPO, NULL::VARCHAR AS CP, municipio AS MUNICIPIO, round(valor_m2 + 0.00123::DOUBLE, 2) AS VALOR_M2, round(x1, 6) AS xmin FROM zones JOIN colonias ON {MEET}"
SQL["gis_landuse"] = f"WITH {LANDUSE}, {ZONES} SELECT zone_id, programa AS PROGRAMA, grupo AS GRUPO, NULL::VARCHAR AS USO, round(gid / 7, 2) AS HECTAREAS, round(y2, 6) AS ymax FROM zones JOIN landuse ON {MEET}"
SQL["polygon_metrics"] = f"""WITH {TRACTS}, {ZONES}, {LANDUSE}, {COLONIAS}, w AS (SELECT zone_id, tracts.* FROM zones JOIN tracts ON {MEET}),
lv AS (SELECT zone_id, nse_nivel AS level, count(*) AS k, sum(coalesce(POBTOT, 0)) AS p FROM w GROUP BY ALL), best AS (SELECT zone_id, level FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY p DESC, {RANK}) AS r FROM lv) WHERE r = 1),
s AS (SELECT zone_id, count(*) AS n, sum(coalesce(POBTOT, 0)) AS people, sum(CASE WHEN POBTOT > 0 THEN nse_score * POBTOT END) / sum(CASE WHEN POBTOT > 0 AND nse_score IS NOT NULL THEN POBTOT END) AS score, avg(pct_2dorm) AS d2, avg(coalesce(pct_3cuart, 0)) AS d3 FROM w GROUP BY 1),
f AS (SELECT z.zone_id, s.* EXCLUDE (zone_id), level, {area('zx1', 'zy1', 'zx2', 'zy2')} AS km2 FROM zones z LEFT JOIN s USING (zone_id) LEFT JOIN best USING (zone_id)),
c AS (SELECT zone_id, colonias.* FROM zones JOIN colonias ON (x1 + x2) / 2 BETWEEN zx1 AND zx2 AND (y1 + y2) / 2 BETWEEN zy1 AND zy2),
v AS (SELECT zone_id, count(*) AS n, min(valor_m2) AS least, round(avg(valor_m2)) AS mean, list_sort(list(valor_m2))[(count(*) // 2 + 1)] AS med, max(valor_m2) AS most FROM c WHERE valor_m2 IS NOT NULL GROUP BY 1),
o AS (SELECT zone_id, grupo, {area(*BOX)} AS part FROM zones JOIN landuse ON {MEET}), u AS (SELECT zone_id, grupo, sum(part) / any_value(km2) * 100 AS pct FROM o JOIN f USING (zone_id) GROUP BY ALL),
x AS ({SQL['population_context']}), all_ AS (
SELECT zone_id, unnest([{{'m': 'tipo_analisis', 'v': 'polígono dibujado', 'u': ''}}, {{'m': 'area_poligono', 'v': {plain('km2', 2)}, 'u': 'km²'}}, {{'m': 'agebs_intersectadas', 'v': {plain('coalesce(n, 0)')}, 'u': 'AGEBs'}}, {{'m': 'poblacion_estimada', 'v': {plain('people', 0)}, 'u': 'habitantes'}},
  {{'m': 'nse_predominante', 'v': coalesce(level, 's/d'), 'u': ''}}, {{'m': 'nse_score', 'v': {plain('score', 2)}, 'u': 'índice NSE'}}, {{'m': 'pct_viviendas_2mas_recamaras', 'v': {plain('d2', 1)}, 'u': '% de viviendas habitadas'}}, {{'m': 'pct_viviendas_3mas_cuartos', 'v': {plain('d3', 1)}, 'u': '% de viviendas habitadas'}}]) AS r FROM f
UNION ALL SELECT zone_id, {{'m': 'nse_' || level || '_agebs', 'v': k::VARCHAR, 'u': 'AGEBs'}} FROM lv
UNION ALL SELECT zone_id, unnest([{{'m': 'catastral_colonias', 'v': {plain('n')}, 'u': 'colonias'}}, {{'m': 'catastral_min', 'v': {plain('least')}, 'u': '$/m² de suelo'}}, {{'m': 'catastral_promedio', 'v': {plain('mean')}, 'u': '$/m² de suelo'}}, {{'m': 'catastral_mediana', 'v': {plain('med')}, 'u': '$/m² de suelo'}}, {{'m': 'catastral_max', 'v': {plain('most')}, 'u': '$/m² de suelo'}}]) FROM v
UNION ALL SELECT zone_id, {{'m': 'colonia: ' || TIPO || ' ' || p_name || ' (' || municipio || ')', 'v': {plain('valor_m2')}, 'u': '$/m² de suelo'}} FROM c
UNION ALL SELECT zone_id, {{'m': 'uso_suelo: ' || grupo, 'v': {plain('pct', 1)}, 'u': '% del área del polígono'}} FROM u
UNION ALL SELECT zone_id, {{'m': 'uso_suelo: sin zonificación PDU', 'v': {plain('greatest(0, 100 - sum(pct))', 1)}, 'u': '% del área del polígono'}} FROM u GROUP BY zone_id
UNION ALL SELECT zone_id, {{'m': 'poblacion_proyeccion_cambio_2020_' || anio_fin || ': ' || municipio, 'v': {plain('cambio_pct')}, 'u': '% (municipio completo)'}} FROM x)
SELECT zone_id, r.m AS metrica, r.v AS valor, r.u AS unidad, count(*) AS times FROM all_ GROUP BY ALL"""
#: Corner cutting of a ring as lists: twice as many corners a round.
CUT = "list_transform(range(1, 2 * len({l}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN 0.75::DOUBLE * {l}[(i + 1) // 2] + 0.25::DOUBLE * {l}[(i + 1) // 2 % len({l}) + 1] ELSE 0.25::DOUBLE * {l}[i // 2] + 0.75::DOUBLE * {l}[i // 2 % len({l}) + 1] END)"
SQL["smoothed_rings"] = f"""WITH {ZONES}, c0 AS (SELECT zone_id, [zx1, zx2, zx2, zx1] AS x, [zy1, zy1, zy2, zy2] AS y FROM zones),
{', '.join(f"c{k + 1} AS (SELECT zone_id, {CUT.format(l='x')} AS x, {CUT.format(l='y')} AS y FROM c{k})" for k in range(4))},
e AS (SELECT zone_id, len(x) + 1 AS corners, unnest(list_transform(range(1, len(x) + 1), lambda i: radians(x[i % len(x) + 1] - x[i]) * (sin(radians(y[i])) + sin(radians(y[i % len(x) + 1]))) / 2)) AS part FROM c4)
SELECT zone_id, corners::INT AS corners, round(abs(sum(part)) * {R2}, 6) AS km2 FROM e GROUP BY ALL"""
SQL["dbscan"] = f"""WITH RECURSIVE {BUSINESSES}, p AS (SELECT id, (lon + 102.42) * 103000 AS x, (lat - 21.75) * 110700 AS y FROM businesses), c AS (SELECT *, floor(x / 300)::INT AS cx, floor(y / 300)::INT AS cy FROM p),
n AS (SELECT a.id, b.id AS other FROM c a JOIN (SELECT *, cx + dx AS nx, cy + dy AS ny FROM c, range(-1, 2) d(dx), range(-1, 2) f(dy)) b ON a.cx = b.nx AND a.cy = b.ny WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 90000),
core AS (SELECT id FROM n GROUP BY id HAVING count(*) >= 6), e AS (SELECT n.id, other FROM n SEMI JOIN core ON n.id = core.id SEMI JOIN core k ON n.other = k.id),
r(id, label) USING KEY (id) AS (SELECT id, id FROM core UNION SELECT * FROM (SELECT e.other AS id, min(r.label) AS label FROM r JOIN e ON r.id = e.id GROUP BY e.other) m WHERE m.label < (SELECT label FROM recurring.r q WHERE q.id = m.id))
SELECT id, true AS core, label AS cluster FROM r UNION ALL SELECT n.id, false, min(r.label) FROM n JOIN r ON n.other = r.id ANTI JOIN core ON n.id = core.id GROUP BY n.id"""
