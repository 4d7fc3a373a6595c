"""Scalar functions and predicates as Column expressions (no Python in any of them)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------

LEVELS = [("A/B", 95), ("C+", 85), ("C", 65), ("C-", 45), ("D+", 25), ("D", 10), ("E", 0)]
LEVEL_ORDER = ["A/B", "C+", "C", "C-", "D+", "D", "E", "S/D"]
SETTLEMENT_TYPES = [
    "UNIDAD HABITACIONAL INFONAVIT", "UNIDAD HABITACIONAL", "CONJUNTO HABITACIONAL",
    "CONJUNTO CONDOMINAL", "ASENTAMIENTO IRREGULAR", "POBLADO COMUNAL",
    "FRACCIONAMIENTO POR REGULARIZACION", "FRACCIONAMIENTO", "FRACCION",
    "CONDOMINIO", "COLONIA", "BARRIO", "PUEBLO", "VILLA", "CONGREGACION",
    "ZONA COMERCIAL", "ZONA INDUSTRIAL", "ZONA", "EJIDO", "RANCHERIA", "COMUNIDAD",
    "DELEGACION", "SUBDELEGACION", "PARQUE INDUSTRIAL", "GRANJA", "COTO", "PRIVADA",
    "PLAZA COMERCIAL", "SUBDIVISION", "AMPLIACION", "CERRADA", "RINCONADA",
]
SEARCH_TYPES = ["FRACCIONAMIENTO", "CONJUNTO HABITACIONAL", "UNIDAD HABITACIONAL", "PARQUE INDUSTRIAL", "ZONA MILITAR", "RANCHERIA", "CONDOMINIO", "COLONIA", "BARRIO", "EJIDO", "PUEBLO", "COTO"]
SEARCH_PLACES = ["JESUS MARIA", "AGUASCALIENTES"]
# Ordinals by their digit, as words and not as patterns: word edges at Ñ differ between engines, so _word adds them.
ORDINALS = {
    "1": ["PRIMER", "PRIMERA", "1RA", "1A", "1ERA", "I"],
    "2": ["SEGUND", "SEGUNDA", "2DA", "2A", "II"],
    "3": ["TERCER", "TERCERA", "3RA", "3A", "III"],
    "4": ["CUART", "CUARTA", "4TA", "4A", "IV"],
    "5": ["QUINT", "QUINTA", "5TA", "5A", "V"],
    "6": ["SEXT", "SEXTA", "6TA", "6A", "VI"],
}
SECTIONS = ["SECCION", "ETAPA", "SECTOR"]
CONNECTIVES = ["DE", "DEL", "LA", "LAS", "LOS", "EL", "Y", "SUBDIVISION", "ZONA"]
SECTOR_CATEGORIES = {
    "46": "Comercio", "43": "Comercio mayoreo", "72": "Restaurantes y hospedaje", "81": "Servicios personales",
    "62": "Salud", "61": "Educación", "54": "Profesional y financiero", "52": "Profesional y financiero",
    "53": "Profesional y financiero", "55": "Profesional y financiero", "56": "Profesional y financiero",
    "31": "Industria y construcción", "32": "Industria y construcción", "33": "Industria y construcción",
    "23": "Industria y construcción", "48": "Transporte", "49": "Transporte", "71": "Esparcimiento",
}
LANDUSE_GROUPS = [
    ("POPULAR|MEDIO|RESIDENCIAL|CONDOMINIO|DENSIDAD|REGULARIZACION|REGULARIZACIÓN|CONSOLIDACION|CONSOLIDACIÓN|COSOLIDACION|COSOLIDACIÓN", "Habitacional"),
    ("MIXTO|MICROINDUSTRIAL|CORREDOR ESTRATEGICO|CORREDOR ESTRATÉGICO", "Mixto"),
    ("COMERCIO|COMERCIAL", "Comercial / Servicios"),
    ("AGROPECUARIO|AGRICOLA|AGRÍCOLA", "Agropecuario"),
    ("INDUSTRIA", "Industrial"),
    ("CONSERVACI|PRESERVACI|ECOL|ECOTUR|FORESTAL|REGENERACION|REGENERACIÓN", "Conservación / Ecológico"),
    ("CRECIMIENTO|EXPANSION|EXPANSIÓN", "Crecimiento futuro"),
    ("RIESGO|ESPECIAL", "Especial"),
]
POI_CATEGORIES = {
    "Educación": [("amenity", "school"), ("amenity", "university"), ("amenity", "college")],
    "Salud": [("amenity", "hospital"), ("amenity", "clinic"), ("amenity", "pharmacy")],
    "Abasto": [("shop", "supermarket"), ("shop", "mall")],
    "Bancos": [("amenity", "bank")],
    "Parques": [("leisure", "park")],
    "Gasolineras": [("amenity", "fuel")],
}
CENTRE_LON, CENTRE_LAT = -102.2958, 21.8794
ZONE_SECTORS = [(50, "Norte"), (145, "Oriente"), (190, "Sur"), (255, "Sur-Poniente"), (315, "Poniente")]
EARTH_KM = 6371.0088
MONTHLY_SHARE = 0.30

# Keys, numbers, rounding ----------------------------------------------------------------------------------------------


def zero_filled(col: Column, n: int) -> Column:
    """Left-padded with zeros to n; longer texts stay whole."""
    return F.when(F.length(col) < n, F.lpad(col, n, "0")).otherwise(col)


def tract_key(state: Column, municipality: Column, locality: Column, tract: Column) -> Column:
    return F.concat(zero_filled(state, 2), zero_filled(municipality, 3), zero_filled(locality, 4), zero_filled(tract, 4))


def to_number(col: Column) -> Column:
    """Text to double; sentinels and anything else that is no number become null."""
    return F.trim(col).try_cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0 or null."""
    return part / F.when(whole != 0, whole)


def vacancy_pct(empty: Column, total: Column) -> Column:
    return round_py(ratio(empty, total) * 100, 1)


def falsy_to_null(col: Column) -> Column:
    """Null for an empty text, or for a number that is 0."""
    trimmed = F.trim(col.cast("string"))
    return F.when((trimmed == "") | (trimmed.try_cast("double") == 0), None).otherwise(col)


def round_js(col: Column, n: int = 0) -> Column:
    """Half up, as zone figures are rounded."""
    return F.round(col, n)


def round_py(col: Column, n: int = 0) -> Column:
    """Half to even, as the builders round."""
    return F.bround(col, n)


# Names ----------------------------------------------------------------------------------------------------------------

_ACCENTED = "ÁÀÂÄÅĀĂĄÉÈÊËĒĖĘĚÍÌÎÏĪĮÓÒÔÖŌŐÚÙÛÜŪŮŰÇĆČÝŸŽŹŻŠŚ"
_PLAIN = "AAAAAAAAEEEEEEEEIIIIIIOOOOOOUUUUUUUCCCYYZZZSS"


def norm_name(col: Column) -> Column:
    """Capitals without accents (Ñ stays, other tildes part words), no punctuation, single spaces."""
    x = F.regexp_replace(F.translate(F.upper(col), "Ð", "Ñ"), "N\u0303", "Ñ")
    x = F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), "[\u0300-\u0302\u0304-\u036f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-ZÑ0-9 ]", " "), r"\s+", " "))


def search_key(col: Column) -> Column:
    """Capitals without any accent (Ñ becomes N), single spaces."""
    x = F.translate(F.upper(col), _ACCENTED + "ÑÃÕĨŨ", _PLAIN + "NAOIU")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[\u0300-\u036f]", ""), r"\s+", " "))


def split_type(col: Column, types: list[str] = SETTLEMENT_TYPES) -> Column:
    """struct(type, base): the first type of the list that leads the name goes; else an empty type."""

    def split(c: Column) -> Column:
        out = None
        for t in types:
            hit = F.struct(F.lit(t).alias("type"), F.substring(c, F.lit(len(t) + 2), F.length(c)).alias("base"))
            out = F.when(c.startswith(t + " "), hit) if out is None else out.when(c.startswith(t + " "), hit)
        return out.otherwise(F.struct(F.lit("").alias("type"), c.alias("base")))

    return F.element_at(F.transform(F.array(col), split), 1)  # the text is computed once


def _word(words: list[str]) -> str:
    return rf"(?<![A-ZÑ0-9])(?:{'|'.join(sorted(words, key=len, reverse=True))})(?![A-ZÑ0-9])"


def _squeezed(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def canon(col: Column) -> Column:
    """Ordinals as digits, the section word before its number."""
    x = F.regexp_replace(col, _word(["SECC"]), "SECCION")
    for digit, words in ORDINALS.items():
        x = F.regexp_replace(x, _word(words), digit)
    return _squeezed(F.regexp_replace(x, rf"(?<![A-ZÑ0-9])(\d)\s+({'|'.join(SECTIONS)})(?![A-ZÑ0-9])", "$2 $1"))


def strip_section(col: Column) -> Column:
    x = F.regexp_replace(col, rf"(?<![A-ZÑ0-9])({'|'.join(SECTIONS)})(?:\s*\d+(?![A-ZÑ0-9])|(?![A-ZÑ0-9])\s*)", " ")
    return _squeezed(F.regexp_replace(x, r"\s+\d+$", ""))


def slug(col: Column) -> Column:
    return F.replace(F.regexp_replace(col, _word(CONNECTIVES), " "), F.lit(" "), F.lit(""))


def colonia_label(kind: Column, name: Column) -> Column:
    return F.concat(F.when(kind == "NINGUNO", "").otherwise(F.concat(kind, F.lit(" "))), name)


def display_name(name: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), fallback)


# Classes --------------------------------------------------------------------------------------------------------------


def sector_category(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTOR_CATEGORIES.items() for x in kv])
    return F.coalesce(table[F.substring(code, 1, 2)], F.lit("Otros"))


def landuse_group(use: Column) -> Column:
    out = None
    for pattern, name in LANDUSE_GROUPS:
        hit = F.upper(use).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Otro")


def drop_uses(col: Column, skip_prefix: str | None = None) -> Column:
    """Predicate: the use is not empty and does not begin with the prefix."""
    keep = F.coalesce(F.trim(col), F.lit("")) != ""
    return keep & ~F.upper(F.trim(col)).startswith(skip_prefix) if skip_prefix else keep


def poi_category(tags: Column) -> Column:
    """struct(category, k, v) of the first pair in the list that the tags hold, else null."""
    out = None
    for category, pairs in POI_CATEGORIES.items():
        for k, v in pairs:
            hit = F.struct(F.lit(category).alias("category"), F.lit(k).alias("k"), F.lit(v).alias("v"))
            out = F.when(tags[k] == v, hit) if out is None else out.when(tags[k] == v, hit)
    return out


def price_zone(lon: Column, lat: Column) -> Column:
    """The centre within 1.7 km, else by bearing from it."""
    x = (lon - CENTRE_LON) * F.cos(F.radians(F.lit(CENTRE_LAT))) * 111.32
    y = (lat - CENTRE_LAT) * 110.57
    bearing = F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))
    out = F.when(F.hypot(x, y) < 1.7, "Centro")
    for upto, name in ZONE_SECTORS:
        out = out.when(bearing < upto, name)
    return out.otherwise("Norte")


def classify_bins(col: Column, bins: list[tuple[float, str]], last: str, null_as: str | float) -> Column:
    """The first class (in descending order) whose minimum the value reaches, below all `last`. Nulls become a class, or a value."""
    value = F.coalesce(col, F.lit(float(null_as))) if not isinstance(null_as, str) else col
    out = F.when(value.isNull(), null_as) if isinstance(null_as, str) else None
    for least, name in sorted(bins, reverse=True):
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(last)


def level_of(pct: Column) -> Column:
    out = None
    for name, least in LEVELS:
        out = F.when(pct >= least, name) if out is None else out.when(pct >= least, name)
    return out.otherwise("E")


def traffic_level(speed: Column, free: Column, closed: Column) -> Column:
    r = speed / F.when(free != 0, free)
    return F.when(closed, "Vía cerrada").when(r.isNull(), "Sin dato").when(r >= 0.9, "Fluido").when(r >= 0.7, "Lento").when(r >= 0.4, "Congestionado").otherwise("Detenido")


def exclusion_reason(n: Column, non_residential: Column, top_share: Column, top: Column) -> Column:
    return F.when(n < 8, "few").when(non_residential > 0.35, "industrial").when((top_share > 0.5) & (n < 20), F.concat(F.lit("single: "), top))


def trend(now: Column, before: Column, digits: int) -> Column:
    a, b = F.round(now, digits), F.round(before, digits)
    return F.when(a > b, "▲").when(a < b, "▼").when(a == b, "→")


# Money, time ----------------------------------------------------------------------------------------------------------


def monthly_payment(credit: Column, rate_pct: Column, years: Column) -> Column:
    r, n = rate_pct / 1200, years * 12
    growth = F.pow(1 + r, n)
    return F.when(r == 0, credit / n).otherwise(credit * r * growth / (growth - 1))


def required_income(payment: Column) -> Column:
    return payment / MONTHLY_SHARE


def time_bands(most: Column) -> Column:
    """Thirds of the longest time, rounded."""
    return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.round(most * i / 3).cast("int"))


def car_budget_s(minutes: Column) -> Column:
    return F.round(minutes * 60 / 1.25).cast("int")


# Distance and projections ---------------------------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def from_mercator(x: Column, y: Column) -> Column:
    r = 6378137.0
    return F.struct(F.degrees(x / r).alias("lon"), F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(3.141592653589793 / 2)).alias("lat"))


_A, _FLAT = 6378137.0, 1 / 298.257223563
_E2 = _FLAT * (2 - _FLAT)


def to_utm13(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on WGS 84 / UTM 13N by the usual series; null outside -111..-99 degrees."""
    ep2, k0 = _E2 / (1 - _E2), 0.9996
    phi, d = F.radians(lat), F.radians(lon + 105)
    s, c, t2 = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    n, cc, a = F.lit(_A) / F.sqrt(1 - _E2 * s * s), ep2 * c * c, d * c
    e4, e6 = _E2**2, _E2**3
    arc = _A * ((1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))
    east = 500000 + k0 * n * (a + (1 - t2 + cc) * F.pow(a, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * cc - 58 * ep2) * F.pow(a, 5) / 120)
    north = k0 * (arc + n * F.tan(phi) * (a * a / 2 + (5 - t2 + 9 * cc + 4 * cc * cc) * F.pow(a, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * cc - 330 * ep2) * F.pow(a, 6) / 720))
    return F.when(lon.between(-111, -99), F.struct(east.alias("x"), north.alias("y")))


def _lcc():
    """Constants of the national Lambert conformal conic (standard parallels 17.5 and 29.5, origin 12 N 102 W, GRS 80)."""
    import math

    e = math.sqrt(2 / 298.257222101 - 1 / 298.257222101**2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = map(math.radians, (17.5, 29.5, 12.0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return e, n, f, 6378137.0 * f * t(p0) ** n


def to_lcc(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres on the national conic (false easting 2,500,000)."""
    e, n, f, rho0 = _lcc()
    phi = F.radians(lat)
    t = F.tan(F.lit(3.141592653589793 / 4) - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho, theta = 6378137.0 * f * F.pow(t, F.lit(n)), n * F.radians(lon + 102)
    return F.struct((2500000 + rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def from_lcc(x: Column, y: Column) -> Column:
    """struct(lon, lat) of metres on the national conic: the latitude is the fixed point of the conformal equation, which each round
    nears by a factor of over a hundred."""
    e, n, f, rho0 = _lcc()
    east, down = x - 2500000, rho0 - y
    t = F.pow(F.hypot(east, down) / (6378137.0 * f), F.lit(1 / n))
    half = 3.141592653589793 / 2
    lat = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(half) - 2 * F.atan(t), lambda phi, _: F.lit(half) - 2 * F.atan(t * F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))))
    return F.struct((F.degrees(F.atan2(east, down) / n) - 102).alias("lon"), F.degrees(F.element_at(F.transform(F.array(t), lat), 1)).alias("lat"))
