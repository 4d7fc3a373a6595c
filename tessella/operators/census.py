"""Census rows to a socioeconomic index by tract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions import scalars as S
from tessella.operators.ranking import running_sum

# The index's variables and weights.
WEIGHTS = {"GRAPROES": 0.25, "pct_inter": 0.20, "pct_pc": 0.15, "pct_auto": 0.15, "pct_serv": 0.15, "PRO_OCUP_C": -0.10}
TOTAL_ROW = "Total AGEB urbana"
#: ratio name -> raw count of dwellings
DWELLING_RATIOS = {
    "pct_inter": "VPH_INTER", "pct_pc": "VPH_PC", "pct_auto": "VPH_AUTOM", "pct_serv": "VPH_C_SERV", "pct_2dorm": "VPH_2YMASD",
    "pct_3cuart": "VPH_3YMASC", "pct_piso_firme": "VPH_PISODT", "pct_electricidad": "VPH_C_ELEC", "pct_sanitario": "VPH_EXCSA", "pct_drenaje": "VPH_DRENAJ",
}
NUMBERS = ["POBTOT", "POBFEM", "POBMAS", "VIVTOT", "TVIVPAR", "TVIVPARHAB", "VIVPAR_DES", "VIVPAR_HAB", "GRAPROES", "PRO_OCUP_C", *DWELLING_RATIOS.values(), "POB0_14", "P_15A17", "P_18A24", "P_60YMAS", "PCON_DISC"]


def tract_rows(df: DataFrame, municipalities: list[int]) -> DataFrame:
    return df.where((F.col("NOM_LOC") == TOTAL_ROW) & F.col("MUN").try_cast("int").isin(municipalities))


def numbers(df: DataFrame) -> DataFrame:
    """CVEGEO and every count as a number."""
    key = S.tract_key(F.col("ENTIDAD"), F.col("MUN"), F.col("LOC"), F.col("AGEB"))
    return df.withColumn("CVEGEO", key).withColumns({c: S.to_number(F.col(c)) for c in NUMBERS if c in df.columns})


def dwelling_ratios(df: DataFrame) -> DataFrame:
    """Shares of inhabited dwellings, as ratios; null where there are none."""
    return df.withColumns({name: S.ratio(F.col(raw), F.col("TVIVPARHAB")) for name, raw in DWELLING_RATIOS.items() if raw in df.columns})


def age_partition(df: DataFrame) -> DataFrame:
    """0-14, 15-24, 25-59 (what is left) and 60 on; nulls go through."""
    d = df.withColumns({"pob_0_14": F.col("POB0_14"), "pob_15_24": F.col("P_15A17") + F.col("P_18A24"), "pob_60_mas": F.col("P_60YMAS")})
    return d.withColumn("pob_25_59", F.col("POBTOT") - F.col("pob_0_14") - F.col("pob_15_24") - F.col("pob_60_mas"))


def minmax(df: DataFrame, cols: list[str], suffix: str = "_norm") -> DataFrame:
    """Each column over its range, 0.5 for a constant one; the ranges are one row, sent to all."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = df.join(F.broadcast(ends), F.lit(True))
    one = lambda c: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), F.when(F.col(c).isNotNull(), 0.5)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")))
    return d.withColumns({c + suffix: one(c) for c in cols}).drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


def composite_score(df: DataFrame, weights: dict[str, float] = WEIGHTS, name: str = "nse_score") -> DataFrame:
    """Weighted sum of normalised columns (null as 0.5), normalised again, 4 decimals half to even."""
    d = minmax(df, list(weights))
    d = d.withColumn("_raw", sum((F.coalesce(F.col(c + "_norm"), F.lit(0.5)) * w for c, w in weights.items()), F.lit(0.0)))
    d = minmax(d.drop(*[c + "_norm" for c in weights]), ["_raw"])
    return d.withColumn(name, S.round_py(F.col("_raw_norm"), 4)).drop("_raw", "_raw_norm")


def percentile_level(df: DataFrame, col: str, name: str = "nse_nivel") -> DataFrame:
    """Level by percentile rank with ties at their average: counts a distinct score, summed up, joined back.

    The running sum is over distinct scores, in ranges of the score.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_k"))
    ranks = running_sum(counts, [F.col(col)], {"_upto": F.col("_k")})
    ranks = ranks.select(F.col(col).alias("_c"), ((F.col("_upto") - F.col("_k") + (F.col("_k") + 1) / 2) / F.col("_upto_all") * 100).alias("_pct"))
    d = df.join(ranks, F.col(col) == F.col("_c"), "left")
    return d.withColumn(name, F.when(F.col("_pct").isNotNull(), S.level_of(F.col("_pct")))).drop("_c", "_pct")


def join_census(tracts: DataFrame, census: DataFrame) -> DataFrame:
    d = tracts.join(census, "CVEGEO", "left")
    return d.withColumn("nse_nivel", F.coalesce("nse_nivel", F.lit("S/D")))


def join_marginality(tracts: DataFrame, official: DataFrame) -> DataFrame:
    o = official.select("CVEGEO", *[S.falsy_to_null(F.col(c)).alias(c) for c in official.columns if c != "CVEGEO"])
    return tracts.join(o, "CVEGEO", "left")


def join_price_zone(zones: DataFrame, dim: DataFrame) -> DataFrame:
    return zones.join(dim, "zona", "left")


def population_series(raw: DataFrame) -> DataFrame:
    """raw(municipio, anio, pob) -> municipio, anio_min, anio_max, serie map of year to people."""
    n = raw.groupBy("municipio", "anio").agg(F.sum("pob").cast("long").alias("pob"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("anio").cast("string").alias("k"), F.col("pob").alias("v"))))
    return n.groupBy("municipio").agg(F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"), F.map_from_entries(pairs).alias("serie"))


def touched_municipalities(overlap: DataFrame) -> DataFrame:
    return overlap.select("zone_id", "municipio").distinct()


def population_context(zone_municipalities: DataFrame, series: DataFrame, base: int = 2020) -> DataFrame:
    """zone_id, municipio, anio_fin, cambio_pct from the base year to the last (1 decimal; null if the base has nobody)."""
    s = series.groupBy("municipio").agg(F.max("anio").alias("anio_fin"), F.max_by("pob", "anio").alias("_last"), F.max(F.when(F.col("anio") == base, F.col("pob"))).alias("_base"))
    pct = F.when(F.col("_base") > 0, S.round_js((F.col("_last") / F.col("_base") - 1) * 100, 1))
    return zone_municipalities.join(s.withColumn("cambio_pct", pct).drop("_last", "_base"), "municipio")
