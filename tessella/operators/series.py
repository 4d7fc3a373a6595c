"""Price-index series: long rows (clave, anio, trimestre, indice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def index_series(df: DataFrame, specs: list[dict]) -> DataFrame:
    """df(global/nivel, estado, municipio, anio, trimestre, indice) -> clave, anio, trimestre, indice.

    A spec has clave and nivel (nacional, estado, municipio) and the names its level needs; the state's own series is the one
    without a municipality.
    """
    d = df.where(F.col("indice").isNotNull())
    clean = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    out = None
    for s in specs:
        if s["nivel"] == "nacional":
            hit = clean("nivel") == s.get("nombre", "Nacional")
        elif s["nivel"] == "estado":
            hit = (clean("estado") == s["estado"]) & (clean("municipio") == "")
        else:
            hit = (clean("estado") == s["estado"]) & (clean("municipio") == s["municipio"])
        one = d.where(hit).select(F.lit(s["clave"]).alias("clave"), F.col("anio").cast("int"), F.col("trimestre").cast("int"), F.round(F.col("indice").cast("double"), 2).alias("indice"))
        out = one if out is None else out.unionByName(one)
    return out


def yoy(series: DataFrame) -> DataFrame:
    """Each point against the same quarter a year before, by key."""
    before = series.select("clave", (F.col("anio") + 1).alias("anio"), "trimestre", F.col("indice").alias("previo"))
    return series.join(before, ["clave", "anio", "trimestre"], "left").withColumn("pct", (F.col("indice") / F.col("previo") - 1) * 100)


def latest_yoy(series: DataFrame) -> DataFrame:
    """clave, anio, trimestre, indice, pct of the last point; pct is null with fewer than 5 points or without the year before."""
    n = series.groupBy("clave").agg(F.count("*").alias("n"), F.max(F.struct("anio", "trimestre")).alias("x")).select("clave", "n", "x.anio", "x.trimestre")
    d = yoy(series).join(n, ["clave", "anio", "trimestre"])
    return d.select("clave", "anio", "trimestre", "indice", F.when(F.col("n") >= 5, F.col("pct")).alias("pct"))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
