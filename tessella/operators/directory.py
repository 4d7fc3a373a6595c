"""Business directory, points of interest and land use: classes, codes, counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions import scalars as S
from tessella.operators.ranking import running_sum
from tessella.operators.spatial import by_block
from tessella.sources.scratch import written

# Sectors of each group, and size classes that count as large.
SECTOR_GROUPS = {
    "comercio_menor": ["46"], "alimentos_alojamiento": ["72"], "otros_servicios": ["81"], "salud": ["62"], "educacion": ["61"],
    "prof_financiero_inmobiliario": ["54", "52", "53"], "industria": ["31", "32", "33"], "comercio_mayor": ["43"], "esparcimiento": ["71"],
}
LARGE = ["31 a 50 personas", "51 a 100 personas", "101 a 250 personas", "251 y más personas"]
FEATURES = ["densidad_km2", *[f"pct_{g}" for g in SECTOR_GROUPS], "pct_empleo_grande"]


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def osm_points(elements: DataFrame) -> DataFrame:
    """elements(id, lat, lon, center, tags) -> id, lat, lon, category, kind, name; without a place or a category a row goes."""
    d = elements.withColumn("_c", S.poi_category(F.col("tags"))).withColumn("_lat", F.coalesce("lat", "center.lat")).withColumn("_lon", F.coalesce("lon", "center.lon"))
    d = d.where("_c is not null and _lat is not null and _lon is not null")
    name = S.display_name(F.col("tags")["name"], F.concat(F.col("_c.category"), F.lit(" sin nombre")))
    return d.select("id", F.round("_lat", 6).alias("lat"), F.round("_lon", 6).alias("lon"), F.col("_c.category").alias("category"), F.concat_ws("=", "_c.k", "_c.v").alias("kind"), name.alias("name"))


def dedupe_points(points: DataFrame, id_col: str = "id") -> DataFrame:
    """Of points of a category in one place (5 decimals), the first by id: a combinable aggregate, not a window."""
    rest = [c for c in points.columns if c != id_col]
    return points.groupBy(F.round("lat", 5).alias("_a"), F.round("lon", 5).alias("_o"), F.col("category").alias("_c")).agg(F.min_by(F.struct(id_col, *rest), id_col).alias("x")).select("x.*")


def dictionary_encode(df: DataFrame, cols: list[str], order: dict[str, list[Column]] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """df with `<col>_code`, and for each column its dictionary (code, value): places in sorted order, from 0.

    A dictionary has a row a distinct value; it is joined, and broadcast where Spark finds it small.
    """
    dims, out = {}, df
    for c in cols:
        by = (order or {}).get(c) or [F.col(c)]
        values = df.where(F.col(c).isNotNull()).select(c).distinct()
        dim = running_sum(values, by, {"_n": F.lit(1)}).select((F.col("_n") - 1).cast("int").alias("code"), F.col(c).alias("value"))
        dims[c] = dim
        out = out.join(dim.select(F.col("code").alias(f"{c}_code"), F.col("value").alias(c)), c, "left")
    return out, dims


def by_length(c: str) -> list[Column]:
    return [F.length(c), F.col(c)]


def viewport_points(points: DataFrame, viewports: DataFrame, cap: int = 4000, cell: float = 0.01) -> DataFrame:
    """points(id, lat, lon, category), viewports(view_id, south, west, north, east, categories) -> view_id, n, ids.

    Boxes are widened by a tenth on each side. ids is null where more than cap points show (too many to draw): only counts
    are kept for those. A view meets its points in one block, where they are counted and dropped.
    """
    dy, dx = (F.col("north") - F.col("south")) * 0.1, (F.col("east") - F.col("west")) * 0.1
    v = viewports.select("view_id", "categories", (F.col("south") - dy).alias("s"), (F.col("north") + dy).alias("n_"), (F.col("west") - dx).alias("w"), (F.col("east") + dx).alias("e"))
    place = lambda d, *keep: d.select(*keep, F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    boxes = v.select("view_id", "categories", F.col("w").alias("x1"), F.col("s").alias("y1"), F.col("e").alias("x2"), F.col("n_").alias("y2"))
    asked = boxes.withColumn("category", F.explode(F.array_distinct("categories"))).drop("categories")
    codes = written(points.select("category").union(asked.select("category")).where("category is not null").distinct().withColumn("code", F.monotonically_increasing_id()))  # a row a category
    coded = points.join(codes, "category")
    wanted = asked.join(codes, "category").groupBy("view_id", "x1", "y1", "x2", "y2").agg(F.sort_array(F.collect_list("code")).alias("codes"))

    def shown(view: dict, x: dict[str, np.ndarray]) -> list[tuple]:
        hit = x["id"][np.isin(x["code"], view["codes"])]
        return [(len(hit), sorted(hit.tolist()) if len(hit) <= cap else None)] if len(hit) else []

    hits = by_block(wanted, place(coded, "id", "code"), ["view_id"], ["id", "code"], "n long, ids array<long>", shown, cell, ["codes"])
    return viewports.select("view_id").join(hits, "view_id", "left").select("view_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) <= cap, F.coalesce("ids", F.array().cast("array<long>"))).alias("ids"))


def business_mix(points: DataFrame, by: str, area_km2: Column | None = None) -> DataFrame:
    """points(by, sector, per_ocu[, area_km2]) -> by, n, density and shares of sector groups and of large firms."""
    area = area_km2 if area_km2 is not None else F.lit(None).cast("double")
    shares = [F.avg(F.when(F.col("sector").isin(s), 1.0).otherwise(0.0)).alias(f"pct_{g}") for g, s in SECTOR_GROUPS.items()]
    d = points.withColumn("_area", area).groupBy(by).agg(F.count("*").alias("n"), F.first("_area", ignorenulls=True).alias("_area"), *shares, F.avg(F.when(F.col("per_ocu").isin(LARGE), 1.0).otherwise(0.0)).alias("pct_empleo_grande"), F.avg(F.when(F.col("sector").isin("11", "21"), 1.0).otherwise(0.0)).alias("pct_primario"))
    return d.withColumn("densidad_km2", F.when(F.col("_area") > 0, F.col("n") / F.col("_area")).otherwise(0.0)).drop("_area")


def top_activity(points: DataFrame, by: str, activity: str = "nombre_act") -> DataFrame:
    """by, top, top_share: the most common activity (of equals the first by name)."""
    n = points.groupBy(by, activity).agg(F.count("*").alias("k"))
    best = n.groupBy(by).agg(F.sum("k").alias("all"), F.min(F.struct((-F.col("k")).alias("k"), F.col(activity).alias("a"))).alias("x"))
    return best.select(by, F.col("x.a").alias("top"), (-F.col("x.k") / F.col("all")).alias("top_share"))


def category_counts(points: DataFrame, col: str = "category") -> DataFrame:
    return points.groupBy(col).count()


def value_histogram(values: DataFrame, col: str, size: int = 1000) -> DataFrame:
    return values.where(F.col(col).isNotNull()).groupBy((F.floor(F.col(col) / size) * size).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def describe_by(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    c = F.col(col)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.percentile(c, F.lit(0.5)).alias("median"), F.max(c).alias("most"), F.sum(c).alias("total"))


def totals_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Sums by key and the grand total (key null, is_total 1)."""
    return df.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in cols])
