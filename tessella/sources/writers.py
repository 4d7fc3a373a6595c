"""Writers of results. Each writes files by partition; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.directory import by_length, dictionary_encode


def geojson_geometry(geom: Column) -> Column:
    """A (multi)polygon as JSON text: each ring without the hole mark opens a polygon, holes follow their part."""
    outer = F.filter(geom["rings"], lambda r: ~r["hole"])
    polygons = F.transform(outer, lambda o: F.concat(F.array(_pairs(o)), F.transform(F.filter(geom["rings"], lambda r: r["hole"] & (r["part"] == o["part"])), _pairs)))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))


def _pairs(ring: Column) -> Column:
    return F.zip_with(ring["xs"], ring["ys"], lambda x, y: F.array(x, y))


def write_features(df: DataFrame, path: str, geom: str = "geom", text: bool = False) -> None:
    """Parquet, or (text=True) one GeoJSON feature a line."""
    if not text:
        df.write.parquet(path)
        return
    rest = [c for c in df.columns if c != geom]
    line = F.concat(F.lit('{"type":"Feature","geometry":'), geojson_geometry(F.col(geom)), F.lit(',"properties":'), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), F.lit("}"))
    df.select(line.alias("value")).write.text(path)


def write_compact(df: DataFrame, path: str) -> None:
    """df(nombre, lat, lon, categoria, actividad, tamano) as facts with codes and three dictionaries."""
    coded, dims = dictionary_encode(df, ["categoria", "actividad", "tamano"], {"tamano": by_length("tamano")})
    coded.select("nombre", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "categoria_code", "actividad_code", "tamano_code").write.parquet(f"{path}/facts")
    for name, dim in dims.items():
        dim.write.parquet(f"{path}/{name}")


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV, a folder a zone, quotes doubled, every file led by a byte order mark through its header."""
    head = [F.col(c).alias(c if i else "﻿" + c) for i, c in enumerate(c for c in rows.columns if c != "zone_id")]
    rows.select(*head, "zone_id").write.partitionBy("zone_id").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def write_zone_reports(reports: DataFrame, path: str) -> None:
    """A JSON line a zone; missing figures are written as null."""
    reports.select(F.to_json(F.struct("zone_id", "report.*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_gis_layers(layers: dict[str, DataFrame], path: str) -> None:
    for name, df in layers.items():
        df.write.parquet(f"{path}/{name}")
