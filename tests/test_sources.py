import json

import pytest
from pyspark.sql import functions as F

from tessella.functions.geometry import rectangle
from tessella.sources import readers, writers
from tessella.streaming.traffic import classify_readings


def test_census_and_businesses(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ENTIDAD,MUN\n01,001\n")
    assert readers.read_census(spark, str(tmp_path / "c.csv")).first().MUN == "001"
    (tmp_path / "d_2023.csv").write_bytes("nom_estab\nviejo\n".encode("latin-1"))
    (tmp_path / "d_2024.csv").write_bytes("nom_estab\nCafé\n".encode("latin-1"))
    assert [r.nom_estab for r in readers.read_businesses(spark, str(tmp_path / "d_*.csv")).collect()] == ["Café"]
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, str(tmp_path / "none*.csv"))
    lines = spark.createDataFrame([("x",), ("Modified: 2025-11-03",)], "value string")
    assert readers.snapshot_label(lines, "f").first().label == "11/2025"
    assert readers.snapshot_label(lines.where("value = 'x'"), "f").first().label == "f"


def test_geojson_round_trip(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.2]]]
    fc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}, "properties": {"id": 1}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": {"id": 2}}]}
    (tmp_path / "a.json").write_text(json.dumps(fc, indent=1))
    d = readers.read_geojson(spark, str(tmp_path / "a.json"), "id int")
    r = {x.id: x for x in d.collect()}
    assert [q.hole for q in r[1].geom.rings] == [False, True] and r[1].geom.xmax == 1 and (r[2].lon, r[2].lat) == (3, 4)
    writers.write_features(d.where("id = 1").select("id", "geom"), str(tmp_path / "out"), text=True)
    back = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert back["geometry"]["coordinates"] == [[[[float(v) for v in p] for p in ring] for ring in square]] and back["properties"] == {"id": 1}


def test_webmap_and_osm(spark, tmp_path):
    f = lambda use: {"attributes": {"USO": use, "HA": 2.34}, "geometry": {"rings": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    w = {"operationalLayers": [{"title": "T", "featureCollection": {"layers": [{"featureSet": {"features": [f("Industria"), f(" "), f("VIALIDAD x")]}}]}}, {"title": "U", "featureCollection": {"layers": []}}]}
    (tmp_path / "w.json").write_text(json.dumps(w))
    r = readers.read_webmap(spark, str(tmp_path / "w.json"), "T", "USO", "A", "P", "HA", "VIALIDAD").collect()
    assert [(x.uso, x.grupo, x.hectareas) for x in r] == [("Industria", "Industrial", 2.3)]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "bank"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}}]}))
    o = {x.id: x for x in readers.read_osm(spark, str(tmp_path / "o.json")).collect()}
    assert o[1].tags == {"amenity": "bank"} and o[2].center.lat == 3.0


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([('Café "Uno"', 21.9, -102.3, "Salud", "x", "10"), ("b", 21.8, -102.2, "Abasto", "y", "9")], "nombre string, lat double, lon double, categoria string, actividad string, tamano string")
    writers.write_compact(b, str(tmp_path / "c"))
    assert {x.value: x.code for x in spark.read.parquet(str(tmp_path / "c/tamano")).collect()} == {"9": 0, "10": 1}
    writers.write_metrics_csv(spark.createDataFrame([(1, 'a "q"', "2")], "zone_id int, metrica string, valor string"), str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("zone_id=1/*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿") or text.startswith('"﻿') and '""q""' in text
    r = spark.createDataFrame([(1,)], "zone_id int").withColumn("report", F.struct(F.lit(None).cast("double").alias("x")))
    writers.write_zone_reports(r, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"zone_id": 1, "x": None}
    writers.write_gis_layers({"z": spark.range(1).select(rectangle(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("geom"))}, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/z")).count() == 1


def test_traffic_stream(spark, tmp_path):
    kind = "current_speed double, free_flow_speed double, current_travel_time double, free_flow_travel_time double, road_closure boolean"
    spark.createDataFrame([(95.0, 100.0, 12.0, 10.0, False), (10.0, 100.0, 90.0, 10.0, None)], kind).write.parquet(str(tmp_path / "in"))
    q = classify_readings(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert {(x.nivel, x.demora) for x in spark.table("levels").collect()} == {("Fluido", 2.0), ("Detenido", 80.0)}
