"""Readers of the raw inputs. Nothing is inferred: texts stay texts until a function turns them into numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.functions.geometry import GEOMETRY, geometry_of
from tessella.functions.scalars import drop_uses, landuse_group


def read_census(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def newest(spark: SparkSession, pattern: str) -> str:
    """The last path by name that the pattern finds, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(x.getPath()) for x in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names[-1]


def read_businesses(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest snapshot of a directory: Latin-1 CSV, all text."""
    return spark.read.csv(newest(spark, pattern), header=True, inferSchema=False, encoding="ISO-8859-1", quote='"', escape='"')


def snapshot_label(lines: DataFrame, file_name: str) -> DataFrame:
    """lines(value) of a snapshot's notes -> one row: label, mm/yyyy of the `Modified:` line, else the file name."""
    at = r"^\s*Modified:\s*(\d{4})-(\d{2})-"
    year, month = F.regexp_extract("value", at, 1), F.regexp_extract("value", at, 2)
    hit = F.when(F.col("value").rlike(at), F.concat_ws("/", month, year))
    return lines.agg(F.coalesce(F.max(hit), F.lit(file_name)).alias("label"))


_POINT = "array<double>"
_LINE = f"array<{_POINT}>"
_POLYGON = f"array<{_LINE}>"


def _rings(polygons: Column) -> Column:
    """Rings of array<polygon>, where a polygon is its outer ring and its holes."""
    one = lambda p, i: F.transform(p, lambda r, k: F.struct(i.alias("part"), (k > 0).alias("hole"), F.transform(r, lambda v: v[0]).alias("xs"), F.transform(r, lambda v: v[1]).alias("ys")))
    return F.flatten(F.transform(polygons, one))


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """A row a feature: the named properties (a DDL list), geom for (multi)polygons, lon and lat for points.

    A file is one collection or, with lines, each line one feature (as write_features has it), which Spark reads in parts.
    """
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("geometry", T.StringType()), T.StructField("properties", T._parse_datatype_string(properties))])))])
    if lines:
        f = spark.read.schema(schema["features"].dataType.elementType).json(path).select(F.struct("geometry", "properties").alias("f"))
    else:
        f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")
    coords = F.get_json_object("f.geometry", "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(coords, _POLYGON))).when(kind == "MultiPolygon", F.from_json(coords, f"array<{_POLYGON}>"))
    point = F.when(kind == "Point", F.from_json(coords, _POINT))
    geom = F.when(kind.isin("Polygon", "MultiPolygon"), geometry_of(_rings(polygons))).otherwise(F.lit(None).cast(GEOMETRY))
    return f.select("f.properties.*", geom.alias("geom"), point[0].alias("lon"), point[1].alias("lat"))


def read_webmap(spark: SparkSession, path: str, title: str, field: str, municipality: str, programme: str, area_field: str | None = None, skip_prefix: str | None = None, lines: bool = False) -> DataFrame:
    """Layers -> sublayers -> features of a web map, those of the layer of this title, with attributes under our names.

    Rows with an empty use, or one that begins with skip_prefix, go. With lines, each line of a file is a map.
    """
    attributes = f"struct<`{field}`:string" + (f",`{area_field}`:double" if area_field else "") + ">"
    kind = f"struct<operationalLayers:array<struct<title:string,featureCollection:struct<layers:array<struct<featureSet:struct<features:array<struct<attributes:{attributes},geometry:struct<rings:{_POLYGON}>>>>>>>>>>"
    d = spark.read.schema(T._parse_datatype_string(kind)).json(path, multiLine=not lines)
    d = d.select(F.explode("operationalLayers").alias("l")).where(F.col("l.title") == title)
    d = d.select(F.explode("l.featureCollection.layers").alias("s")).select(F.explode("s.featureSet.features").alias("f"))
    use = F.trim(F.col("f.attributes")[field])
    d = d.where(drop_uses(use, skip_prefix))
    hectares = F.round(F.coalesce(F.col("f.attributes")[area_field], F.lit(0.0)), 1) if area_field else F.lit(None).cast("double")
    rings = F.transform("f.geometry.rings", lambda r, i: F.struct(i.alias("part"), F.lit(False).alias("hole"), F.transform(r, lambda v: v[0]).alias("xs"), F.transform(r, lambda v: v[1]).alias("ys")))
    return d.select(F.lit(municipality).alias("municipio"), F.lit(programme).alias("programa"), use.alias("uso"), landuse_group(use).alias("grupo"), hectares.alias("hectareas"), F.lit(field).alias("plano"), geometry_of(rings).alias("geom"))


def read_osm(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row an element. A file is one answer of the service or, with lines, each line is one."""
    kind = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    return spark.read.schema(kind).json(path, multiLine=not lines).select(F.explode("elements").alias("e")).select("e.*")
