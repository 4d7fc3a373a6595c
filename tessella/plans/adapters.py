"""Places for the test tables, which have none: a formula of each key, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions.geometry import rectangle

WEST, SOUTH, WIDE, HIGH = -102.42, 21.75, 0.27, 0.23


def lon_of(key: Column) -> Column:
    return F.lit(WEST) + (key * 7919) % 10007 / F.lit(10007.0) * WIDE


def lat_of(key: Column) -> Column:
    return F.lit(SOUTH) + (key * 104729) % 10009 / F.lit(10009.0) * HIGH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business an order: id, lon, lat, category (its priority's), sector, activity, size class."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return o.select(
        k.alias("id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"),
        pick(["Educación", "Salud", "Abasto", "Bancos", "Parques", "Gasolineras"], k * 31 % 97).alias("category"),
        pick(["46", "72", "81", "62", "61", "54", "31", "43", "71", "11"], k * 17 % 101).alias("sector"),
        F.concat(F.lit("act "), (k * 13 % 7).cast("string")).alias("nombre_act"),
        pick(["0 a 5 personas", "6 a 10 personas", "31 a 50 personas", "251 y más personas"], k * 11 % 89).alias("per_ocu"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


def tiles(spark: SparkSession, sf_dir: str, name: str, key: str, shift: float = 0.0) -> tuple[DataFrame, int]:
    """The table's rows as tiles of a g x g grid over the area: all columns, gid, geom, x1, y1, x2, y2."""
    t = table(spark, sf_dir, name)
    n = t.count()
    g = max(1, int(-(-(n**0.5) // 1)))
    while g * g < n:
        g += 1
    i, j = F.col(key) % g, F.floor(F.col(key) / g)
    d = t.withColumns({"gid": F.col(key), "x1": WEST + shift + i * (WIDE / g), "y1": SOUTH + shift + j * (HIGH / g), "x2": WEST + shift + (i + 1) * (WIDE / g), "y2": SOUTH + shift + (j + 1) * (HIGH / g)})
    return d.withColumn("geom", rectangle(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))), g


def tracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tract a supplier, with figures from its key and balance; some are missing."""
    d, _ = tiles(spark, sf_dir, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    unless = lambda n, v: F.when(k % n != 0, v.cast("double"))
    return d.select(
        "gid", "geom", F.concat(F.lit("0100"), k.cast("string")).alias("CVEGEO"),
        unless(11, 200 + k * 37 % 4801).alias("POBTOT"), unless(13, 90 + k * 19 % 2203).alias("POBFEM"), (50 + k * 7 % 1409).cast("double").alias("TVIVPARHAB"),
        unless(17, 5 + k * 29 % 131 / 10).alias("GRAPROES"), unless(7, k * 41 % 1009 / 10.09).alias("pct_inter"), (k * 23 % 907 / 9.07).cast("double").alias("pct_2dorm"),
        unless(5, k * 3 % 701 / 7.01).alias("pct_3cuart"), (F.col("s_acctbal") / 10000).alias("nse_score"),
        F.element_at(F.array(*map(F.lit, ["A/B", "C+", "C", "C-", "D+", "D", "E"])), (k * 5 % 7 + 1).cast("int")).alias("nse_nivel"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn zone a customer: a rectangle of up to 3 km around its place, and the radius of a round one.

    Keys are dealt evenly first: a file of keys is read by a task or two, however much work a zone is."""
    k = F.col("c_custkey")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = table(spark, sf_dir, "customer").select(k).repartition(n, k).select(k.alias("zone_id"), lon_of(k).alias("lng"), lat_of(k).alias("lat"), ((k % 5 + 1) * 0.1).alias("radius_km"), ((k % 6 + 1) * 0.002).alias("half"))
    return d.withColumn("geom", rectangle(F.col("lng") - F.col("half"), F.col("lat") - F.col("half"), F.col("lng") + F.col("half"), F.col("lat") + F.col("half")))


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracts in three shapes, by gid % 3: an L (the upper right corner is missing), with a hole right of the middle, and a tile with
    a corner in the middle of a side. All columns of tracts()."""
    g = F.col("geom")
    x1, y1, x2, y2 = (g[c] for c in ("xmin", "ymin", "xmax", "ymax"))
    x = lambda part: x1 + (x2 - x1) * part
    y = lambda part: y1 + (y2 - y1) * part
    ring = lambda hole, xs, ys: F.struct(F.lit(0).alias("part"), F.lit(hole).alias("hole"), F.array(*xs).alias("xs"), F.array(*ys).alias("ys"))
    whole = ring(False, (x1, x2, x2, x1, x1), (y1, y1, y2, y2, y1))
    ell = ring(False, (x1, x2, x2, x(0.5), x(0.5), x1, x1), (y1, y1, y(0.6), y(0.6), y2, y2, y1))
    hole = ring(True, (x(0.5), x(0.5), x(0.75), x(0.75), x(0.5)), (y(0.25), y(0.75), y(0.75), y(0.25), y(0.25)))
    corner = ring(False, (x1, x(0.5), x2, x2, x1, x1), (y1, y1, y1, y2, y2, y1))
    kind = F.col("gid") % 3
    rings = F.when(kind == 0, F.array(ell)).when(kind == 1, F.array(whole, hole)).otherwise(F.array(corner))
    return tracts(spark, sf_dir).withColumn("geom", F.struct(x1.alias("xmin"), y1.alias("ymin"), x2.alias("xmax"), y2.alias("ymax"), rings.alias("rings")))
