"""Estimates where no tract exists: clusters of businesses, their mix, a boosted model of the index."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.functions.geometry import GEOMETRY
from tessella.functions.scalars import exclusion_reason
from tessella.operators import kernels as K
from tessella.operators.directory import FEATURES
from tessella.operators.spatial import cell_value
from tessella.sources.scratch import written

SEED = 42
#: Rows of a task of the fits. Each of the hundreds of rounds costs a task about as much as it costs this many rows.
TASK_ROWS = 100_000


def fit_proxy(features: DataFrame, label: str = "nse_score", cols: list[str] = FEATURES, trees: int = 150, depth: int = 2, rate: float = 0.05):
    """The boosted model of all rows, which are dealt first to as many tasks as they fill, however they lie."""
    from pyspark.ml import Pipeline

    dealt = features.select(label, *cols).repartition(max(1, -(-features.count() // TASK_ROWS))).sortWithinPartitions(label, *cols)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep"), GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED)]).fit(dealt)


def cross_val_predict(features: DataFrame, key: str, label: str = "nse_score", cols: list[str] = FEATURES, k: int = 5, **options) -> DataFrame:
    """key, label, fold, prediction: each row by a model that has not seen its fold. The folds' fits are jobs side by side, over
    features that are written once."""
    d = written(features.select(key, label, *cols).withColumn("fold", F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(k)).cast("int")))
    fit = inheritable_thread_target(d.sparkSession)(lambda i: fit_proxy(d.where(F.col("fold") != i), label, cols, **options))
    with ThreadPoolExecutor(k) as pool:
        models = list(pool.map(fit, range(k)))
    parts = [m.transform(d.where(F.col("fold") == i)).select(key, label, "fold", "prediction") for i, m in enumerate(models)]
    return functools.reduce(DataFrame.unionByName, parts)


def tercile_cuts(df: DataFrame, col: str) -> DataFrame:
    """One row: cuts, the exact linear quantiles at 1/3 and 2/3."""
    return df.agg(F.percentile(col, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cuts"))


def tercile(df: DataFrame, col: str, cuts: DataFrame, name: str = "nivel3") -> DataFrame:
    """0, 1 or 2: a value on a cut goes up. cuts has one row."""
    d = df.join(F.broadcast(cuts), F.lit(True))
    c = F.col("cuts")
    return d.withColumn(name, F.when(F.col(col) >= c[1], 2).when(F.col(col) >= c[0], 1).when(F.col(col).isNotNull(), 0)).drop("cuts")


def validation_metrics(preds: DataFrame, cuts: DataFrame, label: str = "nse_score") -> DataFrame:
    """One row: n, r2, correlation, share of rows in the right third, share two thirds off."""
    d = tercile(tercile(preds, label, cuts, "_a"), "prediction", cuts, "_b").withColumnRenamed(label, "_y")
    mean = d.agg(F.avg("_y").alias("_m"))
    d = d.join(F.broadcast(mean), F.lit(True))
    return d.agg(F.count("*").alias("n"), (1 - F.sum(F.pow(F.col("_y") - F.col("prediction"), 2)) / F.sum(F.pow(F.col("_y") - F.col("_m"), 2))).alias("r2"), F.corr("_y", "prediction").alias("correlation"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("accuracy"), F.avg((F.abs(F.col("_a") - F.col("_b")) >= 2).cast("double")).alias("serious"))


def dbscan(points: DataFrame, pid: str, eps: float = 180.0, min_samples: int = 6) -> DataFrame:
    """points(pid, x, y in metres) -> pid, core, cluster (its smallest core id); noise has no row.

    Cells are eps / 3 wide, so that all points of a cell and the eight around it are within eps of each other: where these hold
    min_samples points, all of the cell are core without comparing any two. Only the few others meet the points of the cells
    within reach. The cores of a cell are connected, so components are of cells: first by the boxes of their cores, where these
    leave no doubt; only cells that then still lie in different components are compared point by point. No group is gathered.
    """
    side = eps / 3
    p = written(points.select(pid, "x", "y", F.floor(F.col("x") / side).cast("int").alias("cx"), F.floor(F.col("y") / side).cast("int").alias("cy")))
    around = lambda r: F.explode(F.transform(F.sequence(F.lit(0), F.lit((2 * r + 1) ** 2 - 1)), lambda i: F.struct((F.floor(i / (2 * r + 1)) - r).cast("int").alias("dx"), (i % (2 * r + 1) - r).cast("int").alias("dy"))))
    reach = lambda d, r, *keep: d.select(*keep, "cx", "cy", around(r).alias("d")).select(*keep, "cx", "cy", (F.col("cx") + F.col("d.dx")).alias("nx"), (F.col("cy") + F.col("d.dy")).alias("ny"))
    counts = p.groupBy("cx", "cy").agg(F.count("*").alias("k"))
    close = reach(counts, 1).join(counts.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "k"), ["nx", "ny"]).groupBy("cx", "cy").agg(F.sum("k").alias("near"))
    q = p.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    within = F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2) <= eps * eps
    close = written(close)
    sparse = p.join(close.where(F.col("near") < min_samples), ["cx", "cy"], "left_semi")
    few = reach(sparse, 4, pid, "x", "y").join(q, ["nx", "ny"]).where(within)
    some = written(few.groupBy(pid).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(pid))
    core = written(p.join(close.where(F.col("near") >= min_samples), ["cx", "cy"], "left_semi").unionByName(sparse.join(some, pid, "left_semi")))
    cells = written(core.groupBy("cx", "cy").agg(F.min(pid).alias("label"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2")))
    other = cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), *[F.col(c).alias("n" + c) for c in ("x1", "x2", "y1", "y2")])
    two = reach(cells, 4, "x1", "x2", "y1", "y2").where("nx > cx or (nx = cx and ny > cy)").join(other, ["nx", "ny"])
    least = F.pow(F.greatest(F.lit(0.0), F.col("nx1") - F.col("x2"), F.col("x1") - F.col("nx2")), 2) + F.pow(F.greatest(F.lit(0.0), F.col("ny1") - F.col("y2"), F.col("y1") - F.col("ny2")), 2)
    most = F.pow(F.greatest(F.col("nx2") - F.col("x1"), F.col("x2") - F.col("nx1")), 2) + F.pow(F.greatest(F.col("ny2") - F.col("y1"), F.col("y2") - F.col("ny1")), 2)
    two = written(two.where(least <= eps * eps).select("cx", "cy", "nx", "ny", (most <= eps * eps).alias("sure")))

    def spread(links: DataFrame, labels: DataFrame) -> DataFrame:
        """Smallest labels over linked cells. Cells of one label move together, to the smallest label beside any of them, and on to where
        that one moves: whole groups merge in each round, so that rounds hardly grow with the length of a cluster."""
        both = links.unionByName(links.select(F.col("nx").alias("cx"), F.col("ny").alias("cy"), F.col("cx").alias("nx"), F.col("cy").alias("ny")))
        while True:
            seen = both.join(labels.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "label"), ["nx", "ny"]).groupBy("cx", "cy").agg(F.min("label").alias("other"))
            up = written(labels.join(seen, ["cx", "cy"]).groupBy("label").agg(F.min(F.least("label", "other")).alias("up")))
            if not up.where("up < label").take(1):
                return labels
            on = up.join(up.select(F.col("label").alias("up"), F.col("up").alias("on")), "up").select("label", F.col("on").alias("new"))
            labels = written(labels.join(on, "label", "left").select("cx", "cy", F.coalesce("new", "label").alias("label")))

    sure = two.where("sure").select("cx", "cy", "nx", "ny")
    labels = spread(sure, cells.select("cx", "cy", "label"))
    open_ = two.where("not sure").join(labels, ["cx", "cy"]).join(labels.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("label").alias("nlabel")), ["nx", "ny"]).where("label <> nlabel").select("cx", "cy", "nx", "ny")
    far = core.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    touching = written(open_.join(core.select("cx", "cy", "x", "y"), ["cx", "cy"]).join(far, ["nx", "ny"]).where(within).select("cx", "cy", "nx", "ny").distinct())
    if touching.take(1):
        labels = spread(sure.unionByName(touching), labels)
    inside = core.join(labels, ["cx", "cy"]).select(pid, F.lit(True).alias("core"), F.col("label").alias("cluster"))
    # points that are no cores take the smallest cluster among the cores they reach
    rest = sparse.join(some, pid, "left_anti")
    lc = core.join(labels, ["cx", "cy"]).select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), "label")
    border = reach(rest, 4, pid, "x", "y").join(lc, ["nx", "ny"]).where(within)
    return inside.unionByName(border.groupBy(pid).agg(F.min("label").alias("cluster")).select(pid, F.lit(False).alias("core"), "cluster"))


#: Cells across a block where circles meet, and points of a block above which it is parted.
CELLS_ACROSS, MOST_POINTS = 10, 100_000


def _open_arcs(points: DataFrame, others: DataFrame, cluster: str, r: float, most: int = MOST_POINTS) -> DataFrame:
    """points, others (cluster, x, y), each once -> cluster, x, y, first, last: the arcs of a point's circle (angles from 0 to two pi)
    that no other's disc covers. Circles meet in blocks, which get the others within 2r too: pairs, far more than points, are neither
    shuffled nor broadcast. Crowded blocks part their points."""
    size = CELLS_ACROSS * 2 * r
    at = lambda c, by=0.0: F.floor((F.col(c) + by) / size).cast("long")
    keys = [cluster, "bx", "by_"]
    p = points.select(cluster, "x", "y", at("x").alias("bx"), at("y").alias("by_"))
    parts = written(p.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")))
    reach = 2 * r * (1 + 1e-9)
    around = lambda c: F.explode(F.sequence(at(c, -reach), at(c, reach)))
    p = p.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")).drop("parts")
    q = others.select(cluster, "x", "y", around("x").alias("bx")).withColumn("by_", around("y")).join(parts, keys)
    own = ["_cluster", "qbx", "qby", "qpart"]  # the others may be the points themselves
    q = q.select(*[F.col(c).alias(n) for c, n in zip((*keys, "x", "y"), (*own[:3], "qx", "qy"), strict=True)], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("qpart"))

    def meet(ps: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(ps):
            return pd.DataFrame(columns=[cluster, "x", "y", "first", "last"])
        x, y = ps["x"].to_numpy(), ps["y"].to_numpy()
        i, first, last = K.open_arcs(x, y, qs["qx"].to_numpy(), qs["qy"].to_numpy(), r)
        return pd.DataFrame({cluster: ps[cluster].iloc[0], "x": x[i], "y": y[i], "first": first, "last": last})

    kind, keys = points.schema[cluster].dataType.simpleString(), [*keys, "part"]
    return p.groupBy(*keys).cogroup(q.groupBy(*own)).applyInPandas(meet, f"{cluster} {kind}, x double, y double, first double, last double")


def cluster_footprints(points: DataFrame, cluster: str, radius_m: float = 90.0, steps: int = 16, outlines: bool = True) -> DataFrame:
    """points(cluster, x, y in metres) -> cluster, km2, x, y (centroid), geom (outline in metres): the union of discs around the points.
    Without outlines there is no geom, and nothing of a cluster is gathered.

    The boundary of the union is made of the arcs that no other disc covers. Area and centroid are sums over these arcs (Green's
    theorem), exact for circles. Where points crowd, one whose circle is already covered by one point of each cell around it
    lies inside and needn't meet all others, so that a crowd costs what its rim costs. The outline has `steps` pieces a quarter turn; it is put
    together from the arcs of a cluster, which is one row of the result. A null cluster or place takes no part.
    """
    r = float(radius_m)
    d = written(points.where(F.col(cluster).isNotNull()).select(cluster, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().distinct())
    few = d.groupBy(cluster, F.floor(F.col("x") / r).alias("cx"), F.floor(F.col("y") / r).alias("cy")).agg(F.min(F.struct("x", "y")).alias("p")).select(cluster, "p.x", "p.y")
    crowded = d.count() > 3 * few.count()  # else hardly a point is inside
    rim = written(_open_arcs(d, few, cluster, r).select(cluster, "x", "y").distinct()) if crowded else d
    arcs = written(_open_arcs(rim, d, cluster, r))
    a, b, x, y = F.col("first"), F.col("last"), F.col("x"), F.col("y")
    change = lambda f: f(b) - f(a)
    cos, sin = change(F.sin), change(lambda t: -F.cos(t))  # of integrals: over cos, sin, their squares and cubes
    double = change(lambda t: F.sin(2 * t)) / 4
    cos2, sin2 = (b - a) / 2 + double, (b - a) / 2 - double
    cos3, sin3 = change(lambda t: F.sin(t) - F.pow(F.sin(t), 3) / 3), change(lambda t: F.pow(F.cos(t), 3) / 3 - F.cos(t))
    area = F.sum(r * (r * (b - a) + x * cos + y * sin) / 2)
    mx = F.sum(r * (x * x * cos + 2 * r * x * cos2 + r * r * cos3) / 2)
    my = F.sum(r * (y * y * sin + 2 * r * y * sin2 + r * r * sin3) / 2)
    sums = arcs.groupBy(cluster).agg(area.alias("area"), mx.alias("mx"), my.alias("my"))
    figures = sums.select(cluster, (F.col("area") / 1e6).alias("km2"), (F.col("mx") / F.col("area")).alias("x"), (F.col("my") / F.col("area")).alias("y"))

    if not outlines:
        return figures

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for cx, cy, first, last in pdf[["x", "y", "first", "last"]].to_numpy():
            t = np.linspace(first, last, max(2, int(np.ceil((last - first) / (np.pi / 2) * steps - 1e-9)) + 1))
            px, py = cx + r * np.cos(t), cy + r * np.sin(t)
            parts.append(np.column_stack((px[:-1], py[:-1], px[1:], py[1:])))
        return pd.DataFrame([(pdf[cluster].iloc[0], cell_value(K.stitch(*K.snapped(np.concatenate(parts), 1e-6))))], columns=[cluster, "geom"])

    kind = points.schema[cluster].dataType.simpleString()
    shapes = arcs.groupBy(cluster).applyInPandas(outline, f"{cluster} {kind}, geom {GEOMETRY}")
    return figures.join(shapes, cluster)


def score_clusters(features: DataFrame, model, cuts: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Clusters with n, shares, top, top_share -> with excluido (or null), score (3 decimals) and level; excluded ones have neither."""
    d = features.withColumn("excluido", exclusion_reason(F.col("n"), F.col("pct_industria") + F.col("pct_primario"), F.col("top_share"), F.col("top")))
    d = model.transform(d.fillna(0.0, cols)).drop("_x")
    d = tercile(d, "prediction", cuts)
    keep = F.col("excluido").isNull()
    return d.withColumn("score", F.when(keep, F.round("prediction", 3))).withColumn("nivel", F.when(keep, F.element_at(F.array(F.lit("Bajo"), F.lit("Medio"), F.lit("Alto")), F.col("nivel3") + 1))).drop("prediction", "nivel3")
