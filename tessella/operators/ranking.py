"""Running sums over a whole table without a window over all its rows: ranges of the order, and one row a range."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.sources.scratch import scratch_dir


def running_sum(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its value over all rows up to and with each, and `name`_all, the sum of all. The
    order must have no ties. Rows are written once in ranges of the order; only the ranges' totals (one row each) are summed
    in one task."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{scratch_dir(spark)}/ranges-{uuid.uuid4().hex}"
    df.withColumns({f"_value_{c}": v for c, v in values.items()}).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    totals = d.groupBy("_part").agg(*[F.sum(f"_value_{c}").alias(c) for c in values])
    upto, every = W.orderBy("_part"), W.partitionBy(F.lit(1))
    ahead = totals.select("_part", *[(F.sum(c).over(upto) - F.col(c)).alias(f"_ahead_{c}") for c in values], *[F.sum(c).over(every).alias(f"{c}_all") for c in values])
    within = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.join(F.broadcast(ahead), "_part").withColumns({c: F.col(f"_ahead_{c}") + F.sum(f"_value_{c}").over(within) for c in values})
    return d.drop("_part", "_at", *[f"_{x}_{c}" for c in values for x in ("value", "ahead")])
