"""Where steps are written that later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset a temporary one, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_tessella_steps", None)
        if not found:
            found = spark._tessella_steps = "file://" + tempfile.mkdtemp(prefix="spark-tessella-")
    return found


def written(df: DataFrame) -> DataFrame:
    """df written to the scratch folder once and read back: what reads it later doesn't compute it again."""
    path = f"{scratch_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
