"""Vectors in blocks, and every block of queries against every block of vectors.

Vectors are packed into rows of up to BLOCK vectors where they are read. Query blocks meet vector blocks in an equi-join on
(group of query blocks, salt): each vector block has one salt and is sent once a group, each query block is sent to all salts.
The work is queries x vectors, as asked, in pairs of blocks of bounded size; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 2048
QUERIES = 512
PACKED = "n int, ids binary, data binary"


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.float64).reshape(len(i), -1) if len(i) else np.zeros((0, 0))


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is whole: no null, no NaN, no infinity; not all zero if zero=False.
    Empty vectors and null ids take no part."""
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    return d if zero else d.where(F.exists("v", lambda x: x != 0))


def pack(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Vectors to blocks, where they lie. All vectors of a block have one length (others start a block of their own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            lists = batch.column(1)
            flat, n = np.asarray(lists.flatten(), np.float64), np.diff(np.asarray(lists.offsets, np.int64))
            upto = np.concatenate(([0], np.cumsum(n)))
            for d in np.unique(n):
                at = np.flatnonzero(n == d)
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    values = flat[upto[some][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int32()), pa.array([ids[some].tobytes()]), pa.array([values.tobytes()])], names=["n", "ids", "data"])

    return vectors.select("vec_id", "v").mapInArrow(run, PACKED)


def query_blocks(queries: DataFrame, count: int, per_block: int = QUERIES, extra: str | None = None) -> tuple[DataFrame, int]:
    """Queries (one a vec_id: the smallest vector, should an id occur repeatedly) in about count / per_block blocks by hash.
    A column `extra` (double, its least for an id) goes with them as q_extra."""
    n = max(1, -(-count // per_block))
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"), F.min(extra or F.lit(0.0)).alias("x")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))

    def run(pdf):
        import pandas as pd

        out = []
        for d, g in pdf.groupby(pdf["v"].map(len)):
            g = g.sort_values("vec_id")
            out.append((int(g["qb"].iloc[0]), int(d), len(g), g["vec_id"].to_numpy(np.int64).tobytes(), np.array(g["v"].tolist(), np.float64).tobytes(), g["x"].to_numpy(np.float64).tobytes()))
        return pd.DataFrame(out, columns=["qb", "dim", "qn", "q_ids", "q_data", "q_extra"])

    packed = one.groupBy("qb").applyInPandas(run, "qb int, dim int, qn int, q_ids binary, q_data binary, q_extra binary")
    return packed if extra else packed.drop("q_extra"), n


#: Vector blocks that meet a query block in one task, at most: the join holds them.
HELD = 64


def grid(vector_blocks: int, query_blocks: int, tasks: int, heavier: float) -> tuple[int, int]:
    """(groups, salts) of about so many tasks by which least is sent: vector blocks go to each group of query blocks, these to each
    salt. heavier: bytes of a vector block by those of a query block."""
    groups = max(1, min(query_blocks, round((tasks * query_blocks / max(1.0, vector_blocks * heavier)) ** 0.5)))
    salts = max(1, min(vector_blocks, -(-tasks // groups)), -(-vector_blocks // HELD))
    return min(query_blocks, max(groups, -(-tasks // salts))), salts


def pairs(vector_blocks: DataFrame, queries: DataFrame, n_query_blocks: int, tasks: int, heavier: float = BLOCK / QUERIES) -> DataFrame:
    """Rows of a query block and a vector block each, those of a query block and salt in a row; extra columns of either side stay. Lengths
    must agree. Both sides grow where they are dealt, by more than Spark expects: without the hint one is broadcast, through the driver."""
    groups, salts = grid(vector_blocks.count(), n_query_blocks, tasks, heavier)
    v = vector_blocks if "dim" in vector_blocks.columns else vector_blocks.withColumn("dim", (F.length("data") / F.greatest("n", F.lit(1)) / 8).cast("int"))
    v = v.withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    q = queries.withColumn("_group", F.pmod(F.col("qb"), F.lit(groups))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return q.hint("merge").join(v, ["_group", "dim", "_salt"]).drop("_group", "_salt")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def best(found: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query_id in this order, with rank; in two levels, so that no task holds a query's rows of all blocks."""
    from pyspark.sql import Window as W

    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("_salt").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
