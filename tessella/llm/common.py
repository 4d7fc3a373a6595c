"""Shared helpers of the training-data operators: scratch tables, text buffers, hashes, fixed-size counters.

Everything a task needs beyond its own rows is a fixed-size array (a counter table, a weight table, a rotation):
its size is a parameter of the operator and does not grow with the corpus.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

SLICE_BYTES = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_T = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_T_LOWER = _T[_LOWER]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: The words of the contracts: runs of anything but the six ASCII white-space bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where that is unset a temporary one, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark, "_tessella_scratch", None)
        if not found:
            found = spark._tessella_scratch = "file://" + tempfile.mkdtemp(prefix="spark-tessella-")
    return found


#: Rows of an Arrow batch where rows are whole texts or sets: a Python worker holds few batches at once.
BATCH_ROWS = 500


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder once and read it back: later steps read the files, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, once all that reads them is itself written."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in ((0, _B), (1, _BINV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about `limit` bytes; each text is followed by one line end.

    offsets has last - first + 1 entries. A null text counts as empty. A text longer than the limit is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for part in range(0, len(texts), BATCH_ROWS):
        for first, last, data, offsets in _slices(texts[part : part + BATCH_ROWS], limit):
            yield part + first, part + last, data, offsets


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    n = len(joined)
    if not n:
        return
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Spans:
    """Words (or other pieces) of a run of texts, with hashes of any part of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_T_LOWER if lower else _T)[data] * power[:-1], out=self.sums[1:])

    def words(self, kinds: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each run of bytes of a kind. The line end after each text keeps two texts apart."""
        inside = kinds[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def sum_counters(parts: DataFrame, size: int, chunk: int) -> np.ndarray:
    """Add up int64 counter arrays that tasks have sent as rows (chunk_id int, counts binary); `size` is fixed, so is the result."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, np.uint32)
        return pd.DataFrame({"chunk_id": [int(pdf["chunk_id"].iloc[0])], "counts": [total.tobytes()]})

    # two levels: first within a few salts, so that no task reads the arrays of all tasks
    def add_wide(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, np.int64)
        return pd.DataFrame({"chunk_id": [int(pdf["chunk_id"].iloc[0])], "counts": [total.tobytes()]})

    kind = "chunk_id int, counts binary"
    first = parts.groupBy("chunk_id", "salt").applyInPandas(add, kind)
    out = np.zeros(size, np.int64)
    for row in first.groupBy("chunk_id").applyInPandas(add_wide, kind).collect():  # size / chunk rows
        out[row.chunk_id * chunk : (row.chunk_id + 1) * chunk] = np.frombuffer(row.counts, np.int64)
    return out


def counter_rows(counts: np.ndarray, chunk: int, salt: int) -> tuple[list[int], list[int], list[bytes]]:
    """Rows for sum_counters: chunk ids, salts, uint32 bytes."""
    n = len(counts) // chunk
    c = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).reshape(n, chunk)
    return list(range(n)), [salt % 16] * n, [x.tobytes() for x in c]


def held_out(doc_id: str = "doc_id"):
    """The quarter of documents that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node long, component long), component = its smallest node.

    Alternating large-star and small-star rounds; each is one combinable min-aggregate and one equi-join (a hot centre is
    split by adaptive skew handling), and each is written to the shared folder. Nothing of the graph goes to the driver but
    three totals a round. Nulls and loops are ignored; an empty table gives an empty one.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        last, e = e, cut(small, "edges")
        done_with(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if now == before or (now[0] == now[2] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").take(1)):
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
