"""Exact top-k search by distributed histogram selection.

Every score is computed. A query's scores are counted in a histogram over a range that surely holds them; the counts of all
blocks are added up, the bin that holds the kth score becomes the next range, and so on until bins are one integer wide:
that is the kth score. One more pass keeps what lies above it, and of the ties with it the smallest ids that are still needed.

Scores are integers (components floor(256 * x)). Vectors that are null, empty, or hold null or non-finite components take no
part. A query never meets rows of its own id. An id that occurs repeatedly is a candidate as often, and one query (its
smallest vector). Queries with fewer candidates than k return all of them. An empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.llm.blocks import best, pack, pairs, partitions, query_blocks, unpack, usable
from tessella.llm.common import cut

BINS = 1024


def _scores(q_ids, q, v_ids, v) -> np.ndarray:
    """Integer inner products; int64 smallest where a query meets its own id."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    s = (q @ v.T).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ v.astype(np.int64).T
    s[q_ids[:, None] == v_ids[None, :]] = np.iinfo(np.int64).min
    return s


def top_k(vectors: DataFrame, queries: DataFrame, k: int, bins: int = BINS) -> DataFrame:
    """vectors, queries (vec_id long, v array<double> of integers) -> query_id, rank, vec_id, score."""
    blocks = cut(pack(vectors), "vectors")
    q, nqb = query_blocks(queries, queries.count())
    q = cut(q, "queries")
    meet = lambda q: pairs(blocks, q, nqb, partitions(vectors))
    norms = blocks.select("data").mapInPandas(lambda it: (pd.DataFrame({"m": [max(np.sqrt((np.frombuffer(x, np.float64) ** 2).sum()) for x in p["data"])]}) for p in it if len(p)), "m double")
    largest = norms.agg(F.max("m")).first()[0] or 0.0  # of a block's vectors taken together, so surely enough

    def ranges(pdf: pd.DataFrame) -> pd.DataFrame:
        """A range for each query by Cauchy's bound, as wide as bins ** rounds."""
        lo, hi = [], []
        for ids, data in zip(pdf["q_ids"], pdf["q_data"], strict=True):
            _, x = unpack(ids, data)
            bound = np.ceil(np.sqrt((x**2).sum(1)) * largest).astype(np.int64) + 1
            lo.append((-bound).tobytes())
            hi.append((bound + 1).tobytes())
        return pdf.assign(lo=lo, hi=hi)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Histograms of a query block, added up over all vector blocks that a task has of it (they follow one another)."""
        of, total = None, np.zeros(0, np.int64)

        def rows() -> pd.DataFrame:
            key = np.flatnonzero(total)
            return pd.DataFrame({"qb": of[0] if of else 0, "dim": of[1] if of else 0, "query": (key // bins).astype(np.int32), "bin": (key % bins).astype(np.int32), "n": total[key]})

        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, x = unpack(r.q_ids, r.q_data)
                if of != (r.qb, r.dim):
                    yield rows()
                    of, total = (r.qb, r.dim), np.zeros(len(q_ids) * bins, np.int64)
                s = _scores(q_ids, x, *unpack(r.ids, r.data))
                lo, hi, want = (np.frombuffer(b, np.int64) for b in (r.lo, r.hi, r.want))
                width = -(-(hi - lo) // bins)
                # counted from the top: bin 0 has the highest scores
                b = (hi[:, None] - 1 - s) // width[:, None]
                live = (s >= lo[:, None]) & (s < hi[:, None]) & (want > 0)[:, None]
                row, _ = np.nonzero(live)
                total += np.bincount(row * bins + b[live], minlength=len(total))
        yield rows()

    schema = "qb int, dim int, qn int, q_ids binary, q_data binary, lo binary, hi binary"
    q = q.mapInPandas(lambda it: map(ranges, it), schema)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(want=[np.full(n, k, np.int64).tobytes() for n in pdf["qn"]], done=False)

    full = schema + ", want binary, done boolean"
    q = cut(q.mapInPandas(lambda it: map(start, it), full), "ranges")

    def refine(key, states: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        """want: how many of the range's scores belong to the best k. Bins are summed from the top until they hold as many."""
        if not len(states):
            return states
        r = states.iloc[0]
        lo, hi, want = (np.frombuffer(b, np.int64).copy() for b in (r.lo, r.hi, r.want))
        width = -(-(hi - lo) // bins)
        counts = counts.sort_values(["query", "bin"])
        groups = {name: g for name, g in counts.groupby("query")}
        for i in range(len(lo)):
            g = groups.get(i)
            if want[i] <= 0 or hi[i] - lo[i] <= 1:
                continue
            upto = np.cumsum(g["n"].to_numpy()) if g is not None else np.zeros(0, np.int64)
            at = int(np.searchsorted(upto, want[i]))
            if at >= len(upto):  # fewer candidates than k: all of them
                want[i] = 0
                hi[i] = lo[i]
                continue
            want[i] -= upto[at - 1] if at else 0
            top = hi[i] - int(g["bin"].iloc[at]) * width[i]
            lo[i], hi[i] = max(lo[i], top - width[i]), top
        return states.assign(lo=[lo.tobytes()], hi=[hi.tobytes()], want=[want.tobytes()], done=[bool(((hi - lo <= 1) | (want <= 0)).all())])

    while True:
        counts = meet(q.where("not done")).mapInPandas(count, "qb int, dim int, query int, bin int, n long").groupBy("qb", "dim", "query", "bin").agg(F.sum("n").alias("n"))
        q = cut(q.groupBy("qb", "dim").cogroup(counts.groupBy("qb", "dim")).applyInPandas(refine, full), "ranges")
        if q.agg(F.coalesce(F.bool_and("done"), F.lit(True))).first()[0]:
            break

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Scores above the kth (lo), and at most `want` ties, smallest ids first; the rest of a block's ties can't be needed."""
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, x = unpack(r.q_ids, r.q_data)
                v_ids, v = unpack(r.ids, r.data)
                order = np.argsort(v_ids, kind="stable")
                v_ids, v = v_ids[order], v[order]
                s = _scores(q_ids, x, v_ids, v)
                lo, want = (np.frombuffer(b, np.int64) for b in (r.lo, r.want))
                tie = (s == lo[:, None]) & (want > 0)[:, None]
                tie &= np.cumsum(tie, axis=1) <= want[:, None]
                above = (s > lo[:, None]) | ((want <= 0)[:, None] & (s >= lo[:, None]))
                i, j = np.nonzero(above | tie)
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "score": s[i, j]})

    found = meet(q).mapInPandas(gather, "query_id long, vec_id long, score long")
    return best(found, k, F.col("score").desc(), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    v = v.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    return top_k(v, v.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
