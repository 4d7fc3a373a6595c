"""Approximate nearest neighbours by randomly rotated one-bit codes.

Coarse centres are fitted on a bounded sample (SAMPLE rows), every row is indexed under its nearest. A vector less its centre is
rotated by a seeded random rotation into WIDTH dimensions at least (so that codes of short vectors are sharp) and kept as one sign
bit a dimension, with two correction scalars: the distance to the centre and the inner product of the unit vector with its code.
Only these codes are scanned, as packed bits: a query's rotated vector is quantised to PLANES bits a component, so that its inner
product with a code is a sum of population counts. The scalars turn that into an estimate of the distance, and a bound on its
error.

1. A first scan, of the NEAR nearest centres of a query, gives it GUESSES * k best estimates. Their originals are fetched by id and
   measured: the kth of these distances is one that the true kth can't exceed.
2. A second scan, of all centres that by their radius can hold anything as near, keeps every vector that by its bound could be. The
   originals of these are fetched by id and measured, and the k nearest are kept.

Scores are Euclidean distances of the original vectors in double precision, so only which vectors are measured is
approximate. Vectors that are null, empty, zero, or hold null or non-finite components take no part. A query never meets rows
of its own id. An id that occurs repeatedly is a candidate as often, and one query. Distances that overflow a double are
infinite and come last. An empty table returns no rows. Other columns of the caller's are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessella.llm.blocks import BLOCK, QUERIES, best, pack, pairs, partitions, query_blocks, unpack, usable
from tessella.llm.common import cut

#: Width of the error bound: an estimate misses by more with a chance below 2 exp(-BOUND ** 2 / 2).
BOUND = 2.5
PLANES = 8
#: Bits of a code at least; words of a scan that are held at once.
WIDTH, AT_ONCE = 512, 1 << 22
#: Rows that centres are fitted on, rows of the sample for a centre, centres at most, rounds of fitting.
SAMPLE, FOR_ONE, CENTRES, ROUNDS = 20_000, 50, 256, 8
#: Centres that a query looks at first, and guesses it measures for each neighbour asked for.
NEAR, GUESSES = 8, 3
CODES = "dim int, centre int, n int, ids binary, bits binary, norms binary, dots binary"


def rotation(dim: int, seed: int) -> np.ndarray:
    """The first `dim` columns of a random rotation of max(dim, WIDTH) dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((max(dim, WIDTH), dim)))
    return q * np.sign(np.diag(r))


def packed(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    bits = np.packbits(on, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def fit_centres(x: np.ndarray, seed: int) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from a seeded choice of rows; a centre that no row is nearest to stays where it is."""
    k = max(1, min(CENTRES, len(x) // FOR_ONE))
    c = x[np.random.Generator(np.random.PCG64(seed)).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def index(vectors: DataFrame, seed: int = 5) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Blocks of codes by centre, and the centres for each vector length (at most CENTRES rows a length)."""
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    lengths = [r.n for r in vectors.groupBy(F.size("v").alias("n")).agg(F.count("*")).select("n").collect()]  # one row a vector length
    centres = {}
    for d in lengths:
        own = np.array([x for x in sample if len(x) == d], np.float64).reshape(-1, d)
        centres[d] = fit_centres(own, seed) if len(own) else np.zeros((1, d))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, data in zip(pdf["ids"], pdf["data"], strict=True):
                ids, x = unpack(ids, data)
                dim = x.shape[1]
                home = nearest(x, centres[dim])
                x = x - centres[dim][home]
                norm = np.sqrt((x**2).sum(1))
                unit = (x / np.where(norm > 0, norm, 1)[:, None]) @ rotation(dim, seed).T
                bits, dots = packed(unit > 0), np.abs(unit).sum(1) / np.sqrt(unit.shape[1])
                rows = [(dim, int(c), len(at), ids[at].tobytes(), bits[at].tobytes(), norm[at].tobytes(), dots[at].tobytes()) for c in np.unique(home) for at in [np.flatnonzero(home == c)]]
                yield pd.DataFrame(rows, columns=CODES.replace(",", "").split()[::2])

    small = cut(pack(vectors).mapInPandas(code, CODES), "codes")
    salts = small.groupBy("dim", "centre").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("salts"))  # at most CENTRES rows a length
    dealt = small.join(salts, ["dim", "centre"]).withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        radius = float(np.frombuffer(b"".join(pdf["norms"])).max())
        return pd.DataFrame([(r.dim, r.centre, r.salt, r.salts, radius, *(b"".join(pdf[c]) for c in ("ids", "bits", "norms", "dots")))], columns=["dim", "centre", "salt", "salts", "radius", "ids", "bits", "norms", "dots"])

    kind = "dim int, centre int, salt int, salts int, radius double, ids binary, bits binary, norms binary, dots binary"
    return cut(dealt.groupBy("dim", "centre", "salt").applyInPandas(merge, kind), "blocks"), centres


def products(unit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rows of `unit` with codes (packed signs), by population counts, and for each row the most by which
    its quantisation can move them."""
    dim = unit.shape[1]
    low = unit.min(1, keepdims=True)
    step = np.maximum(unit.max(1, keepdims=True) - low, 1e-12) / ((1 << PLANES) - 1)
    level = np.rint((unit - low) / step).astype(np.int64)
    planes = [packed((level >> p) & 1 == 1) for p in range(PLANES)]
    count = np.bitwise_count(codes).sum(1, dtype=np.int64)
    out = np.empty((len(unit), len(codes)), np.float64)
    rows = max(1, AT_ONCE // max(1, codes.size))
    for a in range(0, len(unit), rows):
        total = sum((np.bitwise_count(codes[None] & plane[a : a + rows, None]).sum(2, dtype=np.int64) << p) for p, plane in enumerate(planes))
        out[a : a + rows] = 2 * (low[a : a + rows] * count + step[a : a + rows] * total) - (low * dim + step * level.sum(1, keepdims=True))[a : a + rows]
    return out, 2.3 * step[:, 0] * np.sqrt(dim)  # more with a chance of 1e-4 at most


def estimates(r, x: np.ndarray, centre: np.ndarray, seed: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of queries x to a block's vectors: estimated, and the least they are by the bound."""
    norms, dots = np.frombuffer(r.norms), np.frombuffer(r.dots)
    c = x - centre
    cn = np.sqrt((c**2).sum(1))
    unit = (c / np.where(cn > 0, cn, 1)[:, None]) @ rotation(x.shape[1], seed).T
    width = unit.shape[1]
    product, off = products(unit, np.frombuffer(r.bits, np.uint64).reshape(len(norms), -1))
    safe = np.where(dots > 0, dots, 1)
    cos = product / np.sqrt(width) / safe
    slack = bound * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(max(width - 1, 1)) + off[:, None] / np.sqrt(width) / safe + 1e-6
    both = 2 * cn[:, None] * norms[None, :]
    near = cn[:, None] ** 2 + norms[None, :] ** 2 - both * cos
    return near, near - both * slack


def look_first(x: np.ndarray, c: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each query whether a centre is among the NEAR nearest and holds vectors."""
    away = (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T
    away[:, ~there] = np.inf
    out = np.zeros(away.shape, bool)
    np.put_along_axis(out, np.argsort(away, axis=1, kind="stable")[:, :NEAR], True, axis=1)
    return out & there


def look_within(x: np.ndarray, c: np.ndarray, k: int, radius: float, reach: np.ndarray) -> np.ndarray:
    """Whether the centre k can hold a vector within a query's reach."""
    size = np.sqrt((x**2).sum(1)) + np.sqrt((c**2).sum(1)).max()  # rounding of the distance to a centre
    return np.sqrt(((x - c[k]) ** 2).sum(1)) - radius <= reach + 1e-6 * size


def candidates(blocks: DataFrame, centres: dict[int, np.ndarray], vectors: DataFrame, queries: DataFrame, k: int, seed: int = 5, bound: float = BOUND) -> DataFrame:
    """(query_id, vec_id) of all that is to be measured: what by its bound could be among a query's k nearest."""
    radius = {(x.dim, x.centre): x.r for x in blocks.groupBy("dim", "centre").agg(F.max("radius").alias("r")).collect()}  # at most CENTRES rows a length
    there = {d: np.array([(d, j) in radius for j in range(len(c))]) for d, c in centres.items()}
    count = queries.select("vec_id").distinct().count()
    blocked = lambda q: cut(query_blocks(q, count, extra="reach")[0], "queries")

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, looks = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, x = unpack(r.q_ids, r.q_data)
                if of != (r.qb, r.dim):
                    of, looks = (r.qb, r.dim), look_first(x, centres[r.dim], there[r.dim])
                own = looks[:, r.centre]
                if not own.any():
                    continue
                q_ids, x, v_ids = q_ids[own], x[own], np.frombuffer(r.ids, np.int64)
                near, _ = estimates(r, x, centres[r.dim][r.centre], seed, bound)
                near[q_ids[:, None] == v_ids[None, :]] = np.inf
                most = GUESSES * k
                some = np.argpartition(near, most - 1, axis=1)[:, :most] if len(v_ids) > most else np.tile(np.arange(len(v_ids)), (len(x), 1))
                out = pd.DataFrame({"query_id": np.repeat(q_ids, some.shape[1]), "vec_id": v_ids[some].ravel(), "near": np.take_along_axis(near, some, 1).ravel()})
                yield out[np.isfinite(out["near"])]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, x = unpack(r.q_ids, r.q_data)
                v_ids, upto = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_extra, np.float64)
                own = look_within(x, centres[r.dim], r.centre, radius[r.dim, r.centre], upto)
                if not own.any():
                    continue
                q_ids, x, upto = q_ids[own], x[own], upto[own]
                _, least = estimates(r, x, centres[r.dim][r.centre], seed, bound)
                i, j = np.nonzero(least <= (upto**2)[:, None] * (1 + 1e-9))
                i, j = i[q_ids[i] != v_ids[j]], j[q_ids[i] != v_ids[j]]
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j]})

    dim = max(centres, default=1)
    heavier = BLOCK * (max(dim, WIDTH) // 8 + 24) / (QUERIES * 8 * dim)
    codes = blocks.select("dim", "centre", "ids", "bits", "norms", "dots")
    meet = lambda q: pairs(codes, blocked(q), max(1, -(-count // QUERIES)), partitions(queries), heavier)
    one = queries.select("vec_id", "v").withColumn("reach", F.lit(float("inf")))
    found = best(meet(one).mapInPandas(guess, "query_id long, vec_id long, near double"), GUESSES * k, F.col("near"), F.col("vec_id"))
    nth = best(measured(found.select("query_id", "vec_id").distinct(), vectors, queries), k, F.col("score"), F.col("vec_id"))
    reach = nth.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("nth"))  # with fewer nothing is ruled out
    bounded = one.drop("reach").join(reach, "vec_id", "left").withColumn("reach", F.coalesce("nth", F.lit(float("inf"))))
    return meet(bounded).mapInPandas(keep, "query_id long, vec_id long").distinct()


def measured(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """found(query_id, vec_id) with score, the distance of the originals."""
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("x")).withColumnRenamed("vec_id", "query_id")
    squares = F.aggregate(F.zip_with("x", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    met = found.join(vectors.select("vec_id", "v"), "vec_id").join(asked, "query_id").where(F.size("v") == F.size("x"))
    return met.select("query_id", "vec_id", F.sqrt(squares).alias("score"))


def search(blocks: DataFrame, centres: dict[int, np.ndarray], vectors: DataFrame, queries: DataFrame, k: int, seed: int = 5, bound: float = BOUND) -> DataFrame:
    """codes, centres, vectors and queries (vec_id, v) -> query_id, rank, vec_id, score."""
    found = candidates(blocks, centres, vectors, queries, k, seed, bound)
    return best(measured(found, vectors, queries), k, F.col("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    v = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", zero=False)
    blocks, centres = index(v)
    return search(blocks, centres, v, v.where("vec_id % 100 = 0"), 10)
