"""Near duplicates by SimHash, and by meeting in the middle of a Hamming ball.

A fingerprint's bits are majority votes of the hashes of a text's word shingles. Two fingerprints at most 2r bits apart have a
word within r bits of both. So every distinct fingerprint emits all words within half the radius of it; where two meet in a word
they are a candidate pair, which is verified by counting differing bits. A word can be met by fingerprints of its own small ball
only (65 at a radius of 2), and all that meet in one are linked to its smallest, so no group is large and pairs aren't emitted
for groups. Copies are one fingerprint before anything is emitted.

A null or blank text has no shingle and the fingerprint zero, linked like any other. A text of fewer words than a shingle has one
shingle, all of it. Repeated rows are rows. Rows without a doc_id are in the component of their text's fingerprint, which is
named by its smallest doc_id (null, if none has one). An empty table gives an empty result. Other columns of the caller's are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.common import components, cut, done_with

SEED = 42
BITS = 64
#: Shingles of a text that are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if it is set in over half of the shingles' hashes."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(w) - words + 1)
    ends = ends[min(words, len(w)) - 1 :] - 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, AT_ONCE):
        some = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[k : min(n, k + AT_ONCE)].tolist(), ends[k : k + AT_ONCE].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).view(np.uint64).reshape(-1, 8)  # a byte a bit, eight in a number
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id long, fp long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), words, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """All differences of at most `radius` bits, as signed numbers."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), a > b, at most `radius` (even) bits apart, that connect all such pairs."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    links = met.select(F.col("fp").alias("a"), F.min("fp").over(W.partitionBy("word")).alias("b")).where("a <> b")
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the smallest doc_id reachable by links, itself included."""
    fp = cut(fingerprints(docs, words, seed), "fingerprints")
    classes = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = cut(near(classes.select("fp"), radius), "links")
    parts = cut(components(links), "parts")
    done_with(links)
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("first").alias("least"))
    linked = parts.join(named, "component").select(F.col("node").alias("fp"), "least")
    name = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fp.join(name, "fp").select("doc_id", "fp", "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    d = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
