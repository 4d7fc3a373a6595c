"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a target in words. Whole passes over a source come first; the rest of the target is an exact quota of
words that a seeded tree of hypergeometric draws splits among the output shards, in proportion to the words that each shard
holds of the source. Within a shard the source's documents stand in a keyed random order and are drawn until the shard's
quota is used up (the last one in part), so that draws are disjoint and reruns agree. Each shard is then shuffled locally.

Null sources are a source of their own (last in order). Null and empty texts have size 0 and are never drawn. Repeated rows
of a doc_id are separate documents. An empty table gives an empty result. Columns of the caller's other than those named
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tessella.llm.common import WORD_PATTERN, cut
from tessella.operators.ranking import running_sum

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Shards hold about so many documents; the tree first parts a quota among groups of so many shards, then within each.
DOCS_PER_SHARD, GROUP = 1024, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): a share of all words by weight, no target above `most` times its source.

    Handing the excess on by weight until none is above ends where targets are min(cap, weight * level); the level follows
    from the sources in order of cap / weight, by running sums over ranges of that order.
    """
    k = len(weights)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running_sum(s, [F.col("source").asc_nulls_last()], {"i": F.lit(1)}).drop("i_all")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(k)) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = running_sum(s, [F.col("ratio"), F.col("i")], {"caps": F.col("cap"), "weights": F.col("weight"), "sizes": F.col("source_size")})
    s = s.withColumn("level", (F.col("sizes_all") * share - (F.col("caps") - F.col("cap"))) / (F.col("weights_all") - (F.col("weights") - F.col("weight"))))
    s = s.withColumn("free", F.col("level") <= F.col("ratio"))
    first = s.where("free").groupBy().agg(F.min_by("level", F.struct("ratio", "i")).alias("at"))
    s = s.join(F.broadcast(first), F.lit(True), "left")  # one row
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("at"), "cap")).alias("target"))


def split_quota(have: np.ndarray, quota: int, rng: np.random.Generator) -> np.ndarray:
    """Split quota among cells that hold `have` words: a balanced tree of hypergeometric draws; exact, none above what it has."""
    out = np.zeros(len(have), np.int64)

    def draw(left: int, right: int, q: int) -> int:
        unit = max(1, (left + right) // 400_000_000)  # the generator takes populations below 1e9
        a = int(rng.hypergeometric(left // unit, max(right // unit, 0), min(q // unit, left // unit + right // unit))) * unit if q else 0
        a = min(a + (q % unit if unit > 1 else 0), left, q)
        return max(a, q - right)

    todo = [(0, len(have), int(quota))]
    sums = np.concatenate(([0], np.cumsum(have)))
    while todo:
        a, b, q = todo.pop()
        if q <= 0:
            continue
        if b - a == 1:
            out[a] = q
            continue
        m = (a + b) // 2
        x = draw(int(sums[m] - sums[a]), int(sums[b] - sums[m]), q)
        todo += [(a, m, x), (m, b, q - x)]
    return out


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, taken, passes, part, shard, place.

    taken = passes * size + part. place orders a shard's documents at random.
    """
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), *extra)
    sized = cut(base.select("doc_id", "source", "size", *extra), "sizes")
    n = sized.count()
    shards = max(1, -(-n // DOCS_PER_SHARD))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int"))
    targets = cut(source_targets(sized, weights, share, most), "targets")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    cells = sized.groupBy("source", "shard").agg(F.sum("size").alias("have"))
    cells = cells.join(targets, cells.source.eqNullSafe(targets.source)).select(cells.source, "shard", "have", "source_size", "target", "whole", "quota")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        name = pdf["source"].iloc[0]
        key = [seed, int(pdf["group"].iloc[0]) + 1, *(name or "").encode(), 256 if name is None else 257]
        pdf["quota"] = split_quota(pdf["have"].to_numpy(), int(pdf["quota"].iloc[0]), np.random.Generator(np.random.PCG64(key)))
        return pdf

    cells = cells.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int"))
    groups = cells.groupBy("source", F.col("group").alias("shard"), "quota").agg(F.sum("have").alias("have")).withColumn("group", F.lit(-1))
    upper = groups.groupBy("source").applyInPandas(deal, groups.schema)  # a row for GROUP * DOCS_PER_SHARD documents
    upper = upper.select(F.col("source").alias("s"), F.col("shard").alias("g"), F.col("quota").alias("share"))
    cells = cells.join(upper, cells.source.eqNullSafe(upper.s) & (cells.group == upper.g)).drop("s", "g", "quota").withColumnRenamed("share", "quota")
    dealt = cells.groupBy("source", "group").applyInPandas(deal, cells.schema)  # at most GROUP rows each
    d = dealt.select(F.col("source").alias("s"), F.col("shard").alias("h"), "source_size", "target", "whole", "quota")
    joined = sized.join(d, sized.source.eqNullSafe(d.s) & (sized.shard == d.h)).drop("s", "h")
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    used = F.sum("size").over(order) - F.col("size")
    out = joined.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("quota") - used)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), F.col("whole").cast("int").alias("passes"), "part", "shard", F.xxhash64(F.lit(seed + 2), "doc_id").alias("place"), *extra)


def mixed_documents(docs: DataFrame, seed: int = 17, whole: bool = False, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: a document stands once for each whole pass and once more, cut to its
    first words, for a part. With `whole` no text is cut: a document of which a part is due stands once more as it is when that
    is half of it at least, and else not; a source's words then differ from its target by half a document a shard at most.
    Rows that the mix doesn't take are gone. Partitions are in random order within."""
    given = docs.columns
    columns = [c if c in ("doc_id", "source", "text") else f"column_{i}" for i, c in enumerate(given)]  # no clash with names of ours
    docs = docs.toDF(*columns)
    key = F.xxhash64("doc_id", "source", "text")
    m = mix(docs.withColumn("_row", key), seed=seed, extra=("_row",), **options).where("taken > 0")
    # repeated rows look alike to the draw: each takes one of the draws of their kind
    m = m.groupBy(F.col("doc_id").alias("_id"), "_row").agg(F.collect_list(F.struct("passes", "part", "size")).alias("_draws"))
    d = docs.withColumn("_row", key)
    j = d.join(m, d.doc_id.eqNullSafe(m["_id"]) & (d["_row"] == m["_row"])).drop(m["_row"])
    j = j.withColumn("_k", F.row_number().over(W.partitionBy("doc_id", "_row").orderBy("_row"))).where("_k <= size(_draws)").withColumn("_t", F.element_at("_draws", F.col("_k")))
    once_more = 2 * F.col("_t.part") >= F.col("_t.size") if whole else F.col("_t.part") == F.col("_t.size")
    partial = F.lit(False) if whole else (F.col("_t.part") > 0) & (F.col("_t.part") < F.col("_t.size"))
    copies = F.concat(F.array_repeat(F.lit(False), (F.col("_t.passes") + once_more.cast("int")).cast("int")), F.array_repeat(F.lit(True), partial.cast("int")))
    j = j.select(*columns, "_t", F.posexplode(copies).alias("_copy", "_cut"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)), F.lit(1), F.greatest(F.col("_t.part"), F.lit(1)).cast("int"))
    j = j.sortWithinPartitions(F.xxhash64(F.lit(seed + 2), "doc_id", "_copy"))
    return j.select(*[F.when(F.col("_cut"), F.array_join(words, " ")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns]).toDF(*given)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
