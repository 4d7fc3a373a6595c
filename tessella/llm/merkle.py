"""Merkle manifest of a table: a tree of hashes a group, a tree above the groups, and proofs of all rows by multiproofs.

Leaves are numbered within their group by ranges of the order. A level joins every `WIDTH` neighbours to their hash, one small
combinable aggregate a level; nodes are kept under their coordinates (tree, level, place). Trees are numbered from 1 in the
order of the groups; tree 0 stands above them, and its leaves are the others' roots.

Proofs are made by parts of neighbouring leaves. The union of the paths of a part's leaves to the root is an octopus: what is
below or on its arms is derived from the part's own leaves, and only the nodes beside the arms are missing. Each part lists
these coordinates and fetches them in one join; then it derives the shared interiors and expands every leaf's own proof.

Null groups are a group, the first. A null order value comes first; leaves of one order value (repeated rows) stand in the order
of their hashes. An empty table has no nodes and no proofs. Other columns of the caller's are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.common import cut
from tessella.operators.ranking import running_sum

WIDTH = 16
#: Leaves of a part.
PART = 4096
HEX = 64


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(*columns: Column) -> Column:
    """The hash of a row's values: `-` for a null, else its UTF-8 length, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def manifest(leaves: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """leaves(group, order, leaf, ...) -> numbered leaves (all columns, place, part, tree, n, trees) and nodes (tree, level,
    place, hash) of all levels, leaves and root included. The root is the only node of the highest level of tree 0."""
    ranked = running_sum(cut(leaves, "hashed"), [F.col(group), F.col(order), F.col("leaf")], {"at": F.lit(1)}).drop("at_all")
    ranked = cut(ranked, "ranked")
    sizes = ranked.groupBy(group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    trees = cut(running_sum(sizes, [F.col(group)], {"tree": F.lit(1)}).withColumnRenamed("tree_all", "trees"), "trees")
    t = trees.withColumnRenamed(group, "_group")
    placed = ranked.join(t, ranked[group].eqNullSafe(t["_group"])).withColumn("place", F.col("at") - F.col("first"))
    placed = cut(placed.withColumn("part", F.floor((F.col("at") - 1) / PART)).drop("_group", "first", "at"), "leaves")
    nodes = levels(placed.select("tree", "place", F.col("leaf").alias("hash"), "n"))
    tops = nodes.join(trees.select("tree", "n", "trees"), "tree").where((F.col("place") == 0) & (F.col("level") == _height(F.col("n"))))
    top = levels(tops.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), "hash", F.col("trees").alias("n")))
    return placed, nodes.unionByName(top)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves, in whole numbers."""
    steps = F.array(*[F.lit(WIDTH**k).cast("long") for k in range(16)])
    return F.size(F.filter(steps, lambda s: s < n))


def levels(nodes: DataFrame) -> DataFrame:
    """Leaves (tree, place, hash, n of the tree) -> tree, level, place, hash of all nodes."""
    level, now = 0, cut(nodes, "level-0")
    out = now.withColumn("level", F.lit(0))
    while True:
        more = now.where("n > 1")
        if not more.take(1):
            return out.select("tree", "level", "place", "hash")
        runs = more.groupBy("tree", F.floor(F.col("place") / WIDTH).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("run"), F.ceil(F.first("n") / WIDTH).alias("n"))
        level += 1
        now = cut(runs.select("tree", "place", F.sha2(F.array_join(F.col("run.hash"), ""), 256).alias("hash"), "n"), f"level-{level}")
        out = out.unionByName(now.withColumn("level", F.lit(level)))


def missing(places: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that the paths of these leaves need and that don't follow from the leaves themselves."""
    level, own = 0, np.unique(places)
    while n > 1:
        parents = np.unique(own // WIDTH)
        children = (parents[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        yield level, np.setdiff1d(children[children < n], own, assume_unique=True)
        level, own, n = level + 1, parents, -(-n // WIDTH)


def arms(own: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[dict[int, str], str]:
    """The siblings of each of these leaves up to its tree's root, level by level, and the root, from leaves and fetched nodes."""
    beside: list[dict[int, str]] = []
    while n > 1:
        level, siblings, above = len(beside), {}, {}
        for parent in {k // WIDTH for k in own}:
            run = range(parent * WIDTH, min(parent * WIDTH + WIDTH, n))
            hashes = [own[k] if k in own else fetched[level, k] for k in run]
            joined = "".join(hashes)
            above[parent] = digest(joined)
            for i, k in enumerate(run):
                if k in own:
                    siblings[k] = joined[: HEX * i] + joined[HEX * (i + 1) :]
        beside.append(siblings)
        own, n = above, -(-n // WIDTH)
    up = {0: ""}
    for siblings in reversed(beside):
        up = {k: s + up[k // WIDTH] for k, s in siblings.items()}
    return up, own[0]


def fold(leaf: str, proof: str, place: int, n: int, tree: int, trees: int) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for p, size in ((place, n), (tree - 1, trees)):
        while size > 1:
            before, run = p % WIDTH, min(WIDTH, size - p // WIDTH * WIDTH)
            middle, end = at + HEX * before, at + HEX * (run - 1)
            leaf = digest(proof[at:middle] + leaf + proof[middle:end])
            at, p, size = end, p // WIDTH, -(-size // WIDTH)
    return leaf


def prove(leaves: DataFrame, nodes: DataFrame, keep: list[str], candidate: str = "leaf") -> DataFrame:
    """Numbered leaves of manifest(), all or some of them -> keep, leaf, subroot, root, proof (the siblings' hashes, joined, level by
    level from the leaf to its tree's root and on to the root), folded_root (from `candidate` and the proof)."""
    shape = leaves.select("part", "tree", "place", "n", "trees")

    def wanted(pdf: pd.DataFrame) -> pd.DataFrame:
        trees = int(pdf["trees"].iloc[0])
        own = pdf.groupby("tree")
        found = [(int(t), level, some) for t, g in own for level, some in missing(g["place"].to_numpy(), int(g["n"].iloc[0]))]
        found += [(0, level, some) for level, some in missing(np.array(list(own.groups)) - 1, trees)]
        height = len(list(missing(np.zeros(1, np.int64), trees)))
        found.append((0, height, np.zeros(1, np.int64)))  # the root, to compare with
        size = [len(x[2]) for x in found]
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "tree": np.repeat([x[0] for x in found], size), "level": np.repeat([x[1] for x in found], size).astype(np.int32), "place": np.concatenate([x[2] for x in found])})

    coordinates = shape.groupBy("part").applyInPandas(wanted, "part long, tree long, level int, place long")
    fetched = coordinates.join(nodes, ["tree", "level", "place"])

    kept = leaves.select(*keep).schema
    out = kept.add("subroot", "string").add("root", "string").add("proof", "string").add("folded_root", "string")

    def expand(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=out.names)
        at: dict[int, dict[tuple[int, int], str]] = {}
        for t, level, place, h in zip(others["tree"], others["level"], others["place"], others["hash"], strict=True):
            at.setdefault(t, {})[level, place] = h
        made = {t: arms(dict(zip(g["place"], g["_leaf"], strict=True)), int(g["n"].iloc[0]), at.get(t, {})) for t, g in own.groupby("tree")}
        trees = int(own["trees"].iloc[0])
        above, _ = arms({t - 1: root for t, (_, root) in made.items()}, trees, at.get(0, {}))
        root = max(at[0].items())[1]
        proofs = [made[t][0][p] + above[t - 1] for t, p in zip(own["tree"], own["place"], strict=True)]
        folded = [fold(*x, trees) for x in zip(own["_candidate"], proofs, own["place"].tolist(), own["n"].tolist(), own["tree"].tolist(), strict=True)]
        return own[keep].assign(subroot=[made[t][1] for t in own["tree"]], root=root, proof=proofs, folded_root=folded)

    rows = leaves.select(*keep, "part", "tree", "place", "n", "trees", F.col("leaf").alias("_leaf"), F.col(candidate).alias("_candidate"))
    return rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(expand, out)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    row = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = d.select("doc_id", "source", row(F.col("text")).alias("leaf"), F.when(tampered, row(text)).alias("changed"))
    placed, nodes = manifest(leaves, "source", "doc_id")
    p = prove(placed.withColumn("shown", F.coalesce("changed", "leaf")), nodes, ["doc_id", "leaf"], "shown")
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 7, width: int = WIDTH, digits: int = HEX) -> str:
    """The same in SQL, for up to width ** levels rows a source and sources. r: runs of a level; c: leaves with the path's last node, folded and
    true, and the siblings so far."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([value("doc_id"), value("source"), value("lang"), value("n_chars"), value(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {})"
    crc = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: {bit.format('xor(c, x)')}, 4294967295::BIGINT), 4294967295)"
    steps = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents)",
        "c0 AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, shown AS f, '' AS s FROM d)",
        "n0 AS (SELECT source, p, n, leaf AS h FROM c0)",
    ]

    def up(k: int, key: str) -> list[str]:
        same = f"c.{key} IS NOT DISTINCT FROM r.{key} AND c.p // {width} = r.g"
        before, after = f"substr(r.run, 1, {digits} * (c.p % {width}))", f"substr(r.run, {digits} * (c.p % {width} + 1) + 1)"
        return [
            f"r{k} AS (SELECT {key}, p // {width} AS g, n, string_agg(h, '' ORDER BY p) AS run FROM n{k} GROUP BY ALL)",
            f"n{k + 1} AS (SELECT {key}, g AS p, (n + {width - 1}) // {width} AS n, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS h FROM r{k})",
            f"c{k + 1} AS (SELECT c.* REPLACE (c.p // {width} AS p, (c.n + {width - 1}) // {width} AS n, CASE WHEN c.n = 1 THEN f ELSE sha256({before} || f || {after}) END AS f, CASE WHEN c.n = 1 THEN s ELSE s || {before} || {after} END AS s) FROM c{k} c JOIN r{k} r ON {same})",
        ]

    for k in range(levels):
        steps += up(k, "source")
    k = levels
    steps += [
        f"t AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM n{k})",
        f"n{k + 1} AS (SELECT 0 AS one, p, n, subroot AS h FROM t)",
        f"c{k + 1} AS (SELECT c.doc_id, c.leaf, t.subroot, 0 AS one, t.p, t.n, c.f, c.s FROM c{k} c JOIN t ON c.source IS NOT DISTINCT FROM t.source)",
    ]
    for j in range(k + 1, k + 1 + levels):
        steps += up(j, "one")
    k = k + 1 + levels
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(s) AS proof_sha256, f AS folded_root, f = h AS verified FROM c{k}, n{k}"


OP13_SQL = _sql()
