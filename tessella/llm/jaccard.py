"""N-gram Jaccard join by prefix trees.

A text's set holds its distinct n-word shingles as 64-bit hashes. Two sets join when 100 * |A and B| >= percent * |A or B|.

1. One pass gives every text a fingerprint of its set; texts with one and the same set are one class from here on.
2. Candidates by pigeonholes: two sets that join differ in at most D elements, D by their sizes. Where elements are dealt by
   hash to more than D parts, some part is the same in both. A second pass sends a hash of each part; sets that agree in one
   are candidates. Unrelated sets that share a passage, or single shingles by chance, agree in no whole part, so the work
   grows with the corpus and not with the number of chance meetings. Sizes lie in levels with a number of parts each; a set
   is also dealt by the next level's parts where larger sets of that level could join it. Empty parts say nothing: a level
   has some parts to spare, and a set with more empty ones than that also sends the first elements of its order (its prefix),
   of which two sets that join share one. No pair that joins is left out.
   Below a similarity of PARTED per cent parts become so small that sets with a passage in common often agree in one. There
   candidates are found by shared shingles of the prefixes, rarer shingles first, and prefixes rule out what they can.
3. Components of candidates are blocks. A block's sets, in the global order (of the hashes), form a prefix tree. Each set
   traverses it once, with the overlap of a branch shared by all sets below it; a branch ends where the shingles left on
   either side can't reach the needed overlap. Sets already connected within the block aren't compared again, which loses
   no component.
4. A block above BLOCK sets is cut into chunks. Each chunk is joined by itself; when the components found so
   far still part the block, sets outside its largest component also meet every other chunk. No pair of sets that could join
   is left out, and sets already connected are not paired.

Texts below n words have their whole sequence as the one shingle. Null texts and texts without words have an empty set and
join nothing. Rows of one doc_id are one document: with different texts, its set is the largest of theirs (ties: the larger
fingerprint). Rows without a doc_id take no part and have no row in the result. Extra columns are not read. An empty table
gives an empty result. A collision of 64-bit hashes could make shingles equal that aren't; its chance is below 1e-3 at 10**8
distinct shingles, and far lower for one that matters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import Spans, components, counter_rows, cut, done_with, mix, slices, sum_counters

BLOCK = 1000
#: From this similarity (in per cent) on, parts hold enough elements (six, on the average) to tell sets apart; see the method.
PARTED = 85
COUNTERS, CHUNK = 1 << 20, 1 << 15
#: So many ids (8 bytes each) are broadcast at most, to keep texts where they are; more are joined by a shuffle.
MOST_IDS = 1_000_000
STRIDE = 32
#: A class of copies is gathered in so many parts first.
SALTS = 64


def text_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, sorted distinct shingle hashes text after text, and where each text's begin (one more than texts)."""
    c = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 62, words + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for first, last, data, offsets in slices(texts):
        spans = Spans(data, offsets)
        starts, ends, doc = spans.words()
        h = spans.hashes(starts, ends)
        counts = np.bincount(doc, minlength=last - first)
        if len(h) >= words:
            grams = h[: len(h) - words + 1] * c[0]
            for k in range(1, words):
                grams = grams + h[k : len(h) - words + 1 + k] * c[k]
            whole = doc[: len(grams)] == doc[words - 1 :]
            grams, owner = mix(grams[whole]), doc[: len(grams)][whole]
        else:
            grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            at = np.cumsum(counts) - counts
            extra = []
            for d in short.tolist():
                x = c[words : words + 1]
                for k in range(counts[d]):
                    x = mix(x + h[at[d] + k])
                extra.append(x)
            grams, owner = np.concatenate((grams, *extra)), np.concatenate((owner, short))
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield first, last, grams, np.searchsorted(owner, np.arange(last - first + 1))


def ordered(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order is the global one: eight bits of (logarithmic) frequency, then the hash."""
    return (table[(grams >> np.uint64(44)).astype(np.int64)] << np.uint64(56)) | (grams & np.uint64((1 << 56) - 1))


def needed(n, m, percent: int):
    """Least overlap of sets of n and m elements that join."""
    return -(-(percent * (n + m)) // (100 + percent))


# --- pigeonholes -----------------------------------------------------------------------------------------------------

class Levels:
    """Levels of set sizes: level j holds sizes above border[j] up to border[j + 1], dealt to parts[j] parts of which
    spare[j] may be empty. Sets below `least` join only equal ones."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.least = percent, -(-percent // (100 - percent))
        border = [self.least - 1]
        while border[-1] < largest:
            border.append(max(border[-1] + 1, int(border[-1] * (100 / percent) ** 2)))
        self.border = np.array(border, np.int64)
        parts, spare = [], []
        for low, high in zip(border[:-1], border[1:], strict=True):
            differ = 2 * high * (100 - percent) // (100 + percent)  # the most elements by which two sets up to `high` that join differ
            smallest, s = max(1, -(-percent * (low + 1) // 100)), 0
            while s <= differ // 2:  # small sets have few parts to spare, and send their prefixes more often
                k = differ + 1 + s
                empty = k * math.exp(-smallest / k)
                if s >= empty + 1.5 * math.sqrt(empty):
                    break
                s += 1
            parts.append(differ + 1 + s)
            spare.append(s)
        self.parts, self.spare = np.array(parts, np.int64), np.array(spare, np.int64)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, level): each set's own level, and the next where its smallest sets could join this one."""
        some = np.flatnonzero(sizes >= self.least)
        own = np.searchsorted(self.border, sizes[some]) - 1
        up = (own + 1 < len(self.parts)) & (self.percent * (self.border[np.minimum(own + 1, len(self.border) - 1)] + 1) <= 100 * sizes[some])
        return np.concatenate((some, some[up])), np.concatenate((own, own[up] + 1))


def set_keys(grams: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): sets (grams[at[i]:at[i + 1]], ascending) that join and aren't equal have a key in common."""
    sizes = np.diff(at)
    levels = Levels(percent, int(2 * sizes.max(initial=1) * (100 / percent) ** 2))
    sets, level = levels.of(sizes)
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, parts = sizes[sets], levels.parts[level]
    upto, base = np.cumsum(n), np.cumsum(parts) - parts
    g = grams[np.repeat(at[sets] - upto + n, n) + np.arange(upto[-1])]
    h = mix(g ^ np.uint64(0x2545F4914F6CDD1D))
    place = np.repeat(base, n) + ((h >> np.uint64(20)) % np.repeat(parts, n).astype(np.uint64)).astype(np.int64)
    total = int(parts.sum())
    filled = np.bincount(place, minlength=total)
    sums = [np.bincount(place, x.astype(np.float64), minlength=total).astype(np.uint64) for x in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32))]
    seed = np.repeat(level, parts).astype(np.uint64) << np.uint64(40) | (np.arange(total) - np.repeat(base, parts)).astype(np.uint64)
    key = mix(mix(sums[0] ^ seed) + mix(sums[1] + filled.astype(np.uint64)))
    owner, on = np.repeat(sets, parts), filled > 0
    keys, owners = [key[on]], [owner[on]]
    for i in np.flatnonzero(np.add.reduceat((~on).astype(np.int64), base) > levels.spare[level]).tolist():
        x = grams[at[sets[i]] : at[sets[i] + 1]]
        keys.append(mix(x[: len(x) - -(-percent * len(x) // 100) + 1] + np.uint64(2 * level[i] + 1)))
        owners.append(np.full(len(keys[-1]), sets[i]))
    return np.concatenate(owners), np.concatenate(keys)


# --- the tree --------------------------------------------------------------------------------------------------------

class Tree:
    """Sets (ascending arrays) as a prefix tree. A node holds a run of up to STRIDE elements that its sets have in common
    after the parent's; nodes lie level by level."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())  # equal beginnings lie together
        runs, self.at, self.len, self.depth, self.low, self.high, self.child, self.children, self.ends = [], [], [], [], [], [], [], [], []
        used = 0
        level = [(0, len(sets), 0, -1)]
        first = True
        while level:
            following = []
            for a, b, depth, parent in level:
                members = self.order[a:b]
                done = [i for i in members if self.sizes[i] == depth]
                if parent >= 0:
                    self.ends[parent] = done
                rest = [k for k in range(a, b) if self.sizes[self.order[k]] > depth]
                begin = len(self.at)
                i = 0
                while i < len(rest):
                    head = sets[self.order[rest[i]]]
                    j = i + 1
                    while j < len(rest) and sets[self.order[rest[j]]][depth] == head[depth]:
                        j += 1
                    stop = min(depth + STRIDE, int(min(self.sizes[self.order[k]] for k in rest[i:j])))
                    n = stop - depth
                    for k in rest[i + 1 : j]:
                        differ = np.flatnonzero(sets[self.order[k]][depth : depth + n] != head[depth : depth + n])
                        if len(differ):
                            n = int(differ[0])
                    sizes = self.sizes[[self.order[k] for k in rest[i:j]]]
                    self.at.append(used)
                    self.len.append(n)
                    self.depth.append(depth + n)
                    self.low.append(int(sizes.min()))
                    self.high.append(int(sizes.max()))
                    self.child.append(0)
                    self.children.append(0)
                    self.ends.append([])
                    runs.append(head[depth : depth + n])
                    used += n
                    # members that end below keep their order; those of one branch are contiguous after the sort
                    following.append((rest[i], rest[j - 1] + 1, depth + n, len(self.at) - 1))
                    i = j
                if parent >= 0:
                    self.child[parent], self.children[parent] = begin, len(self.at) - begin
                elif first:
                    self.roots, first = len(self.at), False
            level = following
        self.elements = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        self.at, self.len, self.depth, self.low, self.high, self.child, self.children = (np.array(x, np.int64) for x in (self.at, self.len, self.depth, self.low, self.high, self.child, self.children))

    def matches(self, probe: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(set, overlap) of the sets that join the probe. All branches of a level go on together."""
        n = len(probe)
        nodes, overlap = np.arange(self.roots), np.zeros(self.roots, np.int64)
        while len(nodes):
            size = self.len[nodes]
            upto = np.cumsum(size)
            run = self.elements[np.repeat(self.at[nodes] - upto + size, size) + np.arange(upto[-1])]
            place = np.searchsorted(probe, run)
            hit = np.concatenate(([0], np.cumsum(probe[np.minimum(place, n - 1)] == run)))
            overlap = overlap + hit[upto] - hit[upto - size]
            # the most that a set below can share: what is left of it, and of the probe after the branch's last element
            left = n - np.minimum(place[upto - 1] + (probe[np.minimum(place[upto - 1], n - 1)] == run[upto - 1]), n)
            low, high, depth = self.low[nodes], self.high[nodes], self.depth[nodes]
            most = overlap + np.minimum(high - depth, left)
            fair = (most >= needed(n, np.maximum(low, -(-percent * n // 100)), percent)) & (100 * high >= percent * n) & (percent * low <= 100 * n)
            nodes, overlap = nodes[fair], overlap[fair]
            for k in np.flatnonzero(np.fromiter((bool(self.ends[x]) for x in nodes.tolist()), bool, len(nodes))).tolist():
                for i in self.ends[nodes[k]]:
                    if overlap[k] >= needed(n, int(self.sizes[i]), percent):
                        yield i, int(overlap[k])
            count = self.children[nodes]
            total = np.cumsum(count)
            overlap = np.repeat(overlap, count)
            nodes = np.repeat(self.child[nodes] - total + count, count) + np.arange(total[-1] if len(total) else 0)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def may_join(sizes: np.ndarray, home: np.ndarray, prefixes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all sets whose prefixes don't rule a join out (two guests meet in the band where both are at home).
    Up to the lower of two prefixes' last elements both sets are known; beyond it they share at most what is left of either."""
    x = [np.asarray(p, np.int64).view(np.uint64) for p in prefixes]
    flat, at = np.concatenate(x), np.cumsum([0, *map(len, x)])[:-1]
    last = np.array([p[-1] for p in x], np.uint64)
    union, found = Union(len(x)), []
    for i, p in enumerate(x):
        place = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        common = np.add.reduceat((p[place] == flat).astype(np.int64), at)
        theirs = np.add.reduceat((flat <= p[-1]).astype(np.int64), at)
        mine = np.searchsorted(p, last, "right")
        fair = common + np.minimum(sizes[i] - mine, sizes - theirs) >= needed(sizes[i], sizes, percent)
        fair &= (100 * sizes >= percent * sizes[i]) & (percent * sizes <= 100 * sizes[i])
        if not home[i]:
            fair &= home
        found += [(i, j) for j in np.flatnonzero(fair).tolist() if j != i and union.join(i, j)]
    return found


def join_sets(sets: list[np.ndarray], percent: int, probes: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect what joins among the sets; with probes, only links of the first `probes` sets to the rest."""
    found, union = [], Union(len(sets))
    k = 0 if probes is None else probes
    tree = Tree(sets[k:])
    for i in range(len(sets) if probes is None else probes):
        for j, _ in tree.matches(sets[i], percent):
            if i != j + k and union.join(i, j + k):
                found.append((i, j + k))
    return found


# --- the join --------------------------------------------------------------------------------------------------------

def set_classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, f1, f2 (size and fingerprint of its set) and rep (the smallest doc_id with that set, null where empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, grams, at in text_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *fingerprints(grams, at)], names=["doc_id", "n", "f1", "f2"])

    rows = cut(docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long"), "sets")
    sets = rows.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("x")).select("doc_id", "x.n", "x.f1", "x.f2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    # a class of copies may hold a third of all rows: its members meet its name in SALTS parts
    part = sets.where("n > 0").groupBy("n", "f1", "f2", "salt").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    names = part.groupBy("n", "f1", "f2").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies")).where("copies > 1")
    named = part.drop("rep", "copies").join(names.drop("copies"), ["n", "f1", "f2"])
    member = sets.join(named, ["n", "f1", "f2", "salt"], "left").select("doc_id", "n", "f1", "f2", F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc_id"))).alias("rep"))
    member = cut(member, "classes")
    done_with(rows)
    return member


def fingerprints(grams: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """n, f1, f2 of each set."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (grams, mix(grams ^ np.uint64(0x5851F42D4C957F2D)))]
    return [pa.array(np.diff(at), pa.int64()), *[pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums]]


def candidates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all documents that agree in a key; documents with one and the same set are among them.

    Keys that meet in one batch are joined there, and one row goes on for them, so that a key that a third of all rows
    have is a few rows a task. Keys are then dealt once, in order, and read as a stream.
    """
    kind = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owners, keys = np.asarray(batch.column(0), np.int64), [], []
            for first, last, grams, at in text_sets(batch.column(1), words):
                some, key = set_keys(grams, at, percent)
                owners.append(ids[first:last][some])
                keys.append(key)
            if not owners:
                continue
            owner, key = np.concatenate(owners), np.concatenate(keys).view(np.int64)
            order = np.lexsort((owner, key))
            owner, key = owner[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
            apart = ~new & (owner != lead)
            pair = np.unique(np.column_stack((owner[apart], lead[apart])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(owner[new]), pa.nulls(int(new.sum()), pa.int64())], schema=kind)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(mix(pair[:, 0].view(np.uint64)).view(np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=kind)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, 0  # the key at the end of the last batch, and its first document
        for batch in batches:
            key, a, b = batch.column(0), np.asarray(batch.column(1), np.int64), batch.column(2)
            joined = np.asarray(b.is_valid())
            if joined.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[joined]), b.filter(pa.array(joined))], names=["a", "b"])
            key, a = np.asarray(key, np.int64)[~joined], a[~joined]
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = a[np.flatnonzero(new)]
            if held is not None and key[0] == held:
                first[0] = lead
            leads = first[np.cumsum(new) - 1]
            held, lead = key[-1], leads[-1]
            apart = a != leads
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(leads[apart])], names=["a", "b"])

    keys = docs.mapInArrow(send, "key long, a long, b long")
    return dealt(keys, ["key"], "a").mapInArrow(meet, "a long, b long").distinct()


def dealt(rows: DataFrame, keys: list[str], *then: str) -> DataFrame:
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def groups(keys: list[str], fn):
    """For mapInPandas on sorted partitions: fn on one group after the other; a group may go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.ones(len(pdf), bool)
            new[1:] = np.any([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in keys], axis=0)
            at = np.flatnonzero(new)
            held = pdf.iloc[at[-1] :]
            out = [fn(pdf.iloc[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if out := [x for x in out if len(x)]:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held):
            yield fn(held)

    return run


def shingle_ranks(docs: DataFrame, words: int) -> np.ndarray:
    """A table of COUNTERS (logarithmic) frequencies of shingles by hash: it only sets the order in which prefixes are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held, salt = np.zeros(COUNTERS, np.int64), [], 0, 0
        for batch in batches:
            for _, _, grams, _ in text_sets(batch.column(1), words):
                salt += int(grams[0]) & 0xFF if len(grams) else 0
                waiting.append((grams >> np.uint64(44)).astype(np.int64))
                held += len(grams)
                if held > 2_000_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, held = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        if counts.any():
            chunk, salts, data = counter_rows(counts, CHUNK, salt)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(salts, pa.int32()), pa.array(data)], names=["chunk_id", "salt", "counts"])

    counts = sum_counters(docs.mapInArrow(run, "chunk_id int, salt int, counts binary"), COUNTERS, CHUNK)
    return np.minimum(255, np.floor(6 * np.log2(counts + 1))).astype(np.uint64)


def candidates_by_prefixes(docs: DataFrame, member: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that connect all class representatives that a shared shingle of their prefixes makes candidates, and that
    prefixes don't rule out.

    A set that joins another shares a shingle with it among its first n - ceil(t n) + 1, rarer shingles first. For each such
    shingle the smallest set by hash is the leader, found by a combinable aggregate; every set that shares it goes to the
    leader's block, of which each band of sizes is a block of its own. A block above BLOCK sets goes on whole.
    """
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(shingle_ranks(docs, words))  # COUNTERS numbers, whatever the corpus
    least = Levels(percent, 1).least

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, grams, at in text_sets(batch.column(1), words):
                key = ordered(grams, rank.value)
                doc, tokens = [], []
                for d, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if y - x >= least:
                        some = y - x - -(-percent * (y - x) // 100) + 1
                        doc.append(d)
                        tokens.append(np.sort(np.partition(key[x:y], some - 1)[:some]))
                if doc:
                    _, f1, f2 = fingerprints(grams, at)
                    flat = pa.array(np.concatenate(tokens).view(np.int64))
                    upto = np.cumsum([0, *map(len, tokens)])
                    doc = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([ids.slice(first, last - first).take(doc), f1.take(doc), f2.take(doc), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat)], names=["doc_id", "f1", "f2", "tokens"])

    every = cut(docs.mapInArrow(prefixes, "doc_id long, f1 long, f2 long, tokens array<long>"), "prefixes")
    p = every.join(member.where(f"doc_id = rep and n >= {least}").select("doc_id", "f1", "f2", "n"), ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id"])
    p = cut(p.select("doc_id", "n", "tokens"), "chosen")
    done_with(every)
    tokens = p.select(F.explode("tokens").alias("key"), "doc_id")
    lead = tokens.groupBy("key").agg(F.min(F.xxhash64("doc_id")).alias("leader"), F.count("*").alias("sharing")).where("sharing > 1").drop("sharing")
    block = tokens.join(lead, "key").select("leader", "doc_id").distinct()
    # sizes that join lie in one band or in two that are next to each other: a set is at home in its band and a guest in the next
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    block = block.join(p.select("doc_id", band.alias("own")), "doc_id").select("leader", "doc_id", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"))
    banded = block = cut(block, "blocks")
    counts = block.groupBy("leader", "band").agg(F.count("*").alias("members"), F.max(F.col("own") == F.col("band")).alias("home")).where("members > 1 and home").drop("home")
    block = cut(block.join(counts, ["leader", "band"]).select(F.xxhash64("leader", "band").alias("leader"), "doc_id", (F.col("members") > BLOCK).alias("wide"), (F.col("own") == F.col("band")).alias("home")), "members")
    done_with(banded)
    small = block.where("not wide").join(p, "doc_id").select("leader", "doc_id", "home", "n", "tokens")

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        found = may_join(pdf["n"].to_numpy(), pdf["home"].to_numpy(bool), pdf["tokens"].tolist(), percent)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pd.DataFrame({"a": ids[list(a)], "b": ids[list(b)]}, columns=["a", "b"]).astype("int64")

    wide = block.where("wide")
    star = wide.join(wide.groupBy("leader").agg(F.min("doc_id").alias("b")), "leader").select(F.col("doc_id").alias("a"), "b")
    near = cut(dealt(small, ["leader"]).mapInPandas(groups(["leader"], left), "a long, b long").unionByName(star).distinct(), "near")
    done_with(block, p)
    return near


def links(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between class representatives that connect all that joins, and (doc_id, n, f1, f2, rep) of every document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    member = set_classes(texts, words)
    near = cut(candidates(texts, words, percent), "near") if percent >= PARTED else candidates_by_prefixes(texts, member, words, percent)
    parts = cut(components(near), "candidates")
    done_with(near)
    reps = parts.join(member.where("doc_id = rep").select(F.col("doc_id").alias("node"), "f1", "f2"), "node")
    sizes = reps.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))
    block = cut(reps.join(sizes, "component").select(F.col("component").alias("leader"), F.col("node").alias("doc_id"), "f1", "f2", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")), "members")
    done_with(parts)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, last, grams, at in text_sets(batch.column(1), words):
                _, f1, f2 = fingerprints(grams, at)
                sets = [grams[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, last - k), f1, f2, pa.array(sets, pa.binary())], names=["doc_id", "f1", "f2", "grams"])

    few = block.select("doc_id")
    few = F.broadcast(few) if few.count() <= MOST_IDS else few
    one = ["doc_id", "f1", "f2"]
    full = cut(texts.join(few, "doc_id", "left_semi").mapInArrow(elements, "doc_id long, f1 long, f2 long, grams binary").dropDuplicates(one), "elements")

    def join_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc_id"])
        ids = pdf["doc_id"].to_numpy()
        probes = int((pdf["side"] == 0).sum())
        found = join_sets([np.frombuffer(x, np.uint64) for x in pdf["grams"]], percent, probes or None)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pd.DataFrame({"a": ids[list(a)], "b": ids[list(b)]}, columns=["a", "b"]).astype("int64")

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        r = rows.join(full, one).select(*keys, "side", "doc_id", "grams")
        return dealt(r, keys).mapInPandas(groups(keys, join_group), "a long, b long")

    found = cut(joined(block.select("leader", "chunk", *one, F.lit(1).alias("side")), ["leader", "chunk"]), "links")
    large = block.where("chunks > 1")
    if large.take(1):
        # what large blocks still hold apart: sets outside a block's largest component meet its other sets
        parts = components(found)
        at = large.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        at = cut(at, "apart")
        sizes = at.groupBy("leader", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("leader").agg(F.max(F.struct("n", "component")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("leader", F.col("x.component").alias("main"))
        at = at.join(main, "leader")
        minor = at.where("component <> main").select("leader", *one, "chunks")
        lots = minor.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lots"))
        minor = minor.join(lots, "leader").withColumn("lot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("lots")).cast("int"))
        probes = minor.select("leader", "lot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *one, F.lit(0).alias("side"))
        stored = at.join(lots, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "chunk", *one, F.lit(1).alias("side"))
        found = found.unionByName(cut(joined(probes.unionByName(stored), ["leader", "lot", "chunk"]), "links"))
    done_with(full)
    return found, member


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id that links lead to, itself included."""
    found, member = links(docs, words, percent)
    parts = components(found)
    out = member.join(parts, member.rep == parts.node, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """docs without the documents of a component other than its smallest doc_id. doc_id is taken to be a key of docs; rows
    without one stay."""
    gone = cut(jaccard_components(docs, words, percent).where("component_id <> doc_id").select("doc_id"), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
