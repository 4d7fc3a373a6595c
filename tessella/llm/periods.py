"""Periodic runs of words by block convolution.

A run of period q is a stretch of words that equal the words q places on, and that can't be extended. At the scale B = 1, 2, 4,
... runs with B <= q < 2B are found: texts are cut into blocks of B words, and a run of at least 4q words holds a whole block
with a copy of it q words on. The squared differences of a block and of each place of the window that follows add up to
sum x^2 + sum y^2 - 2 sum xy; the last sum is a convolution, taken for all blocks at once by number-theoretic transforms modulo
as many primes as hold the largest possible sum, so a zero is a zero. Places with zero mismatch give the distances, and each is
extended to both sides by comparing words. Blocks one of whose words has no copy in the window, and blocks that lie with their
window in a run already found, can't give a new run and aren't transformed; neither test loses one.

A null text has no words. A text is read whole, whatever its length (below 2 ** 28 words); texts are worked on by themselves,
so nothing is shuffled. Repeated rows are rows; an empty table gives an empty result. Other columns of the caller's stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from tessella.llm.common import WORD_PATTERN

#: Primes k * 2 ** m + 1 with m of 27 at least, below 2 ** 32.
PRIMES = (3221225473, 3489660929, 2281701377)
#: Words of short texts that are searched together; numbers that a transform holds at once.
TOGETHER, AT_ONCE = 1 << 16, 1 << 19
RUNS = "array<struct<start:long,length:long,period:long>>"
LEAST = 6
TIMES = 4


def roots(p: int, size: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 .. size / 2 - 1 of an element of order `size`."""
    g = next(x for x in range(2, p) if pow(x, (p - 1) // 2, p) != 1)
    r = pow(g, (p - 1) // size * (size - 1 if inverse else 1), p)
    out = np.ones(max(size // 2, 1), np.uint64)
    done = 1
    while done < len(out):
        out[done : 2 * done] = out[:done] * np.uint64(pow(r, done, p)) % np.uint64(p)
        done *= 2
    return out


def convolve(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Cyclic convolution of the rows of a and b modulo p; rows have a power of two of numbers below p."""
    m, q = a.shape[1], np.uint64(p)

    def forward(x: np.ndarray) -> np.ndarray:
        w, half = roots(p, m), m // 2
        while half:
            v = x.reshape(len(x), -1, 2, half)
            low, high = v[:, :, 0].copy(), v[:, :, 1].copy()
            v[:, :, 0] = (low + high) % q
            v[:, :, 1] = (low + q - high) % q * w[:: m // (2 * half)] % q
            half //= 2
        return x

    x = forward(a) * forward(b) % q
    w, half = roots(p, m, inverse=True), 1
    while half < m:
        v = x.reshape(len(x), -1, 2, half)
        low, high = v[:, :, 0].copy(), v[:, :, 1] * w[:: m // (2 * half)] % q
        v[:, :, 0] = (low + high) % q
        v[:, :, 1] = (low + q - high) % q
        half *= 2
    return x * np.uint64(pow(m, -1, p)) % q


def matches(w: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks w[s : s + block] and distances d, block <= d < 2 * block, at which their sum of squared differences is zero.

    w reaches past the last window; its numbers are not negative.
    """
    top = int(w.max(initial=0)) ** 2 * block
    count = next(i for i in range(1, len(PRIMES) + 1) if top < math.prod(PRIMES[:i]))
    size, found = 2 * block, ([], [])
    for k in range(0, len(starts), rows := max(1, AT_ONCE // size)):
        s = starts[k : k + rows]
        x = w[s[:, None] + np.arange(block)].astype(np.uint64)
        y = np.zeros((len(s), size), np.uint64)
        y[:, : 2 * block - 1] = w[s[:, None] + block + np.arange(2 * block - 1)]
        turned = np.zeros_like(y)
        turned[:, -np.arange(block)] = x
        zero = np.ones((len(s), block), bool)
        for p in map(np.uint64, PRIMES[:count]):
            squares = np.zeros((len(s), size + 1), np.uint64)
            np.cumsum(y * y % p, axis=1, out=squares[:, 1:])
            both = (x * x % p).sum(1, keepdims=True) + squares[:, block : 2 * block] - squares[:, :block]
            cross = convolve(turned % p, y % p, int(p))[:, :block]
            zero &= (both % p + np.uint64(2) * (p - cross)) % p == 0
        i, d = np.nonzero(zero)
        found[0].append(s[i])
        found[1].append(d + block)
    return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (starts[:0], starts[:0])


def live(w: np.ndarray, n: int, block: int, keys: np.ndarray, wide: int) -> np.ndarray:
    """Starts of the blocks of w[:n] all of whose words stand again block to 2 * block - 1 words on. keys: word * wide + place, in order."""
    starts = np.arange(n // block) * block
    if block <= 8:
        again = np.zeros(n, bool)
        for d in range(block, min(2 * block, n)):
            again[: n - d] |= w[: n - d] == w[d:n]
        return starts[again[: len(starts) * block].reshape(-1, block).all(1)]

    def again_at(places: np.ndarray) -> np.ndarray:
        wanted = w[places] * wide + places + block
        next_ = keys[np.minimum(np.searchsorted(keys, wanted), n - 1)] - wanted
        return (next_ >= 0) & (next_ < block)

    for k in (0, block - 1, block // 2, block // 4):
        starts = starts[again_at(starts + k)]
    rows = max(1, AT_ONCE // block)
    return np.concatenate([starts[:0], *(s[again_at(s[:, None] + np.arange(block)).all(1)] for s in (starts[k : k + rows] for k in range(0, len(starts), rows)))])


def stretch(w: np.ndarray, n: int, at: int, upto: int, d: int) -> tuple[int, int]:
    """The widest i range around at .. upto with w[i] == w[i + d]."""
    step = 64
    while at > 0:
        a = max(0, at - step)
        off = np.flatnonzero(w[a:at] != w[a + d : at + d])
        if len(off):
            at = a + int(off[-1]) + 1
            break
        at, step = a, step * 2
    step = 64
    while upto < n - d:
        b = min(n - d, upto + step)
        off = np.flatnonzero(w[upto:b] != w[upto + d : b + d])
        if len(off):
            upto += int(off[0])
            break
        upto, step = b, step * 2
    return at, upto


def find_runs(labels: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs (start, length, period), by start and period, of each of some texts given as numbers of words: stretches with
    smallest period q and a length of max(least, times * q) at least, times >= 4, that can't be extended."""
    # one row of numbers: no two texts share one, and a number of its own parts them
    begin, used, parts = [], 0, []
    for x in labels:
        begin.append(begin[-1] + len(parts[-1]) if parts else 0)
        parts.append(np.append(x + used, used + (int(x.max()) + 1 if len(x) else 0)))
        used = int(parts[-1][-1]) + 1
    n = sum(map(len, parts))
    longest = max(map(len, labels), default=0)
    w = np.concatenate([*parts, np.full(3 * max(1, longest), used)]).astype(np.int64)
    wide = 4 * len(w)
    keys = np.sort(w[:n] * wide + np.arange(n))
    known: dict[tuple[int, int], int] = {}
    block = 1
    while times * block <= longest:
        s = live(w, n, block, keys, wide)
        if known and len(s):
            runs = np.array(sorted(known))
            reach = np.append(-1, np.maximum.accumulate(runs[:, 1]))[np.searchsorted(runs[:, 0], s, "right")]
            s = s[reach < s + 3 * block]
        s, d = matches(w, s, block)
        order = np.lexsort((s, d))
        last, upto = 0, 0
        for period, at in zip(d[order].tolist(), s[order].tolist(), strict=True):
            if period == last and at < upto:
                continue
            first, upto = stretch(w, n, at, at + block, period)
            last = period
            if upto + period - first >= max(least, times * period):
                known.setdefault((first, upto + period), period)  # with a smaller period it is known already
        block *= 2
    if not known:
        return [np.zeros((0, 3), np.int64)] * len(labels)
    found = np.array([(a, b - a, q) for (a, b), q in known.items()], np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    at = np.searchsorted(found[:, 0], [*begin, n])
    return [found[a:b] - [c, 0, 0] for a, b, c in zip(at[:-1], at[1:], begin, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", rest: str = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with the text's runs (start, length, period; by start, then period) and the text without their repetitions.

    Columns of the caller's with these two names are replaced. A text without runs has an empty list.
    """
    keep = [c for c in docs.columns if c not in (runs, rest)]
    at = keep.index(text)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first, held, labels = batch.column(at), 0, [], []
            for i in range(len(column) + 1):
                if i == len(column) or held and sum(map(len, held)) > TOGETHER:
                    found = find_runs(labels, least, times)
                    offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
                    flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
                    fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                    texts = pa.array([collapsed(x, r).decode() for x, r in zip(held, found, strict=True)], pa.string())
                    part = batch.slice(first, i - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, fields), texts], names=[*keep, runs, rest])
                    first, held, labels = i, [], []
                if i < len(column):
                    words = (column[i].as_py() or "").encode().split()  # at the six white-space bytes
                    number: dict[bytes, int] = {}
                    held.append(words)
                    labels.append(np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words)))

    schema = StructType([*docs.select(*keep).schema.fields, StructField(runs, DataType.fromDDL(RUNS)), StructField(rest, StringType())])
    return docs.select(*keep).mapInArrow(solve, schema)


def planted(docs: DataFrame) -> DataFrame:
    """docs with the contract's periodic tails: where crc32 of the decimal doc_id is a multiple of 10, words from a on repeat
    the p words that stand there. A null doc_id or text changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))))
    d = d.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("unit", F.slice("w", F.col("a") + 1, F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat("unit", F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periods(spark, sf_dir: str) -> DataFrame:
    d = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    d = d.withColumn("best", best).withColumn("length", -F.col("best.l"))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), "length", F.col("best.p").alias("period"), F.floor(1000 * F.col("length") / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
