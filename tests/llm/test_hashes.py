"""SimHash classes, periodic runs and Merkle proofs against brute force on small tables."""

import math
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import merkle, periods, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, tree string, level int, h int, w string, runs string, collapsed string"


def table(spark, rows):
    """rows of (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], None if r[0] is None else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 7, "t", 3, 5, "w", "r", "c") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def written(spark, rows, tmp_path):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def words(text):
    return (text or "").encode().split()


# --- SimHash ---------------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, linked):
    name = list(range(len(ids)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                name[root(i)] = root(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)].append(x)
    return [min(least[root(i)], default=None) for i in range(len(ids))]


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "ε", "zeta x", "eta", "0", "İ", "ß"]
    out = [None, "", " \t\r\n", "one", "One  two", "one\ttwo\x0bthree", "a b c " * 5000, "same text again", "same text again"]
    for _ in range(n):
        t = [r.choice(vocabulary) for _ in range(r.choice([2, 3, 5, 40, 300]))]
        out.append(" ".join(t))
        if r.random() < 0.5:
            t[r.randrange(len(t))] = "changed"
            out.append("  ".join(t))
    return out


def test_fingerprints():
    for t in texts():
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    """XXH64 with the seed 42 is also what Spark's own function gives of a string."""
    for t in ("", "a b c", "délta ε " * 9):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


def test_simhash_query_against_brute_force(spark, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "same text again"), (None, "alone here now"), (3, "same text again")]
    got = simhash.op11_simhash(spark, written(spark, rows, tmp_path)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = slow_components([i for i, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got)) == sorted(key((i, f"{p:016x}", c)) for (i, _), p, c in zip(rows, prints, want, strict=True))


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_near_fingerprints(spark, radius):
    r = random.Random(radius)
    prints = {0, (1 << 64) - 1, 1 << 63}
    while len(prints) < 40:
        p = r.choice(sorted(prints)) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            p ^= 1 << r.randrange(64)
        prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    found = simhash.near(df.select("fp"), radius).collect()
    apart = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert all(apart(x.a, x.b) <= radius for x in found)
    linked = {(x.a, x.b) for x in found} | {(x.b, x.a) for x in found}
    assert slow_components(signed, lambda i, j: (signed[i], signed[j]) in linked) == slow_components(signed, lambda i, j: apart(signed[i], signed[j]) <= radius)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near(spark.createDataFrame([(1,)], "fp long"), 3)


# --- periodic runs ---------------------------------------------------------------------------------------------------

def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > a and i + q - a >= max(6, 4 * q):
                found.setdefault((a, i + q - a), q)
            i += i == a
    return sorted((a, n, q) for (a, n), q in found.items())


def slow_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in runs)]


def periodic(r, n, k):
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randint(0, 4)):
        if n > 4:
            a, p = r.randrange(n), r.randint(1, max(1, n // 5))
            for i in range(a + p, r.randint(a, n)):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(25):
        some = [periodic(r, r.choice([0, 1, 4, 5, 6, 7, 30, 130, 500]), r.choice([1, 2, 3, 6, 60])) for _ in range(r.randint(1, 5))]
        got = periods.find_runs([np.array(w, np.int64) for w in some])
        assert [[tuple(x) for x in g.tolist()] for g in got] == [slow_runs(w) for w in some]


@pytest.mark.parametrize("p", periods.PRIMES)
def test_convolution(p):
    r = np.random.default_rng(1)
    for m in (1, 2, 4, 64):
        a, b = (r.integers(0, p, (3, m), dtype=np.uint64) for _ in range(2))
        want = [[sum(int(x[i]) * int(y[(k - i) % m]) for i in range(m)) % p for k in range(m)] for x, y in zip(a, b, strict=True)]
        assert periods.convolve(a.copy(), b.copy(), p).tolist() == want


def test_no_match_by_a_remainder():
    """Numbers whose squared differences are a multiple of the first prime aren't taken for equal."""
    p = periods.PRIMES[0]
    a = next(x for x in range(1, math.isqrt(p)) if math.isqrt(p - x * x) ** 2 + x * x == p)
    b = math.isqrt(p - a * a)
    w = np.array([a, b, 0, 0, 1, 0, 0, 0, 0, 0], np.int64)  # differences (a, b): a * a + b * b = p
    assert not len(periods.matches(w, np.array([0]), 2)[0])


def test_long_texts():
    r = np.random.default_rng(0)
    w = np.concatenate((r.integers(0, 9000, 30_000), np.arange(5000).repeat(1), np.tile(np.arange(20_000, 27_000), 5), np.zeros(9000, int)))
    got = periods.find_runs([w, np.zeros(0, np.int64), w[:10]])
    assert got[0].tolist() == [[35_000, 35_000, 7000], [70_000, 9000, 1]] and not len(got[1]) and not len(got[2])


def test_periods_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \n "), (4, "x " * 5), (4, "x " * 6), (4, "x " * 6), (5, "A a A a A a A a")]
    rows += [(i, r.choice([" ", "\n", " \t "]).join(f"w{x}é" for x in periodic(r, r.choice([1, 3, 9, 80, 400]), r.choice([2, 5, 90])))) for i in range(10, 150)]
    got = periods.op12_periods(spark, written(spark, rows, tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        w = [x.decode() for x in words(text)]
        h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = slow_runs(w)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        digest = lambda s: sha256(s.encode()).hexdigest()
        row = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *row, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(" ".join(slow_collapsed(w, runs)))))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_runs_keep_a_callers_columns(spark):
    d = periods.periodic_runs(table(spark, [(1, "a a a a a a b"), (2, None)])).orderBy("doc_id")
    assert "w" in d.columns and d.columns[-2:] == ["runs", "collapsed"]
    assert [([tuple(x) for x in r.runs], r.collapsed) for r in d.collect()] == [([(0, 6, 1)], "a b"), ([], "")]


# --- Merkle manifest -------------------------------------------------------------------------------------------------

def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_tree(level):
    """root, and for each leaf its siblings' hashes level by level."""
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(proofs):
            run = range(at[k] // 16 * 16, min(at[k] // 16 * 16 + 16, len(level)))
            p.append(([level[x] for x in run if x < at[k]], [level[x] for x in run if x > at[k]]))
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [x // 16 for x in at]
    return level[0], proofs


def slow_merkle(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*[value(v) for v in (r[0], r[2], None if r[0] is None else "en", None if r[1] is None else len(r[1]), text)])
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    root, tops = slow_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, h, r), proof in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            way = proof + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            f = leaf(r, r[1].translate({c: c + 32 for c in range(65, 91)})) if tampered else h
            for before, after in way:
                f = H(*before, f, *after)
            out.append((r[0], h, trees[s][0], root, H(*[x for b, a in way for x in (*b, *a)]), f, f == root))
    return out


def merkle_rows(kind):
    if kind == "one":
        return [(5, "Text", "s")]
    if kind == "many sources":
        return [(i, f"T{i}", f"s{i % 37}") for i in range(60)]
    rows = [(i, None if i % 11 == 0 else "É T" * (i % 5), ["hot", "hot", "b", None, "é", "Z"][i % 6]) for i in range(700)]
    return [*rows, (None, "Null", "b"), (None, None, None), (3, "again", "b"), (3, "again", "b"), (9, "x" * 100_000, "lone"), (8, "E", "")]


@pytest.mark.parametrize("kind", ["one", "many sources", "mixed"])
@pytest.mark.parametrize("part", [4096, 50])
def test_merkle_query_against_brute_force(spark, tmp_path, monkeypatch, kind, part):
    monkeypatch.setattr(merkle, "PART", part)
    rows = merkle_rows(kind)
    got = merkle.op13_merkle(spark, written(spark, rows, tmp_path)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, slow_merkle(rows)))


def test_proofs_of_some_leaves(spark):
    """A multiproof of any leaves: folded roots are the root, and a wrong leaf's aren't."""
    leaves = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    placed, nodes = merkle.manifest(leaves, "g", "k")
    some = placed.where("k % 97 = 5 or k in (0, 1, 999)").withColumn("wrong", F.when(F.col("k") == 999, F.lit("0" * 64)).otherwise(F.col("leaf")))
    got = merkle.prove(some, nodes, ["k"], "wrong").collect()
    assert len(got) == 14 and {r.k for r in got if r.folded_root != r.root} == {999}
    root = nodes.where("tree = 0").orderBy(F.desc("level")).first()["hash"]
    assert {r.root for r in got} == {root}


def test_missing_nodes_are_few():
    """Leaves 0 .. 4095 of 20,000 need nothing below the fourth level; no coordinate follows from the leaves or is named twice."""
    found = {level: places.tolist() for level, places in merkle.missing(np.arange(4096), 20_000)}
    assert found == {0: [], 1: [], 2: [], 3: [1, 2, 3, 4]}
    found = {level: places.tolist() for level, places in merkle.missing(np.array([3, 4, 30]), 40)}
    assert found == {0: [*range(3), *range(5, 30), 31], 1: [2]}


@pytest.mark.parametrize("query", [simhash.op11_simhash, periods.op12_periods, merkle.op13_merkle])
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, written(spark, [], tmp_path)).count() == 0
