"""Toxicity by weak supervision.

Voters look at a text: a public word list, LEXICONS lexicons each of words and of word beginnings (4 to 7 bytes) gathered from
labelled rows and dealt by hash, shouting, runs of exclamation marks, and the label itself as one more noisy voter. A
generative model of their votes (how often each fires on toxic and on clean texts; voters that go together beyond that, however
many, are modelled jointly) is fitted by expectation maximisation, from the share of lexicons that fire, and gives each text a
posterior. A linear classifier is trained on the posteriors, over the lexicon
entries and the voters; it alone scores.

Everything is fitted on a bounded sample, SAMPLE labelled rows outside the held-out quarter, taken by hash of the id, of
which near copies (one shared shingle minimum) count once. Every word of every whole text is scored.

A null or empty text has the score of a text in which no voter fires. Repeated rows are each scored. Without labels (an empty
table, say) no lexicon is learned and the public list decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import Spans, cut, done_with, held_out, mix, slices

SAMPLE = 30_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
MOST_FEATURES = 4096
LEXICONS = 4
LEAST_TOXIC = 3
LEAST_ODDS = 2.5
# A public list of insults.
INSULTS = "bastard bitch clown coward creep cretin crap damn disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk liar loser lunatic moron moronic nasty pathetic pig psycho retard ridiculous scum scumbag shit slut stupid suck sucks trash ugly useless vermin vile whore worthless".split()

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
PATTERNS = ("listed", "shouting", "exclaiming")


def word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    n = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(n)
    return mix(Spans(data, np.array([0, len(data)]), lower=False).hashes(ends - n, ends))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: text and hash of each word, and text, kind (index into PREFIXES) and hash of each beginning."""
    spans = Spans(data, offsets, lower=False)
    starts, ends, doc = spans.words(_INSIDE)
    word = mix(spans.hashes(starts, ends))
    out = []
    for k, n in enumerate(PREFIXES):
        some = np.flatnonzero(ends - starts > n)
        out.append((doc[some], np.full(len(some), k), mix(spans.hashes(starts[some], starts[some] + n) ^ np.uint64(0xA5A5 + 977 * n))))
    return doc, word, *(np.concatenate(x) for x in zip(*out, strict=True))


def loudness(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a text shouts (over six tenths of at least 20 ASCII letters are capitals) and whether !! occurs three times."""
    sums = lambda x: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate(([0], np.cumsum(x))))
    capitals, letters = sums(_UPPER[data]), sums(_LETTER[data])
    bang = np.zeros(len(data), bool)
    bang[1:] = (data[1:] == 33) & (data[:-1] == 33)
    return (letters >= 20) & (capitals > 0.6 * letters), sums(bang) >= 3


class Model:
    """Lexicon entries by hash (with the voter each belongs to) and the classifier's weights."""

    def __init__(self, keys: np.ndarray, voters: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.voters = keys[order], voters[order]
        self.listed = np.sort(word_hashes(INSULTS))
        self.width = len(keys) + len(PATTERNS)
        self.weights, self.bias = np.zeros(self.width), 0.0
        self.weights[len(keys)] = 6.0
        self.bias = -3.0

    def columns(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """first, last, and (text, column) of each feature that a text has, once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for first, last, data, offsets in slices(texts):
            shouts, exclaims = loudness(data, offsets)
            low = pc.utf8_lower(texts[first:last])
            _, _, data, offsets = next(slices(low, 1 << 62))
            doc, word, d2, _, begin = features(data, offsets)
            row, col = [], []
            for d, h in ((doc, word), (d2, begin)):
                if len(self.keys):
                    at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                    hit = self.keys[at] == h
                    row.append(d[hit])
                    col.append(at[hit])
            at = np.minimum(np.searchsorted(self.listed, word), len(self.listed) - 1)
            for k, some in enumerate((doc[self.listed[at] == word], np.flatnonzero(shouts), np.flatnonzero(exclaims))):
                row.append(some)
                col.append(np.full(len(some), len(self.keys) + k))
            key = np.unique(np.concatenate(row) * self.width + np.concatenate(col))
            yield first, last, key // self.width, key % self.width

    def score(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for first, last, row, col in self.columns(texts):
            z = self.bias + np.bincount(row, self.weights[col], minlength=last - first)
            yield first, last, 1 / (1 + np.exp(-np.clip(z, -40, 40)))


# --- fitting ---------------------------------------------------------------------------------------------------------

def joint_groups(votes: np.ndarray, weight: np.ndarray, p: np.ndarray, least: float = 0.2) -> list[list[int]]:
    """Voters grouped where their votes go together beyond what the class explains (correlation of residuals above `least`)."""
    m = votes.shape[1]
    groups = [[j] for j in range(m)]
    expect = []
    for q in (1 - p, p):
        w = weight * q
        expect.append((w @ votes) / max(w.sum(), 1e-9))
    residual = votes - np.outer(1 - p, expect[0]) - np.outer(p, expect[1])
    var = np.maximum((weight[:, None] * residual**2).sum(0), 1e-9)
    for i, j in itertools.combinations(range(m), 2):
        if abs((weight * residual[:, i] * residual[:, j]).sum()) / np.sqrt(var[i] * var[j]) > least:
            a, b = (next(g for g in groups if x in g) for x in (i, j))
            if a is not b:
                a += b
                groups.remove(b)
    return groups


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 40) -> np.ndarray:
    """votes (rows x voters, 0 or 1), label (0, 1 or -1 for none, a noisy voter of its own) -> posterior of toxic."""
    patterns, back, count = np.unique(np.column_stack((votes, label)), axis=0, return_inverse=True, return_counts=True)
    # more voters than on the average text speak for toxic; the label comes in as a voter only
    p = np.clip(0.5 + votes.mean(1) - (votes.mean() if votes.size else 0.0), 0.05, 0.95)
    back = back.ravel()
    p = np.bincount(back, p) / count
    v, l, w = patterns[:, :-1].astype(float), patterns[:, -1], count.astype(float)
    groups = joint_groups(v, w, p)
    for _ in range(rounds):
        prior = np.clip((w * p).sum() / w.sum(), 1e-4, 1 - 1e-4)
        logs = np.tile(np.log([1 - prior, prior]), (len(w), 1))
        for g in groups:
            key = np.unique(v[:, g], axis=0, return_inverse=True)[1].ravel()  # the votes that occur
            for c, q in enumerate((1 - p, p)):
                table = np.bincount(key, w * q)
                table = table + 0.5 / len(table)
                logs[:, c] += np.log(table / table.sum())[key]
        right = (w * np.where(l == 1, p, np.where(l == 0, 1 - p, 0))).sum() + 9
        accuracy = np.clip(right / ((w * (l >= 0)).sum() + 10), 0.6, 0.999)
        logs[:, 1] += np.where(l == 1, np.log(accuracy), np.where(l == 0, np.log(1 - accuracy), 0))
        logs[:, 0] += np.where(l == 0, np.log(accuracy), np.where(l == 1, np.log(1 - accuracy), 0))
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -40, 40)))
    return p[back]


def train(rows: np.ndarray, cols: np.ndarray, p: np.ndarray, width: int, l2: float = 2.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors by accelerated gradient steps (features are few a row, so sums are sparse)."""
    n = len(p)
    w, b = np.zeros(width), -2.0
    mw, mb, vw, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], minlength=n)
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - p
        gw, gb = np.bincount(cols, g[rows], minlength=width) + l2 * 0.01 * w, g.sum()
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 if t < steps // 2 else 0.02
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (mw / c) / (np.sqrt(vw / d) + 1e-6)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-6)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> a classifier. Labels of the held-out quarter are not read."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = [min(1.0, sample / 2 / max(n.get(c, 0), 1)) for c in (0, 1)]
    some = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * 1_000_000)
    rows = docs.select("doc_id", "text").where("text is not null").join(some, "doc_id")

    def signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.jaccard import text_sets

        for batch in batches:
            for first, last, grams, at in text_sets(batch.column(1), 3):
                least = np.minimum.reduceat(np.append(grams, np.uint64((1 << 64) - 1)), at[:-1])
                least = np.where(at[1:] > at[:-1], least, np.uint64(0)).view(np.int64)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least)], names=["doc_id", "text", "toxic", "least"])

    held = picked = cut(rows.mapInArrow(signature, "doc_id long, text string, toxic int, least long"), "labelled")
    one = picked.groupBy("least", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    picked = picked.select("doc_id", "text").join(one, "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and beginnings of texts, each once a text: hash, kind (0 words), texts of each label."""
        for batch in batches:
            toxic = np.asarray(batch.column(2))
            for first, last, data, offsets in slices(pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))):
                doc, word, d2, kind, begin = features(data, offsets)
                doc, h, kind = np.concatenate((doc, d2)), np.concatenate((word, begin)), np.concatenate((np.zeros(len(doc), np.int64), kind + 1))
                _, at = np.unique(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                keys, k, back = np.unique(h[at], return_index=True, return_inverse=True)
                t = toxic[first:last][doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind[at][k], pa.int32()), pa.array(np.bincount(back, t).astype(np.int64)), pa.array(np.bincount(back, 1 - t).astype(np.int64))], names=["h", "kind", "pos", "neg"])

    size = {r.toxic: r["count"] for r in picked.groupBy("toxic").count().collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    seen = "h long, kind int, pos long, neg long"
    counts = picked.select("doc_id", "text", "toxic").mapInArrow(found, seen).groupBy("h", "kind").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.1) / (t + 0.2)) - F.log((F.col("neg") + 0.1) / (c + 0.2))
    entries = counts.where(F.col("pos") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("pos"), "h").limit(MOST_FEATURES).collect()
    model = Model(np.array([r.h for r in entries], np.int64).view(np.uint64), np.array([r.kind for r in entries], np.int64))
    if not (t and c):
        done_with(held)
        return model
    shared = picked.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES entries

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, col in shared.value.columns(batch.column(0)):
                at = np.searchsorted(row, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1)[first:last], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(col, pa.int32()))], names=["toxic", "cols"])

    table = picked.select("text", "toxic").mapInArrow(look, "toxic int, cols array<int>").toArrow()  # at most `sample` rows
    done_with(held)
    lists = table["cols"].combine_chunks()
    label = np.asarray(table["toxic"])
    cols = np.asarray(lists.flatten())
    rows_ = np.repeat(np.arange(len(label)), np.diff(np.asarray(lists.offsets)))
    lexicons = (len(PREFIXES) + 1) * LEXICONS
    voter = np.concatenate((model.voters * LEXICONS + (model.keys % np.uint64(LEXICONS)).astype(np.int64), lexicons + np.arange(len(PATTERNS))))
    votes = np.zeros((len(label), lexicons + len(PATTERNS)), np.int64)
    votes[rows_, voter[cols]] = 1
    model.weights, model.bias = train(rows_, cols, label_model(votes, label), model.width)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score, predicted and the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES entries
    schema = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, s in shared.value.score(batch.column(batch.num_columns - 1)):
                yield pa.RecordBatch.from_arrays([*[x[first:last] for x in batch.columns[:-1]], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[f.name for f in schema])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), *keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores below THRESHOLD, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES entries
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, s in shared.value.score(batch.column(at)):
                yield batch.slice(first, last - first).filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
