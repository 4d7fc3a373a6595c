"""Language identification by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. A text's probability in a language is the sum
over all ways to cut it into pieces; as pieces stay within words, it is the product of its words' sums, each by a forward
algorithm over the word's bytes. Piece probabilities are fitted by expectation maximisation (forward and backward) on the
distinct words of a bounded sample, DOCS_PER_LANGUAGE documents of each language, taken by hash of the id. Texts are
lower-cased; every word of every whole text counts. A run without white space above LONGEST bytes is read as parts of at
most that length, cut between characters; pieces don't span two parts.

A null text and one without a letter are `und` with score 0. Rows without a language teach nothing but are scored. Repeated
rows are each scored. If no row teaches a language (an empty table, say), all are `und`.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import Spans, cut, held_out, slices

DOCS_PER_LANGUAGE = 2000
ROUNDS = 3
LONGEST = 64
SMOOTH = 0.02
MOST_WORDS = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")


class Vocabulary:
    """Pieces (bytes, from a tiktoken file) by hash. All 256 bytes are pieces, so every word has a segmentation."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.size = max(ranks.values()) + 1
        pieces = list(ranks.items())
        self.longest = max(map(len, ranks))
        data = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        ends = np.cumsum([len(p) for p, _ in pieces])
        h = Spans(data, np.array([0, len(data)]), lower=False).hashes(ends - np.array([len(p) for p, _ in pieces]), ends)
        self.keys, self.ids = np.zeros(1 << 20, np.uint64), np.full(1 << 20, self.size, np.int32)
        for x, (_, i) in zip(h.tolist(), pieces, strict=True):
            at = x & 0xFFFFF
            while self.keys[at]:
                at = (at + 1) & 0xFFFFF
            self.keys[at], self.ids[at] = x, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, or `size` where there is no such piece."""
        at = (h & np.uint64(0xFFFFF)).astype(np.int64)
        out = np.full(len(h), self.size, np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            at[open_] = (at[open_] + 1) & 0xFFFFF
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def lattice(v: Vocabulary, spans: Spans, starts: np.ndarray, n: int) -> list[list[np.ndarray]]:
    """ids[j][l]: the piece that covers the bytes from j - l - 1 to j, for words of n bytes."""
    return [[v.find(spans.hashes(starts + j - k, starts + j)) for k in range(1, min(j, v.longest) + 1)] for j in range(1, n + 1)]


def forward(ids: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
    """Sums over segmentations of each beginning: alpha[j] is words x languages. p has a last row of zeros."""
    alpha = [np.ones((len(ids[0][0]), p.shape[1]))]
    for row in ids:
        alpha.append(sum(alpha[-k] * p[x] for k, x in enumerate(row, 1)))
    return alpha


def by_length(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    size = ends - starts
    for n in np.unique(size):
        yield int(n), np.flatnonzero(size == n)


def parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (with the byte before them, a white space) in parts of up to LONGEST bytes, and each part's word."""
    starts = starts - 1
    n = -(-(ends - starts) // LONGEST)
    word = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    s = starts[word] + k * LONGEST
    e = np.minimum(s + LONGEST, ends[word])
    for _ in range(3):  # a cut inside a character moves to its start, at both sides of the cut
        s = s - ((k > 0) & (data[s] & 0xC0 == 0x80))
        e = e - ((e < ends[word]) & (data[np.minimum(e, len(data) - 1)] & 0xC0 == 0x80))
    return s, e, word


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case, each text after a space, white space other than spaces as spaces where one byte."""
    t = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), t, pa.scalar("", pa.large_string()))


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


class Scorer:
    def __init__(self, path: str, p: np.ndarray):
        self.v, self.p = vocabulary(path), np.vstack((p, np.zeros((1, p.shape[1]))))
        self.forget()

    def forget(self) -> None:
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros((0, self.p.shape[1]), np.float32)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probabilities, texts x languages."""
        spans = Spans(_SPACED[data], offsets, lower=False)
        starts, ends, doc = spans.words()
        out = np.zeros((len(offsets) - 1, self.p.shape[1]))
        if not len(starts):
            return out
        starts, ends, word = parts(spans.data, starts, ends)
        doc = doc[word]
        keys, first, back = np.unique(spans.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_WORDS:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            s, e = starts[first[new]], ends[first[new]]
            logs = np.zeros((len(new), self.p.shape[1]), np.float32)
            for n, at in by_length(s, e):
                logs[at] = np.log(np.maximum(forward(lattice(self.v, spans, s[at], n), self.p)[-1], 1e-300))
            place = np.searchsorted(self.keys, keys[new])
            self.keys, self.logs = np.insert(self.keys, place, keys[new]), np.insert(self.logs, place, logs, axis=0)
            place = np.searchsorted(self.keys, keys)
        logs = self.logs[place][back]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(doc, logs[:, k], minlength=len(out))
        return out


def fit(docs: DataFrame, vocabulary_path: str, per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """docs(doc_id, text, lang) -> languages and piece probabilities (pieces x languages)."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, 0))
    v = vocabulary(vocabulary_path)
    share = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, per_language / counts[name])))])
    sample = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            for first, last, data, offsets in slices(lowered(batch.column(1))):
                spans = Spans(_SPACED[data], offsets, lower=False)
                starts, ends, doc = spans.words()
                if not len(starts):
                    continue
                starts, ends, word = parts(spans.data, starts, ends)
                lang = np.searchsorted(langs, names[first:last])[doc[word]]
                h = spans.hashes(starts, ends)
                _, at, n = np.unique(h * np.uint64(2 * len(langs) + 1) + lang.astype(np.uint64), return_index=True, return_counts=True)
                raw = spans.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(lang[at], pa.int32()), pa.array([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    words = sample.select("lang", "text").mapInArrow(count, "lang int, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut(words, "words")
    p = np.full((v.size, len(langs)), 1 / v.size)

    def expect(p: np.ndarray):
        p = np.vstack((p, np.zeros((1, p.shape[1]))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocabulary(vocabulary_path)
            total = np.zeros(p.shape)
            for batch in batches:
                lang, n = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                words = batch.column(1).cast(pa.large_binary())
                offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
                data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
                offsets = offsets - offsets[0]
                spans = Spans(data, offsets, lower=False)
                for size, at in by_length(offsets[:-1], offsets[1:]):
                    ids = lattice(v, spans, offsets[at], size)
                    own = lang[at]
                    q = lambda x: p[x, own]  # noqa: B023, E731
                    alpha, beta = [np.ones(len(at))], [np.ones(len(at))]
                    for row in ids:
                        alpha.append(sum(alpha[-k] * q(x) for k, x in enumerate(row, 1)))
                    for j in range(size - 1, -1, -1):
                        beta.append(sum(beta[-k] * q(ids[j + k - 1][k - 1]) for k in range(1, min(size - j, v.longest) + 1)))
                    beta = beta[::-1]
                    weight = n[at] / np.maximum(alpha[-1], 1e-300)
                    for j, row in enumerate(ids, 1):
                        for k, x in enumerate(row, 1):
                            np.add.at(total, (x, own), alpha[j - k] * q(x) * beta[j] * weight)
            x, k = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(k, pa.int32()), pa.array(total[x, k])], names=["piece", "lang", "n"])

        return run

    for _ in range(rounds):
        sums = words.mapInArrow(expect(p), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        rows = sums.toArrow()  # at most the vocabulary's size for each language
        new = np.full(p.shape, SMOOTH)
        np.add.at(new, (np.asarray(rows["piece"]), np.asarray(rows["lang"])), np.asarray(rows["n"]))
        p = new / new.sum(0)
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary_path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score (the posterior of the best language, all equally likely before)."""
    weights = docs.sparkSession.sparkContext.broadcast(p.astype(np.float64))  # vocabulary x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary_path, weights.value) if langs else None
        for batch in batches:
            texts = batch.column(2)
            for first, last, data, offsets in slices(lowered(texts)):
                some = texts[first:last].to_pylist()
                letter = np.array([bool(t and _LETTER.search(t)) for t in some])
                if scorer:
                    logs = scorer.texts(data, offsets)
                    best = logs.argmax(1)
                    odds = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                else:
                    odds, names = np.zeros(len(some)), ["und"] * len(some)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(names), pa.array(np.where(letter, odds, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, *fit(docs, path), path)
