"""SentencePiece encoding and decoding with the tokenizers library as the engine.

The model's protobuf is read by its wire format; normaliser, metaspace marker, pieces, scores and byte fallback are rebuilt
as a tokenizers pipeline (unigram models by their scores, BPE models by merges that follow from the scores). Batches are
encoded by `threads` threads. Ids are held against the sentencepiece library, every distinct piece of text (`parity`).

Most text is repetition: where the model allows it (no character map, no piece with a marker inside), texts are cut before
spaces and around characters that no longer piece holds, and each distinct piece of text is encoded once a worker. Other
models encode whole texts.

A null text counts as empty: no ids, decoded to an empty text. Extra columns are kept unless they bear an output's name.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import slices
from tessella.llm.token_codes import MOST_PIECES, PieceEncoder

MARK = "▁"
#: Threads of the library in a Python worker.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


# --- the model file --------------------------------------------------------------------------------------------------

def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + n]
        at += n


class Model:
    """What encoding needs of a sentencepiece model: pieces (text, score, kind) and the settings of trainer and normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                if kind == UNKNOWN:
                    self.unk = len(self.pieces)
                self.pieces.append((text, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.remove_extra = bool(v)
                    elif n == 5:
                        self.escape = bool(v)

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece from two others, best score first."""
        ids = {t: i for i, (t, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        found = []
        for text, i in ids.items():
            parts = [(ids[text[:k]], ids[text[k:]], text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in ids and text[k:] in ids]
            found += [(-self.pieces[i][1], i, *p) for p in sorted(parts)]
        return [x[4:] for x in sorted(found)]

    def tokenizer(self, prefix: bool = True):
        """The tokenizers pipeline. prefix=False leaves out the marker before the text (for parts of a text)."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            core = models.Unigram([(t, s) for t, s, _ in self.pieces], self.unk, self.byte_fallback)
        elif self.kind == BPE:
            core = models.BPE({t: i for i, (t, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are encoded")
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t = Tokenizer(core)
        t.normalizer = normalizers.Sequence(steps)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix])
        return t

    def parts_apart(self) -> bool:
        """Whether ids of a text are those of its parts, cut before spaces."""
        return not self.charsmap and not self.remove_extra and self.escape and self.kind == BPE and not any(kind == USER or any(a != MARK and b == MARK for a, b in zip(t, t[1:], strict=False)) for t, _, kind in self.pieces)


class Engine:
    def __init__(self, path: str, threads: int, verify: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.apart = self.model.parts_apart()
        self.core = self.model.tokenizer(prefix=not self.apart)
        self.sp = None
        if verify:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        longer = {c for t, _, kind in self.model.pieces if kind == NORMAL and len(t) > 1 for c in t}
        single = np.zeros(256, bool)
        single[[c for c in range(128) if chr(c) not in longer and c != 0x20]] = True

        def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81) | single[data[1:]] | single[data[:-1]]
            cut[offsets[:-1]] = True
            cut[offsets[1:] - 1] = True
            return np.flatnonzero(cut[:-1])

        self.threads, self.apart_at_line_end = threads, bool(single[0x0A])
        self.wrong: set[str] = set()
        self.lost: set[str] = set()  # parts that the library doesn't decode to themselves
        self.pieces = PieceEncoder(self.encode_parts, starts, MOST_PIECES // 2)  # beside two libraries' models
        raw = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else t.replace(MARK, " ").encode() for t, _, kind in self.model.pieces]
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @functools.cached_property
    def whole(self):
        """The pipeline for whole texts; encoding by parts doesn't need it."""
        return self.model.tokenizer() if self.apart else self.core

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        found = [x.ids for i in range(0, len(parts), 1024) for x in self.core.encode_batch_fast(parts[i : i + 1024], add_special_tokens=False)]
        if self.sp and self.apart:  # the library puts the marker itself
            # a part that begins with a space is a text without it; any other follows a line end, which no longer piece holds
            led = [i for i, p in enumerate(parts) if p[0] == " " and len(p) > 1]
            for i, ids in zip(led, self.sp.encode([parts[i][1:] for i in led], num_threads=self.threads), strict=True):
                if ids != found[i]:
                    self.wrong.add(parts[i])
            if self.apart_at_line_end:
                rest, lead = [i for i, p in enumerate(parts) if p[0] != " " or len(p) == 1], self.sp.encode("\n")
                for i, ids in zip(rest, self.sp.encode(["\n" + parts[i] for i in rest], num_threads=self.threads), strict=True):
                    if ids != lead + found[i]:
                        self.wrong.add(parts[i])
        if self.apart:
            skip = 1 if self.model.dummy_prefix else 0
            for i in range(0, len(parts), 1024):
                back = self.core.decode_batch(found[i : i + 1024], skip_special_tokens=False)
                # (the table itself shows that a marker in a text is lost)
                self.lost.update(p for p, b in zip(parts[i : i + 1024], back, strict=True) if b != (p[skip:] if p[0] == " " else p) and MARK not in p)
        return found

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bool]]]:
        """first, last, ids, where each text's ids start, parity."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.apart:
            for first in range(0, len(texts), 256):
                some = texts[first : first + 256].to_pylist()
                ids = [x.ids for x in self.core.encode_batch_fast(some, add_special_tokens=False)]
                ok = [a == b for a, b in zip(ids, self.sp.encode(some, num_threads=self.threads), strict=True)] if self.sp else [True] * len(some)
                yield first, first + len(some), np.array([i for x in ids for i in x], np.uint32), np.cumsum([0, *map(len, ids)]), ok
            return
        if self.model.dummy_prefix:
            empty = pc.equal(pc.binary_length(texts), 0)
            texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        for first, last, data, offsets in slices(texts):
            ids, upto = self.pieces(data, offsets)
            ok = [True] * (last - first)
            if self.wrong:
                raw = data.tobytes()
                ok = [not any(w.encode() in raw[a:b] for w in self.wrong) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield first, last, ids, upto, ok

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> list[str]:
        n = self.length[ids]
        at = np.concatenate(([0], np.cumsum(n)))
        where = np.repeat(self.place[ids] - at[:-1], n) + np.arange(at[-1])
        raw, ends = self.bytes[where].tobytes(), at[upto]
        skip = 1 if self.model.dummy_prefix else 0
        return [raw[a + (skip if raw[a : a + 1] == b" " and b > a else 0) : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_ENGINES: dict = {}


def engine(path: str, threads: int = 1, verify: bool = True) -> Engine:
    key = (path, threads, verify)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(*key)
    return _ENGINES[key]


# --- operators -------------------------------------------------------------------------------------------------------

def encode(docs: DataFrame, model_path: str, threads: int = THREADS, verify: bool = True, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """docs(text, ...) -> the kept columns, n_tokens, ids_crc32, parity, round_trip and (ids=True) ids array<int>.

    parity: every part of the text has the same ids in the sentencepiece library.
    round_trip: the ids decode to the text by the table of pieces' bytes, and where texts are encoded by parts the library
    decodes each of the text's parts to itself (a normalising model may differ). Repeated rows are each encoded.
    """
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("parity"), F.lit(True).alias("round_trip"), *[F.lit(None).cast("array<int>").alias("ids")] * ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(model_path, threads, verify)
        for batch in batches:
            kept, texts = batch.select(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)
            for first, last, found, upto, ok in e.encode(texts):
                raw = memoryview(found.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                back = pa.array(e.decode(found, upto), pa.large_string())
                whole = pc.fill_null(texts[first:last].cast(pa.large_string()), "")
                same = pc.equal(back, whole)
                if e.lost:
                    same = pa.array([x and not any(p in " " + t for p in e.lost) for x, t in zip(same.to_pylist(), whole.to_pylist(), strict=True)], pa.bool_())
                out = [*kept.slice(first, last - first).columns, pa.array(np.diff(upto), pa.int64()), pa.array(sums, pa.int64()), pa.array(ok, pa.bool_()), same]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df(ids array<int>, ...) -> the kept columns and text, decoded by the library. A null or empty array gives an empty text."""
    schema = df.select(*keep, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(model_path, THREADS, False)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = pa.array([x for i in range(0, len(lists), 256) for x in e.whole.decode_batch([y or [] for y in lists[i : i + 256].to_pylist()], skip_special_tokens=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[f.name for f in schema])

    return df.select(*keep, F.col("ids").alias("_ids")).mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
