"""Token ids in directly addressable codes (DAC).

A block of ids is cut into levels of 8, 8 and 16 bits. Level 0 holds the low byte of every id and a bit that says whether the
id goes on; level 1 holds the next byte of those that do, and so on. A rank directory (the count of set bits before each
512-bit stretch) finds the place of an id in the next level, so that any token is read on its own, without decoding a block.

File format: one Parquet row a block (written by Spark's committer, so that a lost executor leaves no half file), with its
range (`part`), its place there (`seq`), the ids of the range before it (`before`), its documents in ascending doc_id order,
their id counts and the code as binary. Documents are dealt to ranges of doc_id (rows of one doc_id by hash of their texts).
Repeated rows are each encoded. A null text counts as empty and is the end id alone; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessella.llm.common import Spans, scratch_dir, slices

MAGIC = b"TDAC1\0\0\0"
WIDTHS = (8, 8, 16)
END_ID = 2
BLOCK_DOCS = 2048
#: Distinct pieces that a Python worker remembers; then it forgets them all and starts anew.
MOST_PIECES = 1_500_000


# --- codes -----------------------------------------------------------------------------------------------------------

def encode_block(ids: np.ndarray) -> bytes:
    """Ids below 2**32 as one code: magic, count, then for each level its count, values, continuation bits and ranks."""
    out, rest = [MAGIC, np.array([len(ids)], "<u8").tobytes()], np.asarray(ids, np.uint32)
    for width in WIDTHS:
        values = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width == 8 else "<u2")
        rest = rest >> np.uint32(width)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 64, np.uint8)))
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), 64)))[:-1])).astype("<u4") if len(bits) else np.zeros(0, "<u4")
        out += [np.array([len(values), len(bits), len(ranks)], "<u8").tobytes(), values.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more]
    return b"".join(out)


class Codes:
    """A reader of one block."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a block of token codes")
        self.n, at, self.levels = int(np.frombuffer(data, "<u8", 1, 8)[0]), 16, []
        for width in WIDTHS:
            n, bits, ranks = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
            at += 24
            level = []
            for kind, count in (("<u1" if width == 8 else "<u2", n), ("<u1", bits), ("<u4", ranks)):
                level.append(np.frombuffer(data, kind, count, at))
                at += level[-1].nbytes
            self.levels.append(level)

    def get(self, at: np.ndarray | int) -> np.ndarray:
        """The ids at these places, each by rank lookups alone."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such token")
        out, shift, place = np.zeros(len(at), np.uint32), 0, at.copy()
        live = np.arange(len(at))
        for width, (values, bits, ranks) in zip(WIDTHS, self.levels, strict=True):
            out[live] |= values[place].astype(np.uint32) << np.uint32(shift)
            shift += width
            on = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live, place = live[on], place[on]
            if not len(live):
                break
            before = ranks[place >> 9].astype(np.int64)
            start = (place >> 9) << 6
            words = bits[start[:, None] + np.arange(64)]
            inside = np.clip((place & 511)[:, None] - np.arange(0, 512, 8), 0, 8)
            words = words & ((1 << inside) - 1).astype(np.uint8)
            place = before + np.bitwise_count(words).sum(1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        out, shift, live = np.zeros(self.n, np.uint32), 0, None
        for width, (values, bits, _) in zip(WIDTHS, self.levels, strict=True):
            v = values.astype(np.uint32) << np.uint32(shift)
            if live is None:
                out |= v
            else:
                out[live] |= v
            shift += width
            on = np.flatnonzero(np.unpackbits(bits, count=len(values), bitorder="little"))
            live = on if live is None else live[on]
            if not len(live):
                break
        return out


# --- tokens ----------------------------------------------------------------------------------------------------------

def _kinds() -> np.ndarray:
    """0 space, 1 other white space, 2 letters, 3 digits, 4 signs, 5 all bytes that are never parted from their neighbours."""
    kind = np.full(256, 5, np.uint8)
    for c in range(0x21, 0x7F):
        x = chr(c)
        kind[c] = 2 if x.isalpha() else 3 if x.isdigit() else 4
    kind[ord("'")] = 5
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
    kind[0x20] = 0
    return kind


_KIND = _kinds()
#: White space beyond ASCII: last bytes of its UTF-8 forms (also of some letters, which are then left whole).
_WIDE_SPACE_END = np.isin(np.arange(256), [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places where a text may be cut without changing its byte-level BPE ids.

    The tokenizer cuts text into pieces first and merges bytes within one. A space joins the run after it, so a cut goes
    before white space that follows a sign, letter or digit; a cut also goes between ASCII letters, digits and signs (an
    apostrophe is left alone) and after a line end that stands alone. Each is a border of the tokenizer's own pieces.
    """
    k = _KIND[data]
    a, b = k[:-1], k[1:]
    to_space = (b <= 1) & (a >= 2) & ~_WIDE_SPACE_END[data[:-1]]
    change = (a != b) & (a >= 2) & (a <= 4) & (b >= 2) & (b <= 4)
    alone = np.zeros(len(a), bool)
    if len(a) > 1:
        alone[1:] = (a[1:] == 1) & (b[1:] >= 2) & (b[1:] <= 4) & (a[:-1] >= 2) & (a[:-1] <= 4)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = to_space | change | alone
    cut[offsets[:-1]] = True
    cut[offsets[1:] - 1] = True  # the line end that parts texts
    return np.flatnonzero(cut[:-1])


class PieceEncoder:
    """Ids of texts by way of their distinct pieces; the tokenizer sees each piece once as long as the worker remembers it."""

    def __init__(self, encode_many, starts_of, most: int = MOST_PIECES):
        self.encode_many, self.starts_of, self.most = encode_many, starts_of, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found = self.encode_many(pieces)
        size = np.fromiter(map(len, found), np.int32, len(found))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        at = self.used + np.cumsum(size) - size
        self.used += total
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts of a run, and where each text's ids start (one more than texts)."""
        starts = self.starts_of(data, offsets)
        ends = np.append(starts[1:], len(data))
        parting = np.isin(starts, offsets[1:] - 1)
        starts, ends = starts[~parting], ends[~parting]
        h = Spans(data, offsets, lower=False).hashes(starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self._learn(keys[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        size = self.size[place][back].astype(np.int64)
        at = self.at[place][back]
        upto = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(at - upto[:-1], size) + np.arange(upto[-1])
        return self.ids[where], upto[np.searchsorted(starts, offsets)]


def kept_whole(starts_of, strings: list[bytes]):
    """starts_of without the places inside one of these strings."""

    def run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, raw = starts_of(data, offsets), data.tobytes()
        inside = np.zeros(len(data) + 1, bool)
        for s in strings:
            at = raw.find(s)
            while at >= 0:
                inside[at + 1 : at + len(s)] = True
                at = raw.find(s, at + 1)
        return starts[~inside[starts]]

    return run


_ENCODERS: dict = {}


def _byte_encoder(path: str, added: bool) -> PieceEncoder:
    if (path, added) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        starts_of = piece_starts
        if added:
            tokens = tokenizer.get_added_tokens_decoder().values()
            if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
                raise ValueError("an added token that depends on what is beside it")
            starts_of = kept_whole(piece_starts, [t.content.encode() for t in tokens])
        else:
            tokenizer.encode_special_tokens = True

        def encode_many(pieces: list[str]) -> list[list[int]]:
            return [x.ids for i in range(0, len(pieces), 4096) for x in tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]

        _ENCODERS[path, added] = PieceEncoder(encode_many, starts_of)
    return _ENCODERS[path, added]


# --- files -----------------------------------------------------------------------------------------------------------

_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("code", pa.binary())])
BLOCK_TYPE = "part int, seq int, before long, doc_ids array<long>, counts array<long>, n_ids long, code binary"


def write_token_codes(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_docs: int = BLOCK_DOCS, added: bool = False) -> None:
    """Encode docs(doc_id, text) and write blocks in ascending doc_id order under path. Rows without a doc_id come first.

    With `added`, the string of one of the tokenizer's added tokens (<|endoftext|>) is that token, as the library has it by
    default; otherwise it is text like any other.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _byte_encoder(tokenizer_path, added)

        part, seq, before = TaskContext.get().partitionId(), 0, 0

        def block(doc_ids, counts, parts):
            nonlocal seq, before
            ids = np.concatenate(parts)
            seq, before = seq + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([before - len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_block(ids)], pa.binary())], schema=_BLOCK)

        doc_ids, counts, parts = [], [], []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, data, offsets in slices(batch.column(1)):
                ids, upto = encoder(data, offsets)
                ids = np.insert(ids, upto[1:], end_id).astype(np.uint32)
                doc_ids += names[first:last]
                counts += (np.diff(upto) + 1).tolist()
                parts.append(ids)
                if len(doc_ids) >= block_docs or sum(map(len, parts)) > 4_000_000:
                    yield block(doc_ids, counts, parts)
                    doc_ids, counts, parts = [], [], []
        if doc_ids:
            yield block(doc_ids, counts, parts)

    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(encode, BLOCK_TYPE).write.parquet(path)


def read_token_codes(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with `start`: the ids of all blocks before it. A block knows its place in its range, so only the ranges'
    totals (one row a range, as many as there were partitions) are summed up and sent to all; codes stay where they are."""
    blocks = spark.read.schema(BLOCK_TYPE).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    return blocks.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")


def token_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the codes."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, counts, code, start in zip(*(batch.column(c) for c in ("doc_ids", "counts", "code", "start")), strict=True):
                counts = np.asarray(counts.values.to_numpy(zero_copy_only=False), np.int64)
                raw = memoryview(Codes(code.as_py()).all().astype("<u4").tobytes())
                upto = np.concatenate(([0], np.cumsum(counts)))
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(start.as_py() + upto[:-1]), pa.array(counts), pa.array(sums, pa.int64())], schema=out)

    return blocks.select("doc_ids", "counts", "code", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_codes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_dir(spark)}/codes-{uuid.uuid4().hex}"
    write_token_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_digests(read_token_codes(spark, path))
