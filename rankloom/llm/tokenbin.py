"""Token ids in binary chunks: fixed-size blocks transposed into bit or byte planes, each plane compressed by zstandard.

Chunk format ("TPL1"), little-endian: magic, plane kind (1 byte: 1 bit planes, 4 byte planes), 3 zero bytes, number of
ids (u64), ids per block (u32), number of planes (u32), then for each plane the length of its compressed bytes (u64),
then those bytes. The ids are cut into blocks of a fixed size (the last is padded with zeros); within a block, plane p
holds bit p, or byte p, of every id; a plane stores its part of every block, one block after another.

A chunk holds whole documents, so a document can be read from its chunk alone; a chunk closes once it holds the wanted
number of ids. Chunks are rows of a Parquet data set, which gives atomic, retryable writes on any file system; the
chunk index (shard, chunk, ids before it in the shard, documents, start and number of ids of each) is stored beside the payload and can be read
without it. Shards are contiguous ranges of doc_id in ascending order.

Defined edge cases: a null text encodes like the empty one, to the end id alone; null doc_ids come first; repeated
doc_ids stand side by side, ordered by their text; an empty table gives an empty store; further columns are not
carried; ids must lie below 2**32.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from rankloom.llm.common import materialise, slices

MODEL = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18
MEMO = 500_000
_HEAD = struct.Struct("<4sB3xQII")


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK_IDS, level: int = 1) -> bytes:
    """One chunk of ids."""
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, "<u4")
    padded[: len(ids)] = ids
    if planes == "byte":
        table = padded.view(np.uint8).reshape(blocks * block, 4).T
        kind, count = 4, 4
    else:
        bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, block, 4), axis=2, bitorder="little")
        table = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(32, -1)
        kind, count = 1, 32
    squeeze = zstandard.ZstdCompressor(level=level).compress
    parts = [squeeze(np.ascontiguousarray(x).tobytes()) for x in table]
    return _HEAD.pack(b"TPL1", kind, len(ids), block, count) + struct.pack(f"<{count}Q", *map(len, parts)) + b"".join(parts)


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of one chunk."""
    magic, kind, total, block, count = _HEAD.unpack_from(chunk)
    if magic != b"TPL1":
        raise ValueError("no chunk of token planes")
    lengths = struct.unpack_from(f"<{count}Q", chunk, _HEAD.size)
    at, planes, grow = _HEAD.size + 8 * count, [], zstandard.ZstdDecompressor().decompress
    for n in lengths:
        planes.append(np.frombuffer(grow(chunk[at : at + n]), np.uint8))
        at += n
    if kind == 4:
        raw = np.ascontiguousarray(np.stack(planes, axis=1))
        return raw.reshape(-1).view("<u4")[:total]
    blocks = -(-total // block)
    bits = np.unpackbits(np.stack(planes).reshape(32, blocks, block // 8), axis=2, bitorder="little")
    raw = np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")[:total]


#: Punctuation that ends a word and makes a piece of its own after letters; an apostrophe may begin a contraction.
_TAIL = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27)


class WordBPE:
    """Ids of texts under the given tokenizer file; white space parts its input, so ids are kept by word.

    ASCII letters are lower-cased first, as the tokenizer's own normaliser does, except where a text holds "<|", as its
    special tokens do. Words of letters, and such with punctuation behind them, go straight to the library's model, all
    others through the whole tokenizer. The ids of words are kept in two parts of MEMO words: where the newer is full, it
    takes the older one's place, so words that come again are kept and those that came once go.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        self.to_chars = {b: chr(b if b in plain else next(spare)) for b in range(256)}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def letters(self, word: bytes) -> bytes | None:
        """The ids of a word that is one piece of letters beyond ASCII, or None."""
        text = unicodedata.normalize("NFC", word.decode()).lower()
        if not text.isalpha() or "σ" in text or "ς" in text:
            return None
        return array("I", [t.id for t in self.tokenize(text.encode().decode("latin-1").translate(self.to_chars))]).tobytes()

    def word(self, word: bytes) -> bytes:
        if word.isalpha():
            return array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
        head = word.rstrip(_TAIL)
        if head.isalpha():
            return self.get(head) + self.whole(word[len(head) :])
        if head and not word.isascii():
            out = self.letters(head)
            if out is not None:
                return out + self.whole(word[len(head) :]) if len(head) < len(word) else out
        return self.whole(word)

    @functools.lru_cache(50_000)
    def whole(self, word: bytes) -> bytes:
        return array("I", self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def get(self, word: bytes) -> bytes:
        out = self.known.get(word)
        if out is None:
            out = self.older.get(word)
            if out is None:
                out = self.word(word)
            if len(self.known) >= MEMO:
                self.known, self.older = {}, self.known
            self.known[word] = out
        return out

    def encode(self, text: str | bytes) -> bytes:
        """Little-endian unsigned 32-bit ids; bytes are UTF-8."""
        raw = text if isinstance(text, bytes) else text.encode()
        if b"<|" in raw:
            return array("I", self.library.encode(raw.decode(), add_special_tokens=False).ids).tobytes()
        words = raw.lower().split()
        parts = list(map(self.known.get, words))
        if None in parts:
            at, get = 0, self.get
            for _ in range(parts.count(None)):
                at = parts.index(None, at)
                parts[at] = get(words[at])
        return b"".join(parts)


@functools.cache
def coder(path: str) -> WordBPE:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBPE(path)


INDEX = "shard int, chunk int, before long, doc_ids array<long>, starts array<long>, counts array<long>, n_ids long"


def write_token_store(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, planes: str = "byte", chunk_ids: int = CHUNK_IDS, tag: str = "tokens") -> DataFrame:
    """Encode all texts in ascending order of the key and store them; returns the stored chunks (INDEX and payload)."""
    path = path or public_tokenizers.path(MODEL)
    end = b"" if end_id is None else array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = coder(path), TaskContext.get().partitionId()
        number, before, keys, counts, parts, size = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0, *counts[:-1]])
            payload = pack(np.frombuffer(b"".join(parts), "<u4"), planes)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            row = [shard, number, before, keys, starts.tolist(), counts, size, payload]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [*(x.split()[0] for x in INDEX.split(", ")), "payload"])

        for batch in batches:
            for part in slices(batch):
                for k, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    raw = own.encode(x or b"") + end
                    keys.append(k)
                    counts.append(len(raw) // 4)
                    parts.append(raw)
                    size += len(raw) // 4
                    if size >= chunk_ids:
                        yield close()
                        number, before, keys, counts, parts, size = number + 1, before + size, [], [], [], 0
        if keys:
            yield close()

    docs = df.select(F.col(key).cast("long").alias(key), text)
    ordered = docs.repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    return materialise(ordered.mapInArrow(run, f"{INDEX}, payload binary"), tag)


def read_token_store(store: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, read back from the stored chunks: doc_id, start, n_tokens, ids_crc32[, ids].

    start counts the ids of all documents before it. A chunk knows the ids before it in its shard; the number of ids of
    each shard comes from the chunk index: one row a shard reaches the driver and goes back to the executors, and there
    are as many shards as partitions of the writing job. The payload is read where it lies.
    """
    before, shards = 0, {}
    totals = store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    for row in sorted(totals, key=lambda r: r["shard"]):
        shards[row["shard"]] = before
        before += row["n"]
    bases = store.sparkSession.createDataFrame([(int(k), int(v)) for k, v in shards.items()], "shard int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, starts, counts, payload, first = (batch.column(i)[k].as_py() for i in range(5))
                ids = unpack(payload)
                cuts = [ids[s : s + n] for s, n in zip(starts, counts)]
                columns = [pa.array(keys, pa.int64()), pa.array([first + s for s in starts], pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in cuts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    joined = store.join(F.broadcast(bases), "shard").select("doc_ids", "starts", "counts", "payload", (F.col("base") + F.col("before")).alias("first"))
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op5(spark, sf_dir: str) -> DataFrame:
    return read_token_store(write_token_store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
