"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the vocabulary: each line holds a token's bytes in base 64 and its rank, which is its id. Bytes map
to printable characters one by one for the library and back afterwards. Text is first cut by the pattern, and each
piece is encoded alone. Pieces never reach over a space that follows a visible character, so a text may be cut there
first; such chunks repeat, and each worker keeps a bounded memo of them. Decoding looks every id up in the
byte table and joins the bytes, so characters that were split over several tokens come back whole.

Defined edge cases: a null text encodes like the empty text (no ids, empty bytes); texts may be of any length and are
never cut; repeated rows give repeated, equal results; an empty table gives an empty result; further columns are not
carried; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

import public_tokenizers
from rankloom.llm.common import map_slices

RANKS = "byte_bpe_50k.tiktoken"
#: Entries of a worker's memo before it starts anew.
MEMO = 150_000
#: A space after white space, where cutting before the space could part a run of white space.
_RUN = regex.compile(r"\s ")


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Memo(dict):
    """What a function gives, kept until there is no room; then it starts anew."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = out = self.function(key)
        return out


class Ragged:
    """Byte strings of different lengths, joined by index without a loop."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.lengths = np.array([len(x) for x in rows], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, index: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(index), 1 << 16):  # blocks keep the working arrays in the cache
            part = index[at : at + (1 << 16)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            where = np.repeat(self.starts[part] - ends + lengths, lengths)
            where += np.arange(where.size)
            out.append(self.flat[where].tobytes())
        return b"".join(out)


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for raw, rank in self.ranks.items():
            self.table[rank] = raw
        chars = byte_characters()
        shown = {raw: "".join(chars[b] for b in raw) for raw in self.ranks}
        self.to_chars = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        # a merge for each split of a token into two tokens, in order of the rank of the result
        merges = [(shown[raw[:k]], shown[raw[k:]]) for raw in sorted(self.ranks, key=self.ranks.get) for k in range(1, len(raw)) if raw[:k] in self.ranks and raw[k:] in self.ranks]
        self.library = Tokenizer(models.BPE({shown[r]: i for r, i in self.ranks.items()}, merges, ignore_merges=True))
        self.tokenize = self.library.model.tokenize
        self.space = chars[32]
        self.known = Memo(self.encode_piece)
        self.chunks = Memo(lambda chunk: array("I", self.encode_chunk(" " + chunk)).tobytes())
        self.table_bytes = Ragged(self.table)
        self.decimals = [b"%d" % i for i in range(len(self.table))]
        self.rounds = Memo(lambda chunk: self._round(" " + chunk))
        self.pieces = regex.compile(pattern).findall

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, straight from the library's model."""
        shown = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.to_chars)
        return [t.id for t in self.tokenize(shown)]

    def encode_chunk(self, chunk: str) -> list[int]:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.encode_piece(chunk)
        known = self.known
        return [i for p in self.pieces(chunk) for i in known[p]]

    def _round(self, chunk: str) -> tuple[int, bytes, bytes]:
        """How many ids a chunk has, the ids in decimal, and the bytes that they decode to."""
        ids, table, decimals = self.encode_chunk(chunk), self.table, self.decimals
        return len(ids), b" ".join([decimals[i] for i in ids]), b"".join([table[i] for i in ids])

    def round_trip(self, text: str) -> tuple[int, bytes, bytes]:
        """For a whole text: the number of ids, the ids in decimal, joined by spaces, and their decoded bytes."""
        if not text:
            return 0, b"", b""
        if _RUN.search(text):
            return self._round(text)
        first, *rest = text.split(" ")
        rounds = self.rounds
        parts = [rounds[x] for x in rest]
        if first:
            parts.insert(0, self._round(first))
        counts, shown, decoded = zip(*parts)
        return sum(counts), b" ".join(shown), b"".join(decoded)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit integers."""
        if _RUN.search(text):
            return np.array(self.encode_chunk(text), np.uint32)
        first, *rest = text.split(" ")
        chunks = self.chunks
        return np.frombuffer(array("I", self.encode_chunk(first) if first else ()).tobytes() + b"".join([chunks[x] for x in rest]), np.uint32)

    def decode_bytes(self, ids) -> bytes:
        return self.table_bytes.join(np.asarray(ids, np.int64))

    def decode(self, ids, errors: str = "replace") -> str:
        return self.decode_bytes(ids).decode("utf-8", errors)

    def offsets(self, text: str, ids) -> np.ndarray:
        """(n, 2) character spans; a token that holds part of a character spans the whole of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        index = np.cumsum((raw & 0xC0) != 0x80)  # 1-based number of each byte's character
        ends = np.cumsum(self.table_bytes.lengths[np.asarray(ids, np.int64)])
        starts = ends - self.table_bytes.lengths[np.asarray(ids, np.int64)]
        return np.stack([index[starts] - 1, index[ends - 1]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


@functools.cache
def coder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_offsets: bool = False) -> DataFrame:
    """(key, ids array<int>[, starts array<int>, ends array<int>]): ids and, if wanted, character offsets of each token."""
    path = path or public_tokenizers.path(RANKS)
    more = ["starts", "ends"] if with_offsets else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        ids = [own.encode(x) for x in texts]
        columns = [batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
        if with_offsets:
            spans = [own.offsets(x, i) for x, i in zip(texts, ids)]
            columns += [pa.array([s[:, k].tolist() for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, [key, "ids", *more])

    return map_slices(df, [key, text], f"{key} {dict(df.dtypes)[key]}, ids array<int>" + "".join(f", {x} array<int>" for x in more), run)


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary, text string): the bytes of the ids, and the text with U+FFFD for bytes that are no UTF-8."""
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [coder(path).decode_bytes(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [key, "decoded", "text"])

    return map_slices(df, [key, ids], f"{key} {dict(df.dtypes)[key]}, decoded binary, text string", run)


def round_trip(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids, and digests both.

    ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the decoded bytes.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(path)
        counts, id_sums, sums = [], [], []
        for x in batch.column(1).to_pylist():
            count, shown, decoded = own.round_trip(x or "")
            counts.append(count)
            id_sums.append(hashlib.sha256(shown).hexdigest())
            sums.append(hashlib.sha256(decoded).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(sums, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(df, [key, text], f"{key} {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def op3(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
