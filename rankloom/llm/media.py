"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized tiles, NPY bytes and difference hashes.

Images are uint8 arrays of shape (height, width) or (height, width, 3). A tile is the image shrunk (or stretched) by
exact area averaging, computed on an integral image that is interpolated at fractional cuts.

Defined edge cases: null or undecodable bytes give null features (``decode`` itself raises ValueError), and so do images
without pixels and samples above their maximum value; a null text
stores as the empty text, whose payload is 64 zero bytes; repeated rows give repeated, equal results; an empty table
gives an empty result; further columns of the input are not carried.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import map_slices, materialise

WIDTH = 64
_SPACE = rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])+"
_HEADER = re.compile(rb"(P[1-6])" + _SPACE + rb"(\d+)" + _SPACE + rb"(\d+)")
_MAXVAL = re.compile(_SPACE + rb"(\d+)")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """Bytes as a binary grey map with the given width; their number must be a multiple of it."""
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError("payload is no positive multiple of the width")
    return b"P5\n%d %d\n255\n" % (width, height) + payload


def encode_bmp(payload: bytes, width: int = WIDTH) -> bytes:
    """Bytes as an uncompressed 8-bit bitmap with a grey palette, top-down; the width must be a multiple of 4."""
    height, rest = divmod(len(payload), width)
    if rest or not height or width % 4:
        raise ValueError("payload is no positive multiple of the width")
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8)
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(payload), 0, 0, start, 40, width, -height, 1, 8, 0, len(payload), 0, 0, 256, 0)
    return head + palette.tobytes() + payload


ENCODERS = {"pgm": encode_pgm, "bmp": encode_bmp}


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, plain and raw; samples of other depths are scaled to 8 bits, bitmap ink (1) is black."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("no Netpbm header")
    kind, width, height = head[1], int(head[2]), int(head[3])
    at, top = head.end(), 1
    if kind not in (b"P1", b"P4"):
        depth = _MAXVAL.match(data, at)
        if not depth:
            raise ValueError("no maximum value")
        at, top = depth.end(), int(depth[1])
        if not 0 < top < 65536:
            raise ValueError("maximum value out of range")
    if not width or not height:
        raise ValueError("no pixels")
    bands = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * bands
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\r\n]*", b" ", data[at:])
        found = re.findall(rb"[01]", body) if kind == b"P1" else body.split(None, count)[:count]
        if any(len(x) > 9 or not x.isdigit() for x in found):
            raise ValueError("samples out of range")
        samples = np.array(found, "S9").astype(np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * height]
        if raw.size < stride * height:
            raise ValueError("truncated samples")
        samples = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(data) - at - 1 < count * wide.itemsize:
            raise ValueError("truncated samples")
        samples = np.frombuffer(data, wide, count, at + 1)
    if samples.size < count:
        raise ValueError("truncated samples")
    if samples.max() > top:
        raise ValueError("samples out of range")
    if kind in (b"P1", b"P4"):
        samples = (1 - samples) * 255
    elif top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    image = samples.astype(np.uint8, copy=False)
    return image.reshape(height, width, 3) if bands == 3 else image.reshape(height, width)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed Windows bitmaps of 1, 4, 8, 24 and 32 bits a pixel, bottom-up or top-down, as RGB (grey palettes as grey)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP header")
    word = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    start, info, width, height, bits, packed, used = word(10), word(14), word(18, signed=True), word(22, signed=True), word(28, 2), word(30), word(46)
    if packed != 0 or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise ValueError("truncated samples")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if bits >= 24:
        return np.ascontiguousarray(lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = lines[:, :width]
    else:
        split = np.unpackbits(lines, axis=1) if bits == 1 else np.stack([lines >> 4, lines & 15], axis=2).reshape(rows, -1)
        index = split[:, :width]
    colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + info).reshape(-1, 4)[:, 2::-1]
    if index.max(initial=0) >= len(colours):
        raise ValueError("palette index out of range")
    image = colours[index]
    grey = (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all()
    return np.ascontiguousarray(image[:, :, 0] if grey else image)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages as float64, from the integral image interpolated at the fractional edges of each output cell."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], height, width) for k in range(image.shape[2])], axis=2)
    rows, cols = image.shape
    # column sums come first and only the needed columns are summed down, so a tall image needs little memory
    along = np.zeros((rows, cols + 1), np.int64)
    np.cumsum(image, axis=1, out=along[:, 1:])
    part = _at(along.T, np.linspace(0, cols, width + 1)).T
    down = np.zeros((rows + 1, width + 1))
    np.cumsum(part, axis=0, out=down[1:])
    cuts = _at(down, np.linspace(0, rows, height + 1))
    return np.diff(np.diff(cuts, axis=0), axis=1) * (height * width / (rows * cols))


def _at(table: np.ndarray, where: np.ndarray) -> np.ndarray:
    low = np.minimum(where.astype(np.int64), table.shape[0] - 2)
    share = (where - low)[:, None]
    return table[low] * (1 - share) + table[low + 1] * share


def to_uint8(image: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(image + 0.5), 0, 255).astype(np.uint8)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else to_uint8(image @ np.array([0.299, 0.587, 0.114]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 neighbours in a 9-wide area thumbnail grows to the right."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def write_npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def features(data: bytes, side: int) -> tuple[bytes, str]:
    """NPY bytes of the side x side tile, and the difference hash."""
    image = decode(data)
    return write_npy(to_uint8(area_resize(image, side, side))), difference_hash(image)


def media_tiles(df: DataFrame, media: str = "media", key: str = "doc_id", side: int = 32) -> DataFrame:
    """(key, tile_npy binary, dhash string) for a binary column of Netpbm or BMP images."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tiles, hashes = [], []
        for x in batch.column(1).to_pylist():
            try:
                tile, code = features(x, side) if x is not None else (None, None)
            except ValueError:
                tile, code = None, None
            tiles.append(tile)
            hashes.append(code)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], [key, "tile_npy", "dhash"])

    return map_slices(df, [key, media], f"{key} {dict(df.dtypes)[key]}, tile_npy binary, dhash string", run)


def texts_as_media(df: DataFrame, key: str = "doc_id", text: str = "text", form: str = "pgm") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a grey image 64 wide."""
    encode = ENCODERS[form]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for x in batch.column(1).to_pylist():
            raw = (x or "").encode()
            sizes.append(len(raw))
            media.append(encode(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return map_slices(df, [key, text], f"{key} {dict(df.dtypes)[key]}, n_bytes long, media binary", run)


def media_digest(df: DataFrame, key: str = "doc_id", side: int = 32) -> DataFrame:
    """Digests, difference hash and NPY tile of a stored media table of ``texts_as_media``, all from the bytes that were read back."""
    schema = f"{key} {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile_npy binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(2).to_pylist():
            image = decode(data)
            payload = image.tobytes()
            tile = write_npy(to_uint8(area_resize(image, side, side)))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), tile))
        own = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(own, kinds))], [x.split()[0] for x in schema.split(", ")])

    return map_slices(df, [key, "n_bytes", "media"], schema, run)


def op2(spark, sf_dir: str) -> DataFrame:
    """The images and then their NPY tiles are stored; ``feature`` is the difference hash, a colon, and the CRC-32 of the stored tile in hex."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tiles = materialise(media_digest(materialise(texts_as_media(docs), "media")), "tiles")
    feature = F.concat_ws(":", "dhash", F.lower(F.lpad(F.hex(F.crc32("tile_npy")), 8, "0")))
    return tiles.withColumn("feature", feature).drop("dhash", "tile_npy")
