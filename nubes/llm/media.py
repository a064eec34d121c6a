"""Media columns: Netpbm (P1-P6) and BMP images decoded to numpy arrays,
area-resized with integral images, written as NPY tiles with difference hashes.

Rows are independent: no shuffle, and a task holds one Arrow batch. An image's
integral image is made once, in whole numbers of four bytes a sample (eight
beyond 16 million samples), and read at the borders of target cells only.
Defined cases: null or undecodable bytes give null outputs in ``media_tiles``;
in the document store a null text is empty, and an empty one becomes one
padding block; equal payloads give equal values; repeated rows and null ids are
stored row by row; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import each_text, map_texts

BLOCK, WIDTH, PAD = 576, 24, 255
TILE = 8


# ------------------------------------------------------------------ codecs


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header after the magic, and where its samples begin."""
    at, out = 2, []
    while len(out) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3) arrays; bitmaps give
    0 for black and 1 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, depth = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    nums, at = _header(data, 2 if bitmap else 3)
    w, h, top = nums[0], nums[1], 1 if bitmap else nums[2]
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise ValueError("bad Netpbm size")
    if kind == b"P1":
        digits = np.frombuffer(data[at - 1 :], np.uint8)
        x = digits[(digits == 48) | (digits == 49)][: w * h] - 48
    elif kind in (b"P2", b"P3"):
        x = np.array(data[at - 1 :].split()[: w * h * depth], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        x = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        x = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at)
    if len(x) != w * h * depth:
        raise ValueError("short Netpbm data")
    x = x.astype(np.uint8 if top < 256 else np.uint16)
    x = 1 - x if bitmap else x
    return x.reshape((h, w) if depth == 1 else (h, w, 3))


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3); 8-bit samples."""
    if image.dtype != np.uint8:
        raise ValueError("8-bit samples only")
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, w, h) + image.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel, bottom-up or top-down."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    begin, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), begin).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        n = used or 256
        palette = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(n, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    px = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return np.ascontiguousarray(px[:, :, 2::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of an (h, w, 3) array."""
    h, w = image.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- features


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each border, with a depth axis."""
    x = image if image.ndim == 3 else image[:, :, None]
    if x.dtype.kind == "f":
        wide = np.float64
    else:
        wide = np.uint32 if x.size * (int(np.iinfo(x.dtype).max) + 1) < 1 << 32 else np.uint64
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1, x.shape[2]), wide)
    np.cumsum(x, axis=0, out=total[1:, 1:])
    return np.cumsum(total, axis=1, out=total)


def resize_sums(total: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean of each target cell's exact area from an integral image, which is
    interpolated at the cells' fractional borders."""

    def along(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        size = a.shape[axis] - 1
        cut = np.arange(n + 1) * size / n
        lo = np.minimum(cut.astype(int), size - 1)
        part = (cut - lo).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
        return np.take(a, lo, axis) * (1 - part) + np.take(a, lo + 1, axis) * part

    cut = along(along(total, h, 0), w, 1)
    return np.diff(np.diff(cut, axis=0), axis=1) / (((total.shape[0] - 1) / h) * ((total.shape[1] - 1) / w))


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    out = resize_sums(integral(image), h, w)
    return out if image.ndim == 3 else out[:, :, 0]


LUMA = np.array([0.299, 0.587, 0.114])


def hash_sums(total: np.ndarray) -> str:
    """Difference hash from an integral image, 64 bits in hex: is each cell of a
    9 x 8 resize (colours: their luma) darker than the next?"""
    small = resize_sums(total, 8, 9)
    small = np.rint((small[:, :, 0] if small.shape[2] == 1 else small @ LUMA) * 16)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def difference_hash(image: np.ndarray) -> str:
    return hash_sums(integral(image))


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, h: int, w: int, tile: int = TILE, total: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes, str]]:
    """Area-resize to (h, w), cut in tiles: (row, column, NPY bytes, hash)."""
    small = np.rint(resize_sums(integral(image) if total is None else total, h, w)).astype(image.dtype)
    small = small if image.ndim == 3 else small[:, :, 0]
    for r in range(0, h, tile):
        for c in range(0, w, tile):
            t = small[r : r + tile, c : c + tile]
            yield r // tile, c // tile, npy_bytes(t), difference_hash(t)


def media_tiles(df: DataFrame, key: str, media: str, h: int = 32, w: int = 32, tile: int = TILE) -> DataFrame:
    """One row per tile of each image: key, ``tile_row``, ``tile_col``,
    ``npy`` (bytes) and ``dhash``; one row of nulls if it can't be decoded."""

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for k, m in zip(b.column(0), b.column(1), strict=True):
                try:
                    got = list(tiles(decode(m.as_py() or b""), h, w, tile))
                except (ValueError, IndexError, struct.error):
                    got = [(None, None, None, None)]
                keys += [k.as_py()] * len(got)
                rows += got
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=["key", "tile_row", "tile_col", "npy", "dhash"])

    kind = df.schema[key].dataType.simpleString()
    out = map_texts(df.select(key, media), run, f"key {kind}, tile_row int, tile_col int, npy binary, dhash string")
    return out.withColumnRenamed("key", key)


# ----------------------------------------------------------- document store


def to_media(text: bytes) -> bytes:
    """A text's bytes, padded to whole blocks, as the samples of a P5 image."""
    n = max(1, -(-len(text) // BLOCK)) * BLOCK
    return b"P5\n%d %d\n255\n" % (WIDTH, n // WIDTH) + text + bytes([PAD]) * (n - len(text))


SIDE = 16
STORED = "doc_id long, n_bytes long, media binary, dhash string, tiles array<struct<tile_row int, tile_col int, npy binary, dhash string>>"
TILES = pa.list_(pa.struct([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())]))


def documents_as_media(df: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, dhash, tiles``: each text stored losslessly as
    a PGM image, with the difference hash and the NPY tiles of the decoded image."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = []
                for raw in each_text(b.slice(at, 200)):
                    stored = to_media(raw.tobytes())
                    image = decode(stored)
                    total = integral(image)
                    own = [dict(zip(("tile_row", "tile_col", "npy", "dhash"), t, strict=True)) for t in tiles(image, SIDE, SIDE, total=total)]
                    rows.append((len(raw), stored, hash_sums(total), own))
                cols = zip(*rows, strict=True)
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.string(), TILES), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 200), *arrays], names=["doc_id", "n_bytes", "media", "dhash", "tiles"])

    return map_texts(df.select("doc_id", "text"), run, STORED)


def read_tile(npy: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(npy), allow_pickle=False)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(stored: DataFrame) -> DataFrame:
    """Read a stored table back; all is computed from the bytes as read: digests
    of payload and stored form, the length without padding (no UTF-8 text has
    the padding byte), and a feature made of the decoded image's difference hash
    and the sum of the decoded tiles."""

    def run(batches):
        for b in batches:
            rows = []
            for m, own in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                media = m.as_py()
                image = decode(media)
                payload = image.tobytes()
                tile_sum = zlib.crc32(b"".join(read_tile(t["npy"]).tobytes() for t in own))
                rows.append((len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}-{tile_sum:08x}"))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])

    return map_texts(stored.select("doc_id", "media", "tiles"), run, FEATURES)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write the documents' images, hashes and tiles as a table and read it back."""
    documents_as_media(df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(STORED).parquet(path)
