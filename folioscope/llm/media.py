"""Media columns: Netpbm and BMP to arrays, area resizing, NPY tiles, difference hashes.

Decoders read PBM, PGM and PPM (plain and raw, 8 and 16 bits, comments), and
uncompressed BMP with 1, 4, 8, 24 or 32 bits a pixel, bottom-up or top-down.
Resizing averages each target cell over its exact area of source pixels, taken
from an integral image; tiles are stored as NPY arrays one after the other.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import stored, table

#: Rows and columns of a tile.
TILE = 1024
#: Width in samples of the images that hold payloads.
WIDTH = 64
TILED = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decode_netpbm(data: bytes) -> np.ndarray:
    """Height x width (x 3) samples: uint8, or uint16 if the largest value is over 255."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bits = kind in (b"P1", b"P4")
    while len(fields) < (2 if bits else 3):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields[0], fields[1], 1 if bits else fields[2]
    deep = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * deep
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        words = [bytes([c]) for c in body if c in b"01"] if bits else body.split()
        flat = np.array(words[:n], dtype="S8").astype(np.int64)
    elif bits:
        row = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        flat = np.unpackbits(raw, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("Netpbm image is cut off")
    out = flat.astype(np.uint16 if top > 255 else np.uint8).reshape((height, width, 3) if deep == 3 else (height, width))
    return (1 - out) * np.uint8(255) if bits else out


def decode_bmp(data: bytes) -> np.ndarray:
    """Height x width (x 3, red first) samples of an uncompressed BMP, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
        packed, used, entry = 0, 0, 3
    else:
        width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or (packed == 3 and depth != 32):
        raise ValueError("unsupported BMP image")
    row = (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if depth >= 24:
        out = raw[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    else:
        if depth == 8:
            index = raw[:, :width]
        elif depth == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(abs(height), -1)[:, :width]
        else:
            index = np.unpackbits(raw, axis=1)[:, :width]
        n = used or 1 << depth
        palette = np.frombuffer(data, np.uint8, n * entry, 14 + head).reshape(n, entry)[:, 2::-1]
        out = palette[np.minimum(index, n - 1)]
    return np.ascontiguousarray(out if height < 0 else out[::-1])


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Raw 8-bit PGM of a height x width array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


#: Samples of which the integral image is held at once.
STRIPE = 1 << 20


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell over its area (fractions of pixels included), as float64."""
    if image.size == 0:
        return np.zeros((height, width, *image.shape[2:]))

    def along(x: np.ndarray, n: int) -> np.ndarray:
        edge = np.arange(n + 1) * (x.shape[0] / n)
        low = np.minimum(edge.astype(np.int64), x.shape[0])
        # The integral image is only kept at the edges, so a long image costs a stripe of it.
        at, sums = np.zeros((n + 1, *x.shape[1:])), np.zeros(x.shape[1:])
        step = max(1, STRIPE // max(1, int(np.prod(x.shape[1:]))))
        for start in range(0, x.shape[0], step):
            integral = sums + np.cumsum(x[start : start + step], axis=0, dtype=np.float64)
            here = (low > start) & (low <= start + len(integral))
            at[here] = integral[low[here] - 1 - start]
            sums = integral[-1]
        inside = low < x.shape[0]
        at[inside] += (edge - low)[inside].reshape(-1, *[1] * (x.ndim - 1)) * x[low[inside]]
        return np.diff(at, axis=0) / (x.shape[0] / n)

    return np.swapaxes(along(np.swapaxes(along(image, height), 0, 1), width), 0, 1)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """side*side bits in hex: is each cell darker than the next one to its right?"""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    small = np.round(area_resize(grey, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def write_tiles(image: np.ndarray, tile: int = TILE) -> bytes:
    """NPY arrays of at most tile x tile samples, by rows of tiles, one after the other;
    the first array holds the image's shape and the tile size."""
    out = io.BytesIO()
    np.save(out, np.array([*image.shape, tile], np.int64))
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            np.save(out, np.ascontiguousarray(image[y : y + tile, x : x + tile]))
    return out.getvalue()


def read_tiles(data: bytes) -> np.ndarray:
    source = io.BytesIO(data)
    *shape, tile = np.load(source).tolist()
    rows = []
    for _ in range(0, shape[0], tile):
        rows.append(np.concatenate([np.load(source) for _ in range(0, shape[1], tile)], axis=1))
    return np.concatenate(rows) if rows else np.zeros(shape, np.uint8)


def media_features(data: bytes) -> dict:
    """Shape, difference hash, size and SHA-256 of a stored media column value."""
    image = read_tiles(data)
    return {"image": image, "feature": difference_hash(image), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}


def store_images(df: DataFrame, image_col: str = "content", id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """Decodes a column of Netpbm or BMP files and stores NPY tiles: doc_id, media.

    Null and undecodable images give a null ``media``; other columns are left out.
    """

    def run(batches):
        for b in batches:
            media = []
            for data in b.column(1):
                try:
                    media.append(write_tiles(decode_image(data.as_py()), tile) if data.is_valid else None)
                except (ValueError, struct.error, IndexError):
                    media.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{image_col}` as binary) content").mapInArrow(run, "doc_id long, media binary")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as the
    samples of a PGM image 64 wide, decoded and stored as NPY tiles: doc_id, n_bytes, media.

    Null counts as empty; null ids stay null; repeated rows give repeated rows; an
    empty table gives no rows; other columns are left out. Texts of any length are
    stored whole, at about their own size. The table is written to the shared
    folder and read from there.
    """

    def run(batches):
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                rows = max(1, -(-len(raw) // WIDTH))
                sizes.append(len(raw))
                samples = np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
                media.append(write_tiles(decode_image(encode_pgm(samples))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return stored(docs.mapInArrow(run, TILED), "media")


def text_features(media: DataFrame) -> DataFrame:
    """Digests and the difference hash of stored texts, from the stored bytes alone."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(2):
                data = data.as_py()
                found = media_features(data)
                payload = found["image"].tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), found["media_bytes"], found["media_sha256"], found["feature"]))
            c = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.string())],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, SCHEMA)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_features(store_texts(table(spark, sf_dir, "documents")))
