"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area, stored as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tiles are TILE x TILE samples; a payload is a whole number of them.
TILE = 24
TILE_BYTES = TILE * TILE
PAD = b"\xff"
HASH_ROWS, HASH_COLUMNS = 8, 9
#: Tiles that are resized at a time.
TILES_AT_ONCE = 2048


def _netpbm_header(data: bytes, numbers: int) -> tuple[list[int], int]:
    """The header's numbers, comments skipped, and where the samples begin."""
    found: list[int] = []
    at = 2
    while len(found) < numbers:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.index(b"\n", at) if data[at : at + 1] == b"#" else at) + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("not a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: rows x columns, or rows x columns x 3. Bitmaps become 0 and 255 (white)."""
    kind = data[1] - 48 if data[:1] == b"P" and len(data) > 2 else 0
    if not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    bitmap, depth = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    n = width * height * depth
    if kind == 4:
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind == 1:
        bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01")[:n], np.uint8) - 48
        return np.where(bits, 0, 255).astype(np.uint8).reshape(height, width)
    wide = numbers[2] > 255
    if kind in (2, 3):
        samples = np.array(data[at:].split()[:n], dtype=np.int64).astype(np.uint16 if wide else np.uint8)
    else:
        samples = np.frombuffer(data, ">u2" if wide else np.uint8, n, at)
    return samples.reshape((height, width) if depth == 1 else (height, width, 3))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, 24 or 32 bits: rows x columns x 3, red first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits and compression {packing}")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A grey image as BMP of 8 bits."""
    height, width = samples.shape
    row = (width + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette.tobytes() + rows.tobytes()


def area_resize(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each cell of a height x width grid laid on each image of the stack, cells cutting samples in part.

    An integral image holds the sums of all samples above and to the left; between its points it is linear. Only
    its rows at the edges of the grid are made: the sums of the samples between them, without a copy of the image.
    """
    n, rows, columns = stack.shape

    def edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * size / cells
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    low, part = edges(rows, height)
    above, at, strips = np.zeros((n, columns), np.int64), 0, []
    for i, p in zip(low.tolist(), part.tolist(), strict=True):
        above = above + stack[:, at:i].sum(axis=1, dtype=np.int64)
        at = i
        strips.append(above + stack[:, i] * p)
    whole = np.zeros((n, height + 1, columns + 1))
    np.cumsum(np.stack(strips, axis=1), axis=2, out=whole[:, :, 1:])
    low, part = edges(columns, width)
    sums = np.take(whole, low, 2) * (1 - part) + np.take(whole, low + 1, 2) * part
    cells = np.diff(np.diff(sums, axis=1), axis=2)
    return cells / (rows / height * columns / width)


def difference_hashes(stack: np.ndarray) -> np.ndarray:
    """64 bits for each image: whether each cell of an 8 x 9 grid is darker than the next one to its right."""
    small = np.round(area_resize(stack, HASH_ROWS, HASH_COLUMNS), 6)
    bits = (small[:, :, :-1] < small[:, :, 1:]).reshape(len(stack), -1)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def payload_of(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of a tile."""
    tiles = max(1, -(-len(text) // TILE_BYTES))
    return text + PAD * (tiles * TILE_BYTES - len(text))


def store(image: np.ndarray) -> bytes:
    """A grey image of TILE columns as an NPY file of tiles: tiles x TILE x TILE."""
    out = io.BytesIO()
    np.save(out, image.reshape(-1, TILE, TILE), allow_pickle=False)
    return out.getvalue()


def load(media: bytes) -> np.ndarray:
    return np.load(io.BytesIO(media), allow_pickle=False)


def feature(tiles: np.ndarray) -> str:
    """The difference hash of the whole image, and a checksum of its tiles' difference hashes."""
    whole = difference_hashes(tiles.reshape(1, -1, TILE))[0]
    check = 0
    for i in range(0, len(tiles), TILES_AT_ONCE):
        check = zlib.crc32(difference_hashes(tiles[i : i + TILES_AT_ONCE]).astype(">u8").tobytes(), check)
    return f"{whole:016x}:{check:08x}"


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = batch.column("whole")
        for a, b in common.sliced(whole, lambda x: len(x.as_buffer())):
            media, sizes = [], []
            for text in whole.slice(a, b - a):
                data = text.as_py()
                payload = payload_of(data)
                picture = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, TILE))
                media.append(store(decode_image(picture)))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's payload as an NPY file, written to the shared folder and read again.

    Null text is empty and has one tile of padding. Null doc_ids and repeated rows are stored like others.
    Empty table: empty result. Other columns aren't read.
    """
    common.require(docs, doc_id="bigint", **{text: "string"})
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_or_empty(text).cast("binary").alias("whole"))
    path = common.scratch(spark, "media")
    stored = common.in_python(rows, _store_batches, "doc_id bigint, n_bytes bigint, media binary")
    stored.write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id bigint, n_bytes bigint, media binary").parquet(path)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            media = media.as_py()
            tiles = load(media)
            payload = tiles.tobytes()
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(tiles))
            )
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored bytes give when read back: sizes, digests and the feature."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return common.in_python(stored, _feature_batches, schema)
