"""Media columns: binary payloads as Netpbm or BMP images, decoded to numpy arrays, tiles and difference hashes.

An image column holds whole files (P5, P6 or 24-bit BMP). Decoding gives an array of height x width x
channels; the tile is its area average on a small grid, by an integral image; the difference hash
compares neighbouring cells of a 9 x 8 grid. All of it runs in Arrow batches, one image at a time.
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

from .common import lean, pick

BLOCK = 576
WIDTH = 24


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """data and bytes 255 up to a positive multiple of block."""
    return data + b"\xff" * (-len(data) % block if data else block)


def encode(payload: bytes, kind: str, width: int = WIDTH) -> bytes:
    """A payload of whole rows as an image file: pgm (1 byte a pixel), ppm or bmp (3 bytes a pixel)."""
    if kind == "bmp":
        row = width * 3
        height, gap = len(payload) // row, -row % 4
        pixels = np.frombuffer(payload, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, row)
        body = np.pad(pixels, ((0, 0), (0, gap))).tobytes()
        head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
        return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
    channels = 1 if kind == "pgm" else 3
    return b"P%d\n%d %d\n255\n" % (5 if kind == "pgm" else 6, width, len(payload) // (width * channels)) + payload


def _netpbm_head(data: bytes) -> tuple[list[int], int]:
    """Width, height and largest value, comments left out; where the samples begin."""
    at, values = 2, []
    while len(values) < 3:
        while at < len(data) and data[at] in b" \t\r\n\v\f":
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and end - at < 10 and data[end] in b"0123456789":
            end += 1
        if end == at:
            raise ValueError("a Netpbm head that is cut off or has no number where one belongs")
        values.append(int(data[at:end]))
        at = end
    return values, at + 1


def decode(data: bytes) -> np.ndarray:
    """An image file as height x width x channels of uint8: P5 or P6 of 8 bits, or an uncompressed 24-bit BMP.

    What is none of these, or is cut off, is a ValueError.
    """
    if data[:2] in (b"P5", b"P6"):
        (width, height, top), at = _netpbm_head(data)
        channels = 1 if data[:2] == b"P5" else 3
        if not 0 < top < 256:
            raise ValueError("only 8-bit samples")
        return np.frombuffer(data, np.uint8, width * height * channels, at).reshape(height, width, channels)
    if data[:2] == b"BM":
        if len(data) < 54:
            raise ValueError("a BMP head that is cut off")
        at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<IiiHHI", data, 14)
        width, height, bits, packed = size[1], size[2], size[4], size[5]
        if bits != 24 or packed:
            raise ValueError("only uncompressed 24-bit BMP")
        row = (width * 3 + 3) // 4 * 4
        lines = np.frombuffer(data, np.uint8, row * abs(height), at).reshape(abs(height), row)[:, : width * 3]
        return (lines[::-1] if height > 0 else lines).reshape(abs(height), width, 3)[:, :, ::-1]
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of each cell of a height x width grid laid over the image's brightness, cells cut through pixels.

    The integral image holds sums over all rectangles from the corner; between its points it is bilinear,
    so each cell's sum is four reads, whatever its size.
    """
    grey = image.mean(axis=2)
    whole = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=whole[1:, 1:])

    def along(table: np.ndarray, n: int) -> np.ndarray:
        size = table.shape[0] - 1
        x = np.arange(n + 1) * size / n
        low = np.minimum(x.astype(int), size - 1)
        part = (x - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    sums = along(along(whole, height).T, width).T
    cells = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return cells / (grey.shape[0] / height * grey.shape[1] / width)


def npy_tile(image: np.ndarray, size: int = 16) -> bytes:
    """The area-resized image as an NPY file of size x size uint8."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, size, size) + 0.5).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is darker than its right neighbour."""
    cells = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


KINDS = ("pgm", "ppm", "bmp")


def kind_of(payload: bytes) -> str:
    """The format a payload is stored in: by its number of blocks, so equal payloads are stored alike."""
    return KINDS[len(payload) // BLOCK % len(KINDS)]


def to_media(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes, media: each text (null: empty) as UTF-8, padded, in an image file that holds it without loss.

    One row for each row, repeated ones too; a null id stays null; other columns are not read; an empty
    table gives an empty one.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = [b"" if t is None else t.encode("utf-8") for t in part.column("text").to_pylist()]
                media = [encode(p := pad(d), kind_of(p)) for d in data]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lean(store), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame, *, tile: int = 16) -> DataFrame:
    """id, n_bytes, the stored file's size and digest, the samples read back, the NPY tile and the difference hash.

    A null media value gives nulls; a value in none of the formats is an error, not a skipped row.
    """
    names = ["id", "n_bytes", "width", "height", "channels", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 10
        image = decode(data)
        payload = image.tobytes()
        height, width, channels = image.shape
        return (
            width, height, channels, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
            len(data), hashlib.sha256(data).hexdigest(), npy_tile(image, tile), difference_hash(image),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column("media").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            arrays = [batch.column("id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(lean(read), f"id {kind}, n_bytes long, width int, height int, channels int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")
