"""Media columns: Netpbm and BMP decoded to numpy, area-resized, tiled, hashed."""

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

from quarrystone.llm.arrow import Rows, values


class MediaError(ValueError):
    """Bytes that are no image of a known form."""


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` numbers after the magic, comments skipped, and where they end."""
    found, at = [], 2
    while len(found) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 0x23):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 0x23 else at + 1
        end = at
        while end < len(data) and 0x30 <= data[end] <= 0x39:
            end += 1
        if end == at:
            raise MediaError("a Netpbm header breaks off")
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of (rows, columns) or (rows, columns, 3); bits are 0 for white turned to 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm magic")
    bits, plain = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3")
    head, at = _header(data, 2 if bits else 3)
    width, height, most = head[0], head[1], 1 if bits else head[2]
    if not (width and height and 0 < most < 65536):
        raise MediaError("a Netpbm header has no size")
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if channels == 3 else (height, width)
    n = width * height * channels
    dtype = np.dtype("u1") if most < 256 else np.dtype(">u2")
    if plain:
        body = b"\n".join(line.split(b"#", 1)[0] for line in data[at:].split(b"\n"))
        numbers = [c - 48 for c in body if c in b"01"] if bits else body.split()
        if len(numbers) < n:
            raise MediaError("samples are missing")
        out = np.array(numbers[:n], dtype=np.int64)
        if not bits and out.max(initial=0) > most:
            raise MediaError("a sample exceeds the maximum")
    elif bits:
        row = -(-width // 8)
        raw = np.frombuffer(data, "u1", offset=at + 1)
        if raw.size < row * height:
            raise MediaError("samples are missing")
        out = np.unpackbits(raw[: row * height].reshape(height, row), axis=1)[:, :width].ravel()
    else:
        if len(data) - at - 1 < n * dtype.itemsize:
            raise MediaError("samples are missing")
        out = np.frombuffer(data, dtype, n, at + 1)
    out = 1 - out if bits else out
    return out.reshape(shape).astype("u1" if most < 256 else "u2")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; gray palettes give (rows, columns), others RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("no BMP magic")
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if size < 40 or packing != 0 or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise MediaError("a BMP of this form is not read")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise MediaError("samples are missing")
    raw = np.frombuffer(data, "u1", stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1].copy()
    index = raw[:, :width] if depth == 8 else np.unpackbits(raw, axis=1)[:, : width * depth]
    if depth == 4:
        index = index.reshape(rows, width, 4) @ np.array([8, 4, 2, 1], "u1")
    palette = np.frombuffer(data, "u1", 4 * (colours or 1 << depth), 14 + size).reshape(-1, 4)[:, 2::-1]
    if index.max(initial=0) >= len(palette):
        raise MediaError("a sample is outside the palette")
    out = palette[index]
    return out[:, :, 0].copy() if (palette == palette[:, :1]).all() else out.copy()


def decode(data: bytes) -> np.ndarray:
    """The image in ``data``; MediaError, whatever is wrong with the bytes."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, OverflowError, struct.error) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit gray samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, "u1").tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit gray samples as BMP with a gray palette, the last row first."""
    rows, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((rows, stride), "u1")
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype="u1")[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area that each output sample covers, by an integral image.

    The integral is interpolated between samples, so fractional areas count
    exactly by their share; it also enlarges.
    """
    gray = image.astype("f8")
    if gray.ndim == 3:
        gray = gray @ np.array([0.299, 0.587, 0.114])
    h, w = gray.shape
    table = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, axis=0), axis=1, out=table[1:, 1:])
    y, x = np.linspace(0, h, rows + 1), np.linspace(0, w, columns + 1)
    j, i = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    by = (y - j)[:, None]
    lines = table[j] * (1 - by) + table[j + 1] * by
    bx = x - i
    at = lines[:, i] * (1 - bx) + lines[:, i + 1] * bx
    return np.diff(np.diff(at, axis=0), axis=1) / (h / rows * (w / columns))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Bits that say where brightness falls from a sample to its right neighbour, as hex."""
    small = np.round(area_resize(image, side, side + 1), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> Iterator[tuple[int, int, bytes, str]]:
    """(tile row, tile column, NPY bytes, difference hash) of each tile; edge tiles are smaller."""
    for top in range(0, image.shape[0], side):
        for left in range(0, image.shape[1], side):
            part = image[top : top + side, left : left + side]
            yield top // side, left // side, npy(part), difference_hash(part)


def decode_media(df: DataFrame, id_col: str, bytes_col: str, tile: int = 256, thumbnail: int = 32) -> DataFrame:
    """A row per tile of each image: id, width, height, tile_row, tile_column,
    npy, tile_dhash, dhash, and thumbnail_npy with the image's first tile.

    Null bytes and bytes of no known form give one row with ``error`` set and
    the rest null. Repeated rows are each decoded; an empty table gives none.
    """
    ddl = "id bigint, width int, height int, tile_row int, tile_column int, npy binary, tile_dhash string, dhash string, thumbnail_npy binary, error string"
    schema = pa.schema(
        [("id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("tile_row", pa.int32()), ("tile_column", pa.int32()), ("npy", pa.binary()),
         ("tile_dhash", pa.string()), ("dhash", pa.string()), ("thumbnail_npy", pa.binary()), ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for key, data in values(batches, "id", "data"):
            try:
                if data is None:
                    raise MediaError("null")
                image = decode(data)
                whole, small = difference_hash(image), npy(np.round(area_resize(image, thumbnail, thumbnail)).astype("u1" if image.dtype == "u1" else "u2"))
                for r, c, block, mark in tiles(image, tile):
                    rows.add(key, image.shape[1], image.shape[0], r, c, block, mark, whole, None if r or c else small, None, weight=len(block))
                    if rows.full():
                        yield rows.batch()
            except MediaError as e:
                rows.add(key, *[None] * 8, str(e))
        yield rows.batch()

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(bytes_col).alias("data")).mapInArrow(run, ddl)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, form: str = "pgm", width: int = 64, tile: int = 256, keep: bool = False) -> DataFrame:
    """Each whole text stored as an image, read back and described.

    The UTF-8 bytes, followed by bytes 0 up to a positive multiple of
    ``width``, are the 8-bit samples of an image ``width`` wide in the given
    ``form`` (pgm or bmp). All columns but n_bytes are computed from the image
    decoded from the stored bytes: payload_bytes, payload_sha256, tail_crc32
    (of the last ``width`` bytes), media_bytes, media_sha256 and ``feature``:
    size, difference hash, the digest of a 32 x 32 NPY thumbnail, and one over
    the place, NPY bytes and difference hash of every tile. ``keep`` adds
    the stored bytes as ``media``.

    A null text counts as empty and gives one row of samples 0; repeated rows
    give repeated results; other columns are not read.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
         ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *([("media", pa.binary())] if keep else [])]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for doc, text in values(batches, "doc_id", "text"):
            raw = (text or "").encode("utf-8", "surrogatepass")
            height = max(1, -(-len(raw) // width))
            media = encode(np.frombuffer(raw.ljust(height * width, b"\0"), "u1").reshape(height, width))
            image = decode(media)
            back = image.tobytes()
            thumbnail = npy(np.round(area_resize(image, 32, 32)).astype("u1"))
            cut = hashlib.sha256()
            for r, c, block, mark in tiles(image, tile):
                cut.update(b"%d %d %d %s\n" % (r, c, len(block), mark.encode()) + block)
            feature = f"{image.shape[1]}x{image.shape[0]}:{difference_hash(image)}:{hashlib.sha256(thumbnail).hexdigest()[:16]}:{cut.hexdigest()[:16]}"
            row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-width:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            rows.add(*row, *([media] if keep else []), weight=len(media) * keep)
            if rows.full():
                yield rows.batch()
        yield rows.batch()

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ddl + ", media binary" * keep)
