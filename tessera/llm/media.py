"""Media columns: Netpbm and BMP images, area-resized tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, samples of one or two bytes)
and uncompressed BMP (1, 4, 8, 16, 24 and 32 bits, with channel masks) into numpy
arrays of the samples as they are stored; ``resize``
averages areas by an integral image, exactly, also at fractional edges;
``tiles`` adds to a table of images an NPY tile and a difference hash each.

Defined results: null or undecodable images (among them run-length BMPs and
samples above the stated maximum) give null shape, tile and hash, and the reason
in ``error``; null text is empty; texts of any length are one image each;
repeated rows give repeated results; a key that is named like a result column
comes back with ``_in`` appended, other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_columns, texts_of

TILE = 8
#: Samples a row of a text stored as an image.
WIDTH = 64


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers after the magic, and where the samples start."""
    at, found = 2, []
    while len(found) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[start:at]))
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3); uint8, or uint16 above a maximum of 255."""
    kind = data[:2]
    bits = kind in (b"P1", b"P4")
    numbers, at = _header(data, 2 if bits else 3)
    width, height = numbers[:2]
    most = 1 if bits else numbers[2]
    if not (width and height and 0 < most < 65536):
        raise ValueError("bad Netpbm size")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    if kind == b"P1":
        digits = bytes(c for c in data[at - 1 :] if c in b"01")
        flat = 1 - (np.frombuffer(digits[:count], np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[:count], dtype=np.int64)
    elif kind == b"P4":
        line = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, line * height, at).reshape(height, line)
        flat = 1 - np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    elif kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at)
    else:
        raise ValueError("not Netpbm")
    if len(flat) < count:
        raise ValueError("truncated")
    if count and flat.max() > most:
        raise ValueError("a sample above the maximum")
    if bits:
        return (flat.reshape(shape) * 255).astype(np.uint8)
    return flat.reshape(shape).astype(np.uint8 if most < 256 else np.uint16)


def masked(pixels: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """Channels cut out of whole pixels by their bit masks, scaled to bytes; an empty mask gives zeros."""
    out = np.zeros((*pixels.shape, len(masks)), np.uint8)
    for c, mask in enumerate(masks):
        if mask:
            shift = (mask & -mask).bit_length() - 1
            most = mask >> shift
            if most & (most + 1):
                raise ValueError("BMP mask with gaps")
            out[:, :, c] = (((pixels.astype(np.uint64) & np.uint64(mask)) >> np.uint64(shift)) * np.uint64(255) + np.uint64(most // 2)) // np.uint64(most)
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        width, height, _, bits, packing = *struct.unpack_from("<HHHH", data, 18), 0
    elif head >= 40:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    else:
        raise ValueError("unknown BMP header")
    if packing in (1, 2):
        raise ValueError("run-length BMP")
    if width <= 0 or height == 0 or bits not in {0: (1, 4, 8, 24) if head == 12 else (1, 4, 8, 16, 24, 32), 3: (16, 32), 6: (16, 32)}.get(packing, ()):
        raise ValueError("unsupported BMP")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, line * rows, start).reshape(rows, line)
    if height > 0:
        raw = raw[::-1]
    if bits == 16 or packing:
        masks = struct.unpack_from("<III", data, 54) if packing else (0x7C00, 0x3E0, 0x1F)
        return masked(raw[:, : width * bits // 8].copy().view(f"<u{bits // 8}"), masks)
    if bits >= 24:
        step = bits // 8
        return raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1].copy()
    used, entry = (1 << bits, 3) if head == 12 else (struct.unpack_from("<I", data, 46)[0] or 1 << bits, 4)
    palette = np.frombuffer(data, np.uint8, used * entry, 14 + head).reshape(used, entry)[:, 2::-1]
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1) * bits
    index = ((raw[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(rows, -1)[:, :width]
    out = palette[index]
    return out[:, :, 0].copy() if (palette[:, :1] == palette).all() else out


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit gray or 24-bit colour, bottom-up."""
    rows, width = image.shape[:2]
    gray = image.ndim == 2
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if gray else b""
    line = (width * (1 if gray else 3) + 3) // 4 * 4
    body = np.zeros((rows, line), np.uint8)
    flat = image if gray else image[:, :, ::-1].reshape(rows, -1)
    body[:, : flat.shape[1]] = flat
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, width, rows, 1, 8 if gray else 24, 0, body.size, 2835, 2835, 0, 0)
    return head + palette + body[::-1].tobytes()


def integral(plane: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the corner, with a row and column of zeros first; whole numbers of whole numbers."""
    out = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64 if plane.dtype.kind in "iu" else np.float64)
    np.cumsum(plane, axis=0, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def _edges(table: np.ndarray, size: int) -> np.ndarray:
    """``size`` times the integral image at ``size + 1`` even, possibly fractional rows."""
    whole, part = np.divmod(np.arange(size + 1) * (table.shape[0] - 1), size)
    part = part[:, None]
    return table[whole] * (size - part) + table[np.minimum(whole + 1, table.shape[0] - 1)] * part


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, in float64; of whole numbers, the nearest one."""
    if image.ndim == 3:
        return np.stack([resize(image[:, :, c], height, width) for c in range(image.shape[2])], axis=2)
    corners = _edges(_edges(integral(image), height).T, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) / (image.shape[0] * image.shape[1])


def gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: is a cell darker than its right neighbour, on a 8 x 9 reduction."""
    small = np.rint(resize(gray(image), 8, 9) * 1024)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(image, size, size)), 0, 255 if image.dtype == np.uint8 else 65535).astype(image.dtype, order="C"))
    return out.getvalue()


def tiles(images: DataFrame, column: str = "image", key: str = "id", size: int = TILE) -> DataFrame:
    """Per image: ``height, width, channels, tile`` (NPY bytes), ``feature`` (hash), ``error``."""
    kind = images.schema[key].dataType.simpleString()
    results = ("height", "width", "channels", "tile", "feature", "error")
    to = f"{key}_in" if key in results else key

    def make():
        def work(batch):
            cols = {n: [] for n in results}
            for data in batch.column(column).to_pylist():
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(bytes(data))
                    row = (image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], npy_tile(image, size), difference_hash(image), None)
                except (ValueError, IndexError, struct.error) as e:
                    row = (None, None, None, None, None, str(e))
                for name, value in zip(cols, row, strict=True):
                    cols[name].append(value)
            return cols | {to: batch.column(key)}

        return work

    return map_columns(images.select(*dict.fromkeys([key, column])), f"`{to}` {kind}, height int, width int, channels int, tile binary, feature string, error string", make)


def store_text(text: str) -> tuple[int, bytes]:
    """UTF-8 with zeros up to a positive multiple of 64 as a PGM of 64 columns; and its bytes before that."""
    raw = text.encode("utf-8", "surrogatepass")
    padded = max(WIDTH, (len(raw) + WIDTH - 1) // WIDTH * WIDTH)
    samples = np.frombuffer(raw.ljust(padded, b"\0"), np.uint8).reshape(-1, WIDTH)
    return len(raw), encode_pgm(samples)


def text_features(docs: DataFrame) -> DataFrame:
    def make():
        def work(batch):
            rows = []
            for text in texts_of(batch):
                n_bytes, media = store_text(text)
                image = decode(media)
                payload = image.tobytes()
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest()))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")
            return {n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)} | {"doc_id": batch.column("doc_id")}

        return work

    return map_columns(
        docs.select("doc_id", "text"),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string",
        make,
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
