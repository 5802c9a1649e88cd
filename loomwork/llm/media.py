"""Media columns: Netpbm and BMP images to arrays, tiles and difference hashes.

``decode`` reads one image file's bytes to a numpy array of rows, columns and,
for colour, three channels. ``resize_area`` averages areas by the integral image,
exact also where borders of the areas fall inside pixels. A tile is the resized
grey image as an NPY file's bytes; its difference hash compares neighbours.

``store_netpbm`` puts any binary column into a lossless grey Netpbm image of 64
columns, padded with bytes 0 to a positive multiple of 64; that needs no Python.

Samples are scaled to the whole range of 8 bits, or of 16 where the maximum is
above 255. A bitmap or palette of greys alone gives a grey image.

``store_bmp`` does the same with an 8-bit grey BMP.

Defined results: null media give null in every output; bytes that are no whole
image of a supported format, whatever sizes and samples they claim, give null
pixels, tile and hash and an error text; so do samples above the maximum.
Equal bytes give equal results. Existing columns with an output's name are
replaced, others kept.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import prepare

COLUMNS = 64
TILE = 16
HASH_ROWS, HASH_COLUMNS = 8, 9
#: Rows of an image that the integral image holds at once.
STRIP = 4096

HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _fields(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(n):
        m = HEADER.match(data, at)
        if not m:
            raise ValueError("header ends early")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def _plain(body: bytes, kind: int, n: int, most: int) -> np.ndarray:
    """The first ``n`` samples written as text; bitmaps need no space between digits."""
    body = re.sub(rb"#[^\n]*", b"", body)
    words = re.findall(rb"[01]" if kind == 1 else rb"[0-9]+", body)[:n] if kind != 1 or not re.search(rb"[^01\s]", body) else []
    if len(words) < n or re.search(rb"[^0-9\s]", body):
        raise ValueError("samples end early or are no numbers")
    if max(map(len, words)) > 5 and any(len(w.lstrip(b"0")) > 5 for w in words):
        raise ValueError("sample above the maximum")
    return np.array([int(w) for w in words], dtype=np.int64)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: bitmaps (1 is black: 0 here), grey maps and colour maps, plain or raw."""
    kind = data[1] - 48
    (width, height), at = _fields(data, 2, 2)
    most = 1
    if kind not in (1, 4):
        (most,), at = _fields(data, at, 1)
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if n <= 0 or not 0 < most < 65536:
        raise ValueError("empty image")
    # the least bytes that so many samples take, before any memory is asked for
    row = (width + 7) // 8
    least = n if kind <= 3 else row * height if kind == 4 else n * (1 + (most > 255))
    if least > len(data) - at:
        raise ValueError("samples end early")
    if kind <= 3:
        values = _plain(data[at:], kind, n, most)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if kind in (1, 4):
        values = 255 * (1 - values.astype(np.int64))
    else:
        full = 255 if most < 256 else 65535
        if most < full:
            if int(values.max()) > most:
                raise ValueError("sample above the maximum")
            values = (values.astype(np.int64) * full + most // 2) // most
        elif kind <= 3 and int(values.max()) > most:
            raise ValueError("sample above the maximum")
    shape = (height, width, 3) if channels == 3 else (height, width)
    return values.astype(np.uint8 if most < 256 else np.uint16, copy=False).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 bits with a palette, or of 24 or 32 bits."""
    at, size = (int.from_bytes(data[k : k + 4], "little") for k in (10, 14))
    width, height = (int.from_bytes(data[k : k + 4], "little", signed=True) for k in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    used = int.from_bytes(data[46:50], "little")
    if packing or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP is not supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if at + rows * stride > len(data):
        raise ValueError("samples end early")
    body = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)
    if bits >= 24:
        image = body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        if used > 1 << bits:
            raise ValueError("the palette is too large")
        colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
        if (colours == colours[:, :1]).all():
            colours = np.ascontiguousarray(colours[:, 0])
        if bits == 1:
            index = np.unpackbits(body, axis=1)[:, :width]
        elif bits == 4:
            index = np.stack([body >> 4, body & 15], axis=2).reshape(rows, -1)[:, :width]
        else:
            index = body[:, :width]
        image = colours[index]
    return image if height < 0 else image[::-1]


def decode(data: bytes) -> np.ndarray:
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.float64) @ np.array([0.299, 0.587, 0.114]))


def resize_area(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each of ``rows`` x ``columns`` equal areas of a grey image.

    The integral image is made strip by strip; only the rows at the areas'
    borders are kept, so memory does not grow with the height.
    """
    height, width = image.shape
    whole = image.dtype.kind in "ui"
    ys, xs = np.linspace(0, height, rows + 1), np.linspace(0, width, columns + 1)
    low = np.minimum(ys.astype(int), height - 1)
    wanted = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(wanted), width + 1))
    carry = np.zeros(width + 1, dtype=np.int64 if whole else np.float64)
    for top in range(0, height, STRIP):
        strip = image[top : top + STRIP]
        table = np.zeros((len(strip) + 1, width + 1), dtype=carry.dtype)
        np.cumsum(strip, axis=0, out=table[1:, 1:], dtype=carry.dtype)
        np.cumsum(table[:, 1:], axis=1, out=table[:, 1:])
        table += carry
        inside = (wanted >= top) & (wanted <= top + len(strip))
        kept[inside] = table[wanted[inside] - top]
        carry = table[-1].copy()
    part = (ys - low)[:, None]
    at = np.searchsorted(wanted, low)
    lines = kept[at] * (1 - part) + kept[at + 1] * part
    left = np.minimum(xs.astype(int), width - 1)
    part = xs - left
    corners = lines[:, left] * (1 - part) + lines[:, left + 1] * part
    sums = np.diff(np.diff(corners, axis=0), axis=1)
    return sums / ((height / rows) * (width / columns))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 areas is brighter than the one to its left."""
    small = np.round(resize_area(image, HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.round(resize_area(image, side, side)).astype(np.uint8 if image.dtype != np.uint16 else np.uint16), version=(1, 0))
    return out.getvalue()


IMAGE = T.StructType().add("height", "integer").add("width", "integer").add("channels", "integer")
IMAGE = IMAGE.add("pixels", "binary").add("tile", "binary").add("dhash", "string").add("error", "string")


@F.arrow_udf(IMAGE)
def _images(media: pa.Array) -> pa.Array:
    columns: list[list] = [[] for _ in range(7)]
    for m in media:
        data = m.as_buffer() if m.is_valid else None
        row = [None] * 7
        if data is not None:
            try:
                image = decode(data.to_pybytes())
                plain = grey(image)
                row = [*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, image.tobytes(), npy_tile(plain), difference_hash(plain), None]
            except (ValueError, IndexError, OverflowError) as e:
                row[6] = f"{e}"
        for c, x in zip(columns, row, strict=True):
            c.append(x)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.string()] * 2
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, ["height", "width", "channels", "pixels", "tile", "dhash", "error"])


def read_media(df: DataFrame, media_col: str = "media", out: str = "image") -> DataFrame:
    """Add size, pixels, NPY tile and difference hash of each image as a struct."""
    prepare(df.sparkSession)
    return df.withColumn(out, _images(F.col(media_col)))


def netpbm(payload: Column) -> Column:
    """A grey Netpbm file that holds the payload, padded to a multiple of 64 bytes."""
    n = F.octet_length(payload)
    rows = F.greatest(F.lit(1), F.ceil(n / COLUMNS).cast("int"))
    header = F.concat(F.lit(f"P5\n{COLUMNS} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, payload, F.repeat(F.lit("\0"), rows * COLUMNS - n).cast("binary"))


def _little(n: Column) -> Column:
    """A number of four bytes, the least first, in hex."""
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1)))


def bmp(payload: Column) -> Column:
    """An 8-bit grey BMP, rows from the top, that holds the payload, padded likewise."""
    n = F.octet_length(payload)
    rows = F.greatest(F.lit(1), F.ceil(n / COLUMNS).cast("int"))
    start = 14 + 40 + 4 * 256
    fixed = lambda *numbers: "".join(x.to_bytes(size, "little").hex() for x, size in numbers)
    head = F.concat(
        F.lit(b"BM".hex()), _little(rows * COLUMNS + start), F.lit(fixed((0, 4), (start, 4), (40, 4), (COLUMNS, 4))), _little(F.lit(1 << 32) - rows),
        F.lit(fixed((1, 2), (8, 2), (0, 4))), _little(rows * COLUMNS), F.lit(fixed((0, 4), (0, 4), (256, 4), (0, 4))),
        F.lit("".join(bytes([k, k, k, 0]).hex() for k in range(256))),
    )
    return F.concat(F.unhex(head), payload, F.repeat(F.lit("\0"), rows * COLUMNS - n).cast("binary"))


def store_bmp(df: DataFrame, payload_col: str, out: str = "media") -> DataFrame:
    """Add the payload (null: empty) stored losslessly as a BMP image."""
    return df.withColumn(out, bmp(F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))))


def store_netpbm(df: DataFrame, payload_col: str, out: str = "media") -> DataFrame:
    """Add the payload (null: empty) stored losslessly as a Netpbm image."""
    return df.withColumn(out, netpbm(F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))))
