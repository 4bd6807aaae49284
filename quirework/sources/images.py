"""Image files: scan, decode and re-encode as PNG, without an imaging library.

PNG (all depths, of 16 bits the upper 8; interlaced or not) and BMP (24- and
32-bit, uncompressed) are decoded to pixels; of GIF and JPEG only the size is
read. What can't be read is null,
and nothing is drawn for it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix

#: Files of a folder, about, and bytes of files that are sent on at once, about.
FOLDER_FILES, READ_BYTES = 4096, 16 << 20

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
# First column and row and steps of the seven passes of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_pixels(data: bytes) -> np.ndarray | None:
    at, head, body, palette = 8, None, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head = part if kind == b"IHDR" else head
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        body += [part] if kind == b"IDAT" else []
        at += 12 + n
    if head is None:
        return None
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[:13])
    channels = 1 if colour == 3 else _CHANNELS.get(colour)
    if depth not in (1, 2, 4, 8, 16) or not channels:
        return None
    data, at = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8), 0
    out = np.zeros((height, width, channels), np.uint8)
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            stride = -(-w * channels * depth // 8)
            lines = _unfiltered(data[at : at + h * (1 + stride)].reshape(h, 1 + stride), max(1, channels * depth // 8))
            at += h * (1 + stride)
            out[y0::dy, x0::dx] = _samples(lines, w * channels, depth, colour == 3).reshape(h, w, channels)
    if colour == 3:
        out = palette[out[:, :, 0]]
    return _rgba(out)


def _unfiltered(rows: np.ndarray, unit: int) -> np.ndarray:
    """The bytes of lines whose first byte tells how the rest was predicted; unit: bytes of a pixel."""
    height, width = rows.shape[0], rows.shape[1] - 1
    out, up = np.zeros((height, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 1:
            padded = np.zeros(-(-width // unit) * unit, np.uint8)
            padded[:width] = line
            line = np.cumsum(padded.reshape(-1, unit), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            own, above = line.tolist(), up.tolist()
            for x in range(width):
                a, b = own[x - unit] if x >= unit else 0, above[x]
                if kind == 3:
                    own[x] = own[x] + (a + b) // 2 & 255
                else:
                    c = above[x - unit] if x >= unit else 0
                    near, over, corner = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    own[x] = own[x] + (a if near <= over and near <= corner else b if over <= corner else c) & 255
            line = np.array(own, np.uint8)
        out[y] = up = line
    return out


def _samples(lines: np.ndarray, count: int, depth: int, indexed: bool) -> np.ndarray:
    """So many samples of each line, as bytes; those of few bits are spread over the range unless they are places in a palette."""
    if depth == 16:
        return lines[:, : 2 * count : 2]
    if depth == 8:
        return lines[:, :count]
    bits = np.unpackbits(lines, axis=1)[:, : count * depth].reshape(len(lines), count, depth)
    value = bits @ (1 << np.arange(depth - 1, -1, -1))
    return (value if indexed else value * 255 // ((1 << depth) - 1)).astype(np.uint8)


def _rgba(pixels: np.ndarray) -> np.ndarray:
    grey = pixels.shape[2] <= 2
    rgb = np.repeat(pixels[:, :, :1], 3, 2) if grey else pixels[:, :, :3]
    alpha = pixels[:, :, -1:] if pixels.shape[2] in (2, 4) else np.full((*pixels.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], 2)


def _bmp_pixels(data: bytes) -> np.ndarray | None:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        return None
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    rows = rows[::-1] if height > 0 else rows
    return _rgba(np.ascontiguousarray(rows[:, :, [2, 1, 0]]))


def pixels(data: bytes | None) -> np.ndarray | None:
    """Height x width x RGBA, or None."""
    try:
        if data and data.startswith(_SIGNATURE):
            return _png_pixels(data)
        if data and data.startswith(b"BM"):
            return _bmp_pixels(data)
    except (ValueError, struct.error, zlib.error, TypeError, IndexError):
        pass
    return None


def size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height, or None if the bytes are no image."""
    try:
        if data and data.startswith(_SIGNATURE):
            return struct.unpack(">II", data[16:24])
        if data and data.startswith(b"BM"):
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data and data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data and data.startswith(b"\xff\xd8"):
            at = 2
            while at + 9 < len(data):
                kind, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
                at += 2 + n
    except struct.error:
        pass
    return None


def to_png(rgba: np.ndarray) -> bytes:
    height, width, _ = rgba.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgba.reshape(height, width * 4)], 1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(images: DataFrame, bytes_col: str = "content") -> DataFrame:
    """Adds width, height (null if no image) and png, the image encoded anew (the bytes themselves where pixels can't be read)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [size(None if d is None else bytes(d)) for d in batch[bytes_col]]
            batch = batch.assign(width=pd.array([s[0] if s else None for s in sizes], "Int32"), height=pd.array([s[1] if s else None for s in sizes], "Int32"))
            yield batch.assign(png=[to_png(p) if (p := pixels(bytes(d))) is not None else bytes(d) if s else None for d, s in zip(batch[bytes_col], sizes, strict=True)])

    from pyspark.sql import types as T

    kinds = {"width": T.IntegerType(), "height": T.IntegerType(), "png": T.BinaryType()}
    return images.mapInPandas(run, T.StructType([*images.schema.fields, *(T.StructField(k, t) for k, t in kinds.items())]))


def parts_for(files: DataFrame) -> int:
    """How many folders to deal files out to, so that each holds about FOLDER_FILES."""
    return max(1, -(-files.count() // FOLDER_FILES))


def scan(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Image files under path: path, format (the suffix as given), content, width, height, png. What is no image is left out.

    parts: as given to write(), whose folders are then listed and read by tasks,
    one a folder. Without it, Spark's reader lists all files in the driver, and
    a task reads few of them.
    """
    if parts is None:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    else:
        files = spark.range(0, parts, 1, parts).mapInArrow(_read(path), "path string, content binary")
    return decode(files.select("path", suffix(F.col("path")).alias("format"), "content")).filter("width IS NOT NULL")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                names, contents, size = [], [], 0
                for info in system.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True)):
                    if info.type == fs.FileType.File:
                        with system.open_input_stream(info.path) as f:
                            contents.append(f.read())
                        names.append(info.path)
                        size += len(contents[-1])
                    if size > READ_BYTES or len(names) == FOLDER_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                        names, contents, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return run


def write(files: DataFrame, path: str, parts: int | None = None) -> int:
    """files: name, content. Writes each as a file of a folder (a URI that pyarrow knows and all executors share) and returns how many. A name that comes again is written again.

    parts: deals the files out to so many folders in that folder, by a hash of
    the name, each written by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        n, made = 0, set()
        for batch in batches:
            for name, content, folder in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "folder")), strict=True):
                if folder not in made:
                    system.create_dir(f"{root}{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{root}{folder}/{name}") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = files.select("name", "content", F.lit("").alias("folder")).filter("name IS NOT NULL AND content IS NOT NULL")
    if parts is None:
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
    else:
        rows = rows.withColumn("folder", F.concat(F.lit("/"), F.pmod(F.hash("name"), F.lit(parts)).cast("string"))).repartition(parts, "folder")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
