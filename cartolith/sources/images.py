"""Images as cell tables: PNG and PGM/PPM files to pixels, and pixels to PNG bytes. No image library is needed."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.operators.features import checked
from cartolith.session import written

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Height by width by channels; 8 bits, not interlaced, without a palette."""
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or interlace or color not in CHANNELS:
        raise ValueError("only plain 8-bit PNG files are read")
    n = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * n)
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.int32)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int32)
        if kind == 1:
            line = np.cumsum(line.reshape(width, n), axis=0).reshape(-1) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for i in range(width * n):
                a, b, c = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                if kind == 3:
                    line[i] = (line[i] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                    line[i] = (line[i] + near[2]) & 255
        out[y], above = line, line
    return out.reshape(height, width, n)


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG bytes of height by width by 1, 3 or 4 channels."""
    height, width, n = pixels.shape
    raw = np.hstack([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, width * n)]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary PGM (P5) or PPM (P6) of 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    n = {b"P5": 1, b"P6": 3}[fields[0]]
    return np.frombuffer(data, np.uint8, int(fields[1]) * int(fields[2]) * n, at + 1).reshape(int(fields[2]), int(fields[1]), n)


def decode(data: bytes) -> np.ndarray:
    return decode_png(data) if data.startswith(SIGNATURE) else decode_pnm(data)


def read_pixels(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> DataFrame:
    """(path, x, y, r, g, b, a) of image files; alpha is 255 where a file has none. size: (width, height) to insist on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode(bytes(content)).astype(np.int32)
                height, width, n = image.shape
                if size is not None and (width, height) != tuple(size):
                    raise ValueError(f"{name} is {width}x{height}, not {size[0]}x{size[1]}")
                color = image[:, :, :3] if n >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
                alpha = image[:, :, n - 1] if n in (2, 4) else np.full((height, width), 255, np.int32)
                for y in range(height):
                    yield pd.DataFrame({"path": name, "x": np.arange(width, dtype=np.int32), "y": np.int32(y), "r": color[y, :, 0], "g": color[y, :, 1], "b": color[y, :, 2], "a": alpha[y]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x int, y int, r int, g int, b int, a int")


def read_binary_mask(spark: SparkSession, path: str, threshold: int = 128, size: tuple[int, int] | None = None) -> DataFrame:
    """(x, y, gray, land) of one grey image."""
    return read_pixels(spark, path, size).select("x", "y", F.col("r").alias("gray"), (F.col("r") >= threshold).cast("int").alias("land"))


def mask_report(mask: DataFrame) -> DataFrame:
    """One row: cells, land and ocean cells, and cells that are neither black nor white."""
    return mask.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("land") == 1).alias("land_cells"), F.count_if(F.col("land") == 0).alias("ocean_cells"), F.count_if(~F.col("gray").isin(0, 255)).alias("grey_cells"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def to_png(cells: DataFrame, channels: list[Column], key: Column, width: int, height: int) -> DataFrame:
    """(key, png) of each image; cells: x, y. An image has to fit into a task; cells that aren't there are 0."""
    n = len(channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((height, width, n), np.uint8)
        out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[[f"c{i}" for i in range(n)]].to_numpy()
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "png": [encode_png(out)]})

    rows = cells.select(key.cast("string").alias("key"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(c.cast("int").alias(f"c{i}") for i, c in enumerate(channels)))
    sound = checked(rows, F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1), "a cell is outside the image")
    return sound.groupBy("key").applyInPandas(run, "key string, png binary")


def write_png(cells: DataFrame, channels: list[Column], key: Column, width: int, height: int, folder: str) -> DataFrame:
    """(key, path) of image files, one a key, which tasks write under folder through Arrow's file systems.

    A file appears under its name only when it is whole; of two attempts of a task the later one's stays, and both are alike.
    """
    uri = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder
    system, base = fs.FileSystem.from_uri(uri)
    system.create_dir(base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for name, png in zip(frame["key"], frame["png"], strict=True):
                stage = f"{base}/_{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(stage) as out:
                    out.write(bytes(png))
                system.move(stage, f"{base}/{name}.png")
            yield pd.DataFrame({"key": frame["key"], "path": [f"{folder}/{name}.png" for name in frame["key"]]})

    return written(to_png(cells, channels, key, width, height).mapInPandas(run, "key string, path string"), "images")
