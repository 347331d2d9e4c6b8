"""Masks as pixels: PNG in and out, resizing, padding, overlapping tiles.

A file is decoded where it lies, one at a time, and becomes rows
``image, x, y, code``; everything after that is relational.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: channels by colour type


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height, width, channels) of a PNG; palette images give their indices. ValueError for what is no plain PNG."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or head[3] not in _CHANNELS or head[6]:
        raise ValueError("no header, unknown colours, or interlaced")
    width, height, depth, colour = head[:4]
    n = _CHANNELS[colour]
    step, stride = max(1, n * depth // 8), (width * n * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (stride + 1):
        raise ValueError("cut off")
    raw, out = raw.reshape(height, stride + 1), np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for i, line in enumerate(raw):
        how, line = line[0], line[1:]
        if how == 0:
            out[i] = line
        elif how == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[i] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif how == 2:
            out[i] = line + before
        else:
            now, up = [0] * stride, before.tolist()
            for j, v in enumerate(line.tolist()):
                a, b, c = (now[j - step], up[j], up[j - step]) if j >= step else (0, up[j], 0)
                if how == 3:
                    near = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[j] = (v + near) & 255
            out[i] = now
        before = out[i]
    if depth == 16:
        samples = out.reshape(height, -1, 2).astype(np.int32)
        samples = samples[..., 0] * 256 + samples[..., 1]
    elif depth == 8:
        samples = out.astype(np.int32)
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        samples = (bits * (1 << np.arange(depth)[::-1])).sum(-1).astype(np.int32)[:, : width * n]
    return samples.reshape(height, width, n)


def encode_png(samples: np.ndarray) -> bytes:
    """A PNG of 8 bits a sample: grey for (height, width), RGB for (height, width, 3)."""
    a = np.ascontiguousarray(samples, np.uint8)
    h, w = a.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def mask_codes(files: DataFrame) -> DataFrame:
    """``image, x, y, code`` of mask files ``path, content``: grey values or palette indices, of colours the red; ``code`` -1 at (-1, -1) for what can't be read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2))):
                try:
                    a = decode_png(content or b"")[..., 0]
                    y, x = np.indices(a.shape, np.int32)
                except (ValueError, zlib.error, struct.error):
                    a, y, x = (np.array([-1], np.int32) for _ in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([path] * a.size, pa.string()), *(pa.array(v.ravel().astype(np.int32)) for v in (x, y, a))], names=["image", "x", "y", "code"])

    return files.select("path", "content").mapInArrow(run, "image string, x int, y int, code int")


def write_masks(pixels: DataFrame, folder: str, code: str = "code") -> DataFrame:
    """Write each image's codes as a grey PNG named after it; ``image, path, bytes`` of what was written. Codes beyond 0 to 255 are a ValueError; places without a pixel are 0."""
    kind = dict(pixels.dtypes)["image"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy() for c in ("x", "y", code))
        if v.min() < 0 or v.max() > 255:
            raise ValueError("codes must fit in a byte")
        a = np.zeros((y.max() + 1, x.max() + 1), np.uint8)
        a[y, x] = v
        data, name = encode_png(a), str(pdf["image"].iloc[0]).rsplit("/", 1)[-1].rsplit(".", 1)[0]
        system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(at)
        with system.open_output_stream(f"{at}/{name}.png") as f:
            f.write(data)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "path": [f"{folder}/{name}.png"], "bytes": [len(data)]})

    return pixels.select("image", "x", "y", code).groupBy("image").applyInPandas(run, f"image {kind}, path string, bytes long")


def dimensions(pixels: DataFrame) -> DataFrame:
    """``image, w, h``."""
    return pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def resize(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pixels`` in the sizes ``image, w, h``, each place with the pixel whose area its middle falls in; images without a size are left out.

    Each pixel says which places it fills, so nothing is looked up.
    """
    old = dimensions(pixels).withColumnsRenamed({"w": "ow", "h": "oh"})
    rows = pixels.join(old, "image").join(sizes.select("image", "w", "h"), "image")

    def filled(at: str, was: str, now: str) -> Column:
        """The places p of the new size with floor((p + 0.5) was / now) = at."""
        low, high = F.ceil(F.col(at) * F.col(now) / F.col(was) - 0.5), F.ceil((F.col(at) + 1) * F.col(now) / F.col(was) - 0.5) - 1
        return F.when(high >= low, F.sequence(low, high))

    out = rows.withColumn("nx", F.explode(filled("x", "ow", "w"))).withColumn("ny", F.explode(filled("y", "oh", "h")))
    return out.select(*[F.col("nx").cast("int").alias(c) if c == "x" else F.col("ny").cast("int").alias(c) if c == "y" else c for c in pixels.columns])


def same_size(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Masks resized to the sizes of their images (``image, w, h``)."""
    return resize(masks, images)


def pad(pixels: DataFrame, multiple: int) -> DataFrame:
    """``pixels`` with the last row and column repeated until both sides are multiples."""
    rows = pixels.join(dimensions(pixels), "image")
    up = lambda c: F.ceil(c / multiple) * multiple - 1
    along = lambda at, side: F.when(F.col(at) == F.col(side) - 1, F.sequence(F.col(at).cast("bigint"), up(F.col(side)))).otherwise(F.array(F.col(at).cast("bigint")))
    out = rows.withColumn("px", F.explode(along("x", "w"))).withColumn("py", F.explode(along("y", "h")))
    return out.select(*[F.col(f"p{c}").cast("int").alias(c) if c in ("x", "y") else c for c in pixels.columns])


def tiled(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """``pixels`` once for each tile that covers them, with ``tx, ty``: the tile's first place. Tiles start every ``stride``, and flush with the end."""
    rows = pixels.join(dimensions(pixels), "image")

    def starts(at: str, side: str) -> Column:
        last = F.greatest(F.col(side) - size, F.lit(0)).cast("bigint")
        low, high = F.greatest(F.floor((F.col(at) - size) / stride) + 1, F.lit(0)), F.floor(F.least(F.col(at).cast("bigint"), last) / stride)
        none = F.array().cast("array<bigint>")
        every = F.when(high >= low, F.sequence(low * stride, high * stride, F.lit(stride).cast("bigint"))).otherwise(none)
        return F.array_union(every, F.when((last <= F.col(at)) & (F.col(at) < last + size), F.array(last)).otherwise(none))

    return rows.withColumn("tx", F.explode(starts("x", "w"))).withColumn("ty", F.explode(starts("y", "h"))).drop("w", "h")


def untiled(tiles: DataFrame, values: list[str], count: str | None = None) -> DataFrame:
    """``image, x, y`` with the mean over tiles of each value; with ``count`` the number of tiles by that name."""
    n = [F.count(F.lit(1)).alias(count)] if count else []
    return tiles.groupBy("image", "x", "y").agg(*[F.avg(v).alias(v) for v in values], *n)
