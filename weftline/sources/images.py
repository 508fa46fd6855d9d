"""Images as pixel arrays: crop, paste and resize on row-major channels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import write_bytes


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images of a folder: origin, height, width, channels, data (bytes)."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def crop(pixels: str | Column, width: int, channels: int, left: int, top: int, right: int, bottom: int) -> Column:
    """Pixels of a box, as an array expression."""
    rows = F.sequence(F.lit(top), F.lit(bottom - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(pixels, r * width * channels + left * channels + 1, F.lit((right - left) * channels))))


def paste(under: str | Column, over: str | Column, width: int, channels: int, left: int, top: int, over_width: int) -> Column:
    """``under`` with ``over`` laid on it."""

    def at(v: Column, i: Column) -> Column:
        x = F.floor((i % (width * channels)) / channels).cast("int") - left
        y = F.floor(i / (width * channels)).cast("int") - top
        place = (y * over_width + x) * channels + i % channels + 1
        inside = x.between(0, over_width - 1) & (y >= 0) & (place <= F.size(over))
        return F.when(inside, F.try_element_at(over, F.when(inside, place.cast("int")).otherwise(1))).otherwise(v)

    return F.transform(under, at)


def resize(pixels: str | Column, width: int, height: int, channels: int, new_width: int, new_height: int) -> Column:
    """The nearest pixel for each new one, as an array expression."""
    at = [((y * height // new_height) * width + x * width // new_width) * channels + c for y in range(new_height) for x in range(new_width) for c in range(channels)]
    column = F.col(pixels) if isinstance(pixels, str) else pixels
    return F.transform(F.array(*(F.lit(i) for i in at)), lambda i: F.get(column, i))


def write_png(spark: SparkSession, path: str, pixels: list[int], width: int, channels: int) -> None:
    """One picture as a PNG file that ``read_images`` reads."""
    rows = np.asarray(pixels, np.uint8).reshape(-1, width * channels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 2 if channels == 3 else 0, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))
    write_bytes(spark, path, b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b""))
