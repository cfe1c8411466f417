"""64-bit perceptual hashes of 32x32 grey samples: DCT kernels in numpy, vectorised over samples, and their Arrow UDFs.

Sums run in a fixed order (along a row, then down the columns), so a sample's hash doesn't depend on the batch it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEPT = 32, 8
PIXELS = SIDE * SIDE
ROTATIONS = (0, 90, 180, 270)
#: COSINES[u, x] = cos((2x + 1) u pi / 64)
COSINES = np.cos((2 * np.arange(SIDE)[None, :] + 1) * np.arange(KEPT)[:, None] * np.pi / (2 * SIDE))
NORMS = np.array([1 / np.sqrt(2)] + [1.0] * (KEPT - 1))


def coefficients(samples: np.ndarray) -> np.ndarray:
    """(n, 64) low DCT coefficients, row-major, of (n, 32, 32) samples."""
    rows = np.zeros((len(samples), SIDE, KEPT))
    for y in range(SIDE):
        rows += samples[:, :, y, None].astype(np.float64) * COSINES[:, y]
    out = np.zeros((len(samples), KEPT, KEPT))
    for x in range(SIDE):
        out += COSINES[:, x][:, None] * rows[:, x, None, :]
    return ((NORMS[:, None] * NORMS[None, :]) * out / SIDE).reshape(-1, KEPT * KEPT)


def binarise(values: np.ndarray) -> np.ndarray:
    """uint64 of each row of 64 values: bit 63 - i is set where value i is at least the mean of values 1 to 63."""
    total = np.zeros(len(values))
    for k in range(1, 64):
        total += values[:, k]
    bits = values >= (total / 63)[:, None]
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def to_hex(bits: np.ndarray) -> list[str]:
    return [f"{b:016x}" for b in bits.tolist()]


def rotated(samples: np.ndarray, degrees: int) -> np.ndarray:
    """Samples turned clockwise by a multiple of 90 degrees."""
    if degrees not in ROTATIONS:
        raise ValueError(f"rotation must be one of {ROTATIONS}")
    return np.rot90(samples, -(degrees // 90), axes=(1, 2))


def phash(samples: np.ndarray) -> np.ndarray:
    return binarise(coefficients(samples))


def rotation_hashes(samples: np.ndarray) -> list[list[str]]:
    """Hashes of each sample in the four rotations, each once, in order."""
    turned = [to_hex(phash(rotated(samples, r))) for r in ROTATIONS]
    return [list(dict.fromkeys(four)) for four in zip(*turned)]


def stacked(pixels: list[bytes]) -> np.ndarray:
    """(n, 32, 32) from row-major pixel buffers of 1024 bytes."""
    if any(len(p) != PIXELS for p in pixels):
        raise ValueError(f"a sample has {PIXELS} bytes")
    return np.frombuffer(b"".join(pixels), np.uint8).reshape(-1, SIDE, SIDE)


@F.pandas_udf(T.StringType())
def phash_udf(pixels: pd.Series) -> pd.Series:
    """Hash of a 1024-byte sample; null for null."""
    known = pixels.notna()
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    if known.any():
        out[known] = to_hex(phash(stacked(pixels[known].tolist())))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def rotation_hashes_udf(pixels: pd.Series) -> pd.Series:
    """Distinct hashes of a 1024-byte sample in four rotations, all from one pass; null for null."""
    known = pixels.notna()
    out = pd.Series([None] * len(pixels), index=pixels.index, dtype=object)
    if known.any():
        out[known] = pd.Series(rotation_hashes(stacked(pixels[known].tolist())), index=pixels.index[known], dtype=object)
    return out


def shrink(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, 32, 32) box samples of whole byte strings: pixel k is the floored mean of bytes k n / 1024 to (k + 1) n / 1024, at least one; empty strings are black."""
    size = np.diff(offsets)
    sums = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    k = np.arange(PIXELS)
    low = k[None, :] * size[:, None] // PIXELS
    high = np.maximum(low + 1, (k[None, :] + 1) * size[:, None] // PIXELS)
    some = size > 0
    out = np.zeros((len(size), PIXELS), np.uint8)
    base = offsets[:-1][some, None]
    out[some] = (sums[base + high[some]] - sums[base + low[some]]) // (high - low)[some]
    return out.reshape(-1, SIDE, SIDE)


def byte_hashes(df: DataFrame, key: str, body: str, step: int = 256) -> DataFrame:
    """(key, hashes): rotation hashes of a string or binary column read as a grey image; a null body has no row."""
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                column = part.column("body")
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                held = column.buffers()[2]
                data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
                hashes = rotation_hashes(shrink(data, offsets - offsets[0]))
                yield pa.record_batch([part.column("key"), pa.array(hashes, pa.list_(pa.string()))], names=["key", "hashes"])

    rows = df.select(F.col(key).alias("key"), F.col(body).cast("binary").alias("body")).filter("body is not null")
    return rows.mapInArrow(scan, f"key {kind}, hashes array<string>").withColumnRenamed("key", key)


def binarised(values: Column) -> Column:
    """Hash of 64 numbers by built-in functions: bit 63 - i where value i is at least the mean of values 1 to 63."""
    wide = F.transform(values, lambda x: x.cast("double"))
    mean = F.aggregate(F.slice(wide, 2, 63), F.lit(0.0), lambda a, x: a + x) / 63
    halves = []
    for start in (1, 33):
        marks = F.transform(F.slice(wide, start, 32), lambda x: F.when(x >= mean, F.lit("1")).otherwise(F.lit("0")))
        halves.append(F.lpad(F.lower(F.conv(F.array_join(marks, ""), 2, 16)), 8, "0"))
    return F.concat(*halves)
