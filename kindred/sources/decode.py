"""From image files to 32x32 grey samples and their hashes.

Files are decoded by the JVM's ImageIO through Spark's image source (PNG, JPEG, BMP, GIF; TIFF where the JVM has it). Samples
are box averages of the whole picture, its sides stretched to a square; alpha is dropped, orientation tags are not applied.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.phash import SIDE, rotation_hashes
from kindred.sources.discovery import GLOB, validate_folder

#: Shares of blue, green and red in grey.
GREY = np.array([0.0722, 0.7152, 0.2126])
HASHES = "path string, hashes array<string>, error string"


class DecodeError(ValueError):
    """A file that is no readable image."""


def box_weights(n: int, side: int = SIDE) -> np.ndarray:
    """(side, n): the share of each of n source cells in each of ``side`` equal boxes."""
    edge = np.arange(side + 1) * n / side
    cell = np.arange(n)
    over = np.minimum(edge[1:, None], cell[None, :] + 1) - np.maximum(edge[:-1, None], cell[None, :])
    return np.clip(over, 0, None) * side / n


def grey_sample(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(32, 32) bytes of rows of blue, green, red (and alpha), or of grey alone."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ GREY
    return np.clip(np.rint(box_weights(height) @ grey @ box_weights(width).T), 0, 255).astype(np.uint8)


def hash_images(images: DataFrame, on_error: str = "fail") -> DataFrame:
    """(path, hashes, error) of rows of the image source. on_error: 'fail' raises at the first unreadable file, 'skip' gives it an error and no hashes."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                path = unquote(row["origin"])
                path = path[len("file://") :] if path.startswith("file://") else path
                if row["width"] <= 0 or not row["data"]:
                    if on_error == "fail":
                        raise DecodeError(f"Unreadable image: {path}")
                    hashes, error = None, f"Skipped unreadable image {path}"
                else:
                    sample = grey_sample(row["data"], row["height"], row["width"], row["nChannels"])
                    hashes, error = rotation_hashes(sample[None])[0], None
                yield pa.record_batch([pa.array([path]), pa.array([hashes], pa.list_(pa.string())), pa.array([error], pa.string())], names=["path", "hashes", "error"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(scan, HASHES)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    path = validate_folder(spark, folder)
    return spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)


def hash_files(spark: SparkSession, files: DataFrame, on_error: str = "fail", per_load: int = 10_000) -> DataFrame:
    """(path, hashes, error) of the files named in ``files``: only these are read, so what the cache holds isn't decoded again."""
    out, held = None, []

    def load(paths: list[str]) -> DataFrame:
        # a path is a glob to the reader
        quoted = ["".join(f"\\{c}" if c in "*?[]{}\\," else c for c in p) for p in paths]
        return hash_images(spark.read.format("image").load(quoted), on_error)

    for row in files.select("path").toLocalIterator():
        held.append(row["path"])
        if len(held) == per_load:
            out = load(held) if out is None else out.unionByName(load(held))
            held = []
    if held:
        out = load(held) if out is None else out.unionByName(load(held))
    return spark.createDataFrame([], HASHES) if out is None else out


def stream_hashes(spark: SparkSession, folder: str, files_per_trigger: int = 1000, on_error: str = "fail") -> DataFrame:
    """A stream of (path, hashes, error) of images as they appear."""
    path = validate_folder(spark, folder)
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.readStream.format("image").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return hash_images(images, on_error)


def errors(hashed: DataFrame) -> DataFrame:
    return hashed.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("warning"))
