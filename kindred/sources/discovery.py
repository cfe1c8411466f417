"""Finding image files in a folder: recursively, by extension, in locale order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions.text import basename
from kindred.operators.ordering import numbered

PATTERN = r"(?i)\.(" + "|".join(schemas.EXTENSIONS) + ")$"
#: The same for file sources, which match case.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in schemas.EXTENSIONS) + "}"


class FolderError(ValueError):
    """A folder that can't be scanned."""


def is_image(path: Column) -> Column:
    """An image's extension, in any case; no other spelling (.tif isn't among them)."""
    return F.coalesce(path.rlike(PATTERN), F.lit(False))


def locale_order(path: Column) -> list[Column]:
    """Locale order, then bytes."""
    return [F.collate(path, "UNICODE"), path]


def plain_path(uri: Column) -> Column:
    """A file source's path without its scheme."""
    return F.regexp_replace(uri, "^file:/*(?=/)", "")


def validate_folder(spark: SparkSession, folder: str) -> str:
    """The folder's absolute path; raises FolderError where it is missing or no folder."""
    import os

    if not isinstance(folder, str) or not folder.strip():
        raise FolderError("Folder must be a string that isn't empty")
    folder = folder.strip()
    path = folder if "://" in folder else os.path.abspath(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise FolderError(f"Folder does not exist: {path}")
    return path


def list_files(spark: SparkSession, folder: str, underscores: bool = False) -> DataFrame:
    """(path, size, mtime_ms) of image files below ``folder``; entries that start with a dot are left out.

    The listing is Spark's own and parallel. It leaves out entries that start with an underscore; with ``underscores`` the driver
    lists the folder instead and finds them too.
    """
    path = validate_folder(spark, folder)
    if not underscores:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)
        return found.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms")).filter(is_image(F.col("path")))
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows, stack = [], [where]
    while stack:
        for s in fs.listStatus(stack.pop()):
            if s.getPath().getName().startswith("."):
                continue
            if s.isDirectory():
                stack.append(s.getPath())
            else:
                rows.append((s.getPath().toUri().getPath(), s.getLen(), float(s.getModificationTime())))
    return spark.createDataFrame(rows, "path string, size long, mtime_ms double").filter(is_image(F.col("path")))


def discover(spark: SparkSession, folder: str, underscores: bool = False) -> DataFrame:
    """FILES rows: image files in locale order, ``ord`` from 0."""
    files = list_files(spark, folder, underscores).withColumn("basename", basename(F.col("path")))
    return numbered(files, *locale_order(F.col("path"))).select(*schemas.FILES.names)


def from_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """The same over a table of paths: images only, with basename and ``ord``."""
    images = paths.filter(is_image(F.col(path))).withColumn("basename", basename(F.col(path)))
    return numbered(images, *locale_order(F.col(path)))


def preview(files: DataFrame, shown: int = 6) -> DataFrame:
    """One row: how many images, the paths of the first few, and how many more there are. A limit of the feature."""
    first = files.orderBy("ord").limit(shown).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda m: m["path"]).alias("samples"))
    return files.agg(F.count("*").alias("image_count")).crossJoin(first).withColumn("overflow", F.col("image_count") - F.size("samples"))


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of image files as they appear, in no order: path, modificationTime, length, content."""
    path = validate_folder(spark, folder)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.withColumn("path", plain_path(F.col("path")))
