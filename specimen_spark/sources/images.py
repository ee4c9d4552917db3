"""Image files as tables, and listings of existing files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.functions.text import file_stem


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """``path, height, width, nChannels, mode, data``; undecodable files have height -1.

    ``data`` holds the pixels row by row, channels in blue-green-red order.
    """
    images = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return images.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.mode",
        "image.data",
    )


def read_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length, content`` of files, for hashing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length`` without reading the contents; local paths lose their scheme."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(plain_path("path").alias("path"), "length")


def plain_path(c) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(column, r"^file:/+", "/")


def with_stem(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("stem", file_stem(path))
