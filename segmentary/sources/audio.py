"""Scanning a folder for media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import MEDIA_LATER, extension
from ..schema import AUDIO_FILES


def media_only(files: DataFrame, kinds: tuple[str, ...] = MEDIA_LATER, path: str = "path") -> DataFrame:
    """Files of a known kind, whatever the case of their extension."""
    return files.filter(extension(F.col(path)).isin(*(f".{k}" for k in kinds)))


def scan_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = MEDIA_LATER) -> DataFrame:
    """Media files right in ``folder``, by path. Content isn't read: only path and length are asked for.

    Spark's reader lists in parallel and skips folders, but also names that begin with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return media_only(files, kinds).orderBy("path")


def list_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = MEDIA_LATER) -> DataFrame:
    """Like ``scan_folder``, with every name that the file system lists, hidden ones and folders as well.

    One listing call of the driver on any Hadoop file system; for folders that fit the driver's memory.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    rows = [(s.getPath().toString(), s.getLen()) for s in path.getFileSystem(conf).listStatus(path)]
    return media_only(spark.createDataFrame(rows, AUDIO_FILES), kinds).orderBy("path")


def totals(files: DataFrame) -> DataFrame:
    """Count and megabytes of the files found."""
    return files.agg(F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / F.lit(1048576.0)).alias("total_mb"))
