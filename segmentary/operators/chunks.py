"""Chunk plans, and the way back from times in a chunk to times in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed_plan(files: DataFrame, minutes: int = 10) -> DataFrame:
    """``files`` (file_id, duration_ms) to contiguous chunks (file_id, chunk_no from 1, start_ms, end_ms); the last may be short."""
    return _plan(files, minutes * 60_000, minutes * 60_000)


def overlapping_plan(files: DataFrame, minutes: int = 5, overlap_ms: int = 2000) -> DataFrame:
    """Like ``fixed_plan``; each chunk but the first begins ``overlap_ms`` before its predecessor's end, and one ends the plan that reaches the file's."""
    return _plan(files, minutes * 60_000, minutes * 60_000 - overlap_ms)


def _plan(files: DataFrame, chunk: int, step: int) -> DataFrame:
    length = F.col("duration_ms")
    last = F.when(length <= chunk, F.lit(0).cast("long")).otherwise(F.ceil((length - chunk) / step))
    starts = files.select("file_id", "duration_ms", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("k", "j"))
    return starts.select("file_id", (F.col("k") + 1).alias("chunk_no"), (F.col("j") * step).alias("start_ms"), F.least(F.col("j") * step + chunk, length).alias("end_ms"))


def overlap_drop(local: DataFrame, overlap_s: float = 2.0) -> DataFrame:
    """Of later chunks, the segments that begin inside the overlap go; ``start`` is the time in the chunk."""
    return local.filter((F.col("chunk_no") == 1) | (F.col("start") >= overlap_s))


def shift_by_start(local: DataFrame, chunks: DataFrame) -> DataFrame:
    """Times in the file from the planned start of each chunk. The join is on both keys; chunks are few beside segments, and Spark sends them out if they are small."""
    offset = F.col("start_ms") / 1000
    found = local.join(chunks.select("file_id", "chunk_no", "start_ms"), ["file_id", "chunk_no"])
    return found.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset}).drop("start_ms")


def running_offset(lengths: DataFrame, length: str = "length_ms") -> DataFrame:
    """Add ``offset_s``: the seconds of all chunks before, summed as whole milliseconds."""
    before = Window.partitionBy("file_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("offset_s", F.coalesce(F.sum(length).over(before), F.lit(0)) / 1000)


def dense_seq(segments: DataFrame, *order: str) -> DataFrame:
    """Number the segments of each file from 0 in the given order."""
    return segments.withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)) - 1)
