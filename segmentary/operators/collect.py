"""From segments to one row a file, and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, strip
from ..schema import METRICS


def results(segments: DataFrame, trim: bool = False) -> DataFrame:
    """One row a file: text, segments (array), n_segments, last_end (end of the last segment, not the greatest).

    Texts are joined by blanks in order. With ``trim`` each is stripped and empty ones stay; without,
    those that are empty as they are are left out.
    """
    fields = [f for f in ("seq", "start", "end", "text", *METRICS) if f in segments.columns]
    return results_of_arrays(segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments")), trim)


def results_of_arrays(grouped: DataFrame, trim: bool = False) -> DataFrame:
    """The same of (file_id, segments), the arrays being in order."""
    texts = F.transform("segments", lambda s: strip(filled(s["text"])) if trim else s["text"])
    if not trim:
        texts = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return grouped.select("file_id", F.array_join(texts, " ").alias("text"), "segments", F.size("segments").alias("n_segments"), F.element_at("segments", -1)["end"].alias("last_end"))


def language_of_last_chunk(chunks: DataFrame) -> DataFrame:
    """The language of each file's last chunk; unknown where it has none."""
    return chunks.groupBy("file_id").agg(F.coalesce(F.max_by("language", "chunk_no"), F.lit("unknown")).alias("language"))


def counters(files: DataFrame) -> DataFrame:
    """``files`` (ok, improved) to totals of a batch."""
    return files.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("improved"))), F.lit(0)).alias("improved"))
