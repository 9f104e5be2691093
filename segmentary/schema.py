"""Schemas of the relations and the settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

METRICS = ("avg_logprob", "no_speech_prob", "compression_ratio")

AUDIO_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])

SEGMENTS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        *(T.StructField(m, T.DoubleType()) for m in METRICS),
    ]
)


@dataclass(frozen=True)
class Settings:
    """What a user may set; the defaults are those of the later profile."""

    mode: str = "balanced"
    split_mb: float = 100.0
    chunk_minutes: int = 5
    overlap_ms: int = 2000
    confidence: float = -0.8
    max_attempts: int = 3
    retry: bool = True
    remove_repeats: bool = True
    merge_short: bool = True
    shortest: float = 2.0
    largest_gap: float = 2.0
    run_cap: int = 2
    vad: bool = False


SMART = Settings()
CLASSIC = replace(SMART, split_mb=200.0, chunk_minutes=10, overlap_ms=0, retry=False, merge_short=False, vad=True)
