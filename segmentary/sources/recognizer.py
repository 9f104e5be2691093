"""The boundary to speech recognition: a pluggable function, and a deterministic stand-in.

No model is part of the library. A recogniser is a function of (path, start_ms, end_ms, options) that
gives (language, segments); it is made once for each worker, where a model would be loaded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Recogniser = Callable[[str, int, int, dict], tuple[str, list[dict]]]

RECOGNISED = (
    "file_id long, chunk_no int, language string, "
    "segments array<struct<start: double, end: double, text: string, avg_logprob: double, no_speech_prob: double, compression_ratio: double>>"
)


def stand_in() -> Recogniser:
    """Words by a checksum of the span; for tests and dry runs."""

    def recognise(path: str, start_ms: int, end_ms: int, options: dict) -> tuple[str, list[dict]]:
        out = []
        for k, at in enumerate(range(start_ms, end_ms, 4000)):
            code = zlib.crc32(f"{path}:{at}".encode())
            stop = min(at + 4000, end_ms)
            out.append({"start": (at - start_ms) / 1000, "end": (stop - start_ms) / 1000, "text": f" word{code % 97} word{k}", "avg_logprob": -(code % 150) / 100, "no_speech_prob": code % 100 / 100, "compression_ratio": 1 + code % 200 / 100})
        return options.get("language") or "en", out

    return recognise


def recognise(chunks: DataFrame, make: Callable[[], Recogniser] = stand_in, options: dict | None = None) -> DataFrame:
    """``chunks`` (file_id, path, chunk_no, start_ms, end_ms) to one row a chunk with its language and local segments."""
    chosen = dict(options or {})

    def run(batches):
        model = make()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                language, segments = model(r.path, int(r.start_ms), int(r.end_ms), chosen)
                rows.append((r.file_id, r.chunk_no, language, segments))
            yield pd.DataFrame(rows, columns=["file_id", "chunk_no", "language", "segments"])

    return chunks.select("file_id", "path", "chunk_no", "start_ms", "end_ms").mapInPandas(run, RECOGNISED)
