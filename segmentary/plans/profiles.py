"""The two processing profiles, end to end over recognised segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.collect import results, results_of_arrays
from ..operators.loops import truncate_loops
from ..operators.merge import merged_by_file
from ..operators.repeats import run_capped, seen_cut
from ..operators.retry import best_pick, best_try
from ..schema import CLASSIC, SMART, Settings


def smart(segments: DataFrame, candidates: DataFrame | Column | None = None, settings: Settings = SMART) -> DataFrame:
    """Retries, then repeats, then merging; text from what is left, not trimmed.

    ``candidates`` is a relation, or an array in each segment's own row, which needs no join.
    """
    out = segments
    if settings.retry and candidates is not None:
        pick = best_try if isinstance(candidates, Column) else best_pick
        out = pick(out, candidates, settings.confidence, settings.max_attempts).drop("attempt")
    if settings.remove_repeats:
        out = run_capped(out, settings.run_cap)
    if settings.merge_short:
        return results_of_arrays(merged_by_file(out, settings.shortest, settings.largest_gap))
    return results(out)


def classic(segments: DataFrame, settings: Settings = CLASSIC) -> DataFrame:
    """Cut at repeats, then the text without loops; the segments stay as they are where a loop shortens the text."""
    if not settings.remove_repeats:
        return results(segments, trim=True)
    return truncate_loops(results(seen_cut(segments), trim=True))


def with_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Add path, length and language of each file; files without a segment have empty results."""
    empty = F.array().cast(found.schema["segments"].dataType)
    joined = files.join(found, "file_id", "left")
    return joined.withColumns({"text": F.coalesce("text", F.lit("")), "segments": F.coalesce("segments", empty), "n_segments": F.coalesce("n_segments", F.lit(0)), "language": F.coalesce("language", F.lit("unknown"))})
