"""Names and sizes of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA = ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav", "wma")
MEDIA_LATER = (*MEDIA, "webm")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1))


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(path), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def size_mb(length: Column) -> Column:
    return length / F.lit(1048576.0)


def route(mb: Column, split_mb: float, has_audio: Column | None = None) -> Column:
    """``chunked`` above the limit, if the audio could be decoded, else ``direct``."""
    large = mb > split_mb
    return F.when(large if has_audio is None else large & has_audio, "chunked").otherwise("direct")
