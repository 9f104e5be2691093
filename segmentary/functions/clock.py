"""Times as text; all parts are cut off, never rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_time(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(seconds / 3600), F.floor((seconds % 3600) / 60), F.floor(seconds % 60), ((seconds - whole) * 1000).cast("long"))


def duration(seconds: Column) -> Column:
    """``0:05:30``, ``1 day, 1:01:01``, ``2 days, 0:00:00``."""
    whole = seconds.cast("long")
    days, rest = F.floor(whole / 86400), F.pmod(whole, F.lit(86400))
    time = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor((rest % 3600) / 60), rest % 60)
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, time).otherwise(F.concat(days.cast("string"), unit, time))


def millis(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")
