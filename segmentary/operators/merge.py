"""Merging of short segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import let
from ..schema import METRICS

FIRST = Window.unboundedPreceding


#: Of a merged segment, as of others.
FIELDS = ("seq", "start", "end", "text", *METRICS)


def with_cuts(segments: DataFrame, shortest: float, largest_gap: float) -> DataFrame:
    """Add ``__cut``, 1 where merging surely starts anew: over a large gap, or past a segment long in itself (if no earlier one starts later)."""
    order = Window.partitionBy("file_id").orderBy("seq")
    prev_end, prev_start = F.lag("end").over(order), F.lag("start").over(order)
    latest = F.max("start").over(order.rowsBetween(FIRST, -1))
    cut = prev_end.isNull() | (F.col("start") - prev_end > largest_gap) | ((prev_end - prev_start >= shortest) & (prev_start >= latest))
    return segments.withColumn("__cut", F.when(cut, 1).otherwise(0))


def merge_short(segments: DataFrame, shortest: float = 2.0, largest_gap: float = 2.0) -> DataFrame:
    """Let each segment that is still too short take in the next one, if the gap before it isn't too large.

    The result takes the end of the last and the metrics of the first; texts are joined by a blank and
    not trimmed. Whether a segment is taken in depends on what was merged before, so this is a fold.
    It can't go on where ``with_cuts`` cuts, so a window cuts each file there first, and the fold's
    arrays are those short stretches, not whole files. A text that takes in a null one is null.
    ``seq`` is that of the first, numbered anew from 0.
    """
    order = Window.partitionBy("file_id").orderBy("seq")
    marked = with_cuts(segments, shortest, largest_gap).withColumn("__stretch", F.sum("__cut").over(order.rowsBetween(FIRST, 0)))
    stretches = marked.groupBy("file_id", "__stretch").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("s"))
    out = stretches.select("file_id", F.inline(merged_stretch(F.col("s"), F.lit(0), F.size("s") - 1, shortest, largest_gap)))
    return out.withColumn("seq", F.row_number().over(order) - 1)


def merged_by_file(segments: DataFrame, shortest: float = 2.0, largest_gap: float = 2.0) -> DataFrame:
    """``merge_short`` as one row a file with its array ``segments``, for who needs that array anyway: one grouping, no order to be made again. Folds run over the stretches."""
    files = with_cuts(segments, shortest, largest_gap).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS, "__cut"))).alias("s"))
    s, last = F.col("s"), F.size("s") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(s, i)["__cut"] == 1)
    merged = let(starts, lambda b: F.flatten(F.transform(b, lambda at, k: merged_stretch(s, at, F.coalesce(F.get(b, k + 1) - 1, last), shortest, largest_gap))))
    numbered = F.transform(merged, lambda x, k: F.struct(k.alias("seq"), *[x[f].alias(f) for f in FIELDS[1:]]))
    return files.select("file_id", numbered.alias("segments"))


def merged_stretch(s: Column, first: Column, last: Column, shortest: float, largest_gap: float) -> Column:
    """The merged segments of the elements ``first`` to ``last`` of ``s``, counted from 0. Elements are taken by place, as slices would copy the array each time."""

    def one(g: Column) -> Column:
        head, texts = F.get(g, F.lit(0)), F.transform(g, lambda x: x["text"])
        text = F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(texts, " "))
        values = {f: head[f] for f in FIELDS} | {"end": F.element_at(g, -1)["end"], "text": text}
        return F.struct(*[values[f].alias(f) for f in FIELDS])

    def part(at: Column, to: Column) -> Column:
        return let(F.transform(F.sequence(at, to), lambda i: F.get(s, i)), one)

    several = let(group_starts(s, first, last, shortest, largest_gap), lambda b: F.transform(b, lambda at, k: part(at, F.coalesce(F.get(b, k + 1) - 1, last))))
    alone = F.array(F.struct(*[F.get(s, first)[f].alias(f) for f in FIELDS]))
    return F.when(first == last, alone).otherwise(several)


def group_starts(s: Column, first: Column, last: Column, shortest: float, largest_gap: float) -> Column:
    """The places where merged segments begin; the fold carries the open one's times and these places only, no texts."""
    none = F.lit(None).cast("double")
    begin = F.struct(none.alias("start"), none.alias("end"), F.array().cast("array<int>").alias("b"))

    def step(done: Column, i: Column) -> Column:
        x = F.get(s, i)
        takes = F.coalesce((done["end"] - done["start"] < shortest) & (x["start"] - done["end"] <= largest_gap), F.lit(False))
        return F.struct(F.when(takes, done["start"]).otherwise(x["start"]).alias("start"), x["end"].alias("end"), F.when(takes, done["b"]).otherwise(F.concat(done["b"], F.array(i))).alias("b"))

    return F.aggregate(F.sequence(first, last), begin, step, lambda done: done["b"])
