"""Two ways to remove repeated segments. Neither is a distinct: order and runs count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, normalised, strip
from ..functions.values import let

FIRST = Window.unboundedPreceding


def run_capped(segments: DataFrame, cap: int = 2, shortest: int = 2) -> DataFrame:
    """Of a run of equal texts keep the first and ``cap`` more.

    Texts are compared in normal form with the last one kept. A shorter one than ``shortest`` goes and
    ends the count, but the text after it is still compared with the one before.
    """
    order = Window.partitionBy("file_id").orderBy("seq")
    out = segments.withColumn("__key", let(normalised(filled(F.col("text"))), lambda key: F.when(F.length(key) >= shortest, key)))
    before = F.last("__key", ignorenulls=True).over(order.rowsBetween(FIRST, -1))
    out = out.withColumn("__rep", F.coalesce(F.col("__key") == before, F.lit(False)).cast("int"))
    out = out.withColumn("__all", F.sum("__rep").over(order.rowsBetween(FIRST, 0)))
    run_start = F.max(F.when(F.col("__rep") == 0, F.col("__all"))).over(order.rowsBetween(FIRST, 0))  # the sum never falls, so the greatest is the last
    out = out.withColumn("__n", F.col("__all") - run_start)
    return out.filter((F.col("__n") <= cap) & F.col("__key").isNotNull()).drop("__key", "__rep", "__all", "__n")


def seen_cut(segments: DataFrame, limit: int = 3, shortest: int = 5) -> DataFrame:
    """Cut a file off at the ``limit``-th segment in a row whose text came before anywhere in the file.

    Texts are compared stripped; those shorter than ``shortest`` go and neither count nor end a row of
    repeats.
    """
    order = Window.partitionBy("file_id").orderBy("seq")
    out = segments.withColumn("__text", strip(filled(F.col("text")))).filter(F.length("__text") >= shortest)
    out = out.withColumn("__seen", (F.row_number().over(Window.partitionBy("file_id", "__text").orderBy("seq")) > 1).cast("int"))
    out = out.withColumn("__run", F.sum(1 - F.col("__seen")).over(order.rowsBetween(FIRST, 0)))
    out = out.withColumn("__n", F.sum("__seen").over(Window.partitionBy("file_id", "__run").orderBy("seq").rowsBetween(FIRST, 0)))
    out = out.withColumn("__cut", F.max((F.col("__n") >= limit).cast("int")).over(order.rowsBetween(FIRST, 0)))
    return out.filter("__cut = 0").drop("__text", "__seen", "__run", "__n", "__cut")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file how many segments were there, and how many went."""
    left = after.groupBy("file_id").agg(F.count(F.lit(1)).alias("kept"))
    return before.groupBy("file_id").agg(F.count(F.lit(1)).alias("segments")).join(left, "file_id", "left").select("file_id", "segments", (F.col("segments") - F.coalesce("kept", F.lit(0))).alias("removed"))
